"""Counts over collections and checks of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def collection_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("n_docs"))


def filtered_count(docs: DataFrame, condition: Column) -> DataFrame:
    """Matches of a filter and the size of the table, without reading texts."""
    return docs.agg(F.count_if(condition).alias("n_match"), F.count(F.lit(1)).alias("n_docs"))


def candidate_budget(top_k: int, multiplier: int, available: Column) -> Column:
    return F.least(F.lit(top_k * multiplier).cast("long"), available)


def embedding_check(docs: DataFrame, dim: int, by: str = "collection") -> DataFrame:
    """Expected and received vectors, and those of a wrong length."""
    return docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count("embedding").alias("n_received"),
        F.count_if(F.size("embedding") != dim).alias("n_wrong_size"))
