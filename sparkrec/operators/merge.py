"""Merging the hits of a query's variants: first seen, or reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def dedup_first_seen(hits: DataFrame, identity: str = "text_hash") -> DataFrame:
    """Keep the first hit of each text per query, in (variant, rank) order.

    A group holds one query's hits of one text: at most variants times k rows,
    however popular the text is over all queries.
    """
    w = W.partitionBy("query_id", identity).orderBy("variant_no", "rank")
    return hits.withColumn("_seen", F.row_number().over(w)).where("_seen = 1").drop("_seen")


def merge_first_seen(hits: DataFrame, identity: str = "text_hash") -> DataFrame:
    """First-seen merge with the position of each document (from 1)."""
    w = W.partitionBy("query_id").orderBy("variant_no", "rank")
    return dedup_first_seen(hits, identity).withColumn("pos", F.row_number().over(w))


def merge_rrf(hits: DataFrame, identity: str = "text_hash", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion. A text counts once per variant, by its best rank;
    scores equal to 12 digits tie and go by the smallest doc_id."""
    per_variant = hits.groupBy("query_id", identity, "variant_no").agg(
        F.min("rank").alias("rank"), F.min_by("doc_id", "rank").alias("doc_id"))
    fused = per_variant.groupBy("query_id", identity).agg(
        F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("rrf_score"),
        F.min("doc_id").alias("doc_id"))
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "doc_id")
    return fused.withColumn("pos", F.row_number().over(w))


def merge_hits(hits: DataFrame, mode: str = "first_seen", identity: str = "text_hash",
               constant: int = 60) -> DataFrame:
    if mode == "first_seen":
        return merge_first_seen(hits, identity)
    if mode == "rrf":
        return merge_rrf(hits, identity, constant)
    raise ValueError(f"unknown merge mode {mode!r}")


def not_seen_before(docs: DataFrame, history: DataFrame, identity: str = "text_hash") -> DataFrame:
    """Documents whose text an earlier run has not returned for the query."""
    return docs.join(history.select("query_id", identity), ["query_id", identity], "left_anti")
