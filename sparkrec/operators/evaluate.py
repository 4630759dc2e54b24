"""Faithfulness of chunk responses from claim verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunk_faithfulness(claims: DataFrame) -> DataFrame:
    """Share of supported claims per chunk; null where a chunk has no claim.

    A chunk without claims may appear as a row whose claim is null.
    """
    supported = F.count_if(F.col("supported") & F.col("claim").isNotNull())
    total = F.count("claim")
    return claims.groupBy("query_id", "chunk_index").agg(
        total.alias("total_claims"), supported.alias("supported_claims"),
        F.when(total > 0, supported / total).alias("faithfulness_score"))


def aggregate_faithfulness(chunks: DataFrame) -> DataFrame:
    """Mean of a query's non-null chunk scores."""
    return chunks.groupBy("query_id").agg(
        F.avg("faithfulness_score").alias("aggregate_faithfulness"),
        F.count(F.lit(1)).alias("num_chunks"))


def with_evaluation(chunks: DataFrame, scores: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks with an `evaluation` struct: score, totals and the claims, which are
    those of one model response."""
    listed = claims.where(F.col("claim").isNotNull()).groupBy("query_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("claim", "verdict", "supported"))).alias("claims"))
    joined = scores.join(listed, ["query_id", "chunk_index"], "left")
    evaluation = F.struct("faithfulness_score", "total_claims", "supported_claims", "claims")
    return chunks.join(joined.select("query_id", "chunk_index", evaluation.alias("evaluation")),
                       ["query_id", "chunk_index"], "left")
