"""Confidence of a query's retrieval: similarity, consistency, keyword overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkrec.config import DEFAULTS, Params
from sparkrec.functions.scores import clamp01, consistency
from sparkrec.functions.text import terms


def _found(terms_: str, corpus: str):
    return F.filter(terms_, lambda t: F.contains(F.col(corpus), t))


def _overlap(n_found, words):
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(
        F.coalesce(n_found, F.lit(0)) / F.size(words))


def distance_scores(hits: DataFrame) -> DataFrame:
    """Similarity of the first hit and consistency of all; takes cosine distances."""
    return _scores(hits.groupBy("query_id").agg(*_distance_stats())).select(
        "query_id", "similarity", "consistency")


def _distance_stats():
    similarity = 1 - F.col("distance")
    return (F.count("distance").alias("n"), F.avg(similarity).alias("mean_similarity"),
            F.min_by(similarity, F.col("rank")).alias("top_similarity"))


def _scores(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "similarity": clamp01(F.col("top_similarity")),
        "consistency": consistency(F.col("n"), F.col("mean_similarity"), F.col("top_similarity"))})


def keyword_overlap(queries: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Share of a query's words that occur inside any of its documents.

    A word holds no blank, so it cannot span two documents: each document is
    searched by itself and the words found are united.
    """
    words = queries.select("query_id", terms(F.col(text)).alias("words"))
    searched = documents.select("query_id", F.lower("document").alias("corpus")).join(words, "query_id")
    per_query = searched.select("query_id", _found("words", "corpus").alias("found")).groupBy("query_id").agg(
        _n_found().alias("n_found"))
    return words.join(per_query, "query_id", "left").select(
        "query_id", _overlap(F.col("n_found"), F.col("words")).alias("overlap"))


def _n_found():
    # A query has k documents, and its words are few.
    return F.size(F.array_distinct(F.flatten(F.collect_list("found"))))


def confidence(queries: DataFrame, hits: DataFrame, params: Params = DEFAULTS, text: str = "text"
               ) -> DataFrame:
    """Parts, score and verdict per query. `hits` holds query_id, rank, distance
    and document; a query without hits scores 0. The hits are read once."""
    words = queries.select("query_id", terms(F.col(text)).alias("words"))
    searched = (
        words.join(hits.select("query_id", "rank", "distance", F.lower("document").alias("corpus")),
                   "query_id", "left")
        .select("query_id", "words", "rank", "distance", _found("words", "corpus").alias("found")))
    stats = searched.groupBy("query_id").agg(
        F.any_value("words").alias("words"), _n_found().alias("n_found"), *_distance_stats())
    parts = _scores(stats).withColumn("overlap", _overlap(F.col("n_found"), F.col("words")))
    total = (params.alpha * F.col("similarity") + params.beta * F.col("consistency")
             + params.gamma * F.col("overlap"))
    none = F.col("n") == 0
    blank = lambda name: F.when(~none, F.col(name)).alias(name)
    return parts.select(
        "query_id", blank("similarity"), blank("consistency"), "overlap",
        F.when(none, F.lit(0.0)).otherwise(F.round(total, 4)).alias("confidence"),
    ).withColumn("use_collection", F.col("confidence") >= params.confidence_threshold)
