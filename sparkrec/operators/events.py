"""The pipeline's event log: union, fold to chunks, session status, metrics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkrec import constants as K, schemas

SEGMENT = 4096  # tokens joined at a time; longer texts are joined from segments


def union_events(*parts: DataFrame) -> DataFrame:
    """Events of several stages in one table; fields a part lacks are null."""
    merged = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [f for f in schemas.EVENTS if f.name not in merged.columns]
    merged = merged.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    return merged.select(*[F.col(f.name).cast(f.dataType) for f in schemas.EVENTS])


def number_events(events: DataFrame, order: list[str]) -> DataFrame:
    """seq per query. Meant for the events one run makes for a query, which its
    parameters and response length bound."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))


def join_tokens(tokens: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    """Tokens of each group joined in seq order, by segments of the order first, so
    one long text is put together by many tasks."""
    part = tokens.withColumn("_part", F.floor(F.col("seq") / SEGMENT)).groupBy(*keys, "_part").agg(
        F.expr("listagg(token, '') within group (order by seq)").alias("_text"))
    return part.groupBy(*keys).agg(
        F.expr("listagg(_text, '') within group (order by _part)").alias(out))


def fold_chunks(events: DataFrame) -> DataFrame:
    """State of each chunk after all its events, in seq order.

    A chunk exists from its first chunk_start; what came before is ignored. The last
    chunk_end sets documents, count and text; tokens after it are appended.
    """
    key = ["query_id", "chunk_index"]
    of = lambda t: F.col("type") == t
    bounds = events.where(F.col("chunk_index").isNotNull()).groupBy(*key).agg(
        F.min(F.when(of("chunk_start"), F.col("seq"))).alias("start_seq"),
        F.max(F.when(of("chunk_end"), F.col("seq"))).alias("end_seq"),
        F.min_by("num_docs_in_chunk", F.when(of("chunk_start"), F.col("seq"))).alias("start_n"),
        F.max_by(F.struct("num_docs_in_chunk", "docs", "generated_response"),
                 F.when(of("chunk_end"), F.col("seq"))).alias("end"),
    ).where(F.col("start_seq").isNotNull())
    ended = F.coalesce(F.col("end_seq") > F.col("start_seq"), F.lit(False))
    bounds = bounds.withColumn("end", F.when(ended, F.col("end"))).withColumn(
        "from_seq", F.when(ended, F.col("end_seq")).otherwise(F.col("start_seq")))
    later = (events.where(of("chunk_token")).select(*key, "seq", "token")
             .join(bounds.select(*key, "from_seq"), key).where(F.col("seq") > F.col("from_seq")))
    text = join_tokens(later, key, "_later")
    none = F.array().cast(schemas.EVENTS["docs"].dataType)
    return bounds.join(text, key, "left").select(
        *key,
        F.coalesce("end.num_docs_in_chunk", "start_n").alias("num_docs_in_chunk"),
        F.coalesce("end.docs", none).alias("docs"),
        F.concat(F.coalesce("end.generated_response", F.lit("")), F.coalesce("_later", F.lit("")))
        .alias("generated_response"))


def progress_message() -> Column:
    """What an event shows as progress; null if it leaves what is shown."""
    kind = F.col("type")
    return (
        F.when(kind == "progress", F.coalesce("message", F.lit("")))
        .when(kind == "chunk_start", F.format_string(K.MSG_CHUNK_START, "chunk_index"))
        .when(kind == "chunk_end", F.format_string(K.MSG_CHUNK_END, "chunk_index"))
        .when(kind == "complete", F.lit("")))


def session_status(events: DataFrame) -> DataFrame:
    """Progress message, status, totals and error of each query after all events."""
    kind, seq = F.col("type"), F.col("seq")
    message = progress_message()
    at = lambda *kinds: F.when(kind.isin(*kinds), seq)
    return events.groupBy("query_id").agg(
        F.max_by(message, F.when(message.isNotNull(), seq)).alias("progress_message"),
        F.coalesce(F.max_by(F.when(kind == "complete", F.lit("success")).otherwise(F.lit("error")),
                            at("complete", "error")), F.lit("loading")).alias("status"),
        F.max_by("total_docs_retrieved", at("complete")).alias("total_docs_retrieved"),
        F.max_by("num_chunks", at("complete")).alias("num_chunks"),
        F.max_by("message", at("error")).alias("error"),
    )


def mark_streaming(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """A chunk without documents is still streaming while its query is unfinished."""
    return chunks.join(status.select("query_id", "status"), "query_id").withColumn(
        "streaming", (F.col("status") == "loading") & (F.size("docs") == 0))


def stage_metrics(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Events and elapsed time per pipeline stage and for whole runs."""
    step = F.when(F.col("type") == "complete", F.lit("total")).otherwise(F.col("step"))
    return events.withColumn("_step", step).where(F.col("_step").isNotNull()).groupBy(
        F.col("_step").alias("step")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("status") == "start").alias("n_started"),
        F.count_if((F.col("status") == "done") | (F.col("type") == "complete")).alias("n_done"),
        F.avg("elapsed_ms").alias("avg_elapsed_ms"),
        F.max("elapsed_ms").alias("max_elapsed_ms"),
        F.percentile_approx("elapsed_ms", 0.5, accuracy).alias("median_elapsed_ms"),
    )


def fold_events(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk states, session status and stage metrics of an event log."""
    status = session_status(events)
    return mark_streaming(fold_chunks(events), status), status, stage_metrics(events)
