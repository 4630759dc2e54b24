"""Streaming forms over the same tables; they must give what the batch forms give."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from sparkrec import schemas
from sparkrec.config import Params
from sparkrec.operators.events import mark_streaming
from sparkrec.storage import scratch_path
from sparkrec.streaming.fold import fold_chunks_stream, latest_chunks, session_status_stream
from sparkrec.streaming.reuse import ttl_reuse_stream
from sparkrec.streaming.serve import STATE_STORE, append_batches, recommend_stream
from workload import answers, logs, reuse
from workload.base import collection, stand_in_answer, table, variants


PARTS = 3


def _time():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _third(rows, order):
    """The third of the range of `order` a row is in."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return F.least(F.floor((order - low) * PARTS / F.lit(max(1, high - low))), F.lit(PARTS - 1))


def _stream(spark, sf, name, part):
    """A stream over a folder, and what puts the rows of each part there, with the table's
    own partitions."""
    rows = table(spark, sf, name)
    path = scratch_path(spark, name)
    rows.limit(0).write.parquet(f"{path}/part-none")
    stream = (spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").parquet(path))
    number = part(rows)
    return stream, [lambda i=i: rows.where(number == i).write.option("compression", "zstd").parquet(f"{path}/part-{i}") for i in range(PARTS)]


def _by_time(spark, sf):
    return _stream(spark, sf, "events", lambda rows: _third(rows, _time()))


def _play(parts, start):
    """Each part arrives and is taken in by the stream, which goes on where it was."""
    for put in parts:
        put()
        query = start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def _stored(spark, stream, parts, name, mode, late_path=None):
    """Run a stream over the parts and return what it stored."""
    spark.conf.set(*STATE_STORE)
    path, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    _play(parts, lambda: append_batches(stream, path, state, mode=mode, late_path=late_path))
    fields = [f for f in stream.schema.fields if late_path is None or f.name != "late"]
    return spark.read.schema(T.StructType([*fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def stream_fold(spark, sf):
    """Chunks and status both out of streams. The log's sessions pause for days, so nothing
    counts as idle."""
    stream, parts = _by_time(spark, sf)
    folded = fold_chunks_stream(logs.event_log(stream), idle_seconds=10 ** 8)
    chunks = latest_chunks(_stored(spark, folded, parts, "fold", "update").drop("batch_id"))
    return logs.shown_chunks(mark_streaming(chunks, stream_status(spark, sf)))


def stream_status(spark, sf):
    """Sessions go on after they were complete, so their state is kept."""
    stream, parts = _by_time(spark, sf)
    status = session_status_stream(logs.event_log(stream), keep_seconds=10 ** 8, idle_seconds=10 ** 8)
    rows = _stored(spark, status, parts, "status", "update")
    last = rows.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("query_id", "batch_id")]),
                                                 "batch_id").alias("s"))
    return last.select("query_id", "s.*")


def _requests(stream):
    return stream.select(F.col("user_id").alias("cache_key"), "ts", F.col("event_id").alias("request_id"))


def stream_ttl_reuse(spark, sf):
    stream, parts = _by_time(spark, sf)
    done = _stored(spark, ttl_reuse_stream(_requests(stream), reuse.SIX_HOURS), parts, "reuse", "append")
    return done.select("request_id", "computed", "entry_us")


def stream_ttl_late(spark, sf):
    """A twentieth of the first part's requests arrives with the last part, behind the
    watermark: these go to a table of their own, all others are served as if they were not."""
    def arrival(rows):
        third = _third(rows, _time())
        return F.when((third == 0) & (F.col("event_id") % 20 == 3), PARTS - 1).otherwise(third)

    stream, parts = _stream(spark, sf, "events", arrival)
    late_path = scratch_path(spark, "late")
    done = _stored(spark, ttl_reuse_stream(_requests(stream), reuse.SIX_HOURS), parts, "reuse", "append", late_path)
    late = spark.read.schema(done.schema).parquet(late_path)
    return (done.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
            .select("request_id", "computed", "entry_us", "late"))


_SQL_THIRD = f"least(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {PARTS}::DOUBLE / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)), {PARTS - 1})"
_SQL_LATE = "WITH RECURSIVE " + f"tl AS (SELECT *, {_SQL_THIRD} = 0 AND event_id % 20 = 3 AS late FROM events), " + reuse.ORACLE["ttl_reuse"].split(
    "WITH RECURSIVE", 1)[1].replace("FROM events)", "FROM tl WHERE NOT late)") + """
UNION ALL SELECT event_id, NULL, NULL FROM tl WHERE late"""


def _asked(spark, sf):
    stream, parts = _stream(spark, sf, "documents", lambda rows: _third(rows, F.col("doc_id")))
    return stream.select(F.col("doc_id").alias("query_id"), "text"), parts


def stream_recommend(spark, sf):
    """Questions arrive as a stream; the collection is static."""
    asked, parts = _asked(spark, sf)
    results, events, state = (scratch_path(spark, n) for n in ("results", "events", "serve-state"))
    vectors = variants(spark, sf)
    _play(parts, lambda: recommend_stream(
        asked, collection(spark, sf), stand_in_answer, results, events, state,
        Params(top_k=5), prepare=lambda batch: {"variants": vectors.join(batch.select("query_id"), "query_id", "left_semi")}))
    return answers.shown_results(spark.read.parquet(results))


def stream_stage_events(spark, sf):
    """The events written while a stream runs. The second batch fails once its retrieval is
    done: its events up to there stay, an error follows, and the third is never asked."""
    asked, parts = _asked(spark, sf)
    results, events, state = (scratch_path(spark, n) for n in ("results", "events", "serve-state"))
    vectors = variants(spark, sf)
    told = []

    def on_stage(stage, run, batch_id):
        told.append(stage)
        if told.count("retrieval") == 2:
            raise RuntimeError("no answers today")

    try:
        _play(parts, lambda: recommend_stream(
            asked, collection(spark, sf), stand_in_answer, results, events, state, Params(top_k=5), on_stage=on_stage,
            prepare=lambda batch: {"variants": vectors.join(batch.select("query_id"), "query_id", "left_semi")}))
    except StreamingQueryException:
        pass
    log = spark.read.schema(schemas.EVENTS).option("recursiveFileLookup", "true").parquet(events)
    return answers.shown_events(log)


_SQL_STAGE_EVENTS = answers.ORACLE["run_events"].split("SELECT query_id, row_number() OVER")[0] + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, b, p) AS seq,
  least(floor((query_id - (SELECT min(doc_id) FROM documents)) * {PARTS}::DOUBLE / (SELECT max(doc_id) - min(doc_id) FROM documents)), {PARTS - 1}) AS part FROM ev),
told AS (SELECT * FROM numbered WHERE part = 0 OR part = 1 AND (a <= 5 OR a = 6 AND p = 1))
SELECT query_id, seq, type, step, status, message, count, num_chunks, chunk_index, num_docs_in_chunk, n_docs, total_docs_retrieved, chunk_size FROM told
UNION ALL SELECT query_id, max(seq) + 1, 'error', NULL, NULL, 'no answers today', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM told WHERE part = 1 GROUP BY query_id"""

QUERIES = {
    "stream_fold_events": stream_fold,
    "stream_session_status": stream_status,
    "stream_ttl_reuse": stream_ttl_reuse,
    "stream_ttl_late": stream_ttl_late,
    "stream_recommend": stream_recommend,
    "stream_stage_events": stream_stage_events,
}

ORACLE = {
    "stream_fold_events": logs.ORACLE["fold_events"],
    "stream_session_status": logs.ORACLE["session_status"],
    "stream_ttl_reuse": reuse.ORACLE["ttl_reuse"],
    "stream_ttl_late": f"SELECT request_id, computed, entry_us, computed IS NULL AS late FROM ({_SQL_LATE})",
    "stream_recommend": answers.ORACLE["recommend"],
    "stream_stage_events": _SQL_STAGE_EVENTS,
}
