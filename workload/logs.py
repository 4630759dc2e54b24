"""Event log queries over the given events, read as the log of many runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrec import constants as K, schemas
from sparkrec.operators import events as ev
from sparkrec.sources import sse
from sparkrec.storage import scratch_path
from sparkrec.streaming.serve import append_batches
from workload.base import table


def event_log(rows):
    """Events as log rows: the user is the query, the event id the order."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    type_ = (F.when(kind == "signup", "chunk_start").when(kind == "click", "chunk_token")
             .when(kind == "view", "progress").when(kind == "purchase", "chunk_end")
             .when(k % 2 == 0, "complete").otherwise("error"))
    of = lambda name, value, t: F.when(F.col("type").isin(*name), value).cast(t)
    name = F.col("event_id").cast("string")
    doc = F.array(F.struct(F.concat(F.lit("d"), name).alias("document"),
                           F.create_map(F.lit("k"), F.col("k").cast("string")).alias("meta")))
    none = F.array().cast(schemas.EVENTS["docs"].dataType)
    chunked = ("chunk_start", "chunk_token", "chunk_end")
    typed = rows.withColumns({"k": k, "type": type_})
    return typed.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), "ts", "type",
        of(["progress"], F.concat(F.lit("step"), (F.col("k") % 3).cast("string")), "string").alias("step"),
        of(["progress"], F.when(F.col("k") % 2 == 0, "start").otherwise("done"), "string").alias("status"),
        of(["progress", "error"], F.concat(F.lit("m"), name), "string").alias("message"),
        of(["progress"], F.col("k"), "long").alias("count"),
        of(chunked, F.col("k") % 3 + 1, "int").alias("chunk_index"),
        of(["chunk_start", "chunk_end"], F.col("k") % 5, "int").alias("num_docs_in_chunk"),
        of(["chunk_token"], F.concat(name, F.lit(" ")), "string").alias("token"),
        F.when(F.col("type") == "chunk_end", F.when(F.col("k") % 2 == 1, doc).otherwise(none)).alias("docs"),
        of(["chunk_end"], F.concat(F.lit("E"), name, F.lit(" ")), "string").alias("generated_response"),
        F.lit(None).cast("string").alias("error"),
        of(["complete"], F.col("k"), "long").alias("total_docs_retrieved"),
        of(["complete"], F.col("k") % 7, "int").alias("num_chunks"),
        of(["complete"], F.lit(5), "int").alias("chunk_size"),
        of(["progress", "complete"], F.bround(F.col("value") * 1000), "long").alias("elapsed_ms"))


def _log(spark, sf):
    return event_log(table(spark, sf, "events"))


def shown_chunks(chunks):
    docs = F.array_join(F.transform("docs", lambda d: d["document"]), ",")
    return chunks.select("query_id", "chunk_index", "num_docs_in_chunk", docs.alias("docs"),
                         "generated_response", "streaming")


def fold_events(spark, sf):
    chunks, _, _ = ev.fold_events(_log(spark, sf))
    return shown_chunks(chunks)


def session_status(spark, sf):
    return ev.session_status(_log(spark, sf))


def stage_metrics(spark, sf):
    return ev.stage_metrics(_log(spark, sf), accuracy=1_000_000).withColumn("avg_elapsed_ms", F.round("avg_elapsed_ms", 4))


def token_texts(spark, sf):
    """All tokens of a chunk, joined in order."""
    log = _log(spark, sf).where("type = 'chunk_token'")
    return ev.join_tokens(log, ["query_id", "chunk_index"])


def sse_roundtrip(spark, sf):
    """The log written as frames and read back."""
    path = scratch_path(spark, "frames")
    sse.write_frames(_log(spark, sf), path)
    back = sse.read_frames(spark, path)
    return back.select("query_id", "seq", "type", "step", "status", "message", "count", "chunk_index",
                       "num_docs_in_chunk", "token", F.get("docs", 0)["document"].alias("doc"),
                       "generated_response", "total_docs_retrieved", "num_chunks", "chunk_size", "elapsed_ms")


def sse_broken(spark, sf):
    """A log whose frames are cut short or no data now and then, read as a stream."""
    log = _log(spark, sf)
    text = sse.frame([c for c in log.columns if c not in ("docs",)])
    cut = F.expr("substring(f, 1, length(f) - 4)")
    value = (F.when(F.col("seq") % 10 == 3, F.concat(cut, F.lit(K.FRAME_END)))
             .when(F.col("seq") % 10 == 4, F.concat(F.lit(": "), F.col("f"))).otherwise(F.col("f")))
    path, out = scratch_path(spark, "frames"), scratch_path(spark, "events")
    log.withColumn("f", text).select(F.rtrim(value, F.lit("\n")).alias("value")).write.option("lineSep", K.FRAME_END).text(path)
    query = append_batches(sse.stream_frames(spark, path), out, scratch_path(spark, "state"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    back = spark.read.schema(schemas.EVENTS).option("recursiveFileLookup", "true").parquet(out)
    return back.select("query_id", "seq", "type", "message", "chunk_index", "token", "generated_response", "elapsed_ms")


SQL_LOG = """
l0 AS (SELECT *, (props ->> '$.k')::INT AS k FROM events),
l1 AS (SELECT *, CASE event_type WHEN 'signup' THEN 'chunk_start' WHEN 'click' THEN 'chunk_token' WHEN 'view' THEN 'progress'
       WHEN 'purchase' THEN 'chunk_end' ELSE CASE WHEN k % 2 = 0 THEN 'complete' ELSE 'error' END END AS type FROM l0),
log AS (SELECT user_id AS query_id, event_id AS seq, ts, type,
  CASE WHEN type = 'progress' THEN 'step' || (k % 3) END AS step,
  CASE WHEN type = 'progress' THEN CASE WHEN k % 2 = 0 THEN 'start' ELSE 'done' END END AS status,
  CASE WHEN type IN ('progress', 'error') THEN 'm' || event_id END AS message,
  CASE WHEN type = 'progress' THEN k::BIGINT END AS count,
  CASE WHEN type LIKE 'chunk%' THEN k % 3 + 1 END AS chunk_index,
  CASE WHEN type IN ('chunk_start', 'chunk_end') THEN k % 5 END AS num_docs_in_chunk,
  CASE WHEN type = 'chunk_token' THEN event_id || ' ' END AS token,
  CASE WHEN type = 'chunk_end' AND k % 2 = 1 THEN 'd' || event_id END AS doc,
  CASE WHEN type = 'chunk_end' THEN 'E' || event_id || ' ' END AS generated_response,
  CASE WHEN type = 'complete' THEN k::BIGINT END AS total_docs_retrieved,
  CASE WHEN type = 'complete' THEN k % 7 END AS num_chunks,
  CASE WHEN type = 'complete' THEN 5 END AS chunk_size,
  CASE WHEN type IN ('progress', 'complete') THEN round_even(value * 1000, 0)::BIGINT END AS elapsed_ms FROM l1)"""

_SQL_STATUS = """
st AS (SELECT query_id,
  arg_max(CASE type WHEN 'progress' THEN message WHEN 'chunk_start' THEN 'Generating response for chunk ' || chunk_index || '...'
          WHEN 'chunk_end' THEN 'Chunk ' || chunk_index || ' complete.' ELSE '' END, seq)
      FILTER (WHERE type IN ('progress', 'chunk_start', 'chunk_end', 'complete')) AS progress_message,
  coalesce(arg_max(CASE type WHEN 'complete' THEN 'success' ELSE 'error' END, seq) FILTER (WHERE type IN ('complete', 'error')), 'loading') AS status,
  arg_max(total_docs_retrieved, seq) FILTER (WHERE type = 'complete') AS total_docs_retrieved,
  arg_max(num_chunks, seq) FILTER (WHERE type = 'complete') AS num_chunks,
  arg_max(message, seq) FILTER (WHERE type = 'error') AS error
  FROM log GROUP BY query_id)"""

SQL_FOLD = f"""WITH {SQL_LOG}, {_SQL_STATUS},
b AS (SELECT query_id, chunk_index, min(seq) AS s FROM log WHERE type = 'chunk_start' GROUP BY ALL),
e AS (SELECT b.query_id, b.chunk_index, max(seq) AS e FROM b JOIN log l ON l.query_id = b.query_id AND l.chunk_index = b.chunk_index
      AND l.type = 'chunk_end' AND l.seq > b.s GROUP BY ALL),
tk AS (SELECT b.query_id, b.chunk_index, string_agg(token, '' ORDER BY seq) AS later FROM b LEFT JOIN e USING (query_id, chunk_index)
       JOIN log l ON l.query_id = b.query_id AND l.chunk_index = b.chunk_index AND l.type = 'chunk_token' AND l.seq > coalesce(e.e, b.s) GROUP BY ALL)
SELECT b.query_id, b.chunk_index, coalesce(le.num_docs_in_chunk, ls.num_docs_in_chunk) AS num_docs_in_chunk,
       coalesce(le.doc, '') AS docs, coalesce(le.generated_response, '') || coalesce(later, '') AS generated_response,
       st.status = 'loading' AND le.doc IS NULL AS streaming
FROM b LEFT JOIN e USING (query_id, chunk_index) LEFT JOIN tk USING (query_id, chunk_index) JOIN log ls ON ls.seq = b.s
LEFT JOIN log le ON le.seq = e.e JOIN st ON st.query_id = b.query_id"""

QUERIES = {
    "fold_events": fold_events,
    "session_status": session_status,
    "stage_metrics": stage_metrics,
    "token_texts": token_texts,
    "sse_roundtrip": sse_roundtrip,
    "sse_broken": sse_broken,
}

ORACLE = {
    "fold_events": SQL_FOLD,
    "session_status": f"WITH {SQL_LOG}, {_SQL_STATUS} SELECT * FROM st",
    "stage_metrics": f"""WITH {SQL_LOG}
        SELECT coalesce(step, 'total') AS step, count(*) AS n_events, count(*) FILTER (WHERE status = 'start') AS n_started,
        count(*) FILTER (WHERE status = 'done' OR type = 'complete') AS n_done, round(avg(elapsed_ms), 4) AS avg_elapsed_ms,
        max(elapsed_ms) AS max_elapsed_ms, quantile_disc(elapsed_ms, 0.5) AS median_elapsed_ms
        FROM log WHERE type IN ('progress', 'complete') GROUP BY 1""",
    "token_texts": f"""WITH {SQL_LOG} SELECT query_id, chunk_index, string_agg(token, '' ORDER BY seq) AS text
        FROM log WHERE type = 'chunk_token' GROUP BY query_id, chunk_index""",
    "sse_broken": f"""WITH {SQL_LOG} SELECT query_id, seq, type, message, chunk_index, token, generated_response, elapsed_ms
        FROM log WHERE seq % 10 NOT IN (3, 4)""",
    "sse_roundtrip": f"WITH {SQL_LOG} SELECT * EXCLUDE (ts) FROM log",
}
