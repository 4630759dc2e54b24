"""Chunk state and session status of a running event log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from sparkrec import schemas
from sparkrec.operators.events import join_tokens, progress_message

_DOCS_JSON = "docs_json"
_TOKENS = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("token", T.StringType())]))
OUT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("from_seq", T.LongType()),
    T.StructField("num_docs_in_chunk", T.IntegerType()),
    T.StructField(_DOCS_JSON, T.StringType()),
    T.StructField("end_text", T.StringType()),
    T.StructField("tokens", _TOKENS),
])
_BOUNDS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("start_seq", T.LongType()),
    T.StructField("start_n", T.IntegerType()),
    T.StructField("end_seq", T.LongType()),
    T.StructField("end_n", T.IntegerType()),
    T.StructField("end_docs", T.StringType()),
    T.StructField("end_text", T.StringType()),
    T.StructField("due", T.LongType()),
])
_STATUS = T.StructType([
    T.StructField("message_seq", T.LongType()),
    T.StructField("progress_message", T.StringType()),
    T.StructField("final_seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("complete_seq", T.LongType()),
    T.StructField("total_docs_retrieved", T.LongType()),
    T.StructField("num_chunks", T.IntegerType()),
    T.StructField("error_seq", T.LongType()),
    T.StructField("error", T.StringType()),
])
STATUS_OUT = T.StructType([
    T.StructField("query_id", T.LongType()),
    *[_STATUS[c] for c in ("progress_message", "status", "total_docs_retrieved", "num_chunks", "error")],
])


def _int(v):
    return None if v is None or pd.isna(v) else int(v)


def _packed(*columns: str | Column) -> Column:
    """What an event tells as one JSON text: each column of a group is handed over by itself,
    which takes longer than its few rows do."""
    return F.to_json(F.struct("seq", F.unix_millis("ts").alias("ms"), "type", *columns)).alias("event")


def _events(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for frame in frames:
        yield from map(json.loads, frame["event"].tolist())


def _row(**values) -> pd.DataFrame:
    return pd.DataFrame({name: [value] for name, value in values.items()}, dtype=object)


class ChunkFold:
    """State of one chunk: its first start and its last end.

    Events may come in any order and more than once: what counts is seq. Tokens pass
    through to the segment of their micro-batch and are not kept, but for those an end has
    replaced: these go. So the work of a micro-batch follows its own events, however long
    the text is. A chunk whose last event lies `idle_ms` behind the watermark is forgotten.
    State travels with the rows of its chunk, many chunks to a batch.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0, 0, None, None, None, None, None, None, 0)
        version, last, start, start_n, end, end_n, end_docs, end_text, due = held
        newest = state.getCurrentWatermarkMs()
        new = []
        for event in _events(frames):
            seq, kind, n = int(event.get("seq")), event["type"], event.get("num_docs_in_chunk")
            newest, last = max(newest, int(event.get("ms"))), max(last, seq)
            if kind == "chunk_start" and (start is None or seq < start):
                start, start_n = seq, n
            elif kind == "chunk_end" and (end is None or seq > end):
                end, end_n, end_docs, end_text = seq, n, event.get(_DOCS_JSON), event.get("generated_response")
            elif kind == "chunk_token":
                new.append((seq, event.get("token")))
        version, due = version + 1, max(due, newest + self.idle_ms)
        state.update((version, last, start, start_n, end, end_n, end_docs, end_text, due))
        state.setTimeoutTimestamp(due)
        # A start may still come, or a smaller one; ends only grow.
        ended = start is not None and end is not None and end > start
        if ended:
            new = [(seq, text) for seq, text in new if seq > end]
        yield _row(query_id=_int(key[0]), chunk_index=_int(key[1]), last_seq=last, version=version,
                   from_seq=end if ended else start, num_docs_in_chunk=end_n if ended else start_n,
                   docs_json=end_docs if ended else None, end_text=end_text if ended else None,
                   tokens=[{"seq": seq, "token": token} for seq, token in sorted(new)])


def fold_chunks_stream(events: DataFrame, delay: str = "10 minutes", idle_seconds: int = 3600
                       ) -> DataFrame:
    """Running fold of a stream of events: a row per changed chunk and micro-batch, with its
    bounds so far and the tokens that are new; (last_seq, version) rises. from_seq is null
    before there is a start; tokens up to it do not count, and are replaced by end_text. `latest_chunks` puts the rows together. Events may
    come up to `delay` late. Needs the RocksDB state store. Event time drives the timers:
    with processing time, a run over what is available would never come to an end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.where(F.col("type").isin("chunk_start", "chunk_token", "chunk_end")).select(
        "query_id", "chunk_index", "ts",
        _packed("num_docs_in_chunk", "token", F.to_json("docs").alias(_DOCS_JSON), "generated_response"))
    out = rows.groupBy("query_id", "chunk_index").applyInPandasWithState(
        ChunkFold(idle_seconds * 1000).__call__, OUT, _BOUNDS, "update", "EventTimeTimeout")
    none = F.array().cast(schemas.EVENTS["docs"].dataType)
    docs = F.from_json(_DOCS_JSON, schemas.EVENTS["docs"].dataType)
    return out.withColumn("docs", F.coalesce(docs, none)).drop(_DOCS_JSON)


def latest_chunks(updates: DataFrame) -> DataFrame:
    """Current state out of stored updates. The bounds are those of the newest event, and of
    these the highest version (versions start anew when an idle chunk was forgotten); the
    text is the end's, and the tokens of all segments behind it, each once."""
    key = ["query_id", "chunk_index"]
    rest = ["from_seq", "num_docs_in_chunk", "docs", "end_text"]
    bounds = updates.where("from_seq IS NOT NULL").groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("last_seq", "version")).alias("_s")).select(*key, "_s.*")
    tokens = updates.select(*key, F.inline("tokens")).join(bounds.select(*key, "from_seq"), key).where("seq > from_seq")
    once = tokens.groupBy(*key, "seq").agg(F.any_value("token").alias("token"))
    text = join_tokens(once, key, "_later")
    return bounds.join(text, key, "left").select(
        *key, "num_docs_in_chunk", "docs",
        F.concat(F.coalesce("end_text", F.lit("")), F.coalesce("_later", F.lit(""))).alias("generated_response"))


class SessionStatus:
    """State of one query: its newest message, its newest end, and what ends told.

    `keep_ms` after a query was complete or failed, or `idle_ms` after its last event, the
    state ends.
    """

    def __init__(self, keep_ms: int, idle_ms: int):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def __call__(self, key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None, None, None, "loading", None, None, None, None, None)
        said, message, final, status, complete, total, chunks, failed, error = held
        newest = state.getCurrentWatermarkMs()
        for event in _events(frames):
            seq, kind, shown = int(event.get("seq")), event.get("type"), event.get("shown")
            newest = max(newest, int(event.get("ms")))
            if shown is not None and (said is None or seq > said):
                said, message = seq, shown
            if kind in ("complete", "error") and (final is None or seq > final):
                final, status = seq, "success" if kind == "complete" else "error"
            if kind == "complete" and (complete is None or seq > complete):
                complete, total, chunks = seq, event.get("total_docs_retrieved"), event.get("num_chunks")
            if kind == "error" and (failed is None or seq > failed):
                failed, error = seq, event.get("message")
        state.update((said, message, final, status, complete, total, chunks, failed, error))
        state.setTimeoutTimestamp(newest + (self.idle_ms if final is None else self.keep_ms))
        yield _row(query_id=_int(key[0]), progress_message=message, status=status,
                   total_docs_retrieved=total, num_chunks=chunks, error=error)


def session_status_stream(events: DataFrame, delay: str = "10 minutes", keep_seconds: int = 600, idle_seconds: int = 86_400
                          ) -> DataFrame:
    """Running status per query: a row per changed query and micro-batch, the last of which
    is what `session_status` gives for its events. Events may come up to `delay` late. The
    state of a query ends `keep_seconds` after it was complete or failed, and
    `idle_seconds` after its last event if it never was. Needs the RocksDB state store."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    shown: Column = progress_message()
    rows = timed.select("query_id", "ts", _packed(shown.alias("shown"), "message", "total_docs_retrieved", "num_chunks"))
    return rows.groupBy("query_id").applyInPandasWithState(
        SessionStatus(keep_seconds * 1000, idle_seconds * 1000).__call__, STATUS_OUT, _STATUS, "update", "EventTimeTimeout")
