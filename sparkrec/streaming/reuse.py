"""Age-limited reuse of responses in a stream of requests."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


ROWS_OUT = 10_000


class TtlReuse(StatefulProcessor):
    """One stored time per key: that of the entry. A hit does not renew it."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get()[0] if self.entry.exists() else None
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        runs, late = [], []
        for frame in rows:  # numbers alone are held, a sorted run for each batch of rows
            run = np.column_stack([frame["us"].to_numpy(np.int64), frame["request_id"].to_numpy(np.int64), frame["ok"].to_numpy(np.int64)])
            behind = run[:, 0] < passed
            late.append(run[behind, 1])
            run = run[~behind]
            runs.append(run[np.lexsort((run[:, 1], run[:, 0]))])
        late = np.concatenate(late)
        for at in range(0, len(late), ROWS_OUT):
            part = late[at:at + ROWS_OUT]
            yield pd.DataFrame({"cache_key": key[0], "request_id": part, "computed": pd.array([None] * len(part), dtype="boolean"),
                                "entry_us": pd.array([None] * len(part), dtype="Int64"), "late": True})
        ids, entries, computed = [], [], []
        for us, request_id, ok in heapq.merge(*(run.tolist() for run in runs)):
            # A request out of order is not served by an entry that did not exist yet.
            fresh = held is None or not 0 <= us - held <= self.ttl_us
            entries.append(us if fresh else held)
            if fresh and ok and (held is None or us > held):
                held = us
            computed.append(fresh)
            ids.append(request_id)
            if len(ids) == ROWS_OUT:
                yield self.served(key, ids, computed, entries)
                ids, entries, computed = [], [], []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is not None:
            self.entry.update((held,))
            # One millisecond more: an age of exactly ttl is still served.
            self.handle.registerTimer((held + self.ttl_us) // 1000 + 1)
        if ids:
            yield self.served(key, ids, computed, entries)

    @staticmethod
    def served(key, ids: list, computed: list, entries: list) -> pd.DataFrame:
        return pd.DataFrame({"cache_key": key[0], "request_id": ids, "computed": pd.array(computed, dtype="boolean"),
                             "entry_us": pd.array(entries, dtype="Int64"), "late": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_reuse_stream(requests: DataFrame, ttl_seconds: float, delay: str = "1 minute") -> DataFrame:
    """Requests (cache_key, ts, request_id) with `computed`, `entry_us` and `late`.

    Requests of a key are taken in time order within a micro-batch. One that comes in a
    later micro-batch than a newer one is computed unless the entry is older than it. One
    that is over `delay` behind the newest of all, so that entries of its time may be gone,
    is not judged: it comes out as `late`, with nulls (see `append_batches`, which keeps
    these rows in a table of their own). Where `ok` (boolean) is given, a failed call is
    computed but stores nothing. State ends when the watermark has passed the entry's
    life. Needs the RocksDB state store.
    """
    key_type = requests.schema["cache_key"].dataType
    out = T.StructType([
        T.StructField("cache_key", key_type), T.StructField("request_id", T.LongType()),
        T.StructField("computed", T.BooleanType()), T.StructField("entry_us", T.LongType()), T.StructField("late", T.BooleanType())])
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    ok = F.coalesce("ok", F.lit(False)) if "ok" in requests.columns else F.lit(True)
    # Without the time column itself the operator drops no late rows; it tells them apart.
    rows = rows.select("cache_key", "request_id", F.unix_micros("ts").alias("us"), ok.alias("ok"))
    return rows.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=TtlReuse(int(ttl_seconds * 1_000_000)), outputStructType=out,
        outputMode="Append", timeMode="EventTime")


def drop_repeats(requests: DataFrame, ttl: str) -> DataFrame:
    """Cheap mode: repeats within the watermark are dropped. Expiry goes by the
    watermark, not by each entry's age."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl)
    return rows.dropDuplicatesWithinWatermark(["cache_key"])
