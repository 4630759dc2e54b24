"""Times as microseconds since 1970, for timestamps with and without a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(df: DataFrame, name: str) -> Column:
    """A zoneless time is counted as it reads, whatever the session's zone."""
    if df.schema[name].dataType == T.TimestampNTZType():
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(name))
    return F.unix_micros(name)


def from_micros(us: Column, like: T.DataType) -> Column:
    if like == T.TimestampNTZType():
        return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))
    return F.timestamp_micros(us)
