"""Event frames: one `data: <json>` line and a blank line per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkrec import constants as K, schemas
from sparkrec.functions.text import strip_client

_END = "~end~"
_PAYLOAD = schemas.EVENT_PAYLOAD.fieldNames()


def event_json(columns: list[str]) -> Column:
    """JSON of an event row; fields a type leaves null are left out."""
    return F.to_json(F.struct(*columns))


def frame(columns: list[str]) -> Column:
    return F.concat(F.lit(K.FRAME_PREFIX), event_json(columns), F.lit(K.FRAME_END))


def write_frames(events: DataFrame, path: str, keys: bool = True) -> None:
    """Frames in (query_id, seq) order. Ranges of both keys spread one long query
    over several files, whose names follow the order."""
    columns = [c for c in (["query_id", "seq", "ts"] if keys else []) + _PAYLOAD if c in events.columns]
    placed = events.repartitionByRange("query_id", "seq").sortWithinPartitions("query_id", "seq")
    text = F.concat(F.lit(K.FRAME_PREFIX), event_json(columns)).alias("value")
    placed.select(text).write.option("lineSep", K.FRAME_END).text(path)


def parse_frames(frames: DataFrame, schema=schemas.EVENTS) -> DataFrame:
    """Events of a table of frames (`value`); what is no frame or no JSON is dropped.

    The parser ignores what follows a complete value. Reading the text as the
    first of two list elements shows that nothing did, in one parse.
    """
    line = strip_client(F.col("value"))
    kept = frames.select(line.alias("_line")).where(F.startswith("_line", F.lit(K.FRAME_PREFIX)))
    body = F.substring("_line", len(K.FRAME_PREFIX) + 1, 2**31 - 1)
    pair = F.concat(F.lit("["), body, F.lit(f',{{"type":"{_END}"}}]'))
    parsed = kept.select(F.from_json(pair, T.ArrayType(schema)).alias("_p")).where(
        (F.size("_p") == 2) & (F.col("_p")[1]["type"] == _END))
    return parsed.select(F.col("_p")[0].alias("_e")).where("_e.type is not null").select("_e.*")


def read_frames(spark: SparkSession, path: str, schema=schemas.EVENTS) -> DataFrame:
    """A stored log as events; the separator makes each frame one row, so large
    files are split among tasks."""
    return parse_frames(spark.read.option("lineSep", K.FRAME_END).text(path), schema)


def stream_frames(spark: SparkSession, path: str, schema=schemas.EVENTS, max_files: int = 100) -> DataFrame:
    frames = (spark.readStream.option("lineSep", K.FRAME_END)
              .option("maxFilesPerTrigger", max_files).text(path))
    return parse_frames(frames, schema)
