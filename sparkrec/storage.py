"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

# Paths made inside the innermost `intermediates` of this thread: runs side by side keep
# their own.
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: spark.checkpoint.dir, or what setCheckpointDir named.
    Where neither is set, the warehouse takes its place, which executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.sparkrec-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkrec/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name of this application under the shared folder."""
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written to the shared folder and read again: survives lost executors, and later
    plans see its size and may skip columns and row groups."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, at the end of a run."""
    delete_path(spark, _run_dir(spark))


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; what shall outlast them
    must have been written by then. Blocks may be nested, and threads may have one each."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete_path(spark, path)


def with_row_no(df: DataFrame, out: str, name: str = "rows") -> DataFrame:
    """`df`, stored, with the number of each row from 0, in the order of its partitions.

    The rows are written with their partition and place, so both stay as they are; only
    one count per partition is ordered in one place and broadcast.
    """
    placed = cut_lineage(df.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    before = counts.selectExpr(
        "_part", "coalesce(sum(count) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    return (placed.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn(out, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_before", "_place"))
