"""Helpers of this package: stored intermediates, row batches, prefix sums over partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sparkrec.storage import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of one execution's shuffles, at its end


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again with the same schema.

    A lost executor costs only the tasks that were running, and later steps see exact
    sizes. An empty table keeps its columns. What was shuffled for it is deleted once it is
    written, as otherwise that lies on the disks until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind tables made by `stored` once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most `most`, or one row that is larger."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield start, batch.num_rows


def with_base(rows: DataFrame, part: str, size: Column, base: str) -> DataFrame:
    """Adds `base`: the sum of `size` over all rows of smaller `part`.

    Only one total per partition leaves the tasks, so what is ordered in one place and
    broadcast has as many rows as the table has partitions.
    """
    totals = rows.groupBy(part).agg(F.sum(size).alias("_total"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(base))
    return rows.join(F.broadcast(shift), part)
