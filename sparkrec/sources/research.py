"""The research table: scan, checks and numbered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkrec import schemas
from sparkrec.config import DEFAULTS
from sparkrec.storage import with_row_no


def read_research(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESEARCH).parquet(path)


def read_research_jdbc(spark: SparkSession, url: str, table: str, *, lower: int, upper: int,
                       partitions: int, **options: str) -> DataFrame:
    """The table out of a database, read in parallel by ranges of id."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="id", lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions), **options)
    return reader.load().select(*schemas.RESEARCH.fieldNames())


def length_violations(research: DataFrame) -> DataFrame:
    """Rows whose texts are longer than the table's declared lengths."""
    checks = [F.when(F.length(c) > n, F.lit(c)) for c, n in schemas.RESEARCH_LENGTHS.items()]
    return (research.withColumn("too_long", F.array_compact(F.array(*checks)))
            .where(F.size("too_long") > 0).select("id", "too_long"))


def _tie(df: DataFrame) -> Column:
    """Orders rows of one key, the same way for every kind of page."""
    return F.xxhash64(*sorted(df.columns))


def number_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """Row number from 1 over the whole table in key order (null keys first), without one
    global sort: ranges of the key are sorted by themselves, and shifted by the counts of
    the ranges before. A hash of the row parts and orders rows of one key."""
    ordered = df.withColumn("_tie", _tie(df)).repartitionByRange(key, "_tie").sortWithinPartitions(key, "_tie").drop("_tie")
    return with_row_no(ordered, "row_no", "numbered").withColumn("row_no", F.col("row_no") + 1)


def all_pages(research: DataFrame, page_size: int = DEFAULTS.page_size, key: str = "id") -> DataFrame:
    """Every row with its page number and its place on the page."""
    row = F.col("row_no") - 1
    return number_rows(research, key).withColumns({
        "page": (F.floor(row / page_size) + 1).cast("long"),
        "place": (F.pmod(row, F.lit(page_size)) + 1).cast("int"),
    })


def write_ordered(research: DataFrame, path: str, key: str = "id", ranges: int | None = None) -> None:
    """The table in ranges of its order (null keys first, rows of one key by a hash), a folder
    for each, and beside it the number of rows in each range: an index for pages."""
    spark = research.sparkSession
    cut = [c for c in (ranges, key, "_tie") if c is not None]
    ordered = research.withColumn("_tie", _tie(research)).repartitionByRange(*cut).sortWithinPartitions(key, "_tie")
    ordered.withColumn("_range", F.spark_partition_id()).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    counts = spark.read.schema("_range int, _tie long").parquet(f"{path}/rows").groupBy("_range").count()
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def page_of(spark: SparkSession, path: str, number: int, page_size: int = DEFAULTS.page_size, key: str = "id",
            schema: T.StructType = schemas.RESEARCH) -> DataFrame:
    """One page of a table that `write_ordered` wrote, however deep. The counts say which
    ranges it lies in, and these alone are read; the driver sees one count for each range."""
    first = (number - 1) * page_size
    counts = spark.read.schema("_range int, count long").parquet(f"{path}/counts").orderBy("_range").collect()
    before, spans = 0, []
    for row in counts:
        if before < first + page_size and before + row["count"] > first:
            spans.append((row["_range"], before))
        before += row["count"]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_tie", T.LongType()), T.StructField("_range", T.IntegerType())])).parquet(f"{path}/rows")
    skipped = spans[0][1] if spans else 0
    own = rows.where(F.col("_range").isin([r for r, _ in spans])).orderBy("_range", key, "_tie")
    return own.offset(first - skipped if spans else 0).limit(page_size if spans else 0).select(*schema.fieldNames())


def page(research: DataFrame, number: int, page_size: int = DEFAULTS.page_size, key: str = "id"
         ) -> DataFrame:
    """One page of a table without an index, however deep, in the order of `all_pages`. Keys
    and hashes alone are numbered; the page's first and last then limit what is read of the
    rows. For pages after pages of one table, `write_ordered` it first."""
    first = (number - 1) * page_size
    keys = number_rows(research.select(key, _tie(research).alias("_t")), key)
    marks = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"))
    low, high, n = keys.where(F.col("row_no").between(first + 1, first + page_size)).agg(
        F.min(marks), F.max(marks), F.count(F.lit(1))).first()
    if not n:
        return research.limit(0)
    skip = keys.where((F.col("row_no") <= first) & (F.col(key).isNull() if not low["known"] else F.col(key) == low["key"])).count()
    inside = F.lit(False)
    if high["known"]:
        inside = F.col(key) <= high["key"]
        if low["known"]:
            inside = inside & (F.col(key) >= low["key"])
    if not low["known"]:
        inside = inside | F.col(key).isNull()
    return research.where(inside).withColumn("_tie", _tie(research)).orderBy(key, "_tie").drop("_tie").offset(skip).limit(page_size)


def page_info(research: DataFrame, number: int, page_size: int = DEFAULTS.page_size) -> DataFrame:
    """Total and neighbours of a page, as a listing shows them."""
    pages = F.ceil(F.col("count") / page_size)
    return research.agg(F.count(F.lit(1)).alias("count")).select(
        "count",
        F.when(F.lit(number) < pages, F.lit(number + 1)).alias("next"),
        F.lit(number - 1 if number > 1 else None).cast("int").alias("previous"))
