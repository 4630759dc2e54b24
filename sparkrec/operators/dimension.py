"""The category dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkrec import constants as K


def category_table(spark: SparkSession, pairs: Sequence[tuple[str, str]] = K.CATEGORIES) -> DataFrame:
    rows = [(i, code, name) for i, (code, name) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "seq int, code string, name string")


def name_categories(rows: DataFrame, dimension: DataFrame, code: str = "code") -> DataFrame:
    """Left join to the names; a code the dimension lacks keeps a null name. Spark
    broadcasts the dimension where its size allows."""
    dim = dimension.select(F.col("code").alias(code), "name")
    return rows.join(dim, code, "left").withColumn("known", F.col("name").isNotNull())


def unknown_categories(rows: DataFrame, dimension: DataFrame, code: str = "code") -> DataFrame:
    dim = dimension.select(F.col("code").alias(code))
    return rows.join(dim, code, "left_anti").groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def render_categories(dimension: DataFrame) -> DataFrame:
    """The list as one text, as prompts show it; the dimension is a few rows."""
    return dimension.select("seq", F.concat(F.lit("  "), "code", F.lit(": "), "name").alias("line")).agg(
        F.expr("listagg(line, '\n') within group (order by seq)").alias("category_list"))
