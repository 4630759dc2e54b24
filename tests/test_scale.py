"""Queries that must do a costly step once, or hold little of it."""

import pytest
from pyspark.sql import functions as F

from sparkrec.sources.results import write_json, write_parquet
from sparkrec.storage import cut_lineage
from workload import answers, search


@pytest.fixture
def tables(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 30).alias("text"),
                                  F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"), F.lit("src1").alias("source"))
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(40).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"),
                           F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000).cast("float"))
                           .alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("query", [search.rerank_join, answers.not_seen])
def test_hits_are_searched_once(spark, tables, query):
    out = query(spark, tables)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count()


def test_texts_are_written_compressed(spark, tmp_path):
    rows = spark.range(3).withColumn("text", F.lit("word " * 50))
    write_json(rows, str(tmp_path / "json"))
    write_parquet(rows, str(tmp_path / "parquet"))
    kept = cut_lineage(rows)
    assert all(f.endswith(".json.gz") for f in spark.read.json(str(tmp_path / "json")).inputFiles())
    assert all(f.endswith(".zstd.parquet") for f in [*kept.inputFiles(), *spark.read.parquet(str(tmp_path / "parquet")).inputFiles()])
    assert spark.read.json(str(tmp_path / "json")).count() == 3
