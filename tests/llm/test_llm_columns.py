"""Operators that keep a user's columns keep them whatever their names are."""

import random

import pytest
from pyspark.sql import functions as F

from sparkrec.llm import decontam, line_dedup, quality, sharding, simhash

NAMES = ["id", "key", "row", "_key", "_new", "_segments", "_removed", "rep", "fp", "digest", "bands", "component_id", "band", "h", "n", "b", "salt",
         "own", "asked", "gone", "hits", "at", "lo", "hi", "slots", "of", "_slot", "SLOT_", "_shard", "leak", "leak_key", "item_id", "runs", "items",
         "features", "part", "block", "words", "none", "others", "salts", "new", "w"]


def frame(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(10 ** 5)}" for _ in range(12)) + ".\n"
    passage = "".join(line() for _ in range(12))
    rows = [(i, "".join(line() for _ in range(3)) + (passage if i % 2 else "") + line()) for i in range(20)]
    rows += [(30, rows[1][1]), (None, None), (31, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.concat(F.lit(n + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def model(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(32)], "doc_id long, quality int, toxic int")
    return quality.train(frame(spark), labels)


OPERATORS = {
    "line dedup": lambda spark, df: line_dedup.dedup_lines(df),
    "decontamination": lambda spark, df: decontam.drop_contaminated(df, spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")),
    "near duplicates": lambda spark, df: simhash.drop_near_duplicates(df),
    "similar": lambda spark, df: simhash.drop_similar(df),
    "sharding": lambda spark, df: sharding.place(df, ["a", "b", "c"], 101),
    "classifier": lambda spark, df: quality.classify(df, model(spark)),
    "rejection": lambda spark, df: quality.drop_rejected(df, model(spark)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_user_columns_stay(spark, name):
    df = frame(spark)
    out = OPERATORS[name](spark, df)
    assert out.columns[:len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)


def test_results_replace_columns_of_their_names(spark):
    df = frame(spark).withColumns({c: F.lit("mine") for c in ("removed_chunks", "removed_chars", "slot", "shard", "quality", "toxicity", "keep")})
    for out, own in ((line_dedup.dedup_lines(df), ("removed_chunks", "removed_chars")), (sharding.place(df, ["a"], 7), ("slot", "shard")),
                     (quality.classify(df, model(spark)), ("quality", "toxicity", "keep"))):
        assert len(set(out.columns)) == len(out.columns)
        assert all(r[c] != "mine" for r in out.collect() for c in own)


def test_conversations_without_a_name(spark):
    from sparkrec.llm import chat

    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), ("null", 0, "user", "c"), ("null", 1, "assistant", "d")],
                                 "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.conversations(chat.chain(rows))).collect()}
    assert got == {None: 2, "null": 2}
