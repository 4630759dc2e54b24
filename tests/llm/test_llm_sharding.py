"""The lookup table and placement by it."""

import hashlib

import pytest

from sparkrec.llm import sharding as S

NAMES = [f"s{i}" for i in range(5)]


def test_table_is_filled_evenly_in_turns():
    owner = S.fill_table(NAMES, 101)
    counts = [owner.count(i) for i in range(5)]
    assert sorted(counts) == [20, 20, 20, 20, 21] and counts[0] == 21
    starts = [S.preference(n, 101)[0] for n in NAMES]
    assert owner[starts[0]] == 0


def test_little_moves():
    before, after = S.fill_table(NAMES, 1009), S.fill_table([*NAMES, "s5"], 1009)
    assert sum(a != b for a, b in zip(before, after)) < 1009 * 0.3


@pytest.mark.parametrize("names, slots", [(["a", "a"], 101), ([], 101), (["a"], 100), (["a", "b", "c"], 2), (["a"], 10 ** 9 + 7)])
def test_refused(names, slots):
    with pytest.raises(ValueError):
        S.fill_table(names, slots)


def test_place(spark):
    rows = spark.createDataFrame([(1, "x", "old"), (1, "y", "old"), (None, "z", None), (7, None, None)],
                                 "doc_id long, slot_text string, shard string")
    out = S.place(rows, NAMES, 101)
    assert sorted(out.columns) == ["doc_id", "shard", "slot", "slot_text"]
    owner = S.fill_table(NAMES, 101)
    for r in out.collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, NAMES[owner[slot]])
    assert out.count() == 4 and S.place(rows.limit(0), NAMES, 101).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hash" not in plan


def test_salt_spreads_a_hot_key(spark):
    rows = spark.range(500).selectExpr("1L AS doc_id", "id % 16 AS salt")
    assert S.place(rows, NAMES, 101).select("shard").distinct().count() == 1
    assert S.place(rows, NAMES, 101, salt="salt").select("shard").distinct().count() > 2


def test_write_shards(spark, tmp_path):
    S.write_shards(S.place(spark.range(100).withColumnRenamed("id", "doc_id"), NAMES, 101), f"{tmp_path}/out", files=2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
