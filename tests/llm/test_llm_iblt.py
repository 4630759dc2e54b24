"""Sketches of paragraph digests against plain sets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrec.llm import iblt as I


def sets(rng, n, shared, own):
    both = rng.integers(0, 2**64, shared, dtype=np.uint64)
    return [(np.unique(np.r_[both, rng.integers(0, 2**64, own, dtype=np.uint64)]),
             np.unique(np.r_[both, rng.integers(0, 2**64, own // 2, dtype=np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize("shared,own", [(0, 0), (1, 0), (0, 1), (500, 3), (40, 40), (3, 900), (0, 5000)])
def test_differences(shared, own):
    pairs = sets(np.random.default_rng(shared + own), 20, shared, own)
    found = I.differences([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), (left, right) in zip(pairs, found):
        assert sorted(left.tolist()) == sorted(set(a.tolist()) - set(b.tolist()))
        assert sorted(right.tolist()) == sorted(set(b.tolist()) - set(a.tolist()))


def test_peeling_grows_on_failure():
    """Far too few cells for what differs: nothing is reported missing, and more cells do."""
    keys = np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64)
    small = I.Sketches(np.array([8]))
    small.add(np.zeros(4000, dtype=np.int64), keys)
    assert not small.peel()[3][0]
    (left, right), = I.differences([keys], [keys[:100]])
    assert set(left.tolist()) == set(keys[100:].tolist()) and len(right) == 0


def plain(text):
    seen, out = {}, set()
    for p in I.paragraphs(text):
        seen[p] = seen.get(p, 0) + 1
        out.add((p, seen[p]))
    return out


def likeness(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b)


def expected(docs):
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(text, changed), likeness(text, after)))
    return sorted(out, key=repr)


def texts(rng, n):
    line = lambda: " ".join(rng.choice(["ein", "zwei.", "trois!", "日本", "\U0001f600", "x" * 50]) for _ in range(rng.randrange(30)))
    out = ["\n".join(line() for _ in range(rng.randrange(8))) for _ in range(n)]
    return [*out, None, "", "a", out[0], out[0][:-3], "a. " * 3000, "y" * 100_001]


@pytest.mark.parametrize("parts", [1, 7])
def test_revisions(spark, parts):
    docs = list(zip(random.Random(4).sample(range(1000), 107), texts(random.Random(3), 100)))
    df = spark.createDataFrame([*docs, (None, "no id")], "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("part", "side", "following", "n_chars", "fingerprint")})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = I.revisions(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=repr)
    want = expected([*docs, (None, "no id")])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got] == [pytest.approx(w[3:]) for w in want]
    prints, by_text = {r.doc_id: r.fingerprint for r in rows}, {}
    for i, text in docs:
        by_text.setdefault(text or "", set()).add(prints[i])
    assert all(len(p) == 1 for p in by_text.values())
    assert len(set(prints.values())) == len({frozenset(plain(t or "")) for _, t in docs} | {frozenset(plain("no id"))})


def test_revisions_edges(spark):
    one = spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")
    row, = I.revisions(one).collect()
    assert (row.doc_id, row.n_chars, row.near_next) == (5, 5, 1.0)
    assert row.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert I.revisions(one.where("doc_id = 0")).collect() == []
    rows = I.revisions(one.union(one).union(one)).collect()
    assert len(rows) == 3 and len(set(rows)) == 1


def test_changed_paragraphs(spark):
    old = spark.createDataFrame([(1, "a\nb\nc"), (2, "same"), (3, None), (4, "gone"), (None, "x")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\nB\nc\nd"), (2, "same"), (3, "z"), (None, "x")], "doc_id long, text string")
    sign = lambda t: sorted(I.digests(t).view(np.int64).tolist())
    got = {r.doc_id: (r.removed, r.added) for r in I.changed_paragraphs(old, new).collect()}
    assert got == {1: (sign("b"), sorted(sign("B") + sign("d"))), 2: ([], []), 3: (sign(""), sign("z"))}
