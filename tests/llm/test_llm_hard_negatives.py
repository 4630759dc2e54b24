"""Hard negatives against all inner products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrec.llm import hard_negatives as H


def expected(rows, anchors):
    by_id = {}
    for i, v, l in rows:
        if i is None or v is None or l is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (l, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        by_id[i] = min(by_id.get(i, row), row)
    width = max((len(v) for _, v in by_id.values()), default=0)
    ids = sorted(by_id)
    labels = [by_id[i][0] for i in ids]
    m = np.array([by_id[i][1] + [0] * (width - len(by_id[i][1])) for i in ids], dtype=np.int64).reshape(len(ids), width)
    out = []
    for a, i in enumerate(ids):
        if not anchors(i):
            continue
        score = m @ m[a]
        ranked = sorted((-int(score[j]), ids[j], labels[j]) for j in range(len(ids)) if j != a)
        for p, pid, _ in [r for r in ranked if r[2] == labels[a]][:5]:
            fit = [r for r in ranked if r[2] != labels[a] and -80 * p <= -100 * r[0] <= -100 * p][:5]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def rows_like(seed, n, kind):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12))
    rows = []
    for i in range(n):
        v = centres[rng.integers(5)] + rng.normal(size=12) * (0.05 if kind == "tight" else 1)
        if kind == "copies" and i % 3:
            v = centres[0]
        if kind == "whole":
            v = rng.integers(-2, 3, size=12) / 4
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("kind", ["loose", "tight", "copies", "whole"])
def test_against_all_pairs(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 100), ("LEAF", 8), ("FAN", 4), ("CELLS", 6), ("SAMPLE", 60)):
        monkeypatch.setattr(H, name, value)
    rows = rows_like(7, 600, kind)
    got = H.mine(table(spark, rows), anchor=F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, lambda i: i % 20 == 0)


def test_tree_skips_nodes():
    """Near an anchor's cluster few leaves are opened, and what they give is exact."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, size=(40, 16))
    rows = (centres[rng.integers(40, size=8000)] + rng.integers(-5, 6, size=(8000, 16))).astype(float)
    norm2 = float((rows ** 2).sum(axis=1).max())
    labels = rng.integers(2, size=8000)
    tree = H.CoverTree(rows, np.arange(8000), labels, norm2)
    leaves, part = sum(len(n) == 2 for n in tree.nodes), []
    for a in range(0, 8000, 400):
        seen: list = []
        got, = tree.search(rows[a], a, int(labels[a]), True, [(-H.NONE, H.NONE)], 5, seen)
        scores = rows @ rows[a]
        want = sorted((-int(scores[j]), j) for j in range(8000) if j != a and labels[j] == labels[a])[:5]
        assert got == want
        part.append(sum(len(tree.nodes[n]) == 2 for n in seen) / leaves)
    assert np.mean(part) < 0.2


def test_tree_covers_and_separates():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, size=(3000, 6)).astype(float)
    norm2 = float((rows ** 2).sum(axis=1).max())
    points = H.augmented(rows, norm2)
    centres, owner, near = H.net(points, 5, norm2, 20)
    gaps = [np.linalg.norm(points[a] - points[b]) for k, a in enumerate(centres) for b in centres[:k]]
    assert centres[0] == 5 and min(gaps) >= near.max() - 1e-6
    assert np.allclose(near, np.linalg.norm(points - points[np.array(centres)[owner]], axis=1), atol=1e-4)


def test_edges(spark):
    assert H.mine(table(spark, []), anchor=F.col("vec_id") >= 0).collect() == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, None, 1), (4, [1.0, 1.0], None),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [], 2), (9, [0.5], 3), (10, [0.75], 3), (None, [1.0, 1.0], 2),
            (11, [0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [0.8, 0.0], 2)]
    frame = table(spark, rows).withColumns({c: F.lit("mine") for c in ("vec", "cell", "distance", "block", "kind", "windows", "rank")})
    got = sorted(tuple(r) for r in H.mine(frame, anchor=F.lit(True)).collect())
    assert got == expected(rows, lambda i: True) and got
    same = spark.createDataFrame([(i, [1.0], 1) for i in range(20)], "vec_id long, embedding array<float>, label int")
    assert H.mine(same, anchor=F.col("vec_id") < 3).collect() == []
    with pytest.raises(ValueError):
        H.mine(table(spark, [(1, [1e9], 1)]), anchor=F.lit(True))
    names = frame.select(F.col("vec_id").alias("label"), F.col("embedding").alias("vec_id"), F.col("label").alias("vec"))
    assert sorted(tuple(r) for r in H.mine(names, anchor=F.lit(True), id_col="label", vector_col="vec_id", label_col="vec").collect()) == got
