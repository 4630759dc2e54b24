"""Fingerprints and groups against all pairs."""

import random
import re
import string
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkrec.llm import simhash as S

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


TEXTS = ["", None, " \n\t", "one", "One", "one two", "a b c", "A  B\tC", "x y z", "é è ê ô", "long " * 3000, "a b c", "\x1cq r s t"]


def test_documents(spark):
    rows = [(i, t, "f") for i, t in enumerate(TEXTS)] + [(3, "one", "f"), (None, "a b c", "f"), (None, "alone here now", "f")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    label = classes(list(fps), fps)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", label[r["doc_id"]])
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["6", "None"]


def nodes_of(spark, fps):
    return spark.createDataFrame([(i, S._signed(f)) for i, f in enumerate(fps)], "rep long, fp long")


@pytest.mark.parametrize("fine", [False, True])
def test_links_join_what_all_pairs_join(spark, monkeypatch, fine):
    if fine:  # large buckets are split
        monkeypatch.setattr(S, "BUCKET", 3)
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    found = {r["id"]: r["component_id"] for r in S.components(S.links(nodes_of(spark, fps))[1]).collect()}
    want = classes(range(len(fps)), fps)
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "a long, b long")
    assert {r["component_id"] for r in S.components(edges).collect()} == {0}
    assert S.components(edges.limit(0)).collect() == []


def test_dense_bucket_in_numpy():
    fps = np.array([S._signed(0xF0F0F0F0 << 32 | i) for i in range(2048)], dtype=np.int64)
    assert set(S.bucket_links(np.arange(2048), fps).tolist()) == {0}


def test_empty_and_drop(spark):
    docs = spark.createDataFrame([(5, "a b c d", 1), (2, "a b c d", 2), (9, "other words here", 3), (None, None, 4), (1, None, 5)],
                                 "doc_id long, text string, component_id long")
    assert S.near_duplicates(docs.limit(0)).collect() == []
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["component_id"] for r in kept.collect()) == [2, 3, 4, 5]


def test_rows_without_an_id_link_others(spark):
    """Two fingerprints that only a row without an id joins are one group."""
    rows = spark.createDataFrame([(1, 0), (None, 7), (2, 63), (None, 1 << 40), (5, 1 << 20 | 1 << 30 | 1 << 50 | 1 << 60)], "doc_id long, fp long")
    real = S.fingerprints
    S.fingerprints = lambda docs: rows
    try:
        got = {(r.doc_id, r.fp): r.component_id for r in S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect()}
    finally:
        S.fingerprints = real
    assert got[(1, 0)] == got[(2, 63)] == got[(None, 7)] == 1 and got[(None, 1 << 40)] == 1


def test_similar_documents(spark):
    """Of planted pairs with a similarity of 0.8 to 1 nine tenths and more are found, and no others."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(50_000)}"
    grams = lambda t: {tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))}
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    docs, near = [], []
    for i in range(400):
        a = [word() for _ in range(rng.choice([30, 80, 300, 900]))]
        b = list(a)
        while like(a, b) > rng.uniform(0.7, 1):
            b[rng.randrange(len(b))] = word()
        docs += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        near.append((like(a, b), i))
    docs += [(5000, docs[0][1]), (5001, docs[0][1].upper()), (5002, None), (5003, ""), (5004, "one"), (None, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.similar_groups(frame).collect()}
    due = [i for s, i in near if s >= 0.8]
    found = [i for _, i in near if got[1000 + i] == i]
    assert len(due) > 150 and len(set(due) & set(found)) >= 0.95 * len(due)
    assert set(found) <= set(due)
    assert got[5000] == got[5001] == 0 and got[5002] == got[5003] == 5002 and got[5004] == 5004 and None not in got
    kept = S.drop_similar(frame.withColumns({"key": F.lit(1), "digest": F.lit(2), "rep": F.lit(3)}))
    assert kept.columns == ["doc_id", "text", "key", "digest", "rep"]
    assert {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c} | {None}
    assert S.drop_similar(frame.limit(0)).collect() == []


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Thousands of copies, each with words of its own, are one group although each is compared with few others."""
    monkeypatch.setattr(S, "SALTED", 50)
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    docs = []
    for i in range(1500):
        t = list(base)
        t[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(t)))
    got = [r.component_id for r in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()]
    assert got.count(0) >= 0.99 * len(docs)


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs just above 0.8, too many for keys of smallest shingles to find them all; those just below stay apart."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    grams = lambda t: {tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))}
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    common = [word() for _ in range(30)]  # a passage of all texts
    docs, due = [], {}
    for i in range(500):
        a = [word() for _ in range(rng.choice([20, 60, 150]))]
        if i % 2:
            a = common + a
        b = list(a)
        while True:
            c = list(b)
            c[rng.randrange(len(c))] = word()
            if like(a, c) < 0.8:
                break
            b = c
        b = c if i % 5 == 0 else b
        docs += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        due[1000 + i] = i if like(a, b) >= 0.8 else 1000 + i
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert {i: got[i] for i in due} == due and all(got[i] == i for i in range(500))


def spied(monkeypatch):
    """Numbers of rows of what is stored from now on, by name."""
    rows, real = {}, S.stored

    def stored(df, name, path=None):
        out = real(df, name, path)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(S, "stored", stored)
    return rows


def test_texts_of_one_template_are_not_compared(spark, monkeypatch):
    """Shingles that some texts share are known as frequent however many texts there are, so texts
    far from alike are no pairs: their number would grow with the square of the texts."""
    monkeypatch.setattr(S, "ORDER_SAMPLE", 20)
    monkeypatch.setattr(S, "ORDER_STEP", 2, raising=False)
    rows = spied(monkeypatch)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(50_000)}"
    templates = [[word() for _ in range(100)] for _ in range(40)]
    docs = [(i, " ".join(templates[i % 40] + [word() for _ in range(60)])) for i in range(600)]
    docs.append((1000, docs[0][1] + " more"))
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: 0 if i == 1000 else i for i, _ in docs}
    assert sum(rows["pairs"][1:]) < 50  # of 4200; the first are those of equal keys


def test_a_pair_is_decided_once(spark, monkeypatch):
    """Pairs just below the threshold that the first shingles propose are not proposed again."""
    rows = spied(monkeypatch)
    rng = random.Random(10)
    docs = []
    for i in range(60):
        a = [f"w{rng.randrange(50_000)}" for _ in range(100)]
        b = list(a)
        b[30] = b[70] = "other"
        b[50] = "words"  # 15 of 96 shingles: 0.73
        docs += [(i, " ".join(a)), (1000 + i, " ".join(b))]
    got = [r.component_id for r in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()]
    assert len(set(got)) == 120 and rows["further"][0] >= 30 and rows["further"][1] == 0


def test_one_shared_shingle_is_no_pair(spark):
    """Of alike texts two first shingles meet; where they share one in all, that does."""
    schema = "rep long, key long, n long, own long, place long, h long"
    rows = [(i, i, 100, i, p, 100 * i + p) for i in (1, 2, 3) for p in range(22)]
    rows = [(*r[:5], 7) if r[4] == 0 else (*r[:5], 8) if r[0] > 1 and r[4] == 3 else r for r in rows]
    got = S._apart_but_alike(spark.createDataFrame([*rows, (8, 8, 1, 8, 0, 5), (9, 9, 1, 9, 0, 5)], schema), 0.8).collect()
    assert {frozenset((r.rep, r.b)) for r in got} == {frozenset((2, 3)), frozenset((8, 9))}


def test_what_was_shuffled_for_a_stored_table_goes(spark):
    from sparkrec.llm.common import stored

    def shuffles():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {n.rsplit("/", 1)[-1] for n in names if "/shuffle_" in n}

    before = shuffles()
    kept = stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
