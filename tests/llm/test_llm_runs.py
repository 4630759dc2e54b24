"""Repeated runs of lines against brute force, and planted passages."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkrec.llm import line_dedup as L

ENDS = " \n\r\t"


def lines_of(text):
    if L.MARK in text:
        return re.split(r"(?<=\n)|(?<=[.!?] )", text)
    for end in ("\n", ". ", "! ", "? "):
        text = text.replace(end, end + L.MARK)
    for empty in ("\r\n", "\n"):
        text = text.replace(L.MARK + empty, empty)
    return text.split(L.MARK)


def line_hash(line):
    return xxhash.xxh64_intdigest(line.rstrip(ENDS).encode(), seed=42) & ~1 | (len(line.encode()) >= L.LONG_LINE)


def starts_of(lines):
    h = [line_hash(x) for x in lines]
    out = []
    for i, own in enumerate(h):
        after = h[i + 1] if i + 1 < len(h) else None
        rolled = None if after is None else (own << 1 | own >> 63) & (2 ** 64 - 1) ^ after
        pair = after is not None and (rolled - (1 << 64) if rolled >> 63 else rolled) % L.SPREAD == 0
        if own & 1 or pair and line_hash("") not in (own, after):
            out.append((i, (own,) if own & 1 else (own, after)))
    return out


def without_runs(docs):
    """Texts after removal. Ids differ, so their order is that of the documents."""
    parts, first = {}, {}
    for key, text in sorted(docs):
        lines = lines_of(text)
        parts[key] = (lines, [x.rstrip(ENDS) for x in lines], starts_of(lines))
        for i, h in parts[key][2]:
            first.setdefault(h, (key, i))
    out = {}

    def window(key, i):
        lines, _, starts = parts[key]
        at = [x for x, _ in starts]
        k = at.index(i)
        return at[k - 1] + 1 if k else 0, at[k + 1] if k + 1 < len(at) else len(lines) - 1

    for key, text in docs:
        lines, bare, starts = parts[key]
        gone = set()
        for i, h in starts:
            other, j = first[h]
            if (other, j) != (key, i):
                low, high = window(key, i)
                theirs = parts[other][1]
                gone |= {x for x in range(low, high + 1) if 0 <= x - i + j < len(theirs) and bare[x] == theirs[x - i + j]}
        kept, piece = set(range(len(lines))), []
        for i in [*sorted(gone), None]:
            if piece and i != piece[-1] + 1:
                n = len("".join(lines[j] for j in piece).split())
                if n >= 50 or n >= 10 and sum(bool(bare[j]) for j in piece) > 1:
                    kept -= set(piece)
                piece = []
            piece.append(i)
        out[key] = "".join(lines[i] for i in sorted(kept))
    return out


def prose(rng, words, ends=(". ", ".\n", "\n", "! ")):
    """Lines of 1 to 30 words."""
    out = []
    while words > 0:
        n = min(words, rng.choice([1, 2, 5, 9, 14, 30]))
        out.append(" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n)) + rng.choice(ends))
        words -= n
    return "".join(out)


def run(spark, docs):
    return {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}


def test_against_brute_force(spark, monkeypatch):
    """Also with hashes that count as hot, and copies that are salted."""
    rng = random.Random(4)
    passages = [prose(rng, n) for n in range(15, 201, 8)]
    docs = []
    for i in range(120):
        text = prose(rng, rng.choice([3, 20, 60]))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            text += p if rng.random() < 0.7 else "".join(lines_of(p)[rng.randrange(4):])
            text += prose(rng, rng.choice([0, 5, 30]))
        docs.append((i, text))
    docs += [(200, docs[1][1]), (201, "\n \n" + docs[2][1]), (202, "So it is.\n" * 40), (203, passages[-1].rstrip()), (204, "\r\n\r\n".join(passages[:3])),
             (205, L.MARK + passages[5] + L.MARK), (206, passages[5]), (207, docs[1][1].replace("\n", "\r\n")), (-5, "a. b. c. d. e. f. g. h. i. j. k. l. " * 3)]
    want = without_runs(docs)
    assert sum(want[i] != t for i, t in docs) > 60
    for hot, salted in ((10_000, 5000), (3, 2)):
        monkeypatch.setattr(L, "HOT_HASHES", hot)
        monkeypatch.setattr(L, "SALTED", salted)
        got = run(spark, docs)
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["removed_chars"] == len(dict(docs)[i]) - len(r["text"]) for i, r in got.items())
        assert all((r["removed_chunks"] > 0) == (r["removed_chars"] > 0) for r in got.values())


def test_planted_passages(spark):
    """Passages of 55 to 200 words in sentences of 5 to 15: nine tenths of their words go, and no others."""
    rng = random.Random(5)

    def sentences(words):
        out = []
        while words > 0:
            n = min(words, rng.randrange(5, 16))
            out.append(" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n)) + rng.choice([". ", ".\n"]))
            words -= n
        return "".join(out)

    docs, planted = [], {}
    for i in range(300):
        p = sentences(rng.randrange(55, 201))
        docs += [(i, sentences(40) + p + sentences(30)), (1000 + i, sentences(25) + p + sentences(45))]
        planted[1000 + i] = set(p.split())
    got = run(spark, docs)
    there = sum(len(w) for w in planted.values())
    left = sum(len(w & set(got[i]["text"].split())) for i, w in planted.items())
    caught = sum(len(w & set(got[i]["text"].split())) < 0.5 * len(w) for i, w in planted.items())
    assert left < 0.1 * there and caught >= 0.9 * len(planted)
    assert all(got[i]["text"] == t for i, t in docs if i < 1000)
    texts = dict(docs)
    assert all(set(texts[i].split()) - w <= set(got[i]["text"].split()) for i, w in planted.items())


def test_nothing_and_repeated_rows(spark):
    text = prose(random.Random(1), 200)
    docs = spark.createDataFrame([(2, text, "a"), (2, text, "a"), (None, text, "b"), (3, None, "c"), (4, "", "d"), (5, "\n\n", "e")],
                                 "doc_id long, text string, h string")
    got = L.dedup_lines(docs)
    assert got.columns == [*docs.columns, "removed_chunks", "removed_chars"]
    rows = {(r["doc_id"], r["h"]): r["text"] for r in got.collect()}
    assert got.count() == 6 and rows[(None, "b")] == text and rows[(3, "c")] is None and rows[(4, "d")] == "" and rows[(5, "e")] == "\n\n"
    assert len(rows[(2, "a")]) < 0.1 * len(text)
    assert L.dedup_lines(docs.limit(0)).collect() == []


@pytest.mark.parametrize("gap", ["\n", "\t", " ", "\r\n", "  "])
@pytest.mark.parametrize("n", [60, 600])
def test_words_parted_by_any_white_space(spark, gap, n):
    passage = gap.join(f"w{i}" for i in range(n)) + "\n"
    got = run(spark, [(1, "one\n" + passage + "two"), (2, "three\n" + passage + "four")])
    assert (got[1]["removed_chars"], got[2]["text"]) == (0, "three\nfour")


def test_no_python(spark):
    frame = spark.createDataFrame([(1, "a b.\nc")], "doc_id long, text string").where(F.col("doc_id") > 0)
    plan = L.dedup_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
