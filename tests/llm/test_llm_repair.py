"""Conversation repair against trying all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkrec.llm import repair as R

GRAMMAR = re.compile("(s?(ua)+)?")
BEGUN = re.compile("(s?(ua)*u?)?")
SPACE = " \t\n\v\f\r"


def cheapest(rows):
    """cost, audit and repaired rows, from all edits of rows (role, text, fault)."""
    best = []

    def go(i, out, audit, cost, puts):
        initials = "".join(r[:1] for r, _ in out)
        if not BEGUN.fullmatch(initials) or best and cost > best[0][0]:
            return
        if i == len(rows):
            if GRAMMAR.fullmatch(initials) and (not best or (cost, audit) < best[0][:2]):
                best[:] = [(cost, audit, out)]
        else:
            role, text, fault = rows[i]
            go(i + 1, out, audit + "D", cost + 4, 0)
            if fault not in (R.BLANK, R.DUPLICATE):
                more = 3 if fault == R.CUT_OFF else 0
                go(i + 1, [*out, (role if role[:1] in ("s", "u", "a") else "x", text)], audit + "K", cost + more, 0)
                for name in ("user", "assistant"):
                    go(i + 1, [*out, (name, text)], audit + "R", cost + 3 + more, 0)
        if puts < 3:
            for name in ("user", "assistant"):
                go(i, [*out, (name, "")], audit + "I", cost + 3, puts + 1)

    go(0, [], "", 0, 0)
    return best[0]


def expected(turns, damage=True):
    """The contract, conversation by conversation, in plain Python."""
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        rest = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if rest == 0:
            continue
        text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
        role = "user" if rest == 4 else role
        rows += [(turn, role, text)] * (2 if rest == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = R.BLANK if not bare else R.DUPLICATE if (role, text) in seen else R.SOUND if bare[-1] in ".!?" else R.CUT_OFF
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest(marked)
        counts = [sum(m[2] == k for m in marked) for k in (R.BLANK, R.DUPLICATE, R.CUT_OFF)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def table(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")


def got(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=repr)


def some_turns(rng, convs, longest):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]
    texts = ["Yes.", "No!", "cut off", "Why? ", "", " \n", None, "a.\x0b", " ", "Yes."]
    turns = []
    for conv in range(convs):
        n = rng.randrange(1, longest)
        numbers = rng.sample(range(-2, 12), n)
        turns += [(conv, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t}.") for t in numbers]
    rng.shuffle(turns)
    return turns


def test_against_all_edits(spark):
    turns = some_turns(random.Random(5), 150, 7)
    turns += [(None, 1, "user", "a."), (None, None, "assistant", "b"), (None, 1, "user", "a.")]
    df = table(spark, turns)
    assert got(R.repair(df, damage=True).repartition(3)) == expected(turns)
    assert got(R.repair(df)) == expected(turns, damage=False)


def test_chunks_of_a_few_rows(spark, monkeypatch):
    """Conversations over many chunks and partitions are repaired as if they were whole."""
    monkeypatch.setattr(R, "CHUNK_ROWS", 2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        turns = some_turns(random.Random(6), 12, 9)
        assert got(R.repair(table(spark, turns))) == expected(turns, damage=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("seed", range(30))
def test_search_in_pieces(seed):
    """The tables of chunks, composed, give the same edits as one search."""
    rng = random.Random(seed)
    rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(0, 60))]
    whole = R.Search(R.EMPTY)
    for row in rows:
        whole.step(*row)
    cost, state, close = R.chosen({s: (whole.cost[s], whole.rank[s]) for s in whole.cost})
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(4))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    survivors, steps = {R.EMPTY: (0, 0)}, []
    for piece in pieces:
        searches = {s: R.Search(s) for s in R.AFTER}
        for s in searches.values():
            for row in piece:
                s.step(*row)
        found = R.entered(survivors, {k: s.table() for k, s in searches.items()})
        steps.append((searches, {e: w[2] for e, w in found.items()}))
        survivors = {e: w[:2] for e, w in found.items()}
    assert R.chosen(survivors)[::2] == (cost, close)
    end, parts = R.chosen(survivors)[1], []
    for searches, back in reversed(steps):
        parts.append(searches[back[end]].edits(end))
        end = back[end]
    assert "".join(reversed(parts)) == whole.edits(state)


def test_memory_is_bounded():
    """Survivors that agree leave few nodes behind; those that never do keep theirs."""
    search = R.Search(R.EMPTY)
    for _ in range(5000):
        search.step("u", R.SOUND)
        search.step("a", R.SOUND)
    node, depth = next(iter(search.node.values())), 0
    while node is not search.root:
        node, depth = node[0], depth + 1
    assert depth < 10
    assert len("".join(search.out)) > 9900


def test_edges(spark):
    none = table(spark, [])
    assert got(R.repair(none, damage=True)) == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(R.repair(table(spark, [(1, dropped, "user", "x.")]), damage=True)) == [(1, 0, 0, 0, 0, 0, 0, "", empty)]
    long = "word " * 200_000 + "."
    odd = table(spark, [(2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", long)]).withColumns(
        {c: F.lit("mine") for c in ("place", "seen", "digest", "gone", "part", "chunk", "rows", "summary")})
    want = hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert got(R.repair(odd)) == [(2, 0, 0, 1, 0, 1, 4, "KKD", want)]
    names = odd.select(F.col("conv_id").cast("string").alias("place"), F.col("turn").alias("gone"), F.col("role").alias("seen"), F.col("text").alias("digest"))
    assert got(R.repair(names, conv="place", turn="gone", role="seen", text="digest"))[0][1:] == (0, 0, 1, 0, 1, 4, "KKD", want)
