"""Cheapest repair of conversations to `(s?(ua)+)?`: a Viterbi search that emits an edit as
soon as all survivors agree on it.

Rows are dealt in ranges of (conversation, turn), so that a conversation of any length is
cut into chunks. The search over a chunk takes four states at its start to four at its
end; what it says is a small table, and the tables of consecutive chunks are composed. So
only one chunk is ever held, and only the final hash of a conversation, which has to see
the rows in order, streams it past one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.llm.common import discard, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)      # nothing yet, or whose turn came last
ENDS = (EMPTY, ASSISTANT)                      # where a conversation may stop
# From any state two inserts and a deletion at most do for what any other one can go on with.
HOPELESS = 2 * INSERT + DELETE
AFTER = {EMPTY: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)    # first fault of a row
CHUNK_ROWS = 20_000
CHUNK_CHARS = 4_000_000

_WORD = re.compile("[^\x20\x09-\x0D]")
_LEGAL = {"su", "ua", "au"}
Survivor = tuple[int, int]                     # cost, and place among the survivors' edits in ASCII order


def _inserts() -> dict[int, list[tuple[str, int]]]:
    """For each state, the rows that may be put in front of the next one: none, one or
    two (two more would come back to the same state for a higher cost)."""
    out = {}
    for state in AFTER:
        ways, now = [("", state)], state
        for n in (1, 2):
            now = ASSISTANT if now == USER else USER
            ways.append(("I" * n, now))
        out[state] = ways
    return out


INSERTS = _inserts()


def moves(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """from, to, cost and edits (inserts, then the row's own) for one row."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == CUT_OFF else 0
    for state, ways in INSERTS.items():
        for put, at in ways:
            cost = INSERT * len(put)
            choices = [(at, cost + DELETE, put + "D")]
            if fault in (SOUND, CUT_OFF):
                choices += [(STATE[c], cost + extra + (KEEP if c == initial else REROLE), put + ("K" if c == initial else "R"))
                            for c in AFTER[at] if c == initial or c != "s"]
            for to, price, edits in choices:
                out[state, to] = min(out.get((state, to), (price, edits)), (price, edits))
    return [(a, b, price, edits) for (a, b), (price, edits) in out.items()]


_MOVES = {(c, f): moves(c, f) for c in ("s", "u", "a", "") for f in range(4)}


class Search:
    """Survivors of one chunk from one state at its start.

    Each edit survives as a node with its parent and the number of its children. A node
    without children that is no survivor goes, and when the oldest node has a single
    child and is no survivor itself, all survivors share it: its edits are emitted. Two
    ways to one state with equal cost differ in their unresolved edits (they have taken
    the same rows, and inserts cost), and the ASCII-least of these complete suffixes
    stays. A survivor that costs over HOPELESS more than another is given up. As neither is the start of the other, the order of two survivors' suffixes
    never changes later; it is kept as a rank, so that no suffix is walked twice.
    """

    def __init__(self, start: int):
        self.root = [None, "", 1]                       # parent, edits, children and survivors that hold it
        self.cost, self.rank, self.node = {start: 0}, {start: 0}, {start: self.root}
        self.out: list[str] = []
        self.wait = 1                                   # rows until the next look for what can be emitted

    def step(self, initial: str, fault: int) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, to, price, edits in _MOVES[initial if initial in STATE else "", fault]:
            if state in self.cost:
                way = (self.cost[state] + price, self.rank[state], edits, state)
                if to not in best or way < best[to]:
                    best[to] = way
        most = min(best.values())[0] + HOPELESS
        best = {to: way for to, way in best.items() if way[0] <= most}
        order = sorted(best, key=lambda to: best[to][1:3])
        nodes = {}
        for to, (_, _, edits, state) in best.items():
            parent = self.node[state]
            parent[2] += 1
            nodes[to] = [parent, edits, 1]
        gone = list(self.node.values())
        self.cost, self.rank, self.node = {to: way[0] for to, way in best.items()}, {to: i for i, to in enumerate(order)}, nodes
        for node in gone:
            while node is not None:
                node[2] -= 1
                if node[2]:
                    break
                node = node[0]
        self._emit()

    def _emit(self) -> None:
        """Edits up to the last node that all survivors share. A walk from one survivor finds
        it; the walk is short where survivors agree, and is put off while they do not."""
        self.wait -= 1
        if self.wait:
            return
        path, node = [], next(iter(self.node.values()))
        while node is not self.root:
            path.append(node)
            node = node[0]
        while path and self.root[2] == 1:
            self.root = path.pop()
            self.root[0] = None
            self.out.append(self.root[1])
        self.wait = max(1, len(path))

    def edits(self, end: int) -> str:
        node, back = self.node[end], []
        while node is not self.root:
            back.append(node[1])
            node = node[0]
        return "".join(self.out) + "".join(reversed(back))

    def table(self) -> list[list[int]]:
        """end, cost, rank of the survivors."""
        return [[to, self.cost[to], self.rank[to]] for to in self.cost]


def entered(survivors: dict[int, Survivor], tables: dict[int, Sequence[Sequence[int]]]) -> dict[int, tuple[int, int, int]]:
    """cost, rank and the state at its start of each survivor behind a chunk, from those in
    front of it and the chunk's tables (one for each state at its start)."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for start, (cost, rank) in survivors.items():
        for end, more, place in tables[start]:
            way = (cost + more, rank, place, start)
            if end not in best or way < best[end]:
                best[end] = way
    order = {end: i for i, end in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
    return {end: (way[0], order[end], way[3]) for end, way in best.items()}


def chosen(survivors: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """Cost, last state and closing inserts of the cheapest whole repair."""
    ways = []
    for state, (cost, rank) in survivors.items():
        n = {EMPTY: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
        ways.append((cost + INSERT * n, rank, "I" * n, state))
    cost, _, put, state = min(ways)
    return cost, state, put


def repaired(rows: Sequence[tuple[str, str]], edits: str, state: int, close: str = "") -> tuple[list[tuple[str, str]], int]:
    """The rows after the edits, which begin in `state`, and the state at the end."""
    out, at = [], iter(rows)
    for edit in edits + close:
        if edit == "D":
            next(at)
            continue
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
        out.append((role if edit == "K" else NAMES[state], text))
    return out, state


def fault(role: str, text: str, seen: bool) -> int:
    if not _WORD.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    last = next(c for c in reversed(text) if _WORD.match(c))
    return SOUND if last in ".!?" else CUT_OFF


# --- tables -------------------------------------------------------------------------------

def damaged(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and gone, one row per row of the damaged conversations.

    The rest of crc32("conv:turn") by 20 decides: 0 drops a row (it stays as `gone`, so
    that its conversation is known), 1 empties its text, 2 takes out its [.!?], 3 repeats
    it, 4 makes its role user. A null number is one space there; a null role or text is one
    space.
    """
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rest = F.crc32(F.encode(F.concat(name(conv), F.lit(":"), name(turn)), "utf-8")) % 20
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), name(role).alias("role"),
                        name(text).alias("text"), rest.alias("rest"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("rest") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("rest") == 1, "").when(F.col("rest") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("rest") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("rest") == 3, 2).otherwise(1))).alias("_n")
    ).drop("_n")


def with_seen(rows: DataFrame) -> DataFrame:
    """Adds `seen`: whether an earlier row of the conversation has this role and text.

    Only repeated texts are looked up, by a digest, and every digest has one row there, so
    that adaptive execution can split a hot one. Of equal rows the one with the smallest
    `place` is the first.
    """
    marked = rows.withColumn("digest", F.when(~F.col("gone"), F.sha2("text", 256)))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")
    first = marked.where("NOT gone").groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.count("*").alias("_n"), F.min(order)["place"].alias("_first")).where("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return marked.join(first, same, "left").select(
        *rows.columns, "digest", F.coalesce(F.col("_first") != F.col("place"), F.lit(False)).alias("seen"))


_CLOSED = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, n_repaired long")
_CHUNK = "part int, chunk long, summary string, rows array<struct<role:string,text:string,fault:int>>"


class _Chunk:
    """Rows of one conversation, in order, up to a bound."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.chars = 0
        self.counts = [0] * 4
        self.illegal = self.turns = 0
        self.first: str | None = None
        self.last: str | None = None
        self.least: int | None = None
        self.most: int | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        kind = fault(role, text, seen)
        self.rows.append((role, text, kind))
        self.chars += len(text)
        self.counts[kind] += 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def searched(self, start: int) -> Search:
        search = Search(start)
        for role, _, kind in self.rows:
            search.step(role[:1], kind)
        return search

    def summary(self) -> str:
        tables = {s: self.searched(s).table() for s in AFTER}
        return json.dumps([self.counts, self.illegal, self.turns, self.first, self.last, self.least, self.most, tables])

    def closed(self) -> tuple:
        search = self.searched(EMPTY)
        cost, state, close = chosen({s: (search.cost[s], search.rank[s]) for s in search.cost})
        audit = search.edits(state)
        rows, _ = repaired([r[:2] for r in self.rows], audit, EMPTY, close)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "replace")).hexdigest()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, cost, audit + close, digest, len(rows))


def _composed(summaries: list[str]) -> tuple[tuple, list[tuple[int, int]], str]:
    """gaps to cost of a conversation from the summaries of its chunks in order, and for each
    chunk its states at start and end, and the closing inserts."""
    counts, illegal, turns, before, least, most = [0] * 4, 0, 0, None, None, None
    survivors: dict[int, Survivor] = {EMPTY: (0, 0)}
    steps = []
    for text in summaries:
        c, wrong, n, first, last, low, high, tables = json.loads(text)
        counts = [a + b for a, b in zip(counts, c)]
        if first is not None:
            illegal += wrong + (before is not None and before + first not in _LEGAL)
            before = last
        if high is not None:
            turns += n - (most == low)
            least, most = low if least is None else least, high
        found = entered(survivors, {int(k): t for k, t in tables.items()})
        steps.append({end: way[2] for end, way in found.items()})
        survivors = {end: way[:2] for end, way in found.items()}
    cost, state, close = chosen(survivors)
    ways = []
    for step in reversed(steps):
        ways.append((step[state], state))
        state = step[state]
    gaps = 0 if most is None else most - least + 1 - turns
    return (gaps, *counts[1:], illegal, cost), ways[::-1], close


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256,
    n_repaired: one row per conversation. `damage` damages the rows first.

    Rows come by turn (nulls first), then role, then digest of the text. A null role or text is one
    space; a null conversation is one of its own. Repeated rows are rows and so duplicates.
    A conversation of which every row is dropped has zeros, no edits and the hash of
    nothing; an empty table gives no rows. Other columns do not matter.
    """
    if damage:
        rows = damaged(turns, conv=conv, turn=turn, role=role, text=text)
    else:
        rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *[
            F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))], F.lit(False).alias("gone"))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    kind = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "digest", "place"]
    seen = stored(with_seen(rows), "seen")
    discard(turns.sparkSession, rows)
    ranged = seen.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", "seen")
    chunk_rows = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CLOSED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()]

        def out(convs: list, closed: list[tuple | None], part=None, chunk=None, summary=None, held=None) -> pa.RecordBatch:
            n = len(convs)
            cols = [pa.array([c[i] if c else None for c in closed], type=k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(
                [pa.array(convs, type=conv_type), *cols, pa.array([part] * n, type=pa.int32()), pa.array([chunk] * n, type=pa.int64()),
                 pa.array([summary] * n, type=pa.string()), pa.array([held] * n, type=chunk_rows)],
                names=["conv_id", *names, "part", "chunk", "summary", "rows"])

        def open_(number: int) -> pa.RecordBatch:
            held = [{"role": r, "text": t, "fault": f} for r, t, f in now.rows]
            return out([conv_id], [None], part, number, now.summary(), held)

        now, conv_id, part, number, whole = None, None, 0, 0, False
        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            ids, closed = [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text", "gone", "seen")]
            for part, conv_at, turn_at, role_at, text_at, gone, dup in zip(*columns):
                if now is None or conv_at != conv_id:
                    if now is not None:
                        if whole:
                            ids.append(conv_id)
                            closed.append(now.closed())
                        else:
                            yield open_(number)
                            number += 1
                    whole = now is not None     # the first of a task may have begun in the one before
                    now, conv_id = _Chunk(), conv_at
                elif now.full():
                    yield open_(number)
                    now, number, whole = _Chunk(), number + 1, False
                if not gone:
                    now.add(turn_at, role_at, text_at, dup)
            if ids:
                yield out(ids, closed)
        if now is not None:                     # the last of a task may go on in the next one
            yield open_(number)

    found = stored(ranged.mapInArrow(run, f"conv_id {kind.simpleString()}, {_CLOSED}, {_CHUNK}"), "repairs")
    names = ["conv_id", *[f.split()[0] for f in _CLOSED.split(", ")]]
    whole = found.where("part IS NULL").select(*names)
    return whole.unionByName(_across(found.where("part IS NOT NULL").select("conv_id", "part", "chunk", "summary", "rows")).select(*names))


def _across(chunks: DataFrame) -> DataFrame:
    """Conversations in more than one chunk: the chunks' tables are composed (a few hundred
    bytes for CHUNK_ROWS rows), each chunk is searched again from the state it is entered
    in, and the pieces are joined in order. The hash sees the rows as they pass."""
    kind = chunks.schema["conv_id"].dataType
    place = F.struct("part", "chunk")
    parts = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "chunk", "summary"))).alias("s"))
    ways = "array<struct<part:int,chunk:bigint,start:int,end:int,close:string>>"
    counted = ", ".join(_CLOSED.split(", ")[:6])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.column("s").to_pylist():
                counts, steps, close = _composed([x["summary"] for x in s])
                rows.append((*counts, [{"part": x["part"], "chunk": x["chunk"], "start": a, "end": b,
                                        "close": close if i + 1 == len(s) else ""} for i, (x, (a, b)) in enumerate(zip(s, steps))]))
            cols = [pa.array(c, type=pa.int64()) for c in list(zip(*rows))[:6]] if rows else [pa.nulls(0, pa.int64())] * 6
            struct = pa.struct([("part", pa.int32()), ("chunk", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("close", pa.string())])
            last = pa.array([r[6] for r in rows], type=pa.list_(struct))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *cols, last], names=["conv_id", *[f.split()[0] for f in counted.split(", ")], "ways"])

    made = stored(parts.mapInArrow(compose, f"conv_id {kind.simpleString()}, {counted}, ways {ways}"), "ways")
    # `part` and `chunk` name a chunk: a task numbers its own.
    steps = made.select(F.explode("ways").alias("w")).select("w.*")
    todo = chunks.join(steps, ["part", "chunk"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                search = Search(row["start"])
                for r in row["rows"]:
                    search.step(r["role"][:1], r["fault"])
                audit = search.edits(row["end"])
                lines, _ = repaired([(r["role"], r["text"]) for r in row["rows"]], audit, row["start"], row["close"])
                text = "\n".join(f"{r}:{t}" for r, t in lines)
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(i, 1).column("conv_id"), pa.array([row["part"]], type=pa.int32()), pa.array([row["chunk"]], type=pa.int64()),
                     pa.array([audit + row["close"]]), pa.array([text]), pa.array([len(lines)], type=pa.int64())],
                    names=["conv_id", "part", "chunk", "audit", "text", "n"])

    pieces = stored(todo.select("conv_id", "part", "chunk", "start", "end", "close", "rows").mapInArrow(
        edit, f"conv_id {kind.simpleString()}, part int, chunk long, audit string, text string, n long"), "pieces")
    audits = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.sum("n").alias("n_repaired"))
    ordered = pieces.where("n > 0").repartition("conv_id").sortWithinPartitions("conv_id", place).select("conv_id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last, conv_type = None, None, None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                if digest is not None and conv_id == last:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], type=conv_type), pa.array([digest.hexdigest()])], names=["conv_id", "sha"])
                    digest, last = hashlib.sha256(), conv_id
                digest.update(batch.column("text")[i].as_py().encode("utf-8", "replace"))
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], type=conv_type), pa.array([digest.hexdigest()])], names=["conv_id", "sha"])

    hashes = ordered.mapInArrow(hashed, f"conv_id {kind.simpleString()}, sha string").withColumnsRenamed({"conv_id": "_h"})
    audits = audits.withColumnsRenamed({"conv_id": "_a"})
    return (made.join(audits, made["conv_id"].eqNullSafe(audits["_a"])).join(hashes, made["conv_id"].eqNullSafe(hashes["_h"]), "left")
            .withColumn("repaired_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))))
