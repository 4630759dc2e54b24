"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has three tables of cells; a digest goes into one cell of each, and a cell holds
the number, the sum and the sum of checks of its digests. Sketches of two versions are
subtracted cell by cell, what they share vanishes, and peeling (take a cell that holds
one digest, remove it from its other cells) recovers the digests that differ. Where
peeling gets stuck, the pair is tried again with twice the cells.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from sparkrec.llm.common import documents, slices, stored

TABLES = 3
BASE = 8                 # cells a table in the fingerprint
LONGEST = 240            # characters of a paragraph; a longer one is cut
BATCH_CHARS = 2_000_000  # texts compared at once, unless one text is longer

_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHECK = 0xD6E8FEB86659FD93


def paragraphs(text: str) -> list[str]:
    """Lines and sentences, those beyond LONGEST characters in pieces. Never empty."""
    for mark in (". ", "! ", "? "):
        text = text.replace(mark, mark + "\n")
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) <= LONGEST:
            out.append(line)
        else:
            out.extend(line[i:i + LONGEST] for i in range(0, len(line), LONGEST))
    return out


def digests(text: str) -> np.ndarray:
    """A set of 64-bit numbers: the hash of each paragraph, seeded by how often it came before."""
    hashed = xxhash.xxh64_intdigest
    rows = paragraphs(text)
    raw = [p.encode("utf-8", "replace") for p in rows]
    if len(set(raw)) == len(raw):
        return np.array([hashed(p) for p in raw], dtype=np.uint64)
    seen: Counter[bytes] = Counter()
    out = []
    for p in raw:
        out.append(hashed(p, seen[p]))
        seen[p] += 1
    return np.unique(np.array(out, dtype=np.uint64))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Sketches:
    """The sketches of some sets, one after the other: set i has TABLES * sizes[i] cells.
    Sizes are powers of two, so a larger sketch folds onto a smaller one."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(TABLES * self.sizes) - TABLES * self.sizes
        total = int((TABLES * self.sizes).sum())
        self.count = np.zeros(total, dtype=np.int64)
        self.keys = np.zeros(total, dtype=np.uint64)
        self.checks = np.zeros(total, dtype=np.uint64)

    def cell(self, owner: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
        """The cell of each key in one table of its owner's sketch."""
        size = self.sizes[owner]
        return self.starts[owner] + table * size + (_mixed(keys, _SALTS[table]) & (size - 1).astype(np.uint64)).astype(np.int64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> list[np.ndarray]:
        """Add keys, or take them out where sign is -1; gives the cells touched."""
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape)
        factor, checks = sign.astype(np.uint64), _mixed(keys, _CHECK)
        cells = [self.cell(owner, keys, t) for t in range(TABLES)]
        for at in cells:
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * factor)
            np.add.at(self.checks, at, checks * factor)
        return cells

    def __sub__(self, other: Sketches) -> Sketches:
        out = Sketches(self.sizes)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def serialised(self, i: int) -> bytes:
        cut = slice(self.starts[i], self.starts[i] + TABLES * self.sizes[i])
        return self.count[cut].tobytes() + self.keys[cut].tobytes() + self.checks[cut].tobytes()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, key and sign of all digests recovered, and for each sketch whether it came
        out empty, that is, whether nothing is missing. Empties the cells."""
        cell_owner = np.repeat(np.arange(len(self.sizes)), TABLES * self.sizes)
        table = (np.arange(len(self.count)) - self.starts[cell_owner]) // self.sizes[cell_owner]
        touched = [np.flatnonzero((table == t) & (np.abs(self.count) == 1)) for t in range(TABLES)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while any(len(t) for t in touched):
            for t in range(TABLES):  # within one table a key has one cell, so none shows twice
                at, touched[t] = np.unique(touched[t]), np.empty(0, dtype=np.int64)
                at = at[np.abs(self.count[at]) == 1]
                sign = self.count[at]
                keys = self.keys[at] * sign.astype(np.uint64)
                pure = (_mixed(keys, _CHECK) * sign.astype(np.uint64)) == self.checks[at]
                at, keys, sign = at[pure], keys[pure], sign[pure]
                fits = self.cell(cell_owner[at], keys, t) == at
                at, keys, sign = at[fits], keys[fits], sign[fits]
                if len(at):
                    owner = cell_owner[at]
                    found.append((owner, keys, sign))
                    for other, cells in enumerate(self.add(owner, keys, -sign)):
                        if other != t:
                            touched[other] = np.concatenate([touched[other], cells])
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        empty = np.bincount(cell_owner[left], minlength=len(self.sizes)) == 0
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none.astype(np.uint64), none, empty
        owner, keys, sign = (np.concatenate(x) for x in zip(*found))
        return owner, keys, sign, empty


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)


def differences(old: list[np.ndarray], new: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what only the old one has and what only the new one has.

    All pairs begin with an eighth of their digests as cells a table. Those that cannot be
    peeled are tried again with twice as many, until every one is.
    """
    out: list = [None] * len(old)
    todo = np.arange(len(old))
    total = np.array([len(a) + len(b) for a, b in zip(old, new)], dtype=np.int64)
    sizes = np.maximum(BASE // 2, 1 << np.ceil(np.log2(np.maximum(total / 8, 1))).astype(np.int64))
    while len(todo):
        first, second = Sketches(sizes[todo]), Sketches(sizes[todo])
        first.add(*_joined([old[i] for i in todo]))
        second.add(*_joined([new[i] for i in todo]))
        owner, keys, sign, empty = (first - second).peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, sign = owner[order], keys[order], sign[order]
        ends = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(empty):
            own, side = keys[ends[k]:ends[k + 1]], sign[ends[k]:ends[k + 1]]
            out[todo[k]] = (own[side > 0], own[side < 0])
        todo = todo[~empty]
        sizes[todo] *= 2
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray]) -> tuple[list[float], list[int]]:
    """Shared digests as a part of all, and the number of those that differ, for each pair."""
    apart = [len(a) + len(b) for a, b in differences(old, new)]
    both = [len(a) + len(b) for a, b in zip(old, new)]
    return [(n - d) / (n + d) for n, d in zip(both, apart)], apart


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """32 hex digits of each set's sketch of BASE cells a table."""
    sketch = Sketches(np.full(len(sets), BASE))
    sketch.add(*_joined(sets))
    return [hashlib.blake2b(sketch.serialised(i), digest_size=16).hexdigest() for i in range(len(sets))]


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double, n_paragraphs long, differing_edited long, differing_next long")


def _compared(texts: list[str], after: list[str]) -> list[list]:
    """The columns of COLUMNS for texts and those that follow them."""
    changed = [edited(a, b) for a, b in zip(texts, after)]
    known: dict[int, np.ndarray] = {}

    def of(text: str) -> np.ndarray:  # a text is mostly the follower of the one before, too
        if id(text) not in known:
            known[id(text)] = digests(text)
        return known[id(text)]

    own, other, following = [of(t) for t in texts], [digests(t) for t in changed], [of(t) for t in after]
    near, apart = likeness(own + own, other + following)
    prints = fingerprints(own + other)
    n = len(texts)
    return [[len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
            prints[:n], prints[n:], near[:n], near[n:], [len(s) for s in own], apart[:n], apart[n:]]


def _record(ids: list, texts: list[str], after: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = [ids, *_compared(texts, after)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in (
    "edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()),
    *[(n, pa.int64()) for n in ("n_paragraphs", "differing_edited", "differing_next")]])


def revisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS: every document compared with a version of it whose last half is
    replaced by the start of the next document, and with that document.

    The next one is that with the next smaller id; rows with one id follow each other by
    their text, rows without an id come last, and the last row is followed by the first.
    A null text is empty; an empty text has one empty paragraph. A single row follows
    itself. Repeated rows are rows of their own; an empty table gives no rows.

    The rows are sorted by ranges, so that the next one is the next of a task; texts are
    shuffled once. Only a task's first and last row wait for those of its neighbours: two
    rows for each partition, joined by the number of the partition.
    """
    rows = documents(docs, id_col, text_col)
    order = [F.desc_nulls_last("doc_id"), F.asc(F.xxhash64("text"))]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.asc(F.xxhash64("text")), F.asc("text"))
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("text", pa.large_string()), *_OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edge(part: int, side: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            row = [part, side, text, doc_id, *[None] * (len(_OUT) - 1)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        held: tuple[int, int | None, str] | None = None
        for batch in batches:
            sizes = [len(t) for t in batch.column("text").to_pylist()]
            for a, b in slices(batch, sizes, BATCH_CHARS):
                cut = batch.slice(a, b - a)
                ids, texts = cut.column("doc_id").to_pylist(), cut.column("text").to_pylist()
                if held is None:
                    part = cut.column("part")[0].as_py()
                    yield edge(part, 0, ids[0], texts[0])
                else:
                    part, ids, texts = held[0], [held[1], *ids], [held[2], *texts]
                held = (part, ids[-1], texts[-1])
                if len(ids) > 1:
                    done = _record(ids[:-1], texts[:-1], texts[1:], _OUT)
                    blank = [pa.nulls(len(done), f.type) for f in list(schema)[:3]]
                    yield pa.RecordBatch.from_arrays([*blank, *done.columns], schema=schema)
        if held is not None:
            yield edge(held[0], 1, held[1], held[2])

    seen = stored(ranged.mapInArrow(run, "part int, side int, text string, doc_id long, " + COLUMNS), "revisions")
    inner = seen.where("part IS NULL").drop("part", "side", "text")
    return inner.unionByName(_edges(seen.where("part IS NOT NULL").select("part", "side", "doc_id", "text")))


def _edges(edges: DataFrame) -> DataFrame:
    """The last row of each partition compared with the first one of the next, round about.
    What is ordered in one place are the numbers of the partitions that have rows."""
    heads = edges.where("side = 0")
    ring = W.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next"))
    pairs = (edges.where("side = 1").select("part", "doc_id", "text").join(after, "part")
             .join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _record([row["doc_id"]], [row["text"]], [row["following"]], _OUT)

    return pairs.select("doc_id", "text", "following").mapInArrow(run, "doc_id long, " + COLUMNS)


def changed_paragraphs(old: DataFrame, new: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, removed and added (lists of paragraph digests as signed longs, ascending) for
    every id that both tables have; found from sketches alone.

    Rows without an id have no other version. Of rows that share an id all pairs are
    compared, as any join does. A null text is empty. No common id: no rows.
    """
    pairs = documents(old, id_col, text_col).join(
        documents(new, id_col, text_col).withColumnRenamed("text", "later"), "doc_id")
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(a) + len(b) for a, b in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist())]
            for a, b in slices(batch, sizes, BATCH_CHARS):
                cut = batch.slice(a, b - a)
                found = differences(*([digests(t) for t in cut.column(c).to_pylist()] for c in ("text", "later")))
                sides = [pa.array([np.sort(s.view(np.int64)).tolist() for s in side], type=lists) for side in zip(*found)]
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), *sides], names=["doc_id", "removed", "added"])

    return pairs.select("doc_id", "text", "later").mapInArrow(run, "doc_id long, removed array<long>, added array<long>")
