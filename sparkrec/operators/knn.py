"""k-nearest-neighbour join of query vectors with a document table.

The documents are never shuffled and no pair is emitted: each task streams its
part of the document table past a block of query vectors and keeps the n best
documents per query. What leaves a task is at most n rows per query, ranked once
more in the JVM. The query block is broadcast only up to a byte bound; a larger
query table is written to the shared folder in blocks of that size, and each task
streams the blocks past the documents it holds, so these are still read once. Where
the vectors allow it, a query then meets only the cells of those documents that may
hold one of its n nearest.
Documents with a hot value (source, cell, category) need no special care, since
nothing is grouped by it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sparkrec.storage import cut_lineage, scratch_path

METRICS = ("l2sq", "cosine", "ip")
BLOCK_BYTES = 32 << 20   # bound on what a task holds for one block of queries, and of documents at a time
MOST_TASKS = 10_000      # each sends at most n rows per query, which bounds what meets in one sort
TILE = 1024              # queries handled at a time inside a task, at most
PAIRS = 2 << 20          # distances at a time
ROWS = 8192              # documents at a time
LEAF = 1024              # documents of a cell at most
FIRST = 0.25             # of a query's distance so far: cells that are nearer come first
WORTH = 0.5              # cells that few queries pass by are not used
PUSHED = 1000            # labels that go to the scan as a filter at most; it only saves work
# Slack on the matrix-product distance; survivors are measured exactly.
SLACK = 1e-9
SAFE = 1e12              # single precision is for vectors of smaller numbers


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two vectors as an expression, summed in double, in order."""
    zero = F.lit(0.0)

    def total(terms: Column) -> Column:
        return F.aggregate(terms, zero, lambda acc, x: acc + x)

    def dot(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))

    if metric == "l2sq":
        return total(F.zip_with(
            a, b,
            lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
        ))
    if metric == "ip":
        return 1 - dot(a, b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norm)


# --- inside a task ------------------------------------------------------------

def _single(v: np.ndarray) -> bool:
    """Whether products of these vectors stay finite in single precision."""
    return bool(v.size) and bool(np.abs(v).max() < SAFE)  # false with NaN


def _approximate(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ d.T
    if metric == "l2sq":
        return (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2.0 * dots
    if metric == "ip":
        return 1.0 - dots
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((d * d).sum(1))[None, :]
    return 1.0 - np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)


def _factors(v: np.ndarray, metric: str, of_query: bool) -> np.ndarray:
    """Vectors whose product is the distance, less the query's square for l2sq and less 1
    for the others: one single-precision product then gives what is compared."""
    if metric == "l2sq":
        last = np.ones(len(v)) if of_query else (v * v).sum(1)
        v = np.column_stack((-2.0 * v if of_query else v, last))
    else:
        if metric == "cosine":
            norm = np.sqrt((v * v).sum(1))[:, None]
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        v = -v if of_query else v
    return v.astype(np.float32)


def _ordered_sum(x: np.ndarray) -> np.ndarray:
    # Left to right, as the column expression adds.
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _exact(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2sq":
        return _ordered_sum((q - d) ** 2)
    dots = _ordered_sum(q * d)
    if metric == "ip":
        return 1.0 - dots
    norm = np.sqrt(_ordered_sum(q * q)) * np.sqrt(_ordered_sum(d * d))
    return 1.0 - np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)


def _measured(q: np.ndarray, i: np.ndarray, d: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of the pairs (i, j), in pieces: many may tie at a cut."""
    step = max(1, (1 << 20) // max(d.shape[1], 1))
    parts = [_exact(q[i[at:at + step]], d[j[at:at + step]], metric) for at in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _at_most_n_copies(vectors: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows to keep so that no vector is held more than n times (smallest ids).

    More than n copies of one vector cannot all be among the n nearest, and a
    large group of copies would otherwise all tie at the cut.
    """
    # Equal vectors have equal sums, so only rows of crowded sums can be such copies.
    weights = np.sin(np.arange(1.0, vectors.shape[1] + 1))
    _, group, counts = np.unique((vectors * weights).sum(axis=1), return_inverse=True, return_counts=True)
    crowded = counts[group] > n
    if not crowded.any():
        return np.arange(len(ids))
    suspects = np.flatnonzero(crowded)
    block = np.ascontiguousarray(vectors[suspects])
    raw = block.view(np.dtype((np.void, block.dtype.itemsize * block.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids[suspects], group))
    by_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(by_group, by_group, side="left")
    return np.sort(np.concatenate((np.flatnonzero(~crowded), suspects[order[place < n]])))


def _places(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a table with few marks: eight cells are looked at in one step."""
    flat = marked.reshape(-1)
    if not len(flat) % 8:
        words = np.flatnonzero(flat.view(np.uint64))
        nth, cell = np.nonzero(flat.reshape(-1, 8)[words])
        flat = words[nth] * 8 + cell
    else:
        flat = np.flatnonzero(flat)
    return np.divmod(flat, marked.shape[1])


class _Documents:
    """Some documents, ready to be compared."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.vectors, self.single = vectors, _single(vectors)
        if self.single:
            self.factors = _factors(vectors, metric, False)
            self.longest = float(np.sqrt((vectors * vectors).sum(1).max()))


class _Cell:
    """A box around some documents, halved along its longest side until LEAF are left."""

    def __init__(self, tree: "_Tree", rows: np.ndarray, data: tuple, metric: str):
        vectors, ids, payload = data
        own = vectors[rows]
        self.low, self.high = own.min(0), own.max(0)
        if len(rows) <= LEAF:
            self.number, self.halves = len(tree.leaves), ()
            tree.leaves.append(self)
            self.content = _Documents(own, metric), ids[rows], [p[rows] for p in payload]
            return
        self.side = int((self.high - self.low).argmax())
        half = len(rows) // 2
        order = np.argpartition(own[:, self.side], half)
        self.value = own[order[half], self.side]
        self.halves = tuple(_Cell(tree, rows[x], data, metric) for x in (order[:half], order[half:]))

    def apart(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of queries from the box; no document in it is nearer."""
        gap = np.maximum(self.low - queries, queries - self.high)
        np.maximum(gap, 0.0, out=gap)
        return np.einsum("ij,ij->i", gap, gap)

    def homes(self, queries: np.ndarray, which: np.ndarray) -> Iterator[tuple["_Cell", np.ndarray]]:
        """Each of the queries `which` with the one leaf on its side of all halvings."""
        if not len(which):
            return
        if not self.halves:
            yield self, which
            return
        left = queries[which, self.side] < self.value
        for half, some in zip(self.halves, (which[left], which[~left])):
            yield from half.homes(queries, some)


class _Tree:
    """Documents in cells, for squared distances of ordinary numbers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, payload: list[np.ndarray], n: int, metric: str):
        self.leaves: list[_Cell] = []
        self.root = _Cell(self, _at_most_n_copies(vectors, ids, n), (vectors, ids, payload), metric)

    def saves(self, queries: np.ndarray, vectors: np.ndarray, n: int) -> bool:
        """Whether some of the queries pass by enough of the cells, once they know their n nearest."""
        asked = queries[::max(1, len(queries) // 64)]
        near = np.array([np.partition(((vectors - q) ** 2).sum(1), n - 1)[n - 1] for q in asked])
        met = sum(len(leaf.content[1]) * np.count_nonzero(leaf.apart(asked) <= near) for leaf in self.leaves)
        return met <= WORTH * len(vectors) * len(asked)


def _tree_for(best: "_Best", opened: tuple) -> _Tree | None:
    """Cells of the documents `opened`, where they save a block of queries work."""
    vectors, ids, payload = opened
    if best.metric != "l2sq" or not best.single or not _single(vectors) or len(ids) < max(8 * LEAF, 4 * best.n):
        return None
    tree = _Tree(vectors, ids, payload, best.n, best.metric)
    return tree if tree.saves(best.queries, vectors, best.n) else None


class _Best:
    """Running n best per query: row q holds its documents in (distance, id) order."""

    def __init__(self, queries: np.ndarray, n: int, metric: str, payload: int,
                 bound: np.ndarray | None = None):
        self.queries, self.n, self.metric, self.bound = queries, n, metric, bound
        shape = (len(queries), n)
        self.dist = np.full(shape, np.inf)
        self.ids = np.full(shape, np.iinfo(np.int64).max, np.int64)
        self.used = np.zeros(shape, bool)
        self.payload = [np.empty(shape, object) for _ in range(payload)]
        self.single = _single(queries)
        if self.single:
            self.factors, self.squares = _factors(queries, metric, True), (queries * queries).sum(1)

    def add(self, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray, payload: list[np.ndarray]):
        keep = _at_most_n_copies(vectors, ids, self.n)
        if len(keep) < len(ids):
            vectors, ids, payload = vectors[keep], ids[keep], [p[keep] for p in payload]
        dim = max(vectors.shape[1], 1)
        for at in range(0, len(ids), ROWS):
            some = slice(at, at + ROWS)
            part = _Documents(vectors[some], self.metric)
            # Tiles bound both the distance matrix and the survivors' vectors.
            tile = max(1, min(TILE, PAIRS // len(part.vectors), (16 << 20) // (8 * self.n * dim)))
            for start in range(0, len(which), tile):
                self._add_tile(which[start:start + tile], part, ids[some], [p[some] for p in payload])

    def add_tree(self, tree: _Tree) -> None:
        """As `add` of all that is in `tree`: each query first meets the leaf it lies in, then
        the cells within part of the distance it has by then, then all others within it."""
        everyone = np.arange(len(self.queries))
        home = np.empty(len(everyone), np.int64)
        for leaf, which in tree.root.homes(self.queries, everyone):
            home[which] = leaf.number
            self._add_leaf(which, leaf)
        first = self._cut(everyone) * FIRST
        self._walk(tree.root, everyone, home, None, first)
        self._walk(tree.root, everyone, home, first, None)

    def _walk(self, cell: _Cell, which: np.ndarray, home: np.ndarray, seen: np.ndarray | None, until: np.ndarray | None) -> None:
        """Leaves below `cell` farther than `seen`, up to `until` or to what each query has."""
        apart = cell.apart(self.queries[which])
        near = apart <= (self._cut(which) * (1 + SLACK) if until is None else until[which])
        which, apart = which[near], apart[near]
        if cell.halves:
            for half in cell.halves if len(which) else ():
                self._walk(half, which, home, seen, until)
            return
        new = home[which] != cell.number
        if seen is not None:
            new &= apart > seen[which]
        self._add_leaf(which[new], cell)

    def _add_leaf(self, which: np.ndarray, leaf: _Cell) -> None:
        docs, ids, payload = leaf.content
        tile = max(1, min(PAIRS // len(ids), (16 << 20) // (8 * self.n * max(docs.vectors.shape[1], 1))))
        for start in range(0, len(which), tile):
            self._add_tile(which[start:start + tile], docs, ids, payload)

    def _cut(self, which: np.ndarray) -> np.ndarray:
        """What a document must not exceed to be among the n of a query."""
        cut = self.dist[which, self.n - 1]
        return cut if self.bound is None else np.minimum(cut, self.bound[which])

    def _distances(self, which: np.ndarray, docs: _Documents) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is compared, a constant of each query it lacks, and by how much it may be wrong."""
        if not (self.single and docs.single):
            own, d = self.queries[which], docs.vectors
            with np.errstate(over="ignore", invalid="ignore"):
                size = (np.sqrt((own * own).sum(1)) + np.sqrt((d * d).sum(1).max())) ** 2 if self.metric != "cosine" else np.ones(len(which))
                wrong = np.where(np.isnan(size), 0.0, 2 * (d.shape[1] + 8) * np.finfo(np.float64).eps * size)
            return _approximate(own, d, self.metric), np.zeros(len(which)), wrong
        approx = self.factors[which] @ docs.factors.T
        if self.metric == "l2sq":
            lacks, size = self.squares[which], docs.longest ** 2 + 2 * docs.longest * np.sqrt(self.squares[which])
        else:
            lacks = np.ones(len(which))
            size = np.ones(len(which)) if self.metric == "cosine" else docs.longest * np.sqrt(self.squares[which])
        # Rounding of the factors, and of each sum; twice, as cuts are approximate, too.
        wrong = 2 * (docs.vectors.shape[1] + 8) * float(np.finfo(np.float32).eps) * size + 1e-30
        return approx, lacks, wrong

    @staticmethod
    def _within(approx, cut, wrong):
        slack = SLACK * (1.0 + np.abs(np.where(np.isfinite(cut), cut, 0.0))) + wrong
        limit = cut + slack
        if approx.dtype == np.float32:
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        return _places(approx <= limit[:, None])

    def _add_tile(self, which, docs, ids, payload):
        approx, lacks, wrong = self._distances(which, docs)
        vectors = docs.vectors
        cut = self._cut(which) - lacks
        wrong = wrong + SLACK * lacks
        empty = np.isinf(cut).all() and approx.shape[1] > 4 * self.n
        row, col = (None, None) if empty else self._within(approx, cut, wrong)
        if empty or len(row) > 4 * self.n * len(which) and approx.shape[1] > self.n:
            # Too many pass, as in the first batch: find this batch's own cut.
            own = np.partition(approx, self.n - 1, axis=1)[:, self.n - 1].astype(np.float64)
            row, col = self._within(approx, np.minimum(cut, own), wrong)
        if not len(row):
            return
        new_q = which[row]
        touched = np.unique(new_q)
        held_row, held_col = np.nonzero(self.used[touched])
        held_q = touched[held_row]
        all_q = np.concatenate((held_q, new_q))
        all_dist = np.concatenate((self.dist[held_q, held_col],
                                   _measured(self.queries, new_q, vectors, col, self.metric)))
        all_ids = np.concatenate((self.ids[held_q, held_col], ids[col]))
        order = np.lexsort((all_ids, all_dist, all_q))
        by_query = all_q[order]
        place = np.arange(len(order)) - np.searchsorted(by_query, by_query, side="left")
        order, place = order[place < self.n], place[place < self.n]
        target = (all_q[order], place)
        merged = [np.concatenate((p[held_q, held_col], new[col]))[order]
                  for p, new in zip(self.payload, payload)]
        self.dist[target] = all_dist[order]
        self.ids[target] = all_ids[order]
        self.used[target] = True
        for p, m in zip(self.payload, merged):
            p[target] = m


def _label_groups(lists: pa.Array, codes: dict) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows of a batch by the set of their labels that some query asks for."""
    offsets = lists.offsets.to_numpy()
    n = len(offsets) - 1
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    known = np.array([codes.get(v, -1) for v in flat.dictionary.to_pylist()] + [-1], np.int64)
    code = known[flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    owner, code = owner[code >= 0], code[code >= 0]
    if not len(owner) or np.bincount(owner).max() <= 1:
        single = np.full(n, -1, np.int64)
        single[owner] = code
        order = np.argsort(single, kind="stable")
        values, starts = np.unique(single[order], return_index=True)
        for value, rows in zip(values, np.split(order, starts[1:])):
            yield ((int(value),) if value >= 0 else ()), rows
        return
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    groups: dict[tuple[int, ...], list[int]] = {}
    for row in range(n):
        groups.setdefault(tuple(code[bounds[row]:bounds[row + 1]]), []).append(row)
    for labels, rows in groups.items():
        yield labels, np.array(rows)


def _opened(batch: pa.RecordBatch, payload_names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Vectors, ids and payload of a batch of documents."""
    lists = batch.column("_vector").flatten().to_numpy(zero_copy_only=False)
    vectors = lists.reshape(batch.num_rows, -1).astype(np.float64)
    payload = [np.array(batch.column(p).to_pylist(), object) for p in payload_names]
    return vectors, batch.column("_id").to_numpy(zero_copy_only=False), payload


def _feed(best: _Best, held: dict, batch: pa.RecordBatch, opened: tuple) -> None:
    """Measure a batch of documents against a block of queries."""
    vectors, ids, payload = opened
    if held["askers"] is None:
        best.add(np.arange(len(held["vectors"])), vectors, ids, payload)
        return
    for labels, rows in _label_groups(batch.column("_labels"), held["codes"]):
        takers = np.unique(np.concatenate([held["free"], *(held["askers"][c] for c in labels)]))
        if len(takers):
            best.add(takers, vectors[rows], ids[rows], [x[rows] for x in payload])


def _lists(best: _Best, held: dict, payload_names: Sequence[str], out_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    queries = max(1, 10_000 // best.n)  # a batch at a time
    for start in range(0, len(best.used), queries):
        query, place = np.nonzero(best.used[start:start + queries])
        if not len(query):
            continue
        query += start
        columns = [pa.array(k[query]) for k in held["keys"]]
        columns += [pa.array(best.ids[query, place]), pa.array(best.dist[query, place])]
        columns += [pa.array(p[query, place].tolist(), out_schema.field(name).type)
                    for p, name in zip(best.payload, payload_names)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)


def _scan(batches: Iterator[pa.RecordBatch], block, n: int, metric: str,
          payload_names: Sequence[str], out_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One block of queries, which a task keeps while it reads its documents."""
    held = block.value
    best = _Best(held["vectors"], n, metric, len(payload_names), held["bound"])
    for batch in batches:
        if batch.num_rows:
            _feed(best, held, batch, _opened(batch, payload_names))
    yield from _lists(best, held, payload_names, out_schema)


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def read_block(uri: str) -> pa.Table:
    """A file of the shared folder, opened by Arrow."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as source:
        return pq.read_table(source)


def _scan_blocks(batches: Iterator[pa.RecordBatch], uris: Sequence[str], keys: Sequence[str], allowed: bool, n: int,
                 metric: str, payload_names: Sequence[str], out_schema: pa.Schema, buffer_bytes: int) -> Iterator[pa.RecordBatch]:
    """Many blocks of queries: a task holds as many of its documents as fit the bound, and
    streams the blocks past them out of the shared folder. Documents are read once. Where the
    first block shows that cells of them save work, no block meets them all."""
    for documents in _buffers(batches, buffer_bytes):
        documents = pa.concat_batches(documents)
        opened = _opened(documents, payload_names)
        tree = None
        for uri in uris:
            held = _block(read_block(uri), keys, allowed)
            best = _Best(held["vectors"], n, metric, len(payload_names), held["bound"])
            if uri == uris[0] and not allowed:
                tree = _tree_for(best, opened)
            if tree and best.single:
                best.add_tree(tree)
            else:
                _feed(best, held, documents, opened)
            yield from _lists(best, held, payload_names, out_schema)


def _block(table: pa.Table, keys: Sequence[str], allowed: bool) -> dict:
    """Rows of queries (keys, _vector, _bound, _allowed) as numpy arrays."""
    table = table.combine_chunks()
    lists = table.column("_vector").combine_chunks()
    vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    block = {
        "keys": [table.column(k).to_numpy() for k in keys],
        "vectors": vectors, "askers": None, "codes": None, "free": None, "bound": None,
    }
    if table.column("_bound").null_count < table.num_rows:
        bounds = table.column("_bound").to_numpy(zero_copy_only=False)
        block["bound"] = np.where(np.isnan(bounds), np.inf, bounds)
    if allowed:
        rows = table.column("_allowed").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        owner, flat = np.repeat(np.arange(len(rows)), sizes), rows.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        code = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(code[code >= 0] * max(len(rows), 1) + owner[code >= 0])  # each label once for a query
        code, owner = np.divmod(pairs, max(len(rows), 1))
        block.update(askers=np.split(owner, np.searchsorted(code, np.arange(1, len(names)))), codes={x: i for i, x in enumerate(names)},
                     free=np.flatnonzero(rows.is_null().to_numpy(zero_copy_only=False)))
    return block


# --- on the driver: query blocks of bounded size ----------------------------------

def _narrow(queries: DataFrame, keys: Sequence[str], vector: str, allowed: str | None) -> DataFrame:
    bound = F.col("_bound") if "_bound" in queries.columns else F.lit(None).cast("double")
    wanted = F.col(allowed) if allowed else F.lit(None).cast("array<string>")
    return queries.where(F.col(vector).isNotNull()).select(
        *keys, F.col(vector).alias("_vector"), bound.alias("_bound"), wanted.alias("_allowed"))


def _blocks(asked: DataFrame, keys: Sequence[str], rows: int, n_blocks: int) -> list[str]:
    """`asked` as files of at most `rows` rows in the shared folder; no vector passes the driver."""
    path = scratch_path(asked.sparkSession, "queries")
    asked.repartition(n_blocks, *keys).write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(asked.sparkSession.read.schema(asked.schema).parquet(path).inputFiles())


def _arrow_opens(uri: str) -> bool:
    try:
        files, path = fs.FileSystem.from_uri(uri)
        return files.get_file_info(path).type == fs.FileType.File
    except (pa.ArrowException, OSError):
        return False


def knn_topk(
    queries: DataFrame,
    docs: DataFrame,
    n: int,
    metric: str = "l2sq",
    keys: Sequence[str] = ("query_id", "variant_no"),
    vector: str = "embedding",
    allowed: str | None = None,
    labels: str | None = None,
    carry: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
    seeds: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """The n nearest documents of each query, exact.

    Returns `keys`, rank (from 1), doc_id, distance and the `carry` columns of the
    document. With `allowed` (a list per query; null: no restriction) and `labels`
    (a list per document) a document counts only when the two lists overlap.
    Ties go to the smaller doc_id.

    Keys must be integers, unique among the queries; a repeated key is an error.

    Two settings save work on very large tables and never change the result.
    `seeds` is any part of `docs` (one file, say): its n-th best distance bounds
    that of the whole, so tasks send only documents within it. `tasks` joins scan
    splits into that many longer tasks at most, each sending one n-best list; where it is
    not given there are as many as run at a time (MOST_TASKS at most), so that the lists
    grow with the queries and not with the documents as well.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if seeds is not None:
        near = knn_topk(queries, seeds, n, metric, keys, vector, allowed, labels, block_bytes=block_bytes)
        bounds = cut_lineage(near.where(F.col("rank") == n).select(*keys, F.col("distance").alias("_bound")), "bounds")
        queries = queries.join(bounds, list(keys), "left")
    spark = docs.sparkSession
    tasks = tasks or min(MOST_TASKS, max(1, spark.sparkContext.defaultParallelism))
    fields = [T.StructField(k, queries.schema[k].dataType) for k in keys]
    fields += [T.StructField("doc_id", T.LongType()), T.StructField("distance", T.DoubleType())]
    fields += [T.StructField(c, docs.schema[c].dataType) for c in carry]
    schema = T.StructType(fields)
    arrow = pa.schema([
        *[pa.field(k, pa.int32() if queries.schema[k].dataType == T.IntegerType() else pa.int64()) for k in keys],
        pa.field("doc_id", pa.int64()), pa.field("distance", pa.float64()),
        *[pa.field(c, _arrow_type(docs.schema[c].dataType)) for c in carry],
    ])
    narrow = [F.col("doc_id").cast("long").alias("_id"), F.col(vector).alias("_vector"), *carry]
    if labels:
        kind = docs.schema[labels].dataType
        narrow.append(F.coalesce(F.col(labels), F.array().cast(kind)).alias("_labels"))
    docs = docs.select(*narrow)

    asked = _narrow(queries, keys, vector, allowed)
    count, shortest, dim, most_labels = asked.agg(
        F.count(F.lit(1)), F.min(F.size("_vector")), F.max(F.size("_vector")),
        F.max(F.coalesce(F.size("_allowed"), F.lit(0)))).first()
    if not count:
        return rank_hits(spark.createDataFrame([], schema), n, keys)
    if shortest != dim:
        raise ValueError("query vectors differ in length")
    # Vectors of another length cannot be compared; the index check counts them.
    usable = docs.where(F.size("_vector") == dim).coalesce(tasks)
    # Vectors in double and single precision, labels as they are read and by label, and the list.
    per_query = dim * 16 + max(most_labels, 0) * 40 + n * (17 + 128 * len(carry))
    repeated = f"{', '.join(keys)} occur more than once among the queries"
    options = dict(n=n, metric=metric, payload_names=tuple(carry), out_schema=arrow)

    def passed(table: pa.Table, docs: DataFrame) -> DataFrame:
        """The documents past one block, which is broadcast."""
        block = _block(table, keys, bool(allowed))
        if allowed and not len(block["free"]) and len(block["codes"]) <= PUSHED:
            docs = docs.where(F.arrays_overlap("_labels", F.array(*[F.lit(c) for c in block["codes"]]).cast(kind)))
        body = functools.partial(_scan, block=spark.sparkContext.broadcast(block), **options)
        return docs.mapInArrow(lambda it: body(it), schema)

    n_blocks = max(1, math.ceil(count * per_query / block_bytes))
    if n_blocks == 1:
        table = asked.toArrow()
        if table.num_rows != table.group_by(list(keys)).aggregate([]).num_rows:
            raise ValueError(repeated)
        return rank_hits(passed(table, usable), n, keys)
    if not asked.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(repeated)
    uris = _blocks(asked, keys, max(1, block_bytes // per_query), n_blocks)
    if _arrow_opens(uris[0]):
        body = functools.partial(_scan_blocks, uris=uris, keys=tuple(keys), allowed=bool(allowed), buffer_bytes=BLOCK_BYTES, **options)
        hits = usable.mapInArrow(lambda it: body(it), schema)
    else:  # one pass over the documents for each block
        parts = (spark.read.schema(asked.schema).parquet(uri).toArrow() for uri in uris)
        hits = functools.reduce(DataFrame.unionByName, [passed(p, usable) for p in parts])
    return rank_hits(hits, n, keys)


def _arrow_type(t: T.DataType) -> pa.DataType:
    simple = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(),
              T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
    if t not in simple:
        raise TypeError(f"cannot carry a column of type {t.simpleString()}")
    return simple[t]


def rank_hits(hits: DataFrame, n: int, keys: Sequence[str] = ("query_id", "variant_no")) -> DataFrame:
    """Rank in distance order and cut to n.

    Rows are placed by the first key alone, so that merging and chunking, which
    work per query, need no further shuffle. A query has at most n rows per task.
    """
    w = W.partitionBy(*keys).orderBy("distance", "doc_id")
    ranked = hits.repartition(keys[0]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    rest = [c for c in hits.columns if c not in (*keys, "doc_id", "distance")]
    return ranked.select(*keys, "rank", "doc_id", "distance", *rest)
