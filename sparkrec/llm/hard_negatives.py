"""Hard negatives: rows of another label whose inner product with an anchor lies in a window
below that of a positive; found with cover trees over norm-augmented rows.

A row x becomes x' = (x, sqrt(M^2 - |x|^2)) with M the largest norm, an anchor q becomes
(q, 0): all rows lie on one sphere and q'x' = qx. A node of the tree has a centre and the
radius that covers its rows, so their inner products with q lie within |q| times the
radius of that of the centre. The upper level of the tree is common to all tasks: cells
around centres taken from a bounded sample. Rows of a cell go to blocks of bounded size,
each with a tree of its own, and an anchor goes to the blocks of those cells that its
windows reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkrec.llm.common import discard, stored

POSITIVES = 5
NEGATIVES = 5
LOWEST = 80              # per cent of the positive's score
SAMPLE = 2000            # rows for the cells and for the first bounds
CELLS = 64
BLOCK = 65_536           # rows of a tree, about
LEAF = 512               # rows kept by a leaf at most
FAN = 32                 # children of a node at most
LIMIT = 1 << 20          # of a component, so that inner products are exact in double
NONE = 1 << 62

_WINDOWS = "array<struct<lo:bigint,hi:bigint>>"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles; missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat[ends[0]:ends[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def augmented(rows: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.maximum(norm2 - np.einsum("ij,ij->i", rows, rows), 0)
    return np.column_stack([rows, np.sqrt(rest)])


def apart(points: np.ndarray, centre: np.ndarray, norm2: float) -> np.ndarray:
    """Distances on the sphere of radius sqrt(norm2)."""
    return np.sqrt(np.maximum(2 * (norm2 - points @ centre), 0))


def net(points: np.ndarray, first: int, norm2: float, most: int, until: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres by farthest point, each point's centre and its distance: points lie within the
    largest of these distances of their centre, centres at least so far from each other."""
    centres, near = [first], apart(points, points[first], norm2)
    owner = np.zeros(len(points), dtype=np.int64)
    while len(centres) < most:
        far = int(np.argmax(near))
        if near[far] <= until or near[far] == 0:
            break
        new = apart(points, points[far], norm2)
        new[far] = 0
        closer = new < near
        near[closer], owner[closer] = new[closer], len(centres)
        centres.append(far)
    return centres, owner, near


def _reach(radius: np.ndarray, length: float | np.ndarray, norm2: float) -> np.ndarray:
    """How far inner products within a radius can be from that of the centre, rounding included."""
    return length * (radius + 1e-6 * np.sqrt(norm2 + 1)) + 1e-6


class CoverTree:
    """Levels of nested nets. Each node's centre is the centre of one of its children; the
    others follow by farthest point until half its radius is covered, or there are FAN, or
    one for half a leaf of rows. A
    node of at most LEAF rows, or of copies alone, keeps its rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm2: float):
        self.norm2 = norm2
        points = augmented(rows, norm2)
        self.nodes: list = []            # (first, last) of a leaf, else arrays of its children
        order: list[np.ndarray] = []
        filled = 0
        todo = [(np.arange(len(rows)), 0, None, 0)]
        while todo:
            members, centre, parent, place = todo.pop()
            number = len(self.nodes)
            if parent is not None:
                self.nodes[parent][0][place] = number
            near = apart(points[members], points[members[centre]], norm2)
            if len(members) <= LEAF or near.max() == 0:
                self.nodes.append((filled, filled + len(members)))
                order.append(members)
                filled += len(members)
                continue
            most = min(FAN, 2 * len(members) // LEAF + 1)
            centres, owner, distance = net(points[members], centre, norm2, most, near.max() / 2)
            children, radius = [], []
            for k, c in enumerate(centres):
                mine = np.flatnonzero(owner == k)
                todo.append((members[mine], int(np.searchsorted(mine, c)), number, k))
                radius.append(distance[mine].max())
                held = labels[members[mine]]
                children.append((held[0], bool((held == held[0]).all())))
            first, single = zip(*children)
            self.nodes.append((np.zeros(len(centres), dtype=np.int64), rows[members[centres]], np.array(radius),
                               np.array(first), np.array(single)))
        place = np.concatenate(order)
        self.rows, self.ids, self.labels = rows[place], ids[place], labels[place]

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int,
               seen: list[int] | None = None) -> list[list[tuple[int, int]]]:
        """For each window (lowest, highest score) its k best rows as (-score, id): of the same
        label but for the row itself, or of other labels. Nodes come by the highest score
        they can hold; those outside all windows, as far as these are still open, are skipped."""
        length = float(np.sqrt(q @ q))
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors, highs = np.array([w[0] for w in windows], dtype=float), np.array([w[1] for w in windows], dtype=float)
        heap: list[tuple[float, float, int]] = [(-np.inf, -np.inf, 0)]
        while heap:
            upper, lower, number = heapq.heappop(heap)
            if not ((-upper >= floors) & (lower <= highs)).any():
                if -upper < floors.min():
                    break
                continue
            if seen is not None:
                seen.append(number)
            node = self.nodes[number]
            if len(node) > 2:
                at, centres, radius, held, single = node
                scores, reach = centres @ q, _reach(radius, length, self.norm2)
                fit = ((scores + reach)[:, None] >= floors) & ((scores - reach)[:, None] <= highs)
                fit = fit.any(axis=1) & ~(single & ((held != label) if same else (held == label)))
                for i in np.flatnonzero(fit):
                    heapq.heappush(heap, (-(scores[i] + reach[i]), scores[i] - reach[i], int(at[i])))
                continue
            a, b = node
            scores = self.rows[a:b] @ q
            near = np.flatnonzero((scores >= floors.min()) & (scores <= highs.max()))
            if not len(near):
                continue
            scores, ids, held = scores[near], self.ids[a:b][near], self.labels[a:b][near]
            fit = (held == label) & (ids != own) if same else held != label
            for w in range(len(windows)):
                hit = np.flatnonzero(fit & (scores >= floors[w]) & (scores <= highs[w]))
                if len(hit):
                    if len(hit) > k:
                        hit = hit[np.lexsort((ids[hit], -scores[hit]))[:k]]
                    best[w] = sorted(best[w] + [(-int(s), int(i)) for s, i in zip(scores[hit], ids[hit])])[:k]
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], -best[w][-1][0])
        return best


def prepared(rows: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and vec (whole numbers) of the rows that take part."""
    x, label = F.col(vector_col), F.col(label_col).cast("long")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256))
    return rows.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull()).where(sound).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole.alias("vec"))


def _cells(rows: DataFrame, norm2: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the cells, and ids, labels and vectors of the sample they are from."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    vectors = matrix(sample.column("vec"), width)
    points = augmented(vectors, norm2)
    centres = net(points, 0, norm2, CELLS)[0]
    return points[centres], sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), vectors


def _in_cells(rows: DataFrame, centres: np.ndarray, norm2: float, width: int) -> DataFrame:
    """Adds cell (that of the nearest centre) and distance to it."""
    schema = "vec_id long, label long, vec array<long>, cell int, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = augmented(matrix(batch.column("vec"), width), norm2) @ centres.T
            cell = inner.argmax(axis=1)
            far = np.sqrt(np.maximum(2 * (norm2 - inner[np.arange(len(cell)), cell]), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vec")), pa.array(cell.astype(np.int32)), pa.array(far)],
                                             names=["vec_id", "label", "vec", "cell", "distance"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


class _Index:
    """Rows in their blocks, and what is known of the cells on the driver (CELLS rows)."""

    def __init__(self, rows: DataFrame, norm2: float, width: int):
        self.norm2, self.width = norm2, width
        self.centres, self.ids, self.labels, self.sample = _cells(rows, norm2, width)
        self.rows = stored(_in_cells(rows, self.centres, norm2, width), "cells")
        sizes = {r["cell"]: (r["n"], r["far"]) for r in
                 self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
        cells = range(len(self.centres))
        self.radius = np.array([sizes.get(c, (0, 0.0))[1] for c in cells])
        self.blocks = np.array([-(-sizes.get(c, (0, 0.0))[0] // BLOCK) for c in cells])

    def candidates(self) -> DataFrame:
        """Rows with the number of their block."""
        many = F.element_at(F.array(*[F.lit(max(1, int(b))) for b in self.blocks]), F.col("cell") + 1)
        block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(1)), many)
        return self.rows.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "vec")

    def routed(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """Queries (vec_id, label, vec, windows), one row for each block they may find something in.
        The sample's k best rows in a window raise its lower end first."""
        norm2, width, centres, radius, blocks = self.norm2, self.width, self.centres[:, :-1], self.radius, self.blocks
        ids, labels, sample = self.ids, self.labels, self.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix(batch.column("vec"), width)
                length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                inner, known = vectors @ centres.T, vectors @ sample.T
                reach = _reach(radius[None, :], length[:, None], norm2)
                windows, targets = [], []
                rows = zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("windows").to_pylist())
                for i, (own, label, spans) in enumerate(rows):
                    fit = ((labels == label) & (ids != own)) if same else labels != label
                    scores = known[i][fit]
                    mine, open_ = [], np.zeros(len(blocks), dtype=bool)
                    for span in spans:
                        lo, hi = span["lo"], span["hi"]
                        inside = scores[(scores >= lo) & (scores <= hi)]
                        if len(inside) >= k:
                            lo = int(np.partition(inside, len(inside) - k)[len(inside) - k])
                        mine.append({"lo": lo, "hi": hi})
                        if lo <= hi:
                            open_ |= (inner[i] + reach[i] >= lo) & (inner[i] - reach[i] <= hi)
                    windows.append(mine)
                    targets.append([int(c) << 32 | b for c in np.flatnonzero(open_) for b in range(blocks[c])])
                span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("vec_id", "label", "vec")), pa.array(windows, type=span_type), pa.array(targets, type=pa.list_(pa.int64()))],
                    names=["vec_id", "label", "vec", "windows", "blocks"])

        out = queries.select("vec_id", "label", "vec", "windows").mapInArrow(
            run, f"vec_id long, label long, vec array<long>, windows {_WINDOWS}, blocks array<long>")
        return out.select(F.explode("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "vec", "windows")

    def found(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """vec_id, window, score, id, rank: the k best rows of each query's windows.

        Within a task a block's rows come first and become a tree, and the queries stream
        past it. No block sends more than k rows for a window.
        """
        norm2, width = self.norm2, self.width
        both = self.candidates().withColumn("windows", F.lit(None).cast(_WINDOWS)).unionByName(self.routed(queries, same, k))
        both = both.repartition("block").sortWithinPartitions("block", "kind")
        names = ["vec_id", "window", "score", "id"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held, tree = None, [], None
            for batch in batches:
                block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
                cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(block)]):
                    if block[a] != current:
                        current, held, tree = block[a], [], None
                    piece = batch.slice(a, b - a)
                    ids, labels, vectors = piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), matrix(piece.column("vec"), width)
                    if kind[a] == 0:
                        held.append((vectors, ids, labels))
                        continue
                    if tree is None:
                        tree, held = CoverTree(*(np.concatenate(x) for x in zip(*held)), norm2), []
                    rows = []
                    for i, spans in enumerate(piece.column("windows").to_pylist()):
                        hits = tree.search(vectors[i], int(ids[i]), int(labels[i]), same, [(s["lo"], s["hi"]) for s in spans], k)
                        rows += [(int(ids[i]), w, -s, j) for w, best in enumerate(hits) for s, j in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

        rows = both.mapInArrow(run, "vec_id long, window int, score long, id long")
        order = W.partitionBy("vec_id", "window").orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, *, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x), and scores are whole inner products. `anchor` is a
    condition on vec_id. An anchor's positives are the `positives` best other rows of its
    label; for each of them the best `negatives` rows of other labels are returned that
    score from `lowest` per cent of it up to as much. Ties go to the smaller id.

    Rows without an id, label or vector, or with a component that is null or not finite,
    take no part. Of rows that share an id the one with the least label, then vector,
    counts. A shorter vector counts as if zeros followed; a component beyond LIMIT is an
    error, as sums would no longer be exact. A positive without any such row has no rows,
    nor has one with a negative score, whose window is empty. An empty table gives none.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    given = prepared(rows, id_col=id_col, vector_col=vector_col, label_col=label_col)
    one = given.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.*")
    one = stored(one, "vectors")
    square = F.aggregate("vec", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v)
    norm2, width, largest = one.agg(F.max(square), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if norm2 is None:
        return spark.createDataFrame([], out)
    if (largest or 0) > LIMIT or norm2 * 4 > 2 ** 53:
        raise ValueError(f"a component is beyond {LIMIT}, or a norm too large for exact sums")
    index = _Index(one, float(norm2), max(1, width))
    anchors = one.where(anchor)

    anything = F.array(F.struct(F.lit(-NONE).alias("lo"), F.lit(NONE).alias("hi")))
    first = index.found(anchors.withColumn("windows", anything), True, positives)
    first = stored(first.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("best")), "positives")
    windows = F.expr(f"transform(best, b -> struct(if(b.score < 0, {NONE}, (b.score * {int(lowest)} + 99) div 100) AS lo, b.score AS hi))")
    asked = anchors.join(first.select(F.col("vec_id"), windows.alias("windows")), "vec_id")
    found = stored(index.found(asked, False, negatives), "negatives")
    pairs = first.select("vec_id", F.posexplode("best").alias("window", "p"))
    done = found.join(pairs, ["vec_id", "window"]).select(
        F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
    discard(spark, index.rows, one)
    return done
