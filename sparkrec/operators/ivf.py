"""Search by cells: documents get a cell, a query looks into its nearest cells, and on
request into all further ones that could hold a nearer document.

Cells decide only which pairs are measured. The documents stay where they are, so
a cell that holds a third of them is no hot partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkrec.operators.knn import knn_topk, rank_hits
from sparkrec.storage import cut_lineage


@dataclass(frozen=True)
class Cells:
    """Centres, and how far the documents of each cell lie from its centre at most (-1: the
    cell is empty) where that is known."""

    centres: np.ndarray
    radii: np.ndarray | None = None

    @cached_property
    def fingerprint(self) -> str:
        """Of the centres; documents keep it beside their cell."""
        return hashlib.sha256(np.ascontiguousarray(self.centres, np.float64).tobytes()).hexdigest()[:16]


def as_cells(centres: np.ndarray | Cells) -> Cells:
    return centres if isinstance(centres, Cells) else Cells(np.asarray(centres, np.float64))


def measure_cells(docs: DataFrame, centres: np.ndarray | Cells, vector: str = "embedding") -> Cells:
    """The cells with their radii, from documents that have their cell: one pass over the
    vectors, and a row for each cell to the driver."""
    cells = as_cells(centres)
    check_cells(docs, cells)
    held = docs.sparkSession.sparkContext.broadcast(cells.centres)

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        far = np.full(len(c), -1.0)
        for batch in batches:
            own = batch.column("cell").to_numpy()
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1])
            np.maximum.at(far, own, np.sqrt(((v - c[own]) ** 2).sum(1)))
        seen = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(far[seen])], names=["cell", "far"])

    usable = docs.where(F.col("cell").isNotNull() & (F.size(vector) == cells.centres.shape[1])).select("cell", F.col(vector).alias("v"))
    radii = np.full(len(cells.centres), -1.0)
    for row in usable.mapInArrow(farthest, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():
        radii[row["cell"]] = row["far"]
    return Cells(cells.centres, radii)


def check_cells(docs: DataFrame, cells: Cells) -> None:
    """Documents placed by other centres are an error; what is stored with each file shows it."""
    if "cells" in docs.columns and not docs.where(F.col("cells") != cells.fingerprint).isEmpty():
        raise ValueError("the documents were placed in cells of other centres")


def train_cells(docs: DataFrame, cells: int, seed: int = 42, vector: str = "embedding",
                fraction: float | None = None) -> np.ndarray:
    """Centres of `cells` k-means cells, fitted to all vectors, or to a `fraction` of them
    where one is given."""
    vectors = docs.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("features"))
    if fraction is not None:
        vectors = vectors.sample(fraction, seed)
    # Training reads its rows many times; the documents are read once.
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(cut_lineage(vectors, "vectors"))
    return np.array(model.clusterCenters())


def nearest_cells(df: DataFrame, centres: np.ndarray, probes: int, out: str, vector: str = "embedding"
                  ) -> DataFrame:
    """Add the numbers of the `probes` nearest cells of each vector, nearest first."""
    held = df.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))  # cells * dim doubles
    probes = min(probes, len(centres))

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = held.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), -1).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(sizes == c.shape[1])
            v = batch.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1])
            near = np.empty((len(good), probes), np.int32)
            for at in range(0, len(good), 1024):
                part = v[at:at + 1024]
                apart = (c * c).sum(1)[None, :] - 2 * part @ c.T
                near[at:at + 1024] = np.argsort(apart, axis=1, kind="stable")[:, :probes]
            ends = np.cumsum(np.r_[0, np.where(sizes == c.shape[1], probes, 0)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))
            yield pc.if_else(pa.array(sizes == c.shape[1]), lists, pa.scalar(None, lists.type))

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(place, T.ArrayType(T.IntegerType())).asNondeterministic()
    return df.withColumn(out, udf(F.col(vector)))


def assign_cells(docs: DataFrame, centres: np.ndarray | Cells, vector: str = "embedding") -> DataFrame:
    """Add `cell` (int) and `cells` (which centres); done once, when the collection is written
    (see `build_index`)."""
    cells = as_cells(centres)
    placed = nearest_cells(docs, cells.centres, 1, "_cells", vector).withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")
    return placed.withColumn("cells", F.when(F.col("cell").isNotNull(), cells.fingerprint))


def _placed(docs: DataFrame, cells: Cells) -> DataFrame:
    """`docs` with their cells, which a collection written without centres has the column for only."""
    if "cell" not in docs.columns or not docs.where("cell IS NULL AND embedding IS NOT NULL").isEmpty():
        return assign_cells(docs.drop("cell", "cells"), cells)
    check_cells(docs, cells)
    return docs


def _within(probing: DataFrame, docs: DataFrame, n: int, probe: str, keys: Sequence[str], allowed: str | None,
            labels: str | None, **knn) -> DataFrame:
    """Nearest documents in the cells listed in `probe`. The cells asked for, of which there
    are as many as centres at most, go to the scan as a filter."""
    asked = [r[0] for r in probing.select(F.explode(probe)).distinct().collect()]
    docs = docs.where(F.col("cell").isin(asked))
    if allowed is None:
        return knn_topk(probing, docs.withColumn("_at", F.array("cell")), n, keys=keys, allowed=probe, labels="_at", **knn)
    # A label of both: "cell/label", and "cell/" for queries that may have any label.
    both = F.when(F.col(allowed).isNull(), F.transform(probe, lambda p: F.concat(p.cast("string"), F.lit("/")))).otherwise(
        F.flatten(F.transform(probe, lambda p: F.transform(allowed, lambda a: F.concat(p.cast("string"), F.lit("/"), a)))))
    marks = F.transform(F.concat(F.array(F.lit("")), F.coalesce(labels, F.array().cast("array<string>"))),
                        lambda x: F.concat(F.col("cell").cast("string"), F.lit("/"), x))
    return knn_topk(probing.withColumn("_both", both), docs.withColumn("_at", marks), n, keys=keys, allowed="_both",
                    labels="_at", **knn)


def knn_approximate(queries: DataFrame, docs: DataFrame, n: int, centres: np.ndarray | Cells, probes: int,
                    keys: Sequence[str] = ("query_id", "variant_no"), allowed: str | None = None,
                    labels: str | None = None, **knn) -> DataFrame:
    """Nearest documents within the `probes` cells nearest to each query.

    Documents with a stored `cell` are read only where some query looks. With `allowed` and
    `labels` a document must match in both ways.
    """
    cells = as_cells(centres)
    probing = cut_lineage(nearest_cells(queries, cells.centres, probes, "_probe"), "probes")
    return _within(probing, _placed(docs, cells), n, "_probe", keys, allowed, labels, **knn)


def further_cells(queries: DataFrame, cells: Cells, probe: str, bound: str, out: str, vector: str = "embedding") -> DataFrame:
    """Add the cells outside `probe` that may hold a document as near as `bound` (a squared
    distance; null: as near as any). By the triangle inequality no document of a cell is
    nearer than the distance of its centre less its radius."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def look(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        centres, radii = held.value.centres, held.value.radii
        for vectors, probed, bounds in batches:
            lists = []
            for v, seen, limit in zip(vectors.to_pylist(), probed.to_pylist(), bounds.to_pylist()):
                if v is None or len(v) != centres.shape[1]:
                    lists.append(None)
                    continue
                far = np.sqrt(((np.array(v, np.float64) - centres) ** 2).sum(1))
                nearest = np.maximum(far - radii, 0) * (1 - 1e-9) - 1e-9
                fit = (radii >= 0) & ((nearest <= 0) | (nearest ** 2 <= (np.inf if limit is None else limit)))
                fit[[c for c in seen or ()]] = False
                lists.append(np.flatnonzero(fit).tolist())
            yield pa.array(lists, pa.list_(pa.int32()))

    look.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(look, T.ArrayType(T.IntegerType())).asNondeterministic()
    return queries.withColumn(out, udf(F.col(vector), F.col(probe), F.col(bound)))


def knn_by_cells(queries: DataFrame, docs: DataFrame, n: int, cells: Cells, probes: int = 1,
                 keys: Sequence[str] = ("query_id", "variant_no"), allowed: str | None = None,
                 labels: str | None = None, **knn) -> DataFrame:
    """The n nearest documents of each query, exact, without reading cells that cannot help.

    The `probes` nearest cells give each query a bound; then it looks into just those
    further cells that the triangle inequality does not rule out. Squared distances only,
    and cells with radii (`measure_cells`, `read_cells`).
    """
    if knn.get("metric", "l2sq") != "l2sq":
        raise ValueError("cells bound squared distances only")
    if cells.radii is None:
        raise ValueError("cells without radii bound nothing")
    docs = _placed(docs, cells)
    probing = cut_lineage(nearest_cells(queries, cells.centres, probes, "_probe"), "probes")
    near = cut_lineage(_within(probing, docs, n, "_probe", keys, allowed, labels, **knn), "near")
    bounds = near.where(F.col("rank") == n).select(*keys, F.col("distance").alias("_bound"))
    more = cut_lineage(further_cells(probing.join(bounds, list(keys), "left"), cells, "_probe", "_bound", "_more"), "further")
    far = _within(more.where(F.size("_more") > 0), docs, n, "_more", keys, allowed, labels, **knn)
    return rank_hits(near.drop("rank").unionByName(far.drop("rank")), n, keys)


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str] = ("query_id", "variant_no")) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    pairs = [*keys, "doc_id"]
    marked = exact.select(*pairs).join(
        found.select(*pairs).withColumn("_found", F.lit(True)), pairs, "left")
    return marked.groupBy(*keys).agg((F.count("_found") / F.count(F.lit(1))).alias("recall"))
