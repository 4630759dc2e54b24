"""Named document collections on Parquet: scan, lookup, index build and repair.

A collection is what its commits say. Rows are appended to folders of their own; a commit
is a small file that names the folders it adds and those it replaces, and appears in one
step once the rows are written. What an append that failed has left behind is in no
commit, and an append that is repeated finds its own. Folders written without commits are
read as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkrec import schemas
from sparkrec.config import DEFAULTS
from sparkrec.operators.filters import where_to_column
from sparkrec.operators.ivf import Cells, as_cells, assign_cells, measure_cells
from sparkrec.operators.models import embed_texts

INCLUDE = {"documents": "document", "metadatas": "meta", "embeddings": "embedding"}
PENDING = "-pending"     # folders of rows that wait for their vectors


# --- commits ------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _commit_folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/_commits/{name}"


def commits(spark: SparkSession, path: str, name: str) -> dict[str, dict]:
    """Id to contents of the commits of a collection, as many as appends were made to it."""
    files, folder = _files(spark, _commit_folder(path, name))
    if not files.exists(folder):
        return {}
    out = {}
    for status in files.listStatus(folder):
        place = status.getPath()
        if place.getName().endswith(".json"):
            stream = files.open(place)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out[place.getName().removesuffix(".json")] = json.loads(text)
    return out


def _commit(spark: SparkSession, path: str, name: str, commit_id: str, contents: dict) -> None:
    """Written under another name, then renamed: there whole, or not at all."""
    files, folder = _files(spark, _commit_folder(path, name))
    files.mkdirs(folder)
    _, draft = _files(spark, f"{_commit_folder(path, name)}/.{commit_id}-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(json.dumps(contents).encode())
    finally:
        stream.close()
    _, place = _files(spark, f"{_commit_folder(path, name)}/{commit_id}.json")
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise ValueError(f"commit {commit_id} is there already")


def _folders(path: str, name: str, made: Mapping[str, dict]) -> list[str]:
    gone = {f for c in made.values() for f in c["replaces"]}
    live = sorted({f for c in made.values() for f in c["adds"]} - gone)
    return [f"{path.rstrip('/')}/collection={name}/append={f}" for f in live]


def _read(spark: SparkSession, path: str, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schemas.COLLECTION)
    table = spark.read.schema(schemas.COLLECTION).option("basePath", path).parquet(*folders)
    return table.where(F.col("collection") == name)


def open_collection(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The named collection (default name when none is given); empty if absent.

    The name is the partition column, so other collections are not read.
    """
    name = name or DEFAULTS.collection
    made = commits(spark, path, name)
    if made:
        return _read(spark, path, name, _folders(path, name, made))
    if _files(spark, f"{path.rstrip('/')}/_commits")[0].exists(_files(spark, f"{path.rstrip('/')}/_commits")[1]):
        return spark.createDataFrame([], schemas.COLLECTION)
    try:
        table = spark.read.schema(schemas.COLLECTION).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.COLLECTION)
    return table.where(F.col("collection") == name)


def read_cells(spark: SparkSession, path: str, name: str | None = None) -> Cells | None:
    """The centres a collection was written with, and the radii over all its appends."""
    made = [c["cells"] for c in commits(spark, path, name or DEFAULTS.collection).values() if c.get("cells")]
    if not made:
        return None
    return Cells(np.array(made[0]["centres"], np.float64), np.max([c["radii"] for c in made], axis=0))


def scan(collection: DataFrame, include: tuple[str, ...] = ("documents", "metadatas")) -> DataFrame:
    """doc_id and the parts asked for; the others are not read."""
    return collection.select("doc_id", *[INCLUDE[i] for i in include])


def get_documents(collection: DataFrame, where: Mapping | None = None,
                  columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Documents that match a filter; no match gives no rows."""
    return collection.where(where_to_column(where, columns)).select("doc_id", "document")


def as_collection(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Complete a table of (doc_id, document, meta) to the collection schema."""
    extra = {}
    if "collection" not in docs.columns:
        extra["collection"] = F.lit(name or DEFAULTS.collection)
    if "category" not in docs.columns:
        extra["category"] = F.col("meta")["categories"]
    if "text_hash" not in docs.columns:
        extra["text_hash"] = F.sha2("document", 256)
    if "embedding" not in docs.columns:
        extra["embedding"] = F.lit(None).cast("array<float>")
    if "cell" not in docs.columns:
        extra["cell"] = F.lit(None).cast("int")
    if "cells" not in docs.columns:
        extra["cells"] = F.lit(None).cast("string")
    return docs.withColumns(extra).select(*schemas.COLLECTION.fieldNames())


def _write(rows: DataFrame, path: str, name: str, folder: str, ordered: bool) -> DataFrame:
    """Rows sorted by category inside files, so a filter on it skips row groups; by cell first
    where they have one."""
    place = f"{path.rstrip('/')}/collection={name}/append={folder}"
    order = ["cell", "category", "doc_id"] if ordered else ["category", "doc_id"]
    as_collection(rows, name).drop("collection").sortWithinPartitions(*order).write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(schemas.COLLECTION).option("basePath", path).parquet(place)


def _append(rows: DataFrame, path: str, name: str, commit_id: str, centres: np.ndarray | Cells | None,
            replaces: list[str]) -> None:
    """Write embedded rows, those that got a vector apart from those that did not, and commit."""
    spark, cells = rows.sparkSession, None if centres is None else as_cells(centres)
    # The model runs once: all rows are written, and split from there.
    folder = f"{commit_id}-{uuid.uuid4().hex[:8]}"
    staged = _write(rows, path, name, folder + "-staged", False)
    found, missing = staged.where("embedding IS NOT NULL"), staged.where("embedding IS NULL")
    adds, contents = [], {"replaces": replaces}
    if not found.isEmpty():
        placed = found if cells is None else assign_cells(found.drop("cell", "cells"), cells)
        written = _write(placed, path, name, folder, cells is not None)
        adds.append(folder)
        if cells is not None:
            contents["cells"] = {"centres": cells.centres.tolist(), "radii": measure_cells(written, cells).radii.tolist()}
    if not missing.isEmpty():
        _write(missing, path, name, folder + PENDING, False)
        adds.append(folder + PENDING)
    files, place = _files(spark, f"{path.rstrip('/')}/collection={name}/append={folder}-staged")
    files.delete(place, True)
    _commit(spark, path, name, commit_id, {"adds": adds, **contents})


def _same_cells(made: Mapping[str, dict], centres: np.ndarray | Cells | None) -> None:
    for c in made.values():
        if c.get("cells") and (centres is None or Cells(np.array(c["cells"]["centres"], np.float64)).fingerprint != as_cells(centres).fingerprint):
            raise ValueError("the collection was written with other centres")


def build_index(docs: DataFrame, path: str, fn: Callable | None = None, name: str | None = None, *,
                batch: int = DEFAULTS.embedding_batch, setup: Callable | None = None,
                centres: np.ndarray | Cells | None = None, append_id: str | None = None) -> DataFrame:
    """Embed and append the documents the collection does not hold yet.

    Running it again adds nothing, and an append that fails leaves nothing that is read. With
    an `append_id` an append that was committed before is not even looked at. Two
    documents of one id are an error, found by looking at the ids alone, so that texts need
    not be shuffled for it. A document whose batch failed keeps its place with a null
    vector until `repair_index` embeds it. With `centres` each document's cell is stored
    and comes first in the order of files, for the search by cells; an append with other
    centres than those before is an error.
    """
    spark = docs.sparkSession
    name, append_id = name or DEFAULTS.collection, append_id or uuid.uuid4().hex
    made = commits(spark, path, name)
    if append_id in made:
        return open_collection(spark, path, name)
    _same_cells(made, centres)
    held = open_collection(spark, path, name)
    if not made and not held.isEmpty():
        raise ValueError("the collection was written without commits; write it anew with build_index")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("document ids occur more than once")
    fresh = docs.join(held.select("doc_id"), "doc_id", "left_anti")
    _append(embed_texts(fresh, fn, batch=batch, setup=setup), path, name, append_id, centres, [])
    return open_collection(spark, path, name)


def repair_index(spark: SparkSession, path: str, fn: Callable, name: str | None = None, *,
                 batch: int = DEFAULTS.embedding_batch, setup: Callable | None = None) -> DataFrame:
    """Embed the documents again whose vectors are missing, and those alone: they lie in
    folders of their own. Rows that fail once more go on waiting. The commit puts the new
    folders in the place of the old ones, so a document is there once at any time."""
    name = name or DEFAULTS.collection
    made = commits(spark, path, name)
    waiting = [f for f in _folders(path, name, made) if f.endswith(PENDING)]
    if waiting:
        rows = _read(spark, path, name, waiting).drop("embedding", "cell", "cells")
        cells = read_cells(spark, path, name)
        _append(embed_texts(rows, fn, batch=batch, setup=setup), path, name, uuid.uuid4().hex, cells,
                [f.rsplit("append=", 1)[1] for f in waiting])
    return open_collection(spark, path, name)
