import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W, functions as F

from sparkrec.operators import ivf, knn
from sparkrec.operators.knn import distance, knn_topk

SCHEMA_Q = "query_id long, variant_no int, embedding array<float>"
SCHEMA_D = "doc_id long, embedding array<float>, text_hash string"


def tables(spark, n_docs=400, n_queries=30, dim=6, seed=0, copies=0.0):
    rng = np.random.default_rng(seed)
    docs = rng.normal(size=(n_docs, dim)).astype(np.float32)
    docs[: int(n_docs * copies)] = docs[0]
    queries = rng.normal(size=(n_queries, dim)).astype(np.float32)
    if copies:
        queries[0] = docs[0]
    d = [(i, [float(x) for x in v], f"h{i}") for i, v in enumerate(docs)]
    q = [(i // 3, i % 3, [float(x) for x in v]) for i, v in enumerate(queries)]
    return (spark.createDataFrame(q, SCHEMA_Q), spark.createDataFrame(d, SCHEMA_D).repartition(5),
            queries.astype(float), docs.astype(float))


def brute(queries, docs, n, metric, keep=lambda qi, di: True):
    out = []
    for qi, q in enumerate(queries):
        if metric == "l2sq":
            dist = ((docs - q) ** 2).sum(1)
        elif metric == "ip":
            dist = 1 - docs @ q
        else:
            dist = 1 - docs @ q / (np.linalg.norm(docs, axis=1) * np.linalg.norm(q))
        rows = sorted((round(x, 9), i) for i, x in enumerate(dist) if keep(qi, i))[:n]
        out += [(qi // 3, qi % 3, r, i) for r, (_, i) in enumerate(rows, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.variant_no, r["rank"], r.doc_id) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_same_as_brute_force(spark, metric):
    q, d, qv, dv = tables(spark)
    assert found(knn_topk(q, d, 7, metric)) == brute(qv, dv, 7, metric)


def test_expression_and_block_distances_agree(spark):
    q, d, _, _ = tables(spark, 40, 6)
    for metric in ("l2sq", "cosine", "ip"):
        hits = knn_topk(q, d, 5, metric)
        exact = hits.join(q, ["query_id", "variant_no"]).join(d.withColumnRenamed("embedding", "dv"), "doc_id")
        gap = exact.select(F.max(F.abs(F.col("distance") - distance(F.col("embedding"), F.col("dv"), metric)))).first()[0]
        assert gap < 1e-12


def test_a_third_of_the_documents_are_copies(spark):
    q, d, qv, dv = tables(spark, copies=0.4)
    assert found(knn_topk(q, d, 9)) == brute(qv, dv, 9, "l2sq")


def test_query_blocks_seeds_and_tasks_change_nothing(spark):
    q, d, qv, dv = tables(spark)
    want = brute(qv, dv, 7, "l2sq")
    assert found(knn_topk(q, d, 7, block_bytes=500)) == want
    assert found(knn_topk(q, d, 7, seeds=d.where("doc_id < 20"), tasks=2)) == want
    assert found(knn_topk(q, d, 7, seeds=d.where("doc_id < 3"))) == want  # too few for a bound


def test_labels_restrict_per_query(spark):
    q, d, qv, dv = tables(spark)
    d = d.withColumn("labels", F.array((F.col("doc_id") % 4).cast("string"), (F.col("doc_id") % 3 + 10).cast("string")))
    q = q.withColumn("allowed", F.when(F.col("variant_no") == 0, F.array(F.lit("1"), F.lit("12")))
                     .when(F.col("variant_no") == 1, F.array(F.lit("none"))))
    keep = lambda qi, di: (di % 4 == 1 or di % 3 == 2) if qi % 3 == 0 else qi % 3 == 2
    assert found(knn_topk(q, d, 6, allowed="allowed", labels="labels")) == brute(qv, dv, 6, "l2sq", keep)


def test_small_and_broken_inputs(spark):
    q, d, qv, dv = tables(spark, n_docs=3)
    assert len(found(knn_topk(q, d, 10))) == 30 * 3
    assert found(knn_topk(q, d.limit(0), 10)) == []
    assert found(knn_topk(q.limit(0), d, 10)) == []
    odd = spark.createDataFrame([(7, None, "x"), (8, [1.0], "y")], SCHEMA_D)
    assert found(knn_topk(q, d.unionByName(odd), 10)) == found(knn_topk(q, d, 10))
    no_vector = spark.createDataFrame([(99, 0, None)], SCHEMA_Q)
    assert found(knn_topk(q.unionByName(no_vector), d, 10)) == found(knn_topk(q, d, 10))


def test_carried_columns_belong_to_their_document(spark):
    q, d, _, _ = tables(spark)
    assert all(r.text_hash == f"h{r.doc_id}" for r in knn_topk(q, d, 4, carry=["text_hash"]).collect())


def test_zero_vector_has_cosine_distance_one(spark):
    q = spark.createDataFrame([(0, 0, [0.0, 0.0])], SCHEMA_Q)
    d = spark.createDataFrame([(1, [1.0, 0.0], "a")], SCHEMA_D)
    assert knn_topk(q, d, 1, "cosine").first().distance == 1.0


def test_documents_are_not_shuffled(spark):
    q, _, _, _ = tables(spark, 20, 3)
    zeros = F.array(*[F.lit(0.0)] * 6).cast("array<float>")
    docs = spark.range(10).select(F.col("id").alias("doc_id"), zeros.alias("embedding"))
    plan = knn_topk(q, docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_approximate_search(spark):
    q, d, qv, dv = tables(spark)
    centres = ivf.train_cells(d, 6)
    exact = knn_topk(q, d, 5)
    assert found(ivf.knn_approximate(q, d, 5, centres, 6)) == found(exact)
    some = ivf.recall(ivf.knn_approximate(q, d, 5, centres, 2), exact)
    values = [r.recall for r in some.collect()]
    assert len(values) == 30 and all(0 <= v <= 1 for v in values) and np.mean(values) > 0.4


def test_lists_leave_a_task_in_small_batches():
    """What a task sends is made some rows at a time, so it holds no second copy of its lists."""
    n, rows = 20, 60_000
    best = knn._Best(np.zeros((rows, 2)), n, "l2sq", 1)
    best.used[:], best.payload[0][:] = True, "h" * 64
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64()), ("text_hash", pa.string())])
    tracemalloc.start()
    sent = 0
    for batch in knn._lists(best, {"keys": [np.arange(rows)]}, ["text_hash"], schema):
        sent += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == n * rows and peak < 10 << 20


def test_labels_of_a_block_take_arrays():
    """Many labels for each query become arrays at once, not Python objects."""
    rows, cells = 4000, 256
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * cells + 1, cells), pa.int32()), pa.array(np.tile(np.arange(cells), rows), pa.int32()))
    table = pa.table({"query_id": np.arange(rows), "_vector": pa.ListArray.from_arrays(pa.array(np.arange(rows + 1), pa.int32()), pa.array(np.zeros(rows))),
                      "_bound": pa.nulls(rows, pa.float64()), "_allowed": lists})
    tracemalloc.start()
    held = knn._block(table, ["query_id"], True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((held["askers"][held["codes"][c]] == np.arange(rows)).all() for c in range(cells)) and not len(held["free"])
    assert peak < 48 * rows * cells


def test_a_large_query_table_goes_in_blocks(spark, monkeypatch):
    """20,000 queries with lists of 20 texts' hashes are more than a task holds at once."""
    made = []
    blocks = knn._blocks
    monkeypatch.setattr(knn, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    q = spark.range(20_000).select(F.col("id").alias("query_id"), F.lit(0).alias("variant_no"), F.array_repeat(F.rand(1).cast("float"), 4).alias("embedding"))
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.array_repeat(F.rand(2).cast("float"), 4).alias("embedding"), F.sha2(F.col("id").cast("string"), 256).alias("text_hash"))
    assert knn_topk(q, d, 20, carry=["text_hash"]).count() == 400_000
    assert len(made) == 1 and len(made[0]) > 1


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("shift", [0.0, 1e4, 1e13])
def test_far_from_zero_the_result_is_exact(spark, metric, shift):
    """Single precision only proposes; far from zero it cannot tell the vectors apart."""
    rng = np.random.default_rng(3)
    docs, asked = rng.normal(size=(300, 5)) + shift, rng.normal(size=(12, 5)) + shift
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(asked)], "query_id long, variant_no int, embedding array<double>")
    want = q.withColumnRenamed("embedding", "qv").crossJoin(d).withColumn("x", distance(F.col("qv"), F.col("embedding"), metric))
    w = W.partitionBy("query_id", "variant_no").orderBy("x", "doc_id")
    want = want.withColumn("rank", F.row_number().over(w)).where("rank <= 6")
    assert found(knn_topk(q, d, 6, metric)) == found(want)


def test_as_many_lists_as_tasks_run_at_a_time(spark):
    """What a query's lists hold does not grow with the partitions of the documents."""
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).repartition(50)
    q = spark.createDataFrame([(1, 0, [3.2, 1.0])], "query_id long, variant_no int, embedding array<float>")
    hits = knn_topk(q, d, 3)
    assert f"Coalesce {spark.sparkContext.defaultParallelism}\n" in hits._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in hits.orderBy("rank").collect()] == [3, 4, 2]


def test_places_of_few_marks():
    from sparkrec.operators.knn import _places

    rng = np.random.default_rng(3)
    for shape in ((4, 16), (3, 5), (1, 8), (0, 4)):
        marked = rng.random(shape) < 0.2
        assert all((a == b).all() for a, b in zip(_places(marked), np.nonzero(marked)))


def measured(monkeypatch):
    """How many pairs of a query and a document are compared from now on."""
    pairs, real = [], knn._Best._add_tile
    monkeypatch.setattr(knn._Best, "_add_tile", lambda self, which, docs, *a: (pairs.append(len(which) * len(docs.vectors)), real(self, which, docs, *a))[1])
    return pairs


@pytest.mark.parametrize("dim", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "line", "bound"])
def test_cells_change_nothing(monkeypatch, dim, kind):
    """Ties, copies, vectors on a line and far from all documents, by cells and without."""
    monkeypatch.setattr(knn, "LEAF", 16)
    rng = np.random.default_rng(dim)
    docs, asked = rng.normal(size=(700, dim)), rng.normal(size=(90, dim))
    if kind == "grid":
        docs, asked = np.round(docs), np.round(asked)
    elif kind == "copies":
        docs[:500], asked[:5] = docs[0], docs[0]
    elif kind == "line":
        docs[:, 1:], asked[:40] = 0.5, asked[:40] * 1e6
    ids = rng.permutation(700) * 3
    words = np.array([f"w{i}" for i in ids], object)
    want = knn._Best(asked, 7, "l2sq", 1)
    want.add(np.arange(90), docs, ids, [words])
    bound = np.where(np.arange(90) % 3, want.dist[:, 6], np.inf) if kind == "bound" else None
    got = knn._Best(asked, 7, "l2sq", 1, bound)
    got.add_tree(knn._Tree(docs, ids, [words], 7, "l2sq"))
    assert (got.used == want.used).all() and (got.ids == want.ids).all() and (got.dist == want.dist).all()
    assert (got.payload[0] == want.payload[0]).all()


def test_a_query_meets_few_cells(monkeypatch):
    rng = np.random.default_rng(4)
    docs, asked = rng.random((40_000, 4)), rng.random((1000, 4))
    best, pairs = knn._Best(asked, 5, "l2sq", 0), measured(monkeypatch)
    best.add_tree(knn._tree_for(best, (docs, np.arange(40_000), [])))
    assert sum(pairs) < 0.2 * 40_000 * 1000
    assert best.ids[7].tolist() == np.argsort(((docs - asked[7]) ** 2).sum(1))[:5].tolist()


def test_cells_are_left_where_they_save_nothing():
    rng = np.random.default_rng(5)
    docs, asked = rng.normal(size=(9000, 64)), rng.normal(size=(50, 64))
    tree = lambda q, d, metric="l2sq": knn._tree_for(knn._Best(q, 5, metric, 0), (d, np.arange(len(d)), []))
    assert tree(asked, docs) is None  # without clusters all are about as far
    few = docs[:, :3]
    assert tree(asked[:, :3], few) and tree(asked[:, :3], few, "ip") is None and tree(asked[:, :3], few[:100]) is None
    few[3, 0] = np.nan
    assert tree(asked[:, :3], few) is None


def test_blocks_of_queries_use_cells(spark, tmp_path, monkeypatch):
    """Many blocks of queries past many documents: the result of one block, with less compared."""
    vector = lambda seed, most: F.array(*[F.round(F.rand(seed + i) * most, 2).cast("float") for i in range(3)]).alias("embedding")
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), vector(1, 9)).coalesce(1)
    q = spark.range(900).select((F.col("id") / 3).cast("long").alias("query_id"), (F.col("id") % 3).cast("int").alias("variant_no"), vector(11, 10))
    d.write.parquet(f"{tmp_path}/d")
    q.write.parquet(f"{tmp_path}/q")
    d, q = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/q")
    in_blocks = knn_topk(q, d, 5, block_bytes=40_000, tasks=1)
    assert sorted(in_blocks.collect()) == sorted(knn_topk(q, d, 5).collect())
    # What a task does, here: the same rows out of the blocks, and fewer pairs.
    uris = knn._blocks(q.select("query_id", "variant_no", F.col("embedding").alias("_vector"), F.lit(None).cast("double").alias("_bound")), ["query_id", "variant_no"], 300, 3)
    batch = d.select(F.col("doc_id").alias("_id"), F.col("embedding").alias("_vector")).toArrow().combine_chunks().to_batches()
    schema = pa.schema([("query_id", pa.int64()), ("variant_no", pa.int32()), ("doc_id", pa.int64()), ("distance", pa.float64())])
    pairs = measured(monkeypatch)
    sent = [r for b in knn._scan_blocks(iter(batch), uris, ("query_id", "variant_no"), False, 5, "l2sq", (), schema, 32 << 20) for r in b.to_pylist()]
    assert len(uris) > 1 and {(r["query_id"], r["variant_no"], r["doc_id"]) for r in sent} == {(r.query_id, r.variant_no, r.doc_id) for r in in_blocks.collect()}
    assert sum(pairs) < 0.5 * 900 * 20_000
