"""Filters, merge, chunks, confidence, rerank, models and evaluation."""

import re

import pytest
from pyspark.sql import functions as F

from sparkrec.config import Params
from sparkrec.operators import chunk, confidence, counts, dimension, evaluate, filters, merge, models, rerank
from sparkrec.plans.answer import answer
from sparkrec.plans.recommend import recommend, run_pipeline
from sparkrec.plans.retrieve import retrieve
from sparkrec.sources.collection import as_collection

HITS = "query_id long, variant_no int, rank int, doc_id long, distance double, text_hash string"


# --- filters -------------------------------------------------------------------

META = [(1, {"k": "a", "n": "3"}), (2, {"k": "b", "n": "10"}), (3, {"n": "x"}), (4, {})]


@pytest.mark.parametrize("where,ids", [
    (None, [1, 2, 3, 4]), ({}, [1, 2, 3, 4]), ({"k": "a"}, [1]), ({"k": {"$ne": "a"}}, [2, 3, 4]),
    ({"n": {"$gt": 3}}, [2]), ({"n": {"$gte": 3, "$lt": 10}}, [1]), ({"n": {"$lte": 10}}, [1, 2]),
    ({"k": {"$in": ["a", "b"]}}, [1, 2]), ({"k": {"$nin": ["a"]}}, [2, 3, 4]), ({"k": {"$in": []}}, []),
    ({"$or": [{"k": "a"}, {"n": 10}]}, [1, 2]), ({"$and": [{"k": "b"}, {"n": {"$gt": 5}}]}, [2]),
    ({"$or": [{"$and": [{"k": "a"}, {"n": 9}]}, {"n": "x"}]}, [3])])
def test_where(spark, where, ids):
    df = spark.createDataFrame(META, "id long, meta map<string,string>")
    assert [r.id for r in df.where(filters.where_to_column(where)).orderBy("id").collect()] == ids


def test_filters_on_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, "de")], "doc_id long, lang string").write.parquet(path)
    pushed = lambda where: spark.read.parquet(path).where(
        filters.where_to_column(where, {"lang": F.col("lang")}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in pushed({"lang": "de"})
    assert "In(lang, [de,fr])" in pushed({"lang": {"$in": ["de", "fr"]}})
    assert "Or(EqualTo(lang,de),GreaterThan(lang,x))" in pushed({"$or": [{"lang": "de"}, {"lang": {"$gt": "x"}}]})


def test_prompt_check(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, " \t")], "query_id long, text string")
    ids = lambda d: sorted(r.query_id for r in d.collect())
    ok, bad = filters.split_prompts(df)
    assert (ids(ok), ids(bad)) == ([1, 4], [2, 3])
    ok, bad = filters.split_prompts(df, strict=True)
    assert (ids(ok), ids(bad)) == ([1], [2, 3, 4])
    assert {r.error for r in bad.collect()} == {"input_prompt is required"}


# --- merge and chunks -------------------------------------------------------------

def test_first_seen_keeps_variant_and_rank_order(spark):
    hits = spark.createDataFrame([
        (1, 0, 1, 10, 0.1, "a"), (1, 0, 2, 11, 0.2, "b"), (1, 1, 1, 12, 0.05, "b"), (1, 1, 2, 13, 0.1, "c"),
        (1, 2, 1, 10, 0.1, "a"), (2, 0, 1, 13, 0.3, "c")], HITS)
    merged = merge.merge_first_seen(hits)
    got = [(r.query_id, r.pos, r.doc_id) for r in merged.orderBy("query_id", "pos").collect()]
    assert got == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (2, 1, 13)]
    again = merge.dedup_first_seen(merged.drop("pos"))
    assert again.count() == merged.count()
    assert [r.doc_id for r in merge.not_seen_before(merged, hits.where("variant_no = 2")).orderBy("query_id", "doc_id").collect()] \
        == [11, 13, 13]


def test_rrf_counts_a_text_once_per_variant(spark):
    hits = spark.createDataFrame([
        (1, 0, 1, 10, 0.1, "a"), (1, 0, 2, 9, 0.2, "a"), (1, 0, 3, 11, 0.3, "b"), (1, 1, 1, 12, 0.1, "b")], HITS)
    got = {r.text_hash: (r.pos, r.rrf_score, r.doc_id) for r in merge.merge_hits(hits, "rrf").collect()}
    assert got["b"] == (1, round(1 / 63 + 1 / 61, 12), 11) and got["a"] == (2, round(1 / 61, 12), 10)
    with pytest.raises(ValueError):
        merge.merge_hits(hits, "other")


@pytest.mark.parametrize("n", [0, 1, 5, 6, 35])
def test_chunks_are_full_but_the_last(spark, n):
    docs = spark.createDataFrame([(1, i + 1, i, f"t{i}", {}) for i in range(n)],
                                 "query_id long, pos int, doc_id long, document string, meta map<string,string>")
    rows = chunk.assemble_chunks(docs, 5).orderBy("chunk_index").collect()
    assert [r.num_docs_in_chunk for r in rows] == [5] * (n // 5) + ([n % 5] if n % 5 else [])
    assert [d.document for r in rows for d in r.docs] == [f"t{i}" for i in range(n)]
    assert [d.doc_no for r in rows for d in r.docs] == [i % 5 + 1 for i in range(n)]
    total = chunk.query_summary(spark.createDataFrame([(1,)], "query_id long"), docs, 5).first()
    assert (total.total_docs_retrieved, total.num_chunks, total.chunk_size) == (n, -(-n // 5), 5)


# --- confidence ---------------------------------------------------------------------

def plain_confidence(query, docs, distances, p=Params()):
    if not docs or not distances:
        return 0.0
    top = 1 - distances[0]
    similarity = max(0.0, min(1.0, top))
    if len(distances) < 2:
        steady = 1.0
    elif top <= 0:
        steady = 0.0
    else:
        steady = max(0.0, min(1.0, sum(1 - d for d in distances) / len(distances) / top))
    words = set(re.findall(r"\w+", query.lower()))
    corpus = " ".join(docs).lower()
    overlap = sum(w in corpus for w in words) / len(words) if words else 0.0
    return p.alpha * similarity + p.beta * steady + p.gamma * overlap


@pytest.mark.parametrize("query,docs,distances", [
    ("deep nets", ["Deep learning", "nets"], [0.12, 0.15, 0.17, 0.18][:2]),
    ("a b c", ["x", "y", "z", "a"], [0.12, 0.60, 0.75, 0.80]),
    ("cat", ["concatenate"], [0.3]), ("?!", ["x", "y"], [0.2, 0.3]), ("w", ["w", "v"], [1.0, 1.2]),
    ("w", ["w", "v"], [1.4, 1.5]), ("é É", ["ÉTÉ"], [0.0]), ("q", [], [])])
def test_confidence(spark, query, docs, distances):
    queries = spark.createDataFrame([(1, query)], "query_id long, text string")
    rows = [(1, i + 1, d, t) for i, (d, t) in enumerate(zip(distances, docs))]
    hits = spark.createDataFrame(rows, "query_id long, rank int, distance double, document string")
    got = confidence.confidence(queries, hits).first()
    want = plain_confidence(query, docs, distances)
    assert got.confidence == pytest.approx(want, abs=1e-4)
    assert got.use_collection == (round(want, 4) >= 0.75)


# --- model functions -----------------------------------------------------------------

def test_embed_keeps_rows_of_failing_batches(spark):
    def fn(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 2 else "x" * i + "\n") for i in range(6)],
                               "doc_id long, document string").coalesce(1)
    got = {r.doc_id: r.embedding for r in models.embed_texts(df, fn, batch=2).collect()}
    assert got == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: None, 3: None, 4: [5.0, 1.0], 5: [6.0, 1.0]}
    short = models.embed_texts(df, lambda texts: [[1.0]], batch=2)
    assert {r.embedding for r in short.collect()} == {None}
    built = models.embed_texts(df, setup=lambda: fn, batch=1)
    check = counts.embedding_check(built.withColumn("collection", F.lit("c")), 2).first()
    assert (check.n_expected, check.n_received, check.n_wrong_size) == (6, 5, 0)


REQ = "query_id long, chunk_index int, system string, prompt string, model string"


def test_generate_retries_and_reports(spark):
    def setup():
        tried = {}

        def call(system, prompt, model):
            tried[prompt] = tried.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "third" and tried[prompt] < 3):
                raise ValueError("no")
            return None if prompt == "empty" else prompt + "!"
        return call

    df = spark.createDataFrame([(1, 1, "s", p, "m") for p in ("a", "third", "never", "empty")], REQ).coalesce(1)
    got = {r.prompt: (r.response, r.error) for r in models.generate(df, setup=setup).collect()}
    assert got == {"a": ("a!", None), "third": ("third!", None), "never": (None, "ValueError: no"), "empty": ("", None)}


def test_token_stream_errors(spark):
    def fn(system, prompt, model):
        yield from ("x", "", "y")
        if prompt == "late":
            raise ValueError

    def dead(system, prompt, model):
        raise ValueError
        yield

    df = spark.createDataFrame([(1, 1, "s", "fine", "m"), (1, 2, "s", "late", "m")], REQ)
    rows = models.stream_tokens(df, fn, retries=1).orderBy("chunk_index", "token_no").collect()
    assert [(r.chunk_index, r.token) for r in rows] == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "x"), (2, "y")]
    assert {r.token for r in models.stream_tokens(df, dead).collect()} == {
        "[Error generating response for chunk 1]", "[Error generating response for chunk 2]"}


# --- rerank ----------------------------------------------------------------------------

def test_rerank_cut_bounds_and_failure(spark):
    cands = spark.createDataFrame([(1, v, r, 10 * v + r) for v in (0, 1, 2) for r in range(1, 7)],
                                  "query_id long, variant_no int, rank int, doc_id long")
    results = spark.createDataFrame(
        [(1, 0, 1, 5, 0.9, None), (1, 0, 2, 99, 0.8, None), (1, 0, 3, -1, 0.7, None), (1, 0, 4, 0, 0.6, None),
         (1, 0, 5, 2, 0.5, None), (1, 1, None, None, None, "down")], rerank.RESULT_SCHEMA)
    rows = rerank.apply_results(cands, results, top_n=2, top_k=3).orderBy("variant_no", "rank").collect()
    # The third variant got an empty answer, so nothing of it stays.
    assert [(r.variant_no, r["rank"], r.doc_id, r.rerank_score) for r in rows] == [
        (0, 1, 6, 0.9), (0, 2, 1, 0.6), (1, 1, 11, None), (1, 2, 12, None), (1, 3, 13, None)]


def test_cross_score_sort_is_stable(spark):
    cands = spark.createDataFrame([(1, 0, r, r, s) for r, s in enumerate([0.5, 0.9, 0.5, 0.9], 1)],
                                  "query_id long, variant_no int, rank int, doc_id long, cross_score double")
    rows = rerank.cut_by_score(cands, 3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [2, 4, 1]


# --- evaluation, dimension, whole runs -----------------------------------------------------

def test_faithfulness(spark):
    claims = spark.createDataFrame([(1, 1, "a", "YES", True), (1, 1, "b", "NO", False), (1, 2, None, None, None),
                                    (1, 3, "c", "YES", True)],
                                   "query_id long, chunk_index int, claim string, verdict string, supported boolean")
    scores = evaluate.chunk_faithfulness(claims)
    got = {r.chunk_index: (r.total_claims, r.supported_claims, r.faithfulness_score) for r in scores.collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, None), 3: (1, 1, 1.0)}
    assert evaluate.aggregate_faithfulness(scores).first().aggregate_faithfulness == 0.75
    chunks = scores.select("query_id", "chunk_index")
    shown = {r.chunk_index: r.evaluation for r in evaluate.with_evaluation(chunks, scores, claims).collect()}
    assert [c.claim for c in shown[1].claims] == ["a", "b"] and shown[2].faithfulness_score is None


def test_category_dimension(spark):
    dim = dimension.category_table(spark)
    rows = spark.createDataFrame([("cs.LG",), ("xx",)], "code string")
    named = {r.code: (r.name, r.known) for r in dimension.name_categories(rows, dim).collect()}
    assert named == {"cs.LG": ("Machine Learning", True), "xx": (None, False)}
    assert [tuple(r) for r in dimension.unknown_categories(rows, dim).collect()] == [("xx", 1)]
    from sparkrec.functions.prompts import category_list
    assert dimension.render_categories(dim).first().category_list == category_list()


def small_collection(spark):
    docs = spark.createDataFrame([(i, f"text {i % 9}", {"categories": "cs.LG" if i % 2 else "cs.CL"}) for i in range(12)],
                                 "doc_id long, document string, meta map<string,string>")
    return models.embed_texts(as_collection(docs), lambda ts: [[float(t[-1]), 1.0] for t in ts])


def test_whole_run(spark):
    queries = spark.createDataFrame([(1, "nearest 0"), (2, "nearest 8")], "query_id long, text string")

    def model(system, prompt, model_name):
        if "abstracts" in system:
            return "hypothetical 3"
        if "librarian" in system:
            return '{"abstracted_query": "broad 5", "categories": [], "confidence": "low"}'
        if "search queries" in system:
            return '["other 1", "nearest 0"]'
        return f"answer to {prompt.splitlines()[0]}"

    params = Params(top_k=3, chunk_size=2)
    embed = lambda ts: [[float(t[-1]), 1.0] for t in ts]
    run = run_pipeline(queries, small_collection(spark), model, params, embed=embed)
    first = {r.query_id: r for r in run.results.collect()}[1]
    texts = [d.document for c in first.responses for d in c.docs]
    assert len(texts) == len(set(texts)) == first.total_docs_retrieved
    assert [c.chunk_index for c in first.responses] == list(range(1, first.num_chunks + 1))
    assert first.responses[0].generated_response == "answer to User query: nearest 0"
    assert [r.text for r in run.variants.where("query_id = 1").orderBy("variant_no").collect()] == [
        "nearest 0", "hypothetical 3", "broad 5", "other 1"]


def test_empty_collection_and_failing_model(spark):
    queries = spark.createDataFrame([(1, "q 1")], "query_id long, text string")
    embed = lambda ts: [[float(t[-1]), 1.0] for t in ts]
    variants = queries.selectExpr("query_id", "0 as variant_no", "text")

    def model(*_):
        raise RuntimeError("down")

    none = recommend(queries, small_collection(spark).limit(0), model, Params(), embed=embed, variants=variants).first()
    assert (none.total_docs_retrieved, none.num_chunks, none.responses) == (0, 0, [])
    failed = recommend(queries, small_collection(spark), model, Params(), embed=embed, variants=variants).first()
    assert {c.generated_response for c in failed.responses} == {"[Error generating response for chunk 1]"}


def test_filter_without_match_is_dropped(spark):
    variants = spark.createDataFrame([(1, 0, [0.0, 1.0])], "query_id long, variant_no int, embedding array<float>")
    docs = small_collection(spark)
    ids = lambda where: [r.doc_id for r in retrieve(variants, docs, Params(top_k=3), where=where).orderBy("rank").collect()]
    assert ids({"categories": "none"}) == ids(None) == [0, 9, 1]
    assert ids({"categories": "cs.LG"}) == [9, 1, 11]


def test_equal_prompts_are_answered_once(spark):
    queries = spark.createDataFrame([(i, "same") for i in range(20)], "query_id long, text string")
    chunks = spark.createDataFrame([(i, 1, 1, [(1, 1, "doc", {"a": "b"})]) for i in range(20)],
                                   "query_id long, chunk_index int, num_docs_in_chunk int, docs array<struct<doc_no:int,"
                                   "doc_id:long,document:string,meta:map<string,string>>>")
    seen = spark.sparkContext.accumulator(0)

    def model(*_):
        seen.add(1)
        return "r"

    assert {r.generated_response for r in answer(queries, chunks, model).collect()} == {"r"}
    assert seen.value == 1


def test_approximate_retrieval_with_every_cell_is_exact(spark):
    import numpy as np
    variants = spark.createDataFrame([(1, 0, [0.0, 1.0])], "query_id long, variant_no int, embedding array<float>")
    docs, params = small_collection(spark), Params(top_k=4)
    centres = np.array([[0.0, 1.0], [5.0, 1.0]])
    ids = lambda **search: [r.doc_id for r in retrieve(variants, docs, params, **search).orderBy("rank").collect()]
    assert ids(centres=centres, probes=2) == ids()
    assert ids(centres=centres, probes=1) == ids()  # the nearest four lie in the first cell
