"""Repeated questions, attached texts, options of retrieval, failing batches."""

import hashlib
import json
import os
import re
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkrec import storage
from sparkrec.config import Params
from sparkrec.functions.prompts import expansion_system
from sparkrec.operators import bloom, knn
from sparkrec.operators.filters import where_to_column
from sparkrec.operators.knn import knn_topk
from sparkrec.plans.recommend import recommend, run_events, run_pipeline
from sparkrec.plans.retrieve import attach_documents, retrieve
from sparkrec.sources.prompts import as_queries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file

calls = {expansion_system(k, 4): k for k in ("hyde", "step_back", "fusion")}


def model(system, prompt, name):
    kind = calls.get(system)
    if kind == "fusion":
        return json.dumps([prompt + " again", "other"])
    return {"hyde": "passage", "step_back": "not json"}.get(kind, "answer")


def embed(texts):
    return [[b / 255 for b in hashlib.md5(t.encode()).digest()[:4]] for t in texts]


def papers(spark, n=40):
    rows = [(i, f"text {i}", {"categories": "ab"[i % 2]}, "ab"[i % 2], embed([f"text {i}"])[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, document string, meta map<string,string>, category string, embedding array<float>")


def test_repeats_get_what_the_first_got(spark):
    texts = ["near 2", "near 2", "far", "near 2", ""]
    asked = as_queries(spark.createDataFrame([(t,) for t in texts], "input_prompt string"))
    run = run_pipeline(asked, papers(spark), model, Params(top_k=3), embed=embed)
    got = {}
    for r in run.results.collect():
        shown = [[d["document"] for d in c["docs"]] for c in r["responses"]]
        got.setdefault(r["query"], []).append((r["total_docs_retrieved"], r["num_chunks"], shown))
    assert len(got["near 2"]) == 3 and all(x == got["near 2"][0] for x in got["near 2"])
    alone = recommend(as_queries(spark.createDataFrame([("near 2",)], "input_prompt string")), papers(spark), model,
                      Params(top_k=3), embed=embed).first()
    assert alone["total_docs_retrieved"] == got["near 2"][0][0] and alone["num_chunks"] == len(got["near 2"][0][2])
    done = run_events(run).where("type = 'complete'").select("elapsed_ms").first()[0]
    assert done >= sum(round(1000 * run.seconds[k]) for k in ("variants", "retrieval", "answers"))


def test_repeated_keys_are_refused(spark):
    asked = spark.createDataFrame([(1, 0, [1.0] * 4), (1, 0, [2.0] * 4)], "query_id long, variant_no int, embedding array<float>")
    with pytest.raises(ValueError, match="more than once"):
        knn_topk(asked, papers(spark), 2)


def test_many_blocks_give_what_one_gives(spark):
    rows = [(i, 0, embed([f"q{i}"])[0]) for i in range(50)]
    asked = spark.createDataFrame(rows, "query_id long, variant_no int, embedding array<float>")
    one, many = (sorted(map(tuple, knn_topk(asked, papers(spark), 3, block_bytes=b).collect())) for b in (1 << 20, 1000))
    assert one == many and len(one) == 150


def test_one_scan_for_twenty_blocks(spark, tmp_path, monkeypatch):
    """Query blocks lie in the shared folder: the documents are read once, and no vector passes the driver."""
    papers(spark).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c")).withColumn("labels", F.array("category"))
    rows = [(i, 0, embed([f"q{i}"])[0], [["a"], ["b", "a"], None][i % 3]) for i in range(100)]
    asked = spark.createDataFrame(rows, "query_id long, variant_no int, embedding array<float>, allowed array<string>")
    one = sorted(map(tuple, knn_topk(asked, stored, 3, allowed="allowed", labels="labels").collect()))

    def refused(*_):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(type(asked), "toArrow", refused)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1)  # every batch of documents is a buffer of its own
    out = knn_topk(asked, stored, 3, allowed="allowed", labels="labels", block_bytes=1500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan and plan.count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect())) == one
    with pytest.raises(ValueError, match="more than once"):
        knn_topk(asked.union(asked.limit(1)), stored, 3, block_bytes=1500)


def test_blocks_where_arrow_cannot_open_them(spark, monkeypatch):
    rows = [(i, 0, embed([f"q{i}"])[0]) for i in range(20)]
    asked = spark.createDataFrame(rows, "query_id long, variant_no int, embedding array<float>")
    one = sorted(map(tuple, knn_topk(asked, papers(spark), 3).collect()))
    monkeypatch.setattr(knn, "_arrow_opens", lambda uri: False)
    assert sorted(map(tuple, knn_topk(asked, papers(spark), 3, block_bytes=1000).collect())) == one


def test_texts_meet_the_filter_before_any_exchange(spark, tmp_path):
    papers(spark).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    hits = spark.createDataFrame([(1, 3), (2, 3), (1, 99)], "query_id long, doc_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_documents(hits, stored)
        assert sorted((r["query_id"], r["document"]) for r in out.collect()) == [(1, "text 3"), (2, "text 3")]
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert re.search(r"Filter .*getbit.*scalar-subquery", plan) and "Broadcast" not in plan
        found = out._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
        above = found[:found.index("getbit")]
        assert above.count("Exchange") >= 1 and "FileScan" not in above[above.rindex("Exchange"):]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 1000, 1_000_000])
def test_filter_of_ids(spark, n):
    """No id is lost, and under 1 % of the others pass, at a million ids, too."""
    ids = spark.range(n).select((F.col("id") * 3 - 50).alias("doc_id"))
    bits = bloom.bits_for(n)
    made = bloom.build(ids, "doc_id", bits)
    passed = spark.range(3 * max(n, 100_000)).select((F.col("id") - 50).alias("x")).where(bloom.might_contain(made, F.col("x"), bits))
    inside = (F.pmod(F.col("x") + 50, F.lit(3)) == 0) & (F.col("x") < 3 * n - 50)
    hits, false = passed.agg(F.count_if(inside), F.count_if(~inside)).first()
    assert hits == n and false < 0.01 * (3 * max(n, 100_000) - n)
    assert bloom.bits_for(10 ** 9) is None


def test_attaching_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 64)
    hits = spark.range(30).select(F.lit(1).alias("query_id"), "id").withColumnRenamed("id", "doc_id")
    out = attach_documents(hits, papers(spark))
    assert "scalar-subquery" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == 30


def test_runs_side_by_side_keep_their_tables(spark):
    """A block that ends in one thread leaves the tables of another alone."""
    ended, stored = threading.Event(), threading.Event()
    seen = []

    def long_run():
        with storage.intermediates(spark):
            table = storage.cut_lineage(spark.range(10))
            stored.set()
            ended.wait(60)
            seen.append(table.count())
            with storage.intermediates(spark):
                inner = storage.cut_lineage(spark.range(5))
            seen.append(table.count())
            path = inner.inputFiles()
        seen.append(path)

    thread = threading.Thread(target=long_run)
    thread.start()
    with storage.intermediates(spark):
        mine = storage.cut_lineage(spark.range(3))
        stored.wait(60)
        files = mine.inputFiles()
    ended.set()
    thread.join()
    assert seen[:2] == [10, 10] and seen[2] and files
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_options_combine_or_are_refused(spark):
    asked = spark.createDataFrame([(1, 0, "q", embed(["q"])[0], ["a"], "high", "odd")],
                                  "query_id long, variant_no int, text string, embedding array<float>, categories array<string>, "
                                  "confidence string, filter_name string")
    docs, params = papers(spark), Params(top_k=3)
    odd = {"odd": F.col("doc_id") % 2 == 1}
    with pytest.raises(ValueError):
        retrieve(asked, docs, params, category_gate=True, filters=odd)
    ids = lambda **o: [r["doc_id"] for r in retrieve(asked, docs, params, **o).orderBy("rank").collect()]
    assert all(i % 2 == 0 for i in ids(category_gate=True)) and all(i % 2 == 1 for i in ids(filters=odd))
    cells = [[0.2] * 4, [0.8] * 4]
    assert ids(category_gate=True, centres=cells, probes=2) == ids(category_gate=True)
    assert ids(filters=odd, centres=cells, probes=2) == ids(filters=odd)
    assert ids(seeds=docs.where("doc_id < 10"), tasks=2) == ids()


def test_failed_rerank_goes_to_the_scorer(spark):
    asked = spark.createDataFrame([(1, 0, "ok", embed(["q"])[0]), (2, 0, "fail", embed(["q"])[0])],
                                  "query_id long, variant_no int, text string, embedding array<float>")

    def service(query, documents, top_n):
        if query == "fail":
            raise RuntimeError("down")
        return [(1, 0.9), (0, 0.8)]

    scores = lambda pairs: [float(d.split()[1]) for _, d in pairs]
    rows = retrieve(asked, papers(spark), Params(top_k=2), reranker=service, scorer=scores).orderBy("query_id", "rank").collect()
    assert [r["rerank_score"] for r in rows if r["query_id"] == 1] == [0.9, 0.8]
    failed = [r for r in rows if r["query_id"] == 2]
    assert [r["cross_score"] for r in failed] == sorted((r["doc_id"] * 1.0 for r in failed), reverse=True) and len(failed) == 2


def test_empty_conditions_are_refused():
    with pytest.raises(ValueError):
        where_to_column({"$or": []})


def test_a_failing_batch_leaves_error_events(spark, tmp_path):
    from sparkrec.streaming.serve import recommend_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"input_prompt": "one"}\n{"input_prompt": "one"}\n')
    stream = as_queries(spark.readStream.schema("input_prompt string").json(str(tmp_path / "in")))

    def broken(texts):
        raise RuntimeError

    def prepare(batch):
        raise RuntimeError("no variants today")

    paths = [str(tmp_path / x) for x in ("results", "events", "state")]
    query = recommend_stream(stream, papers(spark), model, *paths, Params(top_k=2), prepare=prepare)
    with pytest.raises(Exception):
        query.awaitTermination()
    events = spark.read.parquet(paths[1]).collect()
    assert len({r["query_id"] for r in events}) == 2 and {r["type"] for r in events} == {"error"}
    query = recommend_stream(stream, papers(spark), model, *paths, Params(top_k=2), embed=embed)
    query.awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 2
    assert "error" not in {r["type"] for r in spark.read.parquet(paths[1]).collect()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_placed_by_query_and_prompts_stay(spark, monkeypatch):
    """Chunks lie by query_id, so nothing shuffles them on the way to their questions; equal
    prompts are asked once without a shuffle of prompts."""
    from sparkrec.operators.chunk import assemble_chunks
    from sparkrec.plans import answer as plan

    rows = [(q, pos, q % 2 * 10 + pos, f"text {pos}", {"a": "b"}) for q in range(6) for pos in range(1, 8)]
    docs = spark.createDataFrame(rows, "query_id long, pos int, doc_id long, document string, meta map<string,string>")
    queries = spark.createDataFrame([(q, f"same {q % 3}") for q in range(6)], "query_id long, text string")
    chunks = plan.with_questions(assemble_chunks(docs, 5), queries)
    assert "hashpartitioning(query_id" in _plan(chunks) and ", chunk_index" not in "".join(
        line for line in _plan(chunks).splitlines() if "Exchange hashpartitioning" in line)
    asked = []

    def generate(requests, fn, **options):
        asked.append(requests)
        return requests.withColumns({"response": F.col("prompt"), "error": F.lit(None).cast("string")})

    monkeypatch.setattr(plan, "generate", generate)
    kept = storage.cut_lineage(chunks)
    got = plan.answer(queries, kept).collect()
    assert "Exchange hashpartitioning" not in _plan(asked[0]) and asked[0].count() == 6  # of 12 requests
    assert len(got) == 12 and all(f"same {r.query_id % 3}\n" in r.generated_response and len(r.docs) == r.num_docs_in_chunk for r in got)
    # an id that stands for two questions has an answer for each
    twice = queries.union(spark.createDataFrame([(0, "other")], queries.schema))
    got = plan.answer(twice, storage.cut_lineage(plan.with_questions(assemble_chunks(docs, 5), twice))).collect()
    assert sorted(r.query_id for r in got) == sorted([0, 0, *[q for q in range(6) for _ in range(2)]])


def test_prompts_show_what_format_string_shows(spark):
    from sparkrec import constants as K
    from sparkrec.functions.prompts import chunk_prompt

    df = spark.createDataFrame([("50 % %s", 1, ["a $1 \\ %d", None]), (None, None, [])], "q string, i int, d array<string>")
    old = F.format_string(K.ANSWER_USER, "q", "i", F.array_join(F.transform(
        "d", lambda d, i: F.format_string(K.DOCUMENT_BLOCK, (i + 1).cast("int"), d)), "\n"))
    assert all(a == b for a, b in df.select(chunk_prompt(F.col("q"), F.col("i"), F.col("d")), old).collect())


def test_questions_without_hits_are_dropped_where_they_are_read(spark):
    from sparkrec.plans.retrieve import among

    asked = spark.range(2000).withColumnRenamed("id", "query_id")
    got = [r[0] for r in among(asked, "query_id", storage.cut_lineage(asked.where("query_id % 100 = 7"))).collect()]
    assert set(range(7, 2000, 100)) <= set(got) and len(got) < 60
