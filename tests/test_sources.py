"""Research table, collections and prompt files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrec import schemas, storage
from sparkrec.operators import ivf
from sparkrec.operators.knn import knn_topk
from sparkrec.sources import collection, prompts, research, results


def rows(spark, ids):
    return spark.createDataFrame([(i, f"t{i}", "c", "s", "a") for i in ids], schemas.RESEARCH)


IDS = [i * 7 % 101 + (10_000 if i % 2 else 0) for i in range(95)]


@pytest.mark.parametrize("number", [1, 2, 10, 11])
def test_page(spark, number):
    df = rows(spark, IDS)
    want = sorted(IDS)[(number - 1) * 10: number * 10]
    assert [r.id for r in research.page(df, number).collect()] == want
    far = df.withColumn("id", F.col("id") + (1 << 60))  # beyond what doubles tell apart
    assert [r.id - (1 << 60) for r in research.page(far, number).collect()] == want


def test_pages_with_null_and_repeated_keys(spark):
    df = rows(spark, [None, None, 3, 3, 3, 1, 2, None])
    assert research.number_rows(df).count() == 8
    pages = [[r.id for r in research.page(df, n, 3).collect()] for n in (1, 2, 3, 4)]
    assert pages == [[None, None, None], [1, 2, 3], [3, 3], []]


def test_all_pages(spark):
    for parts in (1, 7):
        df = rows(spark, IDS).repartition(parts)
        got = {r.id: (r.page, r.place) for r in research.all_pages(df).collect()}
        assert got == {i: (n // 10 + 1, n % 10 + 1) for n, i in enumerate(sorted(IDS))}


def test_index_pages_are_those_of_all_pages(spark, tmp_path):
    """Repeated and null keys: every kind of page has the same rows in the same order."""
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 5, f"t{i}", "c", "s", "a") for i in range(83)], schemas.RESEARCH).repartition(5)
    path = str(tmp_path / "ordered")
    research.write_ordered(df, path, ranges=6)
    whole = {}
    for r in research.all_pages(df, 10).collect():
        whole.setdefault(r.page, {})[r.place] = r.title
    for n in range(1, 11):
        want = [t for _, t in sorted(whole.get(n, {}).items())]
        assert [r.title for r in research.page_of(spark, path, n, 10).collect()] == want
        assert [r.title for r in research.page(df, n, 10).collect()] == want
    plan = research.page_of(spark, path, 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan and plan.count("FileScan") == 1 and "Window" not in plan
    assert "rangepartitioning" not in plan


def test_page_info(spark):
    info = lambda n: tuple(research.page_info(rows(spark, IDS), n).first())
    assert info(1) == (95, 2, None) and info(10) == (95, None, 9)


def test_read_and_lengths(spark, tmp_path):
    path = str(tmp_path / "r")
    rows(spark, [1, 2]).withColumn("title", F.when(F.col("id") == 2, F.repeat(F.lit("x"), 256)).otherwise("y")).write.parquet(path)
    df = research.read_research(spark, path)
    assert df.schema.fieldNames() == schemas.RESEARCH.fieldNames()
    assert [(r.id, r.too_long) for r in research.length_violations(df).collect()] == [(2, ["title"])]


def docs(spark, ids):
    return spark.createDataFrame([(i, f"text {i % 4}", {"categories": "c%d" % (i % 2)}) for i in ids],
                                 "doc_id long, document string, meta map<string,string>")


embed = lambda texts: [[float(len(t)), 0.5] for t in texts]


def test_index_is_idempotent_and_named(spark, tmp_path):
    path = str(tmp_path / "index")
    assert collection.open_collection(spark, path).count() == 0
    collection.build_index(docs(spark, range(6)), path, embed)
    collection.build_index(docs(spark, range(4, 9)), path, embed)
    collection.build_index(docs(spark, range(2)), path, embed, name="other")
    with pytest.raises(ValueError):
        collection.build_index(docs(spark, [20, 20]), path, embed)
    default = collection.open_collection(spark, path)
    assert sorted(r.doc_id for r in default.collect()) == list(range(9))
    assert collection.open_collection(spark, path, "other").count() == 2
    assert collection.open_collection(spark, path, "absent").count() == 0
    assert default.where("embedding is null or text_hash <> sha2(document, 256)").count() == 0
    plan = collection.open_collection(spark, path, "other")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan


def test_scan_reads_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "index")
    built = collection.build_index(docs(spark, range(3)), path, embed)
    plan = collection.scan(built, ("metadatas",))._jdf.queryExecution().executedPlan().toString()
    assert "document" not in plan.split("ReadSchema")[1] and "embedding" not in plan.split("ReadSchema")[1]
    got = collection.get_documents(built, {"categories": "c1"}, {"categories": F.col("category")})
    assert [tuple(r) for r in got.collect()] == [(1, "text 1")]


def test_prompt_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([('{"input_prompt": "a"}',), ('{"other": 1}',), ("broken",)], "value string").write.text(path)
    asked = prompts.as_queries(prompts.read_prompts(spark, path))
    assert sorted(str(r.text) for r in asked.collect()) == ["None", "None", "a"]
    assert len({r.query_id for r in asked.collect()}) == 3  # null texts, too, are requests of their own
    assert prompts.stream_prompts(spark, path).isStreaming
    assert prompts.as_queries(prompts.stream_prompts(spark, path)).columns == ["text"]


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "q")], "query_id long, query string")
    results.write_json(df, str(tmp_path / "j"))
    results.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == df.collect()
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()


def test_cells_are_stored_and_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    centres = [[5.0, 0.5], [6.0, 0.5], [40.0, 0.5]]
    letters = lambda ids: docs(spark, ids).withColumn("document", F.repeat(F.lit("x"), (F.col("doc_id") + 1).cast("int")))
    built = collection.build_index(letters(range(20)), path, embed, centres=centres)
    assert {r.cell for r in built.collect()} == {0, 1}  # 6 to 20 letters are nearer to 6 than to 40
    asked = spark.createDataFrame([(1, 0, [2.0, 0.5])], "query_id long, variant_no int, embedding array<float>")
    found = ivf.knn_approximate(asked, built, 3, centres, 1)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [1, 0, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(cell,0)" in plan.replace("In(cell, [0])", "EqualTo(cell,0)")
    with pytest.raises(ValueError, match="other centres"):
        ivf.knn_approximate(asked, built, 3, centres[:2], 1)
    with pytest.raises(ValueError, match="other centres"):
        collection.build_index(letters(range(30)), path, embed, centres=centres[:2])
    more = collection.build_index(letters(range(30)), path, embed, centres=centres)
    cells = collection.read_cells(spark, path)
    assert cells.radii.tolist() == ivf.measure_cells(more, centres).radii.tolist() and cells.radii[0] == 4


def test_cells_rule_each_other_out(spark):
    """The result is exact, also with few, tight or empty cells, and cells that cannot help are not read."""
    rng = np.random.default_rng(1)
    heart = rng.normal(size=(12, 4)) * 20
    vectors = heart[rng.integers(12, size=600)] + rng.normal(size=(600, 4))
    table = spark.createDataFrame([(i, [float(x) for x in v.astype(np.float32)], "ab"[i % 2]) for i, v in enumerate(vectors)],
                                  "doc_id long, embedding array<float>, tag string")
    asked = spark.createDataFrame([(i, 0, [float(x) for x in (vectors[i] if i % 2 else rng.normal(size=4) * 15)], ["a"] if i % 3 else None) for i in range(30)],
                                  "query_id long, variant_no int, embedding array<float>, allowed array<string>")
    centres = np.vstack([heart, [[900.0] * 4]])
    placed = storage.cut_lineage(ivf.assign_cells(table, centres))
    cells = ivf.measure_cells(placed, centres)
    assert cells.radii[-1] == -1
    show = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    for n in (1, 7, 100):
        assert show(ivf.knn_by_cells(asked, placed, n, cells)) == show(knn_topk(asked, table, n))
    tagged = dict(allowed="allowed", labels="tags")
    assert show(ivf.knn_by_cells(asked, placed.withColumn("tags", F.array("tag")), 5, cells, **tagged)) == show(
        knn_topk(asked, table.withColumn("tags", F.array("tag")), 5, **tagged))
    near = ivf.nearest_cells(asked, cells.centres, 1, "_probe")
    bounds = knn_topk(asked, table, 7).where("rank = 7").select("query_id", F.col("distance").alias("_bound"))
    read = [len(r._more) for r in ivf.further_cells(near.join(bounds, "query_id"), cells, "_probe", "_bound", "_more").where("query_id % 2 = 1").collect()]
    assert np.mean(read) < 3  # of twelve
    with pytest.raises(ValueError):
        ivf.knn_by_cells(asked, placed, 3, ivf.Cells(centres))
    with pytest.raises(ValueError):
        ivf.knn_by_cells(asked, placed, 3, cells, metric="ip")


def test_failed_vectors_are_made_later(spark, tmp_path):
    path, calls = str(tmp_path / "index"), str(tmp_path / "calls")

    def once(texts):
        import os
        if not os.path.exists(calls):
            raise RuntimeError("down")
        return [[float(len(t)), 0.5] for t in texts]

    first = collection.build_index(docs(spark, range(10)), path, once, append_id="a", centres=[[1.0, 1.0]])
    assert first.where("embedding IS NULL").count() == 10 == first.count()
    assert collection.repair_index(spark, path, once).where("embedding IS NULL").count() == 10
    open(calls, "w").close()
    again = collection.build_index(docs(spark, range(20)), path, once, append_id="a", centres=[[1.0, 1.0]])
    assert again.count() == 10  # that append is there
    grown = collection.build_index(docs(spark, range(12)), path, once, centres=[[1.0, 1.0]])
    assert grown.count() == 12 and grown.where("embedding IS NULL").count() == 10
    whole = collection.repair_index(spark, path, once)
    assert sorted(r.doc_id for r in whole.collect()) == list(range(12))
    assert whole.where("embedding IS NULL OR cell IS NULL").count() == 0
    made = len(collection.commits(spark, path, schemas_name()))
    assert collection.repair_index(spark, path, once).count() == 12 and len(collection.commits(spark, path, schemas_name())) == made


def schemas_name():
    from sparkrec.config import DEFAULTS
    return DEFAULTS.collection


def test_an_append_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    collection.build_index(docs(spark, range(4)), path, embed)

    def broken(*_):
        raise RuntimeError("no commit today")

    with monkeypatch.context() as patch:
        patch.setattr(collection, "_commit", broken)
        with pytest.raises(RuntimeError):
            collection.build_index(docs(spark, range(9)), path, embed)
    assert collection.open_collection(spark, path).count() == 4
    assert collection.build_index(docs(spark, range(9)), path, embed).count() == 9
    with pytest.raises(ValueError, match="already"):
        collection._commit(spark, path, schemas_name(), next(iter(collection.commits(spark, path, schemas_name()))), {"adds": [], "replaces": []})


def test_intermediate_tables_are_shared_and_go(spark):
    import os

    folder = storage.shared_dir(spark)
    assert storage.scratch_path(spark, "x").startswith(folder)
    outer = storage.cut_lineage(spark.range(5), "outer")
    with storage.intermediates(spark):
        inner = storage.cut_lineage(spark.range(5), "inner")
        assert inner.count() == 5 and "FileScan parquet" in inner._jdf.queryExecution().executedPlan().toString()
        place = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert not os.path.exists(place) and outer.count() == 5
    numbered = storage.with_row_no(spark.range(100, numPartitions=7), "n").collect()
    assert [r.n for r in sorted(numbered)] == list(range(100))
    storage.release(spark)
    assert not os.path.exists(outer.inputFiles()[0].removeprefix("file://"))


def test_without_a_checkpoint_folder_the_warehouse_serves():
    class Session:
        class sparkContext:
            folder = None
            getCheckpointDir = classmethod(lambda cls: cls.folder)
            setCheckpointDir = classmethod(lambda cls, path: setattr(cls, "folder", path))
        class conf:
            get = staticmethod(lambda key, default=None: "hdfs://x/warehouse" if key == "spark.sql.warehouse.dir" else default)
    assert storage.shared_dir(Session).startswith("hdfs://x/warehouse/")
    assert Session.sparkContext.folder == storage.shared_dir(Session)
