"""Event log: frames, fold, status, metrics; batch and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from sparkrec import schemas
from sparkrec.operators import events as ev
from sparkrec.sources import sse
from sparkrec.streaming.fold import fold_chunks_stream, latest_chunks, session_status_stream
from sparkrec.streaming.reuse import drop_repeats, ttl_reuse_stream
from sparkrec.streaming.serve import STATE_STORE, append_batches, recommend_stream

FIELDS = schemas.EVENTS.fieldNames()


def table(spark, rows):
    """Events given as dicts of the fields they use."""
    full = [tuple(r.get(f) for f in FIELDS) for r in rows]
    return spark.createDataFrame(full, schemas.EVENTS)


def start(q, seq, chunk, n=1):
    return dict(query_id=q, seq=seq, type="chunk_start", chunk_index=chunk, num_docs_in_chunk=n)


def token(q, seq, chunk, text):
    return dict(query_id=q, seq=seq, type="chunk_token", chunk_index=chunk, token=text)


def end(q, seq, chunk, text, n=1):
    return dict(query_id=q, seq=seq, type="chunk_end", chunk_index=chunk, num_docs_in_chunk=n,
                docs=[("d%d" % seq, {"a": "b"})] * n, generated_response=text)


def plain_fold(rows):
    """Event by event, as a client does."""
    state = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["seq"])):
        key = (r["query_id"], r.get("chunk_index"))
        if r["type"] == "chunk_start":
            state.setdefault(key, [r["num_docs_in_chunk"], [], ""])
        elif key in state and r["type"] == "chunk_token":
            state[key][2] += r["token"]
        elif key in state and r["type"] == "chunk_end":
            state[key] = [r["num_docs_in_chunk"], [d for d, _ in r["docs"]], r["generated_response"]]
    return state


def folded(df):
    return {(r.query_id, r.chunk_index): [r.num_docs_in_chunk, [d.document for d in r.docs], r.generated_response]
            for r in df.collect()}


def random_log(seed, queries=3, n=60):
    rng, rows = random.Random(seed), []
    for q in range(queries):
        for seq in range(n):
            chunk = rng.randrange(1, 4)
            rows.append(rng.choices([start(q, seq, chunk, rng.randrange(5)), token(q, seq, chunk, f"t{seq} "),
                                     end(q, seq, chunk, f"E{seq} ", rng.randrange(3))], [1, 6, 1])[0])
    return rows


CASES = {
    "usual": [start(1, 1, 1), token(1, 2, 1, "a"), token(1, 3, 1, "b"), end(1, 4, 1, "ab")],
    "token first": [token(1, 1, 1, "x"), start(1, 2, 1), token(1, 3, 1, "a")],
    "start again": [start(1, 1, 1, 3), token(1, 2, 1, "a"), start(1, 3, 1, 4), token(1, 4, 1, "b")],
    "tokens after the end": [start(1, 1, 1), end(1, 2, 1, "e"), token(1, 3, 1, "x")],
    "end without start": [end(1, 1, 1, "e")],
    "end before start": [end(1, 1, 1, "e"), start(1, 2, 1), token(1, 3, 1, "a")],
    "two ends": [start(1, 1, 1), end(1, 2, 1, "e"), end(1, 3, 1, "f", 0), token(1, 4, 1, "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_fold_cases(spark, name):
    assert folded(ev.fold_chunks(table(spark, CASES[name]))) == plain_fold(CASES[name])


def test_fold_in_any_row_order_and_over_segments(spark, monkeypatch):
    monkeypatch.setattr(ev, "SEGMENT", 7)
    rows = random_log(1)
    shuffled = random.Random(2).sample(rows, len(rows))
    assert folded(ev.fold_chunks(table(spark, shuffled))) == plain_fold(rows)


def test_status(spark):
    rows = [dict(query_id=1, seq=1, type="progress", message="m", step="s", status="start"), start(1, 2, 1),
            dict(query_id=1, seq=3, type="complete", total_docs_retrieved=4, num_chunks=1),
            dict(query_id=2, seq=1, type="complete", total_docs_retrieved=1, num_chunks=1),
            dict(query_id=2, seq=2, type="error", message="bad"), start(3, 1, 2)]
    got = {r.query_id: (r.progress_message, r.status, r.total_docs_retrieved, r.num_chunks, r.error)
           for r in ev.session_status(table(spark, rows)).collect()}
    assert got == {1: ("", "success", 4, 1, None), 2: ("", "error", 1, 1, "bad"),
                   3: ("Generating response for chunk 2...", "loading", None, None, None)}
    marked = ev.mark_streaming(ev.fold_chunks(table(spark, rows)), ev.session_status(table(spark, rows)))
    assert {(r.query_id, r.streaming) for r in marked.collect()} == {(1, False), (3, True)}


def test_frames(spark, tmp_path):
    good = table(spark, random_log(3) + [dict(query_id=9, seq=1, type="error", message='né "q"\n\n{x}')])
    path = str(tmp_path / "log")
    sse.write_frames(good, path)
    back = sse.read_frames(spark, path)
    assert back.schema == schemas.EVENTS
    assert sorted(map(repr, back.collect())) == sorted(map(repr, good.collect()))


def test_broken_frames_are_dropped(spark):
    frames = ['data: {"type":"error","message":"a"}', '  data: {"type":"error","message":"b"}\n', "event: x",
              'data: {"type":"error"} junk', 'data: {"type":"err', "data: [1]", "data:{}", "data: ", "data: null",
              'data: {"type":"error","message":"c"},{"type":"error"}']
    df = spark.createDataFrame([(f,) for f in frames], "value string")
    assert sorted(r.message for r in sse.parse_frames(df).collect()) == ["a", "b"]


def test_frame_text(spark):
    df = table(spark, [dict(query_id=1, seq=1, type="chunk_token", chunk_index=1, token="x")])
    got = df.select(sse.frame(["type", "message", "chunk_index", "token"]).alias("f")).first().f
    assert got == 'data: {"type":"chunk_token","chunk_index":1,"token":"x"}\n\n'


# --- streaming ------------------------------------------------------------------------

def stream_of(spark, tmp_path, parts, schema):
    """Parts as files that a stream takes one per micro-batch."""
    folder = tmp_path / "in"
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"p{i}"))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder)))


def test_streaming_fold_of_any_split_equals_the_batch_fold(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    rows = random_log(4, queries=2, n=40)
    mixed = random.Random(5).sample(rows, len(rows))
    timed = lambda part: table(spark, part).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    stream = stream_of(spark, tmp_path, [timed(mixed[i::3]) for i in range(3)], schemas.EVENTS)
    out = fold_chunks_stream(stream, delay="1 hour")
    query = append_batches(out, str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    stored = spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert stored.agg(F.max("version")).first()[0] == 3
    assert folded(latest_chunks(stored)) == plain_fold(rows)
    assert folded(latest_chunks(stored.union(stored))) == plain_fold(rows)  # a repeated update changes nothing


def test_a_batch_emits_its_own_tokens_only(spark, tmp_path):
    """A long text grows by what is new; an end replaces it."""
    spark.conf.set(*STATE_STORE)
    batches = [[token(1, 2, 1, "early ")], [start(1, 1, 1)], *[[token(1, 10 + i, 1, f"t{i} ")] for i in range(4)],
               [end(1, 20, 1, "whole")], [token(1, 21, 1, " more")]]
    timed = lambda part: table(spark, part).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    stream = stream_of(spark, tmp_path, [timed(b) for b in batches], schemas.EVENTS)
    out = fold_chunks_stream(stream, delay="1 hour")
    query = append_batches(out, str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    query.awaitTermination(200)
    assert query.exception() is None
    stored = spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    rows = {r.version: "".join(t.token for t in r.tokens) for r in stored.collect()}
    assert rows == {1: "early ", 2: "", 3: "t0 ", 4: "t1 ", 5: "t2 ", 6: "t3 ", 7: "", 8: " more"}
    state = [s for s in query.lastProgress["stateOperators"]][0]
    assert state["numRowsTotal"] <= 3  # bounds and a timer, no tokens
    assert folded(latest_chunks(stored)) == plain_fold([r for b in batches for r in b])
    assert folded(latest_chunks(stored.where("version < 7")))[(1, 1)][2] == "early t0 t1 t2 t3 "


def test_status_state_ends(spark, tmp_path):
    """Complete and failed queries leave the state once the watermark is past their time."""
    spark.conf.set(*STATE_STORE)
    ended = [dict(query_id=q, seq=1, type="progress", message="m", step="s", status="start") for q in range(20)]
    ended += [dict(query_id=q, seq=2, type="complete" if q % 2 else "error", message="bad", total_docs_retrieved=3, num_chunks=1) for q in range(20)]
    at = lambda part, s: table(spark, part).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + s)))
    last = [dict(query_id=99, seq=1, type="complete", total_docs_retrieved=1, num_chunks=1)]
    stream = stream_of(spark, tmp_path, [at(ended, 0), at(last, 5000), at(last, 10_000)], schemas.EVENTS)
    out = session_status_stream(stream, delay="10 seconds", keep_seconds=60)
    query = append_batches(out, str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    query.awaitTermination(200)
    assert query.exception() is None
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 20 and sizes[-1] == 1  # the last one alone
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).where("query_id < 20").collect()
    want = {r.query_id: tuple(r)[1:] for r in ev.session_status(at(ended, 0)).collect()}
    assert {r.query_id: tuple(r)[1:] for r in rows} == want


def test_late_requests_go_to_their_own_table(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    df = spark.createDataFrame([("k", 0, 0), ("k", 1000, 1), ("j", 5000, 2), ("k", 10, 3), ("k", 5001, 4)], "cache_key string, s long, request_id long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    stream = stream_of(spark, tmp_path, [df.where("request_id < 2"), df.where("request_id = 2"), df.where("request_id > 2")], df.schema)
    query = append_batches(ttl_reuse_stream(stream, 300), str(tmp_path / "out"), str(tmp_path / "state"), late_path=str(tmp_path / "late"))
    query.awaitTermination(120)
    assert query.exception() is None
    read = lambda n: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / n))
    assert sorted(r.request_id for r in read("out").where("computed").collect()) == [0, 1, 2, 4]
    assert [tuple(r) for r in read("late").collect()] == [("k", 3, None, None)]


def test_streaming_reuse_over_micro_batches(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    seconds = [0, 100, 300, 301, 500, 601, 602]
    df = spark.createDataFrame([("k", s, i) for i, s in enumerate(seconds)], "cache_key string, s long, request_id long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    parts = [df.where("request_id < 3"), df.where("request_id between 3 and 4"), df.where("request_id > 4")]
    stream = stream_of(spark, tmp_path, parts, df.schema)
    query = append_batches(ttl_reuse_stream(stream, 300), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(r.request_id for r in got.where("computed").collect()) == [0, 3, 6]
    assert got.count() == 7


def test_cheap_repeat_mode(spark, tmp_path):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "cache_key string, s long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    query = append_batches(drop_repeats(stream_of(spark, tmp_path, [df], df.schema), "5 minutes"),
                           str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(r.cache_key for r in got.collect()) == ["j", "k"]


def test_prompts_as_they_arrive(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", {"a": "b"}, f"h{i}", [float(i), 1.0]) for i in range(8)],
                                 "doc_id long, document string, meta map<string,string>, text_hash string, embedding array<float>")
    asked = spark.createDataFrame([(1, "near 2"), (2, ""), (3, "near 6")], "query_id long, text string")
    stream = stream_of(spark, tmp_path, [asked.where("query_id < 3"), asked.where("query_id = 3")], asked.schema)
    prepare = lambda batch: {"variants": batch.selectExpr("query_id", "0 as variant_no", "text")}
    query = recommend_stream(stream, docs, lambda s, p, m: "ok", str(tmp_path / "res"), str(tmp_path / "ev"),
                             str(tmp_path / "state"), prepare=prepare, embed=lambda ts: [[float(t[-1]), 1.0] for t in ts])
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    results = spark.read.parquet(str(tmp_path / "res")).collect()
    assert {r.query_id: r.responses[0].docs[0].document for r in results} == {1: "text 2", 3: "text 6"}
    log = spark.read.parquet(str(tmp_path / "ev"))
    assert [r.type for r in log.where("query_id = 1").orderBy("seq").collect()] == [
        "progress"] * 5 + ["chunk_start", "chunk_end", "complete"]
    rejected = spark.read.parquet(str(tmp_path / "ev-rejected")).collect()
    assert [(r.query_id, r.error) for r in rejected] == [(2, "input_prompt is required")]


def test_frames_as_a_stream(spark, tmp_path):
    log = table(spark, random_log(6, queries=1, n=20))
    sse.write_frames(log, str(tmp_path / "log"))
    query = append_batches(sse.stream_frames(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = spark.read.schema(schemas.EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, log.collect()))


def test_fold_state_travels_with_its_rows(spark, tmp_path):
    """One text column a group besides its time, and no call to the JVM for each state."""
    stream = stream_of(spark, tmp_path, [table(spark, [start(1, 1, 1)])], schemas.EVENTS)
    for out in (fold_chunks_stream(stream), session_status_stream(stream)):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "FlatMapGroupsInPandasWithState" in plan and "AS event" in plan
