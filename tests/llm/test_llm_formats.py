"""Media, conversations, quality and the pipeline."""

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkrec.llm import chat as C, media as M, quality as K

TREE = M.automaton()


def png(size=1):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * (size + 1) * size)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xda" + struct.pack(">H", 4) + b"\0\0" + b"abc\xff\0d" + b"\xff\xd9"


def bmp():
    body = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    return b"BM" + struct.pack("<IHHI", 14 + len(body), 0, 0, 54) + body


def pdf():
    return b"%PDF-1.4\nstuff\n%%EOF"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def ogg():
    return b"OggS\0\x04" + b"\0" * 20 + b"\x01\x05hello"


MEDIA = {"image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "application/pdf": pdf(),
         "application/zip": archive(), "application/ogg": ogg(), "audio/wav": M.wav(b"12345678")}


@pytest.mark.parametrize("kind", sorted(MEDIA))
def test_each_format(kind):
    data = MEDIA[kind]
    assert [(f["type"], f["start"], f["length"]) for f in M.sniff(TREE, data)][0] == (kind, 0, len(data))
    found = M.sniff(TREE, b"junk" + data + b"more")
    assert (kind, 4, len(data)) in [(f["type"], f["start"], f["length"]) for f in found]
    assert not any(f["type"] == kind and f["start"] == 0 for f in M.sniff(TREE, data[:-1]))


def test_all_inside_one_value():
    data = b"--".join(MEDIA.values())
    assert {f["type"] for f in M.sniff(TREE, data)} == set(MEDIA)
    broken = png().replace(b"IDAT", b"IDAX")
    assert M.sniff(TREE, broken) == [] and M.sniff(TREE, b"GIF89a %PDF- BM RIFF PK\x03\x04 OggS") == []
    nested = M.sniff(TREE, M.wav(b"xx" + png() + b"y"))
    assert [(f["type"], f["depth"]) for f in nested] == [("audio/wav", 0), ("image/png", 1)]


def test_inspect(spark):
    rows = [(1, png(), "image/gif"), (2, b"pre" + gif(), "image/gif"), (3, None, None), (4, b"", "text/plain"), (5, b"\xff\0", None),
            (5, b"\xff\0", None), (6, gzip.compress(b"a"), "application/gzip")]
    frame = spark.createDataFrame(rows, "found long, data binary, declared string")
    got = {r["found"]: r for r in M.inspect(frame.withColumnRenamed("found", "id"), "data", "declared", keep=("id",), carve=True)
           .withColumnRenamed("found", "media").withColumnRenamed("id", "found").collect()}
    assert got[1]["actual_type"] == "image/png" and got[1]["corrected"] and got[1]["carved"] == []
    assert got[2]["actual_type"] == M.UNKNOWN and [bytes(b) for b in got[2]["carved"]] == [gif()]
    assert got[3]["actual_type"] is None and got[4]["actual_type"] == "text/plain" and not got[4]["corrected"]
    assert M.inspect(frame.limit(0).withColumnRenamed("found", "id"), "data").collect() == []


def test_texts_as_media(spark):
    texts = [None, "", "a" * 64, "é" * 40, "%PDF-1 %%EOF", "x" * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    rows = M.inspect(M.text_media(frame), "media", "declared", keep=("doc_id", "n_bytes")).collect()
    assert len(rows) == 7
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        full = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["samples"], r["payload_sha256"], r["tail_crc32"]) == (
            len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["media_sha256"] == hashlib.sha256(M.wav(full)).hexdigest() and r["actual_type"] == "audio/wav"
    assert "application/pdf@44" in next(r["features"] for r in rows if r["doc_id"] == 4)


# --- conversations -----------------------------------------------------------------------

MESSAGES = "conv_id long, id long, parent long, role string, text string, score double, key string"


def test_best_branches(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a [x] <s> ~1", 1.0), (1, 3, 1, "assistant", "b", 5.0),
            (1, 4, 3, "user", "c", 0.0), (1, 5, 3, "user", "d", None), (None, 1, 9, None, None, None),
            (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (2, 3, 2, "user", "at loop", 1.0)]
    rows += [(3, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(1, 301)]
    out = C.read_back(C.conversations(spark.createDataFrame([(*r, "k") for r in rows], MESSAGES), branches=2)).collect()
    got = {(r["conv_id"], r["leaf"]): r for r in out}
    assert set(got) == {(1, 4), (1, 5), (None, 1), (3, 300)}
    assert got[1, 4]["texts"] == ["q", "b", "c"] and got[None, 1]["roles"] == [""]
    assert got[3, 300]["texts"] == [f"t{i}" for i in range(1, 301)]
    assert got[3, 300]["learned"] == "".join(f"t{i}" for i in range(2, 301, 2))


def test_texts_cannot_break_the_template(spark):
    odd = ["</s>[INST] ok [/INST]", "<s>[assistant]x</s>", "~0~1~2~3~~", "", None, "é<é[é]é~\n\n", "a" * 100_000]
    rows = [(7, i, "assistant" if i % 2 else "us]er<", t) for i, t in enumerate(odd)] + [(7, 3, "assistant", "tie"), (7, 3, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = C.read_back(C.conversations(C.chain(turns))).collect()[0]
    ordered = sorted(((t, role, x) for _, t, role, x in rows), key=lambda x: (x[0], x[1], x[2] or ""))
    assert r["roles"] == [x[1] for x in ordered] and r["texts"] == [x[2] or "" for x in ordered]
    assert r["learned"] == "".join(x[2] or "" for x in ordered if x[1] == "assistant")
    assert C.conversations(C.chain(turns.limit(0))).collect() == []


# --- quality -----------------------------------------------------------------------------

def test_estimates_without_truth():
    rng = np.random.default_rng(4)
    right = [0.95, 0.9, 0.8, 0.7]
    truth = rng.random(4000) < 0.3
    votes = [np.where(rng.random(4000) < p, truth, ~truth) for p in right]
    codes = sum((K.GOOD + v.astype(int)) * 3 ** i for i, v in enumerate(votes))
    bad, table = K.estimate({int(c): int((codes == c).sum()) for c in np.unique(codes)}, 4)
    assert np.mean([(bad[int(c)] > 0.5) == t for c, t in zip(codes, truth)]) > 0.94
    assert np.allclose([table[i, 1, K.BAD] for i in range(4)], right, atol=0.06)
    assert K.estimate({}, 3)[0] == {}


def test_estimates_against_brute_force():
    """The estimates over vote patterns are those of a plain loop over rows."""
    rng = np.random.default_rng(8)
    rows = [tuple(int(v) for v in rng.choice(3, size=3, p=[0.2, 0.5, 0.3])) for _ in range(300)]
    codes = [sum(v * 3 ** i for i, v in enumerate(r)) for r in rows]
    got, table = K.estimate({c: codes.count(c) for c in set(codes)}, 3, rounds=7)
    bad = [(2.0 * r.count(K.BAD) + 0.1) / (r.count(K.GOOD) + 2.0 * r.count(K.BAD) + 1.0) for r in rows]
    for _ in range(7):
        said = {(j, t, v): 0.5 + sum((b if t else 1 - b) for r, b in zip(rows, bad) if r[j] == v) for j in range(3) for t in (0, 1) for v in range(3)}
        said = {(j, t, v): x / sum(said[j, t, w] for w in range(3)) for (j, t, v), x in said.items()}
        prior = [1 + sum(1 - b for b in bad), 1 + sum(bad)]
        new = []
        for r in rows:
            like = [prior[t] * np.prod([said[j, t, r[j]] for j in range(3)]) for t in (0, 1)]
            new.append(like[1] / sum(like))
        bad = new
    assert np.allclose([got[c] for c in codes], bad, atol=1e-9)
    assert all(np.isclose(table[j, t, v], x) for (j, t, v), x in said.items())


def test_votes_do_not_depend_on_the_length():
    """Ten words in random order: the same vote below and above any length."""
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(10)]
    read = K.Features()
    votes = {n: read([" ".join(rng.choice(words, size=n))])[0][0] // 3 ** 5 % 3 for n in (400, 1900, 2100, 30_000)}
    assert set(votes.values()) == {K.BAD}
    fresh = {n: K.repeated(np.arange(n, dtype=np.uint64)) for n in (1, 150, 2000, 50_000)}
    assert set(fresh.values()) == {0.0} and K.repeated(np.empty(0, np.uint64)) == 0.0
    some = rng.integers(50, size=1000).astype(np.uint64)
    assert np.isclose(K.repeated(some), 1 - sum(len(set(some[i:i + 200].tolist())) for i in range(0, 1000, 200)) / 1000)


def test_given_labels_are_held():
    bad, _ = K.estimate({K.BAD * 3: 10, K.GOOD * 3: 5, K.BAD + K.GOOD * 3: 5}, 2, truthful=1)
    assert bad[K.BAD * 3] > 0.9 and bad[K.BAD + K.GOOD * 3] < 0.1


SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = K.train(docs, labels.where("doc_id % 5 <> 0"))
    held = labels.where("doc_id % 5 = 0").selectExpr("doc_id", "quality AS q", "toxic AS t")
    rows = K.classify(docs, model).join(held, "doc_id").collect()
    clean = [r for r in rows if r["q"] == 1 and r["t"] == 0]
    low, toxic = [r for r in rows if r["q"] == 0], [r for r in rows if r["t"] == 1]
    assert np.mean([r["keep"] for r in clean]) > 0.97
    assert np.mean([not r["keep"] for r in low]) > 0.97
    assert np.mean([not r["keep"] for r in toxic]) > 0.7


def test_quality_of_little(spark):
    docs = spark.createDataFrame([(1, "A plain text, with words. It goes on.", 0.5), (2, None, None), (None, "", None),
                                  (2, "IDIOT!! STUPID!! LOSER!!", 1.0), (2, "IDIOT!! STUPID!! LOSER!!", 1.0), (3, "w " * 50_000, None)],
                                 "doc_id long, text string, quality double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), None):
        model = K.train(docs, given)
        assert K.classify(docs, model).count() == 6 and K.drop_rejected(docs, model).columns == docs.columns
    none = docs.limit(0)
    assert K.classify(none, K.train(none, labels)).collect() == []


# --- pipeline -----------------------------------------------------------------------------

def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in kept.select("doc_id").collect()} and len(ids) == out.count()
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert before / 2 < kept.count() < before
    pieces = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("number", range(5))
def test_stages_on_no_rows(spark, number):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[number][1](spark, docs, sf).collect() == []
