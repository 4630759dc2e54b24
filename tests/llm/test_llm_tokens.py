"""Encoder, packing and token files against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkrec.llm import packing, pfor
from sparkrec.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, cache_words=50)
ODD = ["", " ", "a", "The the, THE!!", "naïve café Ünïcode ßtraße", "don't we'll 'tis x's 's", "a1b22 ½ ²x 3,14", "日本語 テキスト",
       "<|endoftext|> x<|startoftext|>y", "é ́x a b c\x1cd e\x85f", "ΣΑΣ İstanbul ﬁ", "🙂🙂 a🙂b", "%%%a***",
       "x" * 5000, "word " * 3000, "tab\tnew\nline\r\n\x0b\x0cend"]


def ids_of(text, end):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("text", ODD)
def test_encoder_is_the_tokenizer(text):
    assert ENCODER(text) == ids_of(text, 0)[:-1].tobytes()
    assert ENCODER(text) == ids_of(text, 0)[:-1].tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_encoder_on_any_text(text):
    assert ENCODER(text) == ids_of(text, 0)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=600), st.integers(0, 31))
def test_blocks_round_trip(values, shift):
    values = np.array(values, dtype=np.uint32) >> np.uint32(shift)
    starts, data = pfor.encode_blocks(values)
    assert pfor.decode_blocks(starts, data, len(values)).tolist() == values.tolist()


def test_outliers_are_exceptions():
    values = np.full(256, 7, dtype=np.uint32)
    values[100] = 2 ** 32 - 1
    starts, data = pfor.encode_blocks(values)
    assert len(data) < 20 and pfor.decode_blocks(starts, data, 256)[100] == 2 ** 32 - 1


def test_range_of_a_segment():
    values = np.arange(1000, dtype="<u4") * 3
    data = pfor.encode_segment([1, None], [values[:10].tobytes(), values[10:].tobytes()])
    assert pfor.read_range(data, 300, 500).tolist() == values[300:800].tolist()
    assert pfor.read_range(data, 990, 50).tolist() == values[990:].tolist()
    docs, counts, ids = pfor.decode_segment(data)
    assert docs == [1, None] and counts.tolist() == [10, 990] and ids.tolist() == values.tolist()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(90, None, None, None), (91, "a b c", "x", 1), (91, "a b c", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part long").repartition(3)


def test_pack(spark, docs):
    rows = packing.pack(docs, PATH, 2, window=64, keep_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"], 2)) for r in docs.collect())
    for r in rows:
        ids = ids_of(texts[r["doc_id"]], 2)
        piece = ids[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and bytes(r["ids"]) == piece.tobytes()
        assert r["more"] == (r["start"] + r["length"] < len(ids))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or s == len(by) - 1
    whole = packing.sequences(packing.pack(docs, PATH, 2, window=64, keep_ids=True), 64).collect()
    assert sum(r["n_ids"] for r in whole) == sum(r["length"] for r in rows)
    assert all(r["padded_to"] == 64 or r["padded_to"] & (r["padded_to"] - 1) == 0 for r in whole)


def test_token_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(pfor, "SEGMENT_IDS", 500)
    pfor.write_ids(docs, f"file://{tmp_path}/ids", PATH, 1)
    rows = sorted(pfor.read_ids(spark, f"file://{tmp_path}/ids", keep_ids=True).collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = 0
    for r in rows:
        ids = ids_of(texts[r["doc_id"]], 1)
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.collect())


def test_empty_table(spark, docs, tmp_path):
    none = docs.limit(0)
    assert packing.pack(none, PATH, 2).collect() == []
    pfor.write_ids(none, f"file://{tmp_path}/none", PATH, 1)
    assert pfor.read_ids(spark, f"file://{tmp_path}/none").collect() == []


def test_null_id(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b"), (3, "a")], "doc_id long, text string")
    pfor.write_ids(rows, f"file://{tmp_path}/null", PATH, 1)
    assert [r["doc_id"] for r in pfor.read_ids(spark, f"file://{tmp_path}/null").orderBy("start").collect()] == [None, 3]
    assert packing.pack(rows, PATH, 2).where(F.col("doc_id").isNull()).count() == 1
