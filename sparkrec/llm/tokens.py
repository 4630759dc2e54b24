"""Token ids of whole texts by a tokenizers file, with a cache of words."""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CACHE_WORDS = 400_000

# A word of plain letters and the marks behind it: two pieces for the tokenizer, whatever
# stands around them, and already in composed form.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer never joins what white space parts, so a text is encoded word by word,
    and a word that was met before is looked up. Words of plain letters and marks go to
    the tokenizer's model in the two pieces its splitter makes of them; all others go
    through the whole tokenizer. Only for a lower-casing byte-level tokenizer whose
    splitter keeps letters and marks apart and drops white space.

    Words are kept in two generations of `cache_words` at most: the old one goes when the
    new one is full, and words that are met again move from old to new.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def _piece(self, piece: str) -> bytes:
        data = piece.lower().encode()
        found = self.cache.get(data) or self.old.get(data)
        if found is None:
            shown = data.decode("latin-1")
            if not data.isascii():
                shown = shown.translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.cache[data] = found
        return found

    def _pieces(self, text: str) -> tuple[str, ...] | None:
        """A plain word's letters and marks; None for any other word."""
        if text.isascii():
            core = text.rstrip(string.punctuation)
            return (core, text[len(core):]) if not core or core.isalpha() else None
        plain = _PLAIN.fullmatch(text)
        return plain.groups() if plain else None

    def _word(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode()
            pieces = self._pieces(text)
            if pieces is None:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                found = b"".join([self._piece(p) for p in pieces if p])
        self.cache[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if len(self.cache) > self.cache_words:
            self.old, self.cache = self.cache, {}
        cache = self.cache
        words = text.encode("utf-8", "replace").split()
        return b"".join([cache.get(w) or self._word(w) for w in words])


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that tasks share its words. This module is sent
    anew with every task; the tokenizers module stays, so the encoder is kept there."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


TOKEN_SCHEMA = "part int, row long, doc_id long, start long, n_ids long, ids binary"


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Per document of (doc_id, text): its ids with `end_id` behind them, the partition
    and row it is in, and how many ids the rows before it in that partition have."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        row = start = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids = batch.column("doc_id").slice(at, 256)
                ids = [encode_text(t) + tail for t in batch.column("text").slice(at, 256).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = start + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(np.arange(row, row + len(ids))),
                    doc_ids, pa.array(ends - sizes), pa.array(sizes), pa.array(ids, type=pa.binary()),
                ], names=["part", "row", "doc_id", "start", "n_ids", "ids"])
                row, start = row + len(ids), int(ends[-1])

    return docs.mapInArrow(encode, TOKEN_SCHEMA)
