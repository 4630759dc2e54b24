"""Documents that repeat passages of a benchmark, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.llm.common import slices, stored

WINDOW = 10           # words of a passage that count as a leak
FILTER_BITS = 1 << 24  # of the filter over benchmark fingerprints: 2 MB, however large it is
CHUNK = 1 << 20        # bytes hashed at once

# A-Z lower-cased, other ASCII than letters and digits blank; bytes of longer characters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

HITS = "array<struct<n: int, hash: bigint, pos: int, before: array<string>, gram: array<string>, after: array<string>>>"
_HIT = pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("before", pa.list_(pa.string())),
                  ("gram", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def gram_words(n: int) -> int:
    """Words of a fingerprinted gram for passages of n words. A window of n - k + 1 grams
    then lies within any such passage, so the smallest of them is kept on both sides."""
    return (n + 1) // 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in bytes that went through WORDS."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK)
        if stop <= at:  # one word fills the chunk
            stop = data.find(b" ", at + CHUNK)
            stop = len(data) if stop < 0 else stop
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        inside = np.r_[False, raw != 32, False]
        first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        powers = np.cumprod(np.full(len(raw) + 1, _BASE, dtype=np.uint64))
        back = np.cumprod(np.full(len(raw) + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])]
        hashes.append(mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        ends.append(last + at)
        at = stop + 1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def winnow(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams kept for passages of n words. Windows lie inside one
    owner; equal windows keep grams at equal places."""
    k = gram_words(n)
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = len(words) - k + 1
    grams = np.full(count, n, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(_BASE) + words[j:j + count]
    grams = mix(grams)
    windows = np.lib.stride_tricks.sliding_window_view(grams, n - k + 1)
    at = np.arange(len(windows)) + windows.argmin(axis=1)
    at = np.unique(at[owner[:len(windows)] == owner[n - 1:]])
    return at, grams[at]


def _found(texts: list[str], classes: list[int], known: np.ndarray | None) -> tuple[list[int], list[list[dict]]]:
    """Number of words of each text, and its fingerprints that may be in the filter, with
    the words around them."""
    parts = [t.encode("utf-8", "replace").translate(WORDS) for t in texts]
    data = b" ".join(parts)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    starts, ends, words = find_words(data)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    hits: list[list[dict]] = [[] for _ in texts]

    def span(a: int, b: int) -> list[str]:
        return [data[x:y].decode("utf-8", "replace") for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]

    for n in classes:
        at, grams = winnow(words, owner, n)
        if known is not None:
            bit = grams & np.uint64(FILTER_BITS - 1)
            fits = (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, grams = at[fits], grams[fits]
        k = gram_words(n)
        for p, gram in zip(at.tolist(), grams.view(np.int64).tolist()):
            own = int(owner[p])
            low, high = int(first[own]), int(first[own] + counts[own])
            hits[own].append({"n": n, "hash": gram, "pos": p - low, "before": span(max(low, p - (n - k)), p)[::-1],
                              "gram": span(p, p + k), "after": span(p + k, min(high, p + n))})
    return counts.tolist(), hits


def _fingerprints(rows: DataFrame, classes: list[int] | None, known: np.ndarray | None) -> DataFrame:
    """(id, key, text) to (id, key, n_words, hits). Without classes, each text has that of
    its own number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(batch, pc.binary_length(text).to_pylist(), CHUNK):
                texts = text.slice(a, b - a).to_pylist()
                if classes is None:
                    counts, hits = [], []
                    for t in texts:
                        n = len(t.encode("utf-8", "replace").translate(WORDS).split())
                        counts.append(n)
                        hits += _found([t], [min(n, WINDOW)] if n else [], None)[1]
                else:
                    counts, hits = _found(texts, classes, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a),
                     pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT))],
                    names=["id", "key", "n_words", "hits"])

    return rows.mapInArrow(run, f"id long, key long, n_words long, hits {HITS}")


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each fingerprint: FILTER_BITS / 64 numbers at most come to the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (items.groupBy(F.shiftright(bit, 6).alias("place"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(hash & 63 AS INT))")).alias("bits")).collect())
    known = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in rows:
        known[r["place"]] = r["bits"]
    return known.view(np.uint64)


def _alike(a: Column, b: Column, most: int) -> Column:
    """How many words in front are equal, up to `most`."""
    same = [F.when((F.size(a) >= i) & (F.size(b) >= i) & (F.slice(a, 1, i) == F.slice(b, 1, i)), 1).otherwise(0)
            for i in range(1, most + 1)]
    return sum(same[1:], same[0])


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, runs (start and end of each matched run of words) and items.

    Words are runs of ASCII letters and digits and of all other characters, lower-cased
    in A-Z. A passage is WINDOW words in a row of an item, or a whole shorter item. Grams
    are hashed, the smallest hash of every window of grams is kept on both sides, and
    fingerprints that meet are extended by comparing the words around them. Every
    shared passage contains a kept gram, so each is found; what is reported was compared
    word by word. Documents' fingerprints pass a filter of fixed size before they are
    joined, and carry the few words around them, so no text is moved.

    `key` is a hash of id and text. A null text has no words; repeated rows have equal
    results; an item that repeats counts once, one without an id marks words but is not
    listed. Empty tables on either side are fine. Other columns are not read.
    """
    def rows(t: DataFrame, i: str, c: str) -> DataFrame:
        t = t.select(F.col(i).cast("long").alias("id"), F.coalesce(F.col(c), F.lit("")).alias("text"))
        return t.select("id", F.xxhash64("id", "text").alias("key"), "text")

    hit = ("hit.n", "hit.hash", "hit.before", "hit.gram", "hit.after")
    items = stored(_fingerprints(rows(benchmark, item_col, item_text_col), None, None)
                   .select("id", F.explode("hits").alias("hit")).select(F.col("id").alias("item"), *hit).distinct(),
                   "items")
    classes = sorted(r["n"] for r in items.select("n").distinct().collect())
    found = stored(_fingerprints(rows(docs, id_col, text_col), classes, _filter(items)), "passages")
    left = found.where(F.size("hits") > 0).select("key", F.explode("hits").alias("hit")).select("key", "hit.pos", *hit)
    d, b = left.distinct().alias("d"), items.alias("b")
    pairs = d.join(b, (F.col("d.n") == F.col("b.n")) & (F.col("d.hash") == F.col("b.hash"))
                   & (F.col("d.gram") == F.col("b.gram")))
    before = _alike(F.col("d.before"), F.col("b.before"), WINDOW // 2)
    after = _alike(F.col("d.after"), F.col("b.after"), WINDOW // 2)
    runs = (pairs.select("key", "item", "d.n", "pos", F.size("d.gram").alias("k"), before.alias("l"), after.alias("r"))
            .where(F.col("l") + F.col("k") + F.col("r") >= F.col("n")))
    hits = runs.groupBy("key").agg(
        F.collect_set(F.struct((F.col("pos") - F.col("l")).alias("start"),
                               (F.col("pos") + F.col("k") + F.col("r")).alias("end"))).alias("runs"),
        F.collect_set("item").alias("items"))
    return found.select("id", "key", "n_words").join(hits, "key", "left").select(
        F.col("id").alias("doc_id"), "key", "n_words", "runs", "items")


def report(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """Per document its words, words hit, benchmark items found and whether it is contaminated."""
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1))))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    none = F.col("runs").isNull()
    return scan(docs, benchmark, **columns).select(
        "doc_id", "n_words", F.when(none, 0).otherwise(F.size(places)).cast("long").alias("n_hit"),
        F.when(none, 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.when(none, "").otherwise(F.array_join(names, ",")), 256).alias("items_sha256"),
        (~none).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      **columns: str) -> DataFrame:
    """`docs` without those that repeat a passage of the benchmark. Other columns are kept,
    whatever their names."""
    leaks = scan(docs, benchmark, id_col=id_col, text_col=text_col, **columns).where("runs IS NOT NULL")
    leaks = leaks.select(F.col("doc_id").alias("leak"), F.col("key").alias("leak_key")).distinct()
    own = F.col(id_col).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("id"), F.xxhash64(own, F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return rows.join(leaks, (F.col("key") == F.col("leak_key")) & F.col("id").eqNullSafe(F.col("leak")), "left_anti").select("row.*")
