"""Near-duplicate documents: 64-bit fingerprints of word shingles, linked with the help of
tables of distances to reference fingerprints (pivots)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkrec.llm.common import discard, documents, slices, stored
from sparkrec.operators import bloom
from sparkrec.storage import with_row_no

SHINGLE = 3
MOST_BITS = 3
GROUPS = 6             # of bits; a pair agrees in GROUPS - MOST_BITS of them at least
KEY_PIVOTS = 12        # distances to them, halved, fill a key of 60 bits
TABLE_PIVOTS = 16
BUCKET = 4096          # distinct fingerprints compared in one task at once
FINE_BITS = 4          # 3 fine groups of 4 bits leave 2^12 = BUCKET fingerprints
SHINGLES_AT_ONCE = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in range(256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot(i: int) -> int:
    """The i-th reference fingerprint."""
    return xxhash.xxh64_intdigest(b"pivot", seed=i)


def shingle_hashes(text: str, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, some at a time."""
    data = b" ".join(text.encode("utf-8", "replace").translate(_LOWER).split())
    if not data:
        return
    blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(data)]
    if len(starts) > size:
        starts, ends = starts[:1 - size], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        pairs = zip(starts[at:at + SHINGLES_AT_ONCE].tolist(), ends[at:at + SHINGLES_AT_ONCE].tolist())
        yield np.array([digest(data[a:b], 42) for a, b in pairs], dtype=np.uint64)


def fingerprint_batch(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints as signed 64-bit integers; a bit is set if most shingles have it set."""
    ones, totals = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def count() -> None:
        if not parts:
            return
        bits = np.unpackbits(np.concatenate(parts).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sizes = np.array([len(p) for p in parts])
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        np.add.at(ones, rows, sums)
        np.add.at(totals, rows, sizes)
        rows.clear()
        parts.clear()

    held = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, size):
            rows.append(i)
            parts.append(hashes)
            held += len(hashes)
            if held >= SHINGLES_AT_ONCE:
                count()
                held = 0
    count()
    return np.packbits(ones * 2 > totals[:, None], axis=1).view(">i8").reshape(-1).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of documents (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(batch, pc.binary_length(text).to_pylist(), 8_000_000):
                fps = fingerprint_batch(text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fps)],
                                                 names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _distance(fp: Column, point: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(point))))


def group_masks(groups: int = GROUPS) -> list[int]:
    """The 64 bits in nearly equal runs, one mask each."""
    cuts = [64 * i // groups for i in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def bucketed(nodes: DataFrame) -> DataFrame:
    """node (rep, fp) and bucket, for every bucket a fingerprint is in.

    Two fingerprints that differ in at most MOST_BITS bits agree in some choice of
    GROUPS - MOST_BITS groups of bits. Restricted to these bits their distance is 0, so
    their distances to every restricted pivot are equal: the maximum coordinate
    difference there must be 0. The coordinates of one choice make one key. As all
    distances of a fingerprint have the parity of its first one up to a constant, the
    first is kept whole and the others halved.
    """
    choices = [sum(c) for c in combinations(group_masks(), GROUPS - MOST_BITS)]
    rows = nodes.select(F.struct("rep", "fp").alias("node"),
                        F.posexplode(F.array(*[F.lit(_signed(m)) for m in choices])).alias("choice", "mask"))
    fp, mask = F.col("node.fp"), F.col("mask")
    near = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot(i)))).bitwiseAND(mask)).cast("long")
            for i in range(KEY_PIVOTS)]
    key = near[0].bitwiseAND(F.lit(1))
    for d in near:
        key = F.shiftleft(key, 5).bitwiseOR(F.shiftright(d, 1))
    return rows.select("node", F.xxhash64("choice", key).alias("bucket"))


def _near(a: Column, b: Column) -> Column:
    """Whether a pair stays: every pivot's distances differ by MOST_BITS at most, and so
    do the fingerprints."""
    apart = [F.abs(_distance(a, pivot(i)) - _distance(b, pivot(i))) for i in range(TABLE_PIVOTS)]
    return (F.greatest(*apart) <= MOST_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)


def bucket_links(reps: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each member the smallest rep it is linked to, over any number of links."""
    points = np.array([pivot(i) for i in range(TABLE_PIVOTS)], dtype=np.uint64)
    own = fps.astype(np.int64).view(np.uint64)
    coordinates = np.bitwise_count(own[:, None] ^ points).astype(np.int8)
    order = np.argsort(coordinates[:, 0], kind="stable")
    own, coordinates = own[order], coordinates[order]
    first = coordinates[:, 0].astype(np.int64)
    until = np.searchsorted(first, first + MOST_BITS, side="right")
    left, right = [], []
    for start in range(0, len(own), 256):
        stop = min(start + 256, len(own))
        end = int(until[stop - 1])
        span = coordinates[start:end]
        fits = np.ones((stop - start, end - start), dtype=bool)
        for k in range(TABLE_PIVOTS):
            fits &= np.abs(coordinates[start:stop, k, None] - span[None, :, k]) <= MOST_BITS
        i, j = np.nonzero(np.triu(fits, 1))
        i, j = i + start, j + start
        near = np.bitwise_count(own[i] ^ own[j]) <= MOST_BITS
        left.append(i[near])
        right.append(j[near])
    i, j = np.concatenate(left), np.concatenate(right)
    label = reps[order].copy()
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if np.array_equal(before, label):
            break
    out = np.empty_like(label)
    out[order] = label
    return out


def _links_of(groups: DataFrame) -> DataFrame:
    """a, b (b < a): links that join the members of each bucket as all near pairs would;
    at most one for each member. `groups` has one list of (rep, fp) per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            ends, members = column.offsets.to_numpy(), column.values
            reps, fps = members.field("rep").to_numpy(), members.field("fp").to_numpy()
            found = [bucket_links(reps[a:b], fps[a:b]) for a, b in zip(ends, ends[1:])]
            rest = reps[ends[0]:ends[-1]]
            least = np.concatenate(found) if found else rest
            keep = least != rest
            yield pa.RecordBatch.from_arrays([pa.array(rest[keep]), pa.array(least[keep])], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored buckets, and links between the distinct fingerprints of `nodes` (rep, fp), as a, b with b < a.

    Links that follow from others may be left out; none that joins two parts is. A bucket
    of two is a pair. Larger ones are gathered, up to BUCKET members. A bucket beyond
    that is split by the bits outside every choice of fine groups: its members then
    differ in 3 * FINE_BITS bits only, which are BUCKET fingerprints at most.
    """
    keyed = bucketed(nodes)
    counts = stored(keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("x"),
                                                F.max("node").alias("y")).where("n > 1"), "buckets")
    pairs = counts.where("n = 2").where(_near(F.col("x.fp"), F.col("y.fp"))).select(
        F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct()
    members = keyed.join(counts.where("n > 2").select("bucket", "n"), "bucket")
    fine = [sum(c) for c in combinations(group_masks(64 // FINE_BITS), MOST_BITS)]
    shared = [F.struct(F.lit(i), F.col("node.fp").bitwiseAND(F.lit(_signed(~m & (2 ** 64 - 1)))))
              for i, m in enumerate(fine)]
    whole = members.where(F.col("n") <= BUCKET).groupBy("bucket").agg(F.collect_list("node").alias("members"))
    parts = (members.where(F.col("n") > BUCKET).select("bucket", "node", F.explode(F.array(*shared)).alias("part"))
             .groupBy("bucket", "part").agg(F.collect_list("node").alias("members")))
    return counts, stored(pairs.union(_links_of(whole)).union(_links_of(parts)).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """id, component_id: for each id of `edges` (a, b with b < a) the smallest one it is
    joined with. Rounds of large-star and small-star steps, each stored, until nothing
    changes; their number grows with the logarithm of the longest chain."""
    spark = edges.sparkSession

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    before = state(edges)
    table, mine = edges, False
    while before[0]:
        both = table.select("a", "b").union(table.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = state(new)
        if mine:
            discard(spark, table)
        table, mine = new, True
        if now == before:
            break
        before = now
    return table.select(F.col("a").alias("id"), F.col("b").alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and fp.

    Fingerprints of equal documents are counted once before anything is compared, so a
    group of exact copies costs one comparison however large it is. Documents without
    words (null or empty text) have fingerprint zero and are linked like any other.
    Repeated rows appear as often as they occur. A null doc_id stays null; it is no
    component_id unless its group has no other. An empty table gives no rows.
    """
    prints = stored(fingerprints(documents(docs, id_col, text_col)), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("named"))
    # A fingerprint of rows without an id links others, too: it has a number above all ids
    # (and below, if ids come near the end of what a long holds).
    top = prints.agg(F.max("doc_id")).first()[0]
    nameless = nodes.where("named IS NULL").count()
    if nameless:
        free = (top if top is not None else 0) + 1
        if free + nameless >= 1 << 63:
            raise ValueError("ids leave no room for rows without an id")
        numbered = with_row_no(nodes.where("named IS NULL"), "rep", "nameless").withColumn("rep", F.col("rep") + free)
        nodes = nodes.where("named IS NOT NULL").withColumn("rep", F.col("named")).unionByName(numbered)
    else:
        nodes = nodes.withColumn("rep", F.col("named"))
    nodes = stored(nodes, "nodes")
    buckets, found = links(nodes.select("rep", "fp"))
    classes = components(found)
    labels = nodes.join(classes, nodes["rep"] == classes["id"], "left").select(
        "fp", F.coalesce("component_id", "named").alias("component_id"))
    if nameless:  # a group of rows without an id alone has none
        labels = labels.withColumn("component_id", F.when(F.col("component_id") < free, F.col("component_id")))
    discard(docs.sparkSession, buckets)
    return prints.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group: that with the smallest id. Rows without an
    id cannot be named and stay; rows that share an id stay or go together."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).where(
        F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


# --- documents alike in most of their shingles --------------------------------------------

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS = 8               # keys of a document
ROWS = 4                # smallest shingles that make up a key
APART = 26              # bits, more than fingerprints of such a pair differ in
SALTED = 2000           # pairs with one document in one place
ORDER_SAMPLE = 20_000   # documents at least that tell which shingles are frequent; only the order of shingles depends on it
ORDER_STEP = 16         # and one in so many, so that what passes as rare is in a bounded number of texts
FREQUENT = 1_000_000    # such shingles at most
MEET = 2                # of their first shingles alike texts share so many
FEW = 3                 # members of a group that a shingle proposes before all of them


def shingle_set(text: str, size: int) -> np.ndarray:
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


_MULTIPLIERS = np.array([pivot(1000 + i) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
_OFFSETS = np.array([pivot(2000 + i) for i in range(BANDS * ROWS)], dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set of shingles; two sets share one with probability 1 - (1 - s^ROWS)^BANDS,
    where s is their similarity."""
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096, None] * _MULTIPLIERS + _OFFSETS
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def frequent_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles of three documents and more of a sample, the most frequent last."""
    step = max(1, min(rows.count() // ORDER_SAMPLE, ORDER_STEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, size)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    counts = rows.where(F.pmod("key", F.lit(step)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").count()
    counts = stored(counts.where("count > 2"), "counts")
    least = total = 0
    for count, shingles in sorted(counts.groupBy("count").agg(F.count("*")).collect(), reverse=True):
        total += shingles
        if total > FREQUENT:
            least = count + 1
            break
    top = counts.where(F.col("count") >= least).toArrow()
    discard(rows.sparkSession, counts)
    h, count = top.column("h").to_numpy(), top.column("count").to_numpy()
    return h[np.lexsort((h, -count))][::-1].view(np.uint64)


def prefix_length(n: int, least: float) -> int:
    """How many of n shingles, in any one order for all texts, have MEET in common with
    every set that shares `least` of them (all that it shares, where they are fewer)."""
    return min(n, n - math.ceil(least * n - 1e-9) + MEET)


def _described(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, key, digest of the set of shingles, fp, band keys, number of shingles and the first of
    them (frequent ones come last) of (doc_id, key, text)."""
    by_rank = frequent_shingles(rows, size)
    by_hash = np.argsort(by_rank)
    held = rows.sparkSession.sparkContext.broadcast((by_rank[by_hash], by_hash.astype(np.int32)))

    def first(shingles: np.ndarray) -> np.ndarray:
        frequent, rank = held.value
        wanted = prefix_length(len(shingles), similarity)
        if not len(frequent):
            return shingles[:wanted]
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        hot = frequent[at] == shingles
        rare = shingles[~hot][:wanted]
        return np.concatenate((rare, shingles[hot][np.argsort(rank[at[hot]])][:wanted - len(rare)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(batch, pc.binary_length(text).to_pylist(), 8_000_000):
                texts = text.slice(a, b - a).to_pylist()
                sets = [shingle_set(t, size) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a),
                     pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array(fingerprint_batch(texts, size)),
                     pa.array([band_keys(s).tolist() for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([first(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "key", "digest", "fp", "bands", "n", "first"])

    return rows.mapInArrow(run, "doc_id long, key long, digest string, fp long, bands array<long>, n long, first array<long>")


def _in_groups(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """`rows` with the group `own` of their `rep`."""
    return rows.join(classes, rows["rep"] == classes["id"], "left").withColumn(
        "own", F.coalesce("component_id", "rep")).drop("id", "component_id")


def _between_groups(shingles: DataFrame, most_are: bool = False) -> DataFrame:
    """Rows of `shingles` (rep, key, n, own, place, h) that documents of different groups have.
    Unless `most_are`, those in one text alone are dropped where they are read."""
    spark = shingles.sparkSession
    shared = stored(shingles.groupBy("h").agg(F.min("own").alias("_x"), F.max("own").alias("_y")).where("_x <> _y").select("h"), "shared")
    bits = None if most_are else bloom.bits_for(shared.count())
    some = shingles.where(bloom.might_contain(bloom.build(shared, "h", bits), F.col("h"), bits)) if bits else shingles
    kept = stored(some.join(shared, "h", "left_semi"), "shingles")
    discard(spark, shared)
    return kept


def _apart_but_alike(shingles: DataFrame, similarity: float, most: int | None = None, decided: DataFrame | None = None) -> DataFrame:
    """rep, key, b, b_key: all pairs of different groups that may share
    `similarity` of their shingles; with `most`, of so many members of a group at a shingle.
    Those `decided` (rep, key, b, b_key) are left out.

    Of two such sets, in one order of all shingles, the first ones of the larger (as many as
    `prefix_length` says) meet the first ones of the smaller, where fewer do, MEET times; and
    behind the first ones they share enough is left of both.
    """
    if most:
        w = W.partitionBy("h", "own").orderBy(F.xxhash64("rep", "key"))
        shingles = shingles.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most).drop("_at")
    share = similarity / (1 + similarity)
    fewer = F.col("n") - F.ceil(F.lit(2 * share) * F.col("n") - 1e-9) + MEET
    small = shingles.where(F.col("place") < fewer).select(
        "h", F.col("rep").alias("b"), F.col("key").alias("b_key"), F.col("n").alias("b_n"), F.col("own").alias("b_own"), F.col("place").alias("b_place"))
    n, m = F.col("n"), F.col("b_n")
    both = F.ceil(F.lit(share) * (n + m) - 1e-9)
    left = F.least(n - F.col("place"), m - F.col("b_place"))
    fits = (F.col("own") != F.col("b_own")) & (n >= m) & (m >= F.lit(similarity) * n - 1e-9) & (left >= both - (MEET - 1))
    pairs = shingles.join(small, "h").where(fits).groupBy("rep", "key", "b", "b_key").agg(
        F.count("*").alias("_met"), F.max(F.least(F.lit(MEET), both)).alias("_due")).where("_met >= _due").select("rep", "key", "b", "b_key")
    if decided is not None:
        pairs = pairs.join(decided, ["rep", "key", "b", "b_key"], "left_anti")
    return stored(pairs, "further")


def _with_counts(pairs: DataFrame) -> DataFrame:
    """Stored `pairs` with n, how many there are with their b."""
    return pairs.join(pairs.groupBy("b", "b_key").agg(F.count("*").alias("n")), ["b", "b_key"])


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE,
                   similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of documents that share
    `similarity` of their word shingles or more, over any number of links.

    At such a similarity some ten of 64 bits differ, too many for pivots to propose pairs.
    So equal keys of smallest shingles propose, the pivot table discards by the maximum
    coordinate difference, and the shingles of both texts decide. Documents with equal
    sets of shingles are one node. A bucket of any size proposes one pair for each member,
    with its head; every band has other heads, so members of a large group meet several.
    This finds most links. Then all pairs of different groups that may still be alike are
    proposed by their first shingles (`_apart_but_alike`) and decided likewise, so that no
    link between two groups is left out.

    Documents without words are alike. Rows without an id are left out. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("text"))
    seen = stored(_described(rows, shingle, similarity), "described")
    nodes = seen.groupBy("digest").agg(F.min(F.struct("doc_id", "key", "fp", "bands", "n", "first")).alias("x")).select(
        "digest", F.col("x.doc_id").alias("rep"), "x.key", "x.fp", "x.bands", "x.n", "x.first")
    nodes = stored(nodes, "nodes")
    named = stored(seen.select("doc_id", "digest"), "named")
    discard(spark, seen)
    banded = nodes.select("rep", "key", "fp", F.posexplode("bands").alias("band", "h"))
    head = F.struct(F.xxhash64("rep", "band").alias("order"), F.col("rep").alias("b"), F.col("key").alias("b_key"), F.col("fp").alias("b_fp"))
    buckets = banded.groupBy("band", "h").agg(F.count("*").alias("n"), F.min(head).alias("head")).where("n > 1")
    buckets = stored(buckets.select("band", "h", "n", "head.b", "head.b_key", "head.b_fp"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 10_000 >= total  # 10,000 of them at most
    on = ["band", "h"]
    met = banded.join(F.broadcast(buckets.where(hot)), on).unionByName(
        banded.join(F.broadcast(buckets.where(hot)), on, "left_anti").join(buckets.where(~hot), on))
    coordinates = F.greatest(*[F.abs(_distance(F.col("fp"), pivot(i)) - _distance(F.col("b_fp"), pivot(i))) for i in range(TABLE_PIVOTS)])
    pairs = met.where((F.col("rep") != F.col("b")) & (coordinates <= APART)).groupBy("rep", "key", "b", "b_key").agg(F.max("n").alias("n"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                b = batch.column("b")[i].as_py()
                if b != last:
                    last, held = b, shingle_set(batch.column("other")[i].as_py(), shingle)
                own = shingle_set(batch.column("own")[i].as_py(), shingle)
                both = len(np.intersect1d(own, held, assume_unique=True))
                if both >= similarity * (len(own) + len(held) - both):
                    a = batch.column("a")[i].as_py()
                    found.append((max(a, b), min(a, b)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b (b < a) of those `pairs` (rep, key, b, b_key, n: pairs with b) whose texts are alike."""
        pairs = stored(pairs.withColumn("salts", F.ceil(F.col("n") / SALTED)).drop("n"), "pairs")

        heads = pairs.groupBy(F.col("b").alias("doc_id"), F.col("b_key").alias("key")).agg(F.max("salts").alias("salts"))
        members = pairs.groupBy(F.col("rep").alias("doc_id"), "key").agg(F.collect_list(F.struct("b", "b_key", "salts")).alias("others"))
        ids = stored(heads.select("doc_id").union(members.select("doc_id")).distinct(), "ids")
        bits = bloom.bits_for(ids.count())
        needed = rows.where(bloom.might_contain(bloom.build(ids, "doc_id", bits), F.col("doc_id"), bits)) if bits else rows
        once = needed.join(members.join(heads, ["doc_id", "key"], "full_outer"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
        texts = stored(once, "candidates")
        left = texts.where("others IS NOT NULL").select("doc_id", "text", F.explode("others").alias("o")).select(
            F.col("doc_id").alias("a"), F.col("text").alias("own"), "o.b", "o.b_key", F.pmod(F.xxhash64("doc_id"), F.col("o.salts")).alias("salt"))
        right = texts.where("salts IS NOT NULL").select(F.col("doc_id").alias("b"), F.col("key").alias("b_key"), F.col("text").alias("other"),
                                                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        linked = left.join(right, ["b", "b_key", "salt"]).select("a", "b", "own", "other").mapInArrow(decide, "a long, b long")
        found = stored(linked.where("a <> b").distinct(), "links")
        discard(spark, texts, pairs, ids)
        return found

    found = verified(pairs)
    discard(spark, buckets)
    # A few members of a group at a shingle, then all that are still apart: a group of any size
    # has most of what belongs to it by then, and shingles of one group alone propose nothing.
    reps = stored(nodes.select("digest", "rep"), "reps")
    shingles = _between_groups(_in_groups(nodes.select("rep", "key", "n", "first"), stored(components(found), "classes")).select(
        "rep", "key", "n", "own", F.posexplode("first").alias("place", "h")))
    discard(spark, nodes)
    further = _apart_but_alike(shingles, similarity, FEW)
    found = stored(found.union(verified(_with_counts(further))), "links")
    shingles = _between_groups(_in_groups(shingles.drop("own"), stored(components(found), "classes")), most_are=True)
    rest = _apart_but_alike(shingles, similarity, decided=further)
    if not rest.isEmpty():
        found = stored(found.union(verified(_with_counts(rest))), "links")
    discard(spark, shingles, further, rest)
    classes = components(found)
    labels = reps.join(classes, reps["rep"] == classes["id"], "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    return named.join(labels, "digest").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE,
                 similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each group of `similar_groups`: that with the smallest id.
    Rows without an id cannot be named and stay; rows that share an id stay or go together."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
