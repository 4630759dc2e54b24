"""Removal of repeated runs of lines. A rolling hash over line hashes cuts texts into chunks
of lines; chunks whose first lines occur more than once propose; lines go after a
comparison of bytes with their first occurrence, line by line to both sides.

Column expressions and joins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.llm.common import discard, stored

RUN_WORDS = 10                 # a run of two lines or more counts from so many words on
PASSAGE_WORDS = 50             # a single line counts from so many on
SPREAD = 3                     # one line in so many begins a chunk
LONG_LINE = 150                # bytes from which a line may have so many words, and is a chunk of its own
HOT_HASHES = 10_000            # at most so many hashes have so great a part of all chunks each
SALTED = 5_000                 # copies of a chunk that meet its first occurrence in one place

MARK = "\u0001"
LINE_END = r"(?<=[\n ])(?<=\n|[.!?] )"
SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIRST_LETTERS = rf"([^{SPACE}])[^{SPACE}]*+[{SPACE}]*+|[{SPACE}]++"
NO_ID = -(1 << 63)


def spaced_words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.length(F.regexp_replace(text, FIRST_LETTERS, "$1"))


def has_words(text: Column, n: Column) -> Column:
    """Whether there are n words. Where blanks alone part as many, nothing else is looked at."""
    return F.when(F.size(F.array_remove(F.split(text, " ", -1), "")) >= n, True).otherwise(spaced_words(text) >= n)


def lines_of(text: Column) -> Column:
    """Lines with their ends, so that they join to the text: up to a line break or the end of
    a sentence; empty lines belong to the one before. The ends are marked and split at the
    mark, which is cheaper than a pattern; texts that hold the mark itself take the pattern."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    for empty in ("\r\n", "\n"):
        marked = F.replace(marked, F.lit(MARK + empty), F.lit(empty))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END, -1)).otherwise(F.split(marked, MARK, -1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, also where a lambda of the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \n\r\t"))


def _hashes(lines: Column) -> Column:
    """Hashes of the bare lines; the lowest bit says that a line is long."""
    def one(line: Column) -> Column:
        return F.shiftleft(F.shiftright(F.xxhash64(_bare(line)), 1), 1).bitwiseOR((F.octet_length(line) >= LONG_LINE).cast("long"))

    return F.transform(lines, one)


def _empty() -> Column:
    """The hash of a line without anything."""
    return F.shiftleft(F.shiftright(F.xxhash64(F.lit("")), 1), 1)


def _rolled(first: Column, second: Column) -> Column:
    """A cyclic polynomial over the hashes of two lines."""
    return F.shiftleft(first, 1).bitwiseOR(F.shiftrightunsigned(first, 63)).bitwiseXOR(second)


def _starts(hashes: Column) -> Column:
    """Numbers of the lines that begin a chunk: one in SPREAD, as the rolling hash over it
    and the next one says, and every long line. Lines that come or go elsewhere move no start
    but that of the line before them."""
    def begins(i: Column) -> Column:
        own, after = F.get(hashes, i), F.get(hashes, i + 1)
        pair = (F.pmod(_rolled(own, after), F.lit(SPREAD)) == 0) & (own != _empty()) & (after != _empty())
        return (own.bitwiseAND(F.lit(1)) == 1) | F.coalesce(pair, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), begins)


def _chunk_key(hashes: Column, i: Column) -> Column:
    """What proposes a chunk: a long line, or the first two lines."""
    own = F.get(hashes, i)
    return F.when(own.bitwiseAND(F.lit(1)) == 1, own).otherwise(F.xxhash64(own, F.get(hashes, i + 1)))


def chunk_keys(text: Column) -> Column:
    """h, at (number of the first line) and lo, hi of each chunk: the lines behind the start
    before it, and those up to the next start. A repeated run is compared in there; what it
    has beyond, other chunks propose."""
    def of_hashes(hashes: Column, starts: Column) -> Column:
        return F.transform(starts, lambda i, k: F.struct(
            _chunk_key(hashes, i).alias("h"), i.alias("at"), F.coalesce(F.get(starts, k - 1) + 1, F.lit(0)).alias("lo"),
            F.coalesce(F.get(starts, k + 1), F.size(hashes) - 1).alias("hi")))

    return _let(_hashes(lines_of(text)), lambda hashes: _let(_starts(hashes), lambda starts: of_hashes(hashes, starts)))


def pieces_of(hits: str) -> Column:
    """Chunks of a document (src_id, src_key, shift, lo, hi, n) that are proposed against the same
    document, equally shifted and one behind the other, as one piece each."""
    def of_sorted(hits: Column) -> Column:
        def begins(i: Column) -> Column:
            x, y = F.get(hits, i), F.get(hits, i - 1)
            return (i == 0) | (x["src_id"] != y["src_id"]) | (x["src_key"] != y["src_key"]) | (x["shift"] != y["shift"]) | (x["lo"] > y["hi"] + 1)

        def joined(begin: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                x, until = F.get(hits, i), F.coalesce(F.get(begin, k + 1), F.size(hits)) - 1
                n = F.array_max(F.transform(F.slice(hits, i + 1, until - i + 1), lambda h: h["n"]))
                # The source has no lines before its first.
                return F.struct(x["src_id"].alias("src_id"), x["src_key"].alias("src_key"), x["shift"].alias("shift"),
                                F.greatest(x["lo"], x["shift"]).alias("lo"), F.get(hits, until)["hi"].alias("hi"),
                                F.ceil(n / SALTED).cast("int").alias("salts"))

            return F.transform(begin, one)

        return _let(F.filter(F.sequence(F.lit(0), F.size(hits) - 1), begins), joined)

    return _let(F.sort_array(hits), of_sorted)


def with_lines(text: Column, wanted: str) -> Column:
    """`wanted` (structs with lo and hi), each with its bare lines."""
    return _let(lines_of(text), lambda lines: F.transform(wanted, lambda w: w.withField(
        "lines", F.transform(F.slice(lines, w["lo"] + 1, w["hi"] - w["lo"] + 1), _bare))))


def islands(gone: Column) -> Column:
    """first and last of the unbroken pieces of a set of line numbers."""
    def of_sorted(numbers: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(numbers) - 1), lambda i: (i == 0) | (F.get(numbers, i) != F.get(numbers, i - 1) + 1))
        return _let(begins, lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(numbers, i).alias("first"), F.get(numbers, F.coalesce(F.get(b, k + 1), F.size(numbers)) - 1).alias("last"))))

    return _let(F.sort_array(F.array_distinct(gone)), of_sorted)


def _without(text: Column, gone: str) -> Column:
    """text and pieces: the text less those unbroken pieces of `gone` that count."""
    def of_lines(lines: Column) -> Column:
        def counts(p: Column) -> Column:
            own = F.slice(lines, p["first"] + 1, p["last"] - p["first"] + 1)
            several = F.size(F.filter(own, lambda x: _bare(x) != "")) > 1
            return _let(F.array_join(own, ""), lambda x: has_words(x, F.when(several, RUN_WORDS).otherwise(PASSAGE_WORDS)))

        def cut(pieces: Column) -> Column:
            out = F.flatten(F.transform(pieces, lambda p: F.sequence(p["first"], p["last"])))
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
            return F.struct(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "").alias("text"), F.size(pieces).alias("pieces"))

        return _let(F.filter(islands(F.col(gone)), counts), cut)

    return _let(lines_of(text), of_lines)


def _repeated(index: DataFrame) -> DataFrame:
    """h, n and the first place (first_id, first_key, first_at) of the chunks that occur more than
    once. The smallest id is found for all; where it is, for those that repeat alone."""
    counted = index.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return stored(counted, "repeated")


def _with_repeated(index: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of the index whose hash repeats. Hashes of a ten-thousandth of all repeated chunks
    or more, of which there are HOT_HASHES at most, are broadcast; the others are joined."""
    total = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_HASHES >= total
    hot, cold = F.broadcast(repeated.where(is_hot)), repeated.where(~is_hot)
    return index.join(hot, "h").unionByName(index.join(hot, "h", "left_anti").join(cold, "h"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text of `text_col` less its repeated runs of lines, and removed_chunks
    (pieces that went), removed_chars (both 0 where the text stays as it was).

    A chunk is compared byte by byte, line by line, forward to the next start and backward to
    the one before, with the first one in the table that begins with the same two lines, or
    the same long line: smallest id, then smallest hash of the text, then place. Neighbours
    that are equally shifted against one document are compared in one. Equal lines go
    if they make up a piece of two lines and RUN_WORDS words, or of PASSAGE_WORDS words,
    parted by any white space. White space at the end of a line is not compared. A removed
    line always has an equal one at an earlier place, so the first of equal lines stays.

    Hashes and places are shuffled for all documents, texts once by document; those of
    documents that lose something a second time. A chunk that very many documents share
    is broadcast while it is looked up, and salted where its copies meet the first one.

    Ids must be whole numbers or null, which is smaller than all others. A null or empty
    text stays. Rows that share id and text are one document and stay alike. A document of
    which everything is repeated becomes empty. Other columns are kept whatever their
    names, but for the two that are added, which replace those of the same name. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("removed_chunks", "removed_chars")]
    others = [F.col(c) for c in columns if c != text_col] or [F.lit(0).alias("none")]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("key"),
                       F.col(text_col).alias("text"), F.struct(*others).alias("row"))
    index = rows.where(F.length("text") > 0).select("id", "key", F.explode(chunk_keys(F.col("text"))).alias("c"))
    index = stored(index.select("c.h", "id", "key", "c.at", "c.lo", "c.hi"), "chunks")
    counted = _repeated(index)
    found = stored(_with_repeated(index, counted), "found")
    first = (found.where("id = first_id").groupBy("h").agg(F.min(F.struct("key", "at")).alias("f"))
             .select("h", F.col("f.key").alias("first_key"), F.col("f.at").alias("first_at")))
    first = stored(first.join(counted, "h"), "first")
    later = (F.col("id") != F.col("first_id")) | (F.col("key") != F.col("first_key")) | (F.col("at") != F.col("first_at"))
    hit = F.struct(F.col("first_id").alias("src_id"), F.col("first_key").alias("src_key"), (F.col("at") - F.col("first_at")).alias("shift"), "lo", "hi", "n")
    hits = _with_repeated(found.drop("n", "first_id"), first).where(later).groupBy("id", "key").agg(F.collect_set(hit).alias("hits"))
    own = stored(hits.select("id", "key", pieces_of("hits").alias("own")), "pieces")
    discard(spark, index, found)
    asked = own.select(F.inline("own")).groupBy("src_id", "src_key", (F.col("lo") - F.col("shift")).alias("lo"), (F.col("hi") - F.col("shift")).alias("hi")).agg(
        F.max("salts").alias("salts")).groupBy(F.col("src_id").alias("id"), F.col("src_key").alias("key")).agg(
        F.collect_list(F.struct("lo", "hi", "salts")).alias("asked"))
    marks = own.join(asked, ["id", "key"], "full_outer")
    marked = stored(rows.join(marks.hint("shuffle_hash"), ["id", "key"], "left"), "marked")

    def places(of: str) -> DataFrame:
        rows = marked.where(F.col(of).isNotNull()).select("id", "key", F.explode(with_lines(F.col("text"), of)).alias("w"))
        return rows.select("id", "key", "w.*")

    salt = F.pmod(F.xxhash64("id", "key"), F.col("salts"))
    mine = places("own").select("id", "key", "src_id", "src_key", "lo", "lines", (F.col("lo") - F.col("shift")).alias("src_lo"),
                                (F.col("hi") - F.col("shift")).alias("src_hi"), salt.alias("salt"))
    theirs = places("asked").dropDuplicates(["id", "key", "lo", "hi"]).select(
        F.col("id").alias("src_id"), F.col("key").alias("src_key"), F.col("lo").alias("src_lo"), F.col("hi").alias("src_hi"),
        F.col("lines").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - F.lit(1).cast("long"))).alias("salt"))
    same = F.zip_with("lines", "src", lambda x, y: F.coalesce(x == y, F.lit(False)))
    gone = mine.join(theirs, ["src_id", "src_key", "src_lo", "src_hi", "salt"]).select(
        "id", "key", F.array_compact(F.transform(same, lambda x, i: F.when(x, F.col("lo") + i))).alias("gone"))
    gone = stored(gone.where(F.size("gone") > 0).groupBy("id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone")), "gone")

    touched = marked.where("own IS NOT NULL").join(gone.hint("shuffle_hash"), ["id", "key"], "left").withColumn(
        "new", F.when(F.col("gone").isNotNull(), _without(F.col("text"), "gone")))
    pieces = F.coalesce(F.col("new.pieces"), F.lit(0))
    touched = touched.select("row", F.when(pieces > 0, F.col("new.text")).otherwise(F.col("text")).alias("text"), pieces.alias("removed_chunks"),
                             F.when(pieces > 0, F.length("text") - F.length("new.text")).otherwise(0).alias("removed_chars"))
    same = marked.where("own IS NULL").select("row", "text", F.lit(0).alias("removed_chunks"), F.lit(0).alias("removed_chars"))
    out = same.unionByName(touched).select(
        *[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns], "removed_chunks", "removed_chars")
    return out
