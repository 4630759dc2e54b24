"""A Bloom filter of ids as a column expression, sized by the number of ids.

The filter is made by tasks (bits or-ed word by word), and reaches the scans as the
value of a scalar subquery, so rows are dropped where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_ID = 12
HASHES = 6               # 12 bits and 6 hashes: some 0.4 % false positives
MOST_BITS = 1 << 29      # 64 MB, what 44 million ids take
CHUNK = 1 << 16          # words put together in one task


def bits_for(n_ids: int) -> int | None:
    """Bits of a filter for so many ids; None if it would be too large to send around."""
    bits = -(-max(1, n_ids) * BITS_PER_ID // 64) * 64
    return bits if bits <= MOST_BITS else None


def _places(value: Column, bits: int) -> list[Column]:
    """Where the bits of a value are: two halves of one hash give all places."""
    h = F.xxhash64(value)
    low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [F.pmod(low + high * i, F.lit(bits)) for i in range(HASHES)]


def build(ids: DataFrame, id_col: str, bits: int) -> DataFrame:
    """One row, one column: the words of the filter, in chunks."""
    place = F.explode(F.array(*_places(F.col(id_col), bits)))
    words = ids.where(F.col(id_col).isNotNull()).select(place.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int")).alias("bits"))
    zeros = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = words.union(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def in_order(key: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])

    chunks = whole.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(in_order("word", "bits").alias("words"))
    return chunks.agg(in_order("chunk", "words").alias("filter"))


def might_contain(made: DataFrame, value: Column, bits: int) -> Column:
    """True for every value in the filter `made` by `build`, and for few others."""
    words = made.scalar()

    def held(place: Column) -> Column:
        word = F.shiftright(place, 6)
        chunk = F.get(words, F.floor(word / CHUNK).cast("int"))
        bit = F.get(chunk, F.pmod(word, F.lit(CHUNK)).cast("int"))
        return F.getbit(bit, F.pmod(place, F.lit(64)).cast("int")) == 1

    out = F.lit(True)
    for place in _places(value, bits):
        out = out & held(place)
    return out
