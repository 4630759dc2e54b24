"""Placement of keys on shards by a table that the shards fill in turns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_SLOTS = 1_000_003   # keeps the broadcast table below some 20 MB


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard's order of slots begins, and its step; prime slots make it a permutation."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """Which shard (by place in `shards`) owns each slot.

    The shards take turns; each claims the first free slot in its own order. Each owns
    slots / len(shards) of them, give or take one, and a shard that comes or goes moves
    little besides its own. Depends on names and their order only.
    """
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, at least one")
    if not _prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards up to {MOST_SLOTS}")
    orders = [preference(s, slots) for s in shards]
    owner, turn = [-1] * slots, [0] * len(shards)
    for claim in range(slots):
        shard = claim % len(shards)
        start, step = orders[shard]
        slot = (start + turn[shard] * step) % slots
        while owner[slot] >= 0:
            turn[shard] += 1
            slot = (start + turn[shard] * step) % slots
        owner[slot] = shard
        turn[shard] += 1
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """slot int, shard string: one row per slot, a literal of the plan."""
    owners = F.from_json(F.lit(json.dumps([shards[i] for i in fill_table(shards, slots)])), "array<string>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key's string form; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: Sequence[str], slots: int, *, key: str = "doc_id", salt: str | None = None,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """`df` with the slot and shard of each row's key: one broadcast lookup, no shuffle.

    All rows of a key go to one shard. With `salt`, a column of whole numbers such as a
    row's number modulo 16, a hot key is spread over several. Null keys and salts have
    their own place. Repeated rows stay together. The table has `slots` rows, at most
    MOST_SLOTS, which bounds the broadcast. Columns named like the results are replaced.
    """
    source = F.col(key).cast("string")
    if salt is not None:
        source = F.concat_ws("#", source, F.col(salt).cast("string"))
    others = [F.col(c) for c in df.columns if c not in (slot_col, shard_col)]
    rows = df.select(F.struct(*others).alias("row"), slot_of(source, slots).alias("of")) if others else df.select(
        F.struct(F.lit(0).alias("none")).alias("row"), slot_of(source, slots).alias("of"))
    table = lookup_table(df.sparkSession, shards, slots)
    found = rows.join(F.broadcast(table), F.col("of") == F.col("slot"), "left")
    return found.select(*(["row.*"] if others else []), F.col("of").alias(slot_col), F.col("shard").alias(shard_col))


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", files: int = 1) -> None:
    """One folder per shard, written by `files` tasks each: shards are dealt out by hash
    of shard and a hash of the row, so that a large shard is no single task."""
    spread = F.pmod(F.xxhash64(*placed.columns), F.lit(files))
    placed.repartition(F.col(shard_col), spread).write.partitionBy(shard_col).parquet(path)
