"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size. The shards take turns; each claims the first
slot of its permutation that is still free, until all are claimed. Shares differ by one slot at most, and removing a
shard moves few slots of the others. A row is placed by hash and one lookup.

The table has a fixed size whatever the data (65,537 slots by default), so it may be broadcast. Placement needs no
shuffle. A null key goes to slot 0, an empty one by its hash; equal keys, ties and repeated rows share a shard, and very long keys are
hashed whole. Empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index into ``shards`` of each slot's owner. ``slots`` must be a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime larger than the number of shards, and there must be a shard")
    offset = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    owner, tried, free = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while True:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + tried[i] * skip[i]) % slots
                tried[i] += 1
                if owner[slot] < 0:
                    break
            owner[slot] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """By 60 bits of the key's MD5, which every SQL engine can compute."""
    hashed = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return F.coalesce(F.pmod(hashed, F.lit(slots)), F.lit(0)).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    owner = fill(shards, slots)
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], f"slot int, {name} string")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot, shard, and shard_without_last: where a row goes once the last shard is gone.

    They replace any of their names.
    """
    spark = df.sparkSession
    df = df.drop(*({"slot", "shard", "shard_without_last"} - {key}))
    placed = df.withColumn("slot", F.when(F.col(key).isNull(), F.lit(0)).otherwise(slot_of(F.col(key), slots)))
    placed = placed.join(F.broadcast(lookup(spark, shards, slots)), "slot", "left")
    if len(shards) > 1:
        placed = placed.join(F.broadcast(lookup(spark, shards[:-1], slots, "shard_without_last")), "slot", "left")
    return placed
