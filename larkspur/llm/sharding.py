"""Consistent placement of rows on shards through a lookup table filled by permutations.

Each shard has a preference order over the slots of a prime-sized table (an offset and a stride from its name's md5).
The shards take turns; each claims the first slot of its order that is free, until the table is full. So every shard
holds as many slots as any other, give or take one, and few slots move when a shard joins or leaves. A row's slot is its
key's md5 modulo the table size; a broadcast of the table, whose size is the parameter, gives the shard in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table that is broadcast: about 16 bytes a slot.
MAX_SLOTS = 2_000_003


def next_prime(n: int) -> int:
    """The least prime that is n or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """The position of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if size < len(shards) or next_prime(size) != size or size > MAX_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:15], 16) % size for d in digests]
    stride = [int(d[15:30], 16) % (size - 1) + 1 if size > 2 else 1 for d in digests]
    slots, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                return slots


def table_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    rows = [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "_slot int, _shard string")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int | None = None, *, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row's key; nothing is shuffled.

    Null keys count as the empty text, equal keys (repeated rows too) go to one shard, empty tables give empty tables.
    Columns of df named like slot_col or shard_col are replaced. size: a prime, 100 slots a shard unless given.
    """
    size = size or next_prime(100 * len(shards))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    table = F.broadcast(table_frame(df.sparkSession, shards, size).withColumnsRenamed({"_slot": slot_col, "_shard": shard_col}))
    return df.withColumn(slot_col, slot).drop(shard_col).join(table, slot_col)
