"""Placement by a permutation-filled lookup table (DataFrame operations only).

Each shard orders the slots of a prime-sized table by (offset + j * skip) mod M, both derived from its name. Shards
take turns in claiming the first free slot of their order until the table is full. A key hashes to a slot, and the
table, M rows whatever the data, is broadcast: placement costs one hash and one lookup a row and no shuffle. Shares
differ by one slot at most, and when a shard leaves, few keys besides its own move.

Defined results: a null key is placed like the empty string; repeated keys share a shard; an empty table gives an
empty result; a column of the input named like an output column gives way to it (output names are parameters).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

SHARDS, SLOTS = 64, 8191


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def filled_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The slot table: entry i is the index of the shard that claimed slot i."""
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shard names must be distinct, and no more than slots")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of its MD5 modulo the table size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """`df` with its slot and the name of its shard."""
    spark = df.sparkSession
    claims = ",".join(map(str, filled_table(shards, slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(claims), ",")).alias("_slot", "_claim"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = table.select(F.col("_slot").cast("long"), F.element_at(names, F.col("_claim").cast("int") + 1).alias("_name"))
    rows = df.select(F.struct(*df.columns).alias("row"))  # so no column can clash
    placed = rows.withColumn("_at", slot_of(F.col("row")[key_col], slots)).join(F.broadcast(table), F.col("_at") == F.col("_slot"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in (slot_name, shard_name)]
    return placed.select(*kept, F.col("_at").alias(slot_name), F.col("_name").alias(shard_name))
