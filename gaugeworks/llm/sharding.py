"""Sharding with a permutation-filled lookup table, in DataFrame functions only.

A table of prime size is filled by the shards: each has a preference order of the slots, a permutation
``(offset + j * skip) mod size`` that follows from its name, and the shards take turns, each claiming the
first slot of its order that is still free, until none is. A row's key is hashed to a slot. Shards
so hold slots in equal numbers to within one, and when a shard comes or goes, few keys of the others move.

The table depends on the shard names alone and has ``SLOTS`` rows at any size of data, so it is broadcast.

Defined cases: a null key has a slot of its own kind, that of the text "null"; repeated keys share a
shard; an empty table gives an empty result; extra columns are carried. No shard, a repeated shard name or
a size that is not a prime of at least 100 slots per shard is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def _number(text: str) -> int:
    """60 bits of a digest; SQL engines can compute the same."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def claims(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (by place in ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if slots < 100 * len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least 100 times the number of shards")
    place = [_number(f"offset {name}") % slots for name in shards]
    skip = [_number(f"skip {name}") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[place[shard]] >= 0:
            place[shard] = (place[shard] + skip[shard]) % slots
        owner[place[shard]] = shard
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard`` (name) of every slot."""
    owners = F.split(F.lit(",".join(map(str, claims(shards, slots)))), ",").cast("array<int>")
    names = F.array(*[F.lit(name) for name in shards])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner") + 1).alias("shard"))


def slot(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, into: str = "shard") -> DataFrame:
    """``df`` with the shard of every row in a column ``into`` (which must be new)."""
    if into in df.columns:
        raise ValueError(f"there is a column {into} already")
    table = F.broadcast(lookup(df.sparkSession, shards, slots).select(F.col("slot").alias("_slot_of_table"), F.col("shard").alias(into)))
    return df.join(table, slot(F.col("`" + key.replace("`", "``") + "`"), slots) == F.col("_slot_of_table")).drop("_slot_of_table")


def balance(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows per shard."""
    return placed.groupBy(shard).agg(F.count("*").alias("n_rows"))
