"""Placement on shards through a lookup table that permutations fill.

Every shard has a preference order over the slots of a prime-sized table: an offset and a skip, both
drawn from its name, visit all slots once. The shards take turns, by name, and each claims the first
slot of its order that is still free, until the table is full. So all shards get the same number of
slots but for one, and a shard that goes leaves most other claims as they were.

The table depends on the shards alone and holds a fixed number of small rows, so it is broadcast
whatever the data. A row is placed by one hash and one lookup, in the JVM. Rows with equal keys share
a shard by intent, and no other rows are moved together. A null key is replaced by the digest of the
text, so that rows without a key spread as others do; rows without either share one slot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The number of the shard, in order of names, that owns each slot. ``slots`` must be prime."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must have different names and be at most as many as the slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at, skip = [], []
    for name in sorted(shards):
        digest = hashlib.md5(name.encode()).hexdigest()
        at.append(int(digest[:15], 16) % slots)
        skip.append(int(digest[15:30], 16) % (slots - 1) + 1)
    owner = [-1] * slots
    for claim in range(slots):
        shard = claim % len(at)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % slots
        owner[at[shard]] = shard
    return owner


def slot_table(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``, one row per slot."""
    owners = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*map(F.lit, sorted(shards)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    word = F.coalesce(key.cast("string"), F.md5(text), F.lit(""))
    number = F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")
    return (number % slots).cast("int")


def place(
    docs: DataFrame,
    shards: tuple[str, ...] = SHARDS,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Adds ``slot`` and ``shard``; columns of these names are replaced. Empty tables stay empty."""
    table = F.broadcast(slot_table(docs.sparkSession, shards, slots))
    docs = docs.drop("slot", "shard")
    return docs.withColumn("slot", slot_of(F.col(key), F.col(text), slots)).join(table, "slot")
