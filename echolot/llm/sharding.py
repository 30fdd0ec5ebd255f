"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by an
offset and a skip that hash from its name.  The shards take turns; in its turn a
shard claims the first slot of its permutation that is still free, until none is.
The filled table is small and of fixed size, so it is broadcast; the shard of a
row is the entry at the hash of its key modulo the table's size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Number of slots.  A prime over 100 times the number of shards keeps shares within about one percent.
SLOTS = 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the place in ``shards`` of the shard that claimed it.

    Names must differ and there must be one at least, but no more than slots;
    the number of slots must be prime, else a skip might not reach all of them.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least, and no more than slots")
    if not _prime(slots):
        raise ValueError("slots must be prime")
    place = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, of any type that casts to a string; null hashes as the empty string does."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` (underscores before the name where ``df`` has one of it).

    Equal keys share a shard, so repeated rows do; a null key counts as the empty
    string; an empty table stays empty.  One narrow pass: the table of ``slots``
    rows is broadcast, its size being a parameter and not that of the data.
    """
    spark = df.sparkSession
    slot, shard = fresh("slot", df.columns), fresh("shard", df.columns)
    rows = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))]
    filled = spark.createDataFrame(rows, f"`{slot}` int, `{shard}` string")
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), slots))
    return placed.join(F.broadcast(filled), slot).select(*(f"`{c}`" for c in df.columns), f"`{slot}`", f"`{shard}`")


def write(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 16) -> None:
    """Writes each shard of ``df`` as a Parquet folder of its own, of at most ``files`` files.

    Rows of a shard meet in that many tasks, by a hash of the whole row, so that neither
    a large shard nor a hot key is one task's; empty tables write no folder of a shard.
    """
    placed = place(df, key, shards, slots)
    shard = placed.columns[-1]
    salt = F.pmod(F.xxhash64(*(f"`{c}`" for c in df.columns)), F.lit(files))
    placed.drop(placed.columns[-2]).repartition(F.col(f"`{shard}`"), salt).write.partitionBy(shard).parquet(path)
