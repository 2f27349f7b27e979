"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table (an offset and a
stride derived from its name). The shards take turns, each claiming the first slot of its order that
is still free, until the table is full. A key is placed by one hash and one lookup, shards differ by
at most one slot, and removing a shard moves few keys of the others.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Production parameters: the table has a prime number of slots, well over 100 for each shard.
SHARDS = 256
SLOTS = 65_537


def _preference(shard: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "little") % slots, int.from_bytes(digest[8:16], "little") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot. ``slots`` must be prime and not fewer than the shards."""
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, not fewer than the shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    table = np.full(slots, -1, np.int32)
    at, step = map(list, zip(*(_preference(s, slots) for s in shards), strict=True))
    free = slots
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) rows; ``slots`` of them whatever the data."""
    table = lookup_table(shards, slots)
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(table)], "slot int, shard int")


def shard(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to the rows of ``df``; existing columns of those names are replaced.

    The key is hashed as text, a null key as the empty text, so equal keys always share a shard. The
    broadcast table has ``slots`` rows, a parameter. No row is shuffled.
    """
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot")


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op5_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document; one row per row of documents."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"))
    return shard(docs, "doc_id", names()).select("doc_id", "slot", "shard")
