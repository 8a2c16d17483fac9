"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and
a step, both hashes of its name; the prime makes the order a permutation). The shards take
turns; each claims the first slot of its order that is still free, until none is. The
filled table is of fixed size and broadcast; a row's key is hashed to a slot, whose owner
is its shard. Shares differ by at most one slot, and a shard that leaves moves few keys
besides its own.

Defined results: a null key is hashed like the empty string; equal keys share a shard, so
repeated rows do; texts aren't read, whatever their length; an empty table gives an empty
result; columns that clash are kept (see `placed`).
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.llm.common import free

#: Slots; prime and over a hundred times the usual number of shards.
SLOTS = 65537


def filled(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The owner of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime and not below that of shards")
    shards = sorted(shards)
    order = [(xxhash.xxh64_intdigest(s, 1) % slots, xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1) for s in shards]
    turn = [0] * len(shards)
    owner = [-1] * slots
    left = slots
    while left:
        for k, (at, step) in enumerate(order):
            while owner[slot := (at + turn[k] * step) % slots] >= 0:
                turn[k] += 1
            owner[slot] = k
            turn[k] += 1
            left -= 1
            if not left:
                break
    return [shards[k] for k in owner]


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(filled(shards, slots))), "slot int, shard string")


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df, all columns, with slot and shard; no shuffle, the table of `slots` rows is broadcast.

    Where df has a column of that name, ours gets underscores after it (`slot_`, `shard_`).
    """
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    place, owner = free("slot", df.columns), free("shard", df.columns)
    table = lookup(df.sparkSession, shards, slots).select(F.col("slot").alias("__crawlens_slot"), F.col("shard").alias("__crawlens_shard"))
    out = df.withColumn("__crawlens_slot", slot).join(F.broadcast(table), "__crawlens_slot")
    return out.select(*df.columns, F.col("__crawlens_slot").alias(place), F.col("__crawlens_shard").alias(owner))


def write(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 8) -> None:
    """Parquet folders shard=<name> (`shard_` if df has such a column); a shard's rows are dealt over `files_per_shard` tasks by slot."""
    rows = placed(df, key, shards)
    slot, shard = rows.columns[-2:]
    rows.repartition(len(shards) * files_per_shard, shard, F.pmod(slot, F.lit(files_per_shard))).drop(slot).write.partitionBy(shard).parquet(path)


def report(docs: DataFrame, shards: int = 64) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return placed(docs.select("doc_id"), "doc_id", [f"shard-{i:03d}" for i in range(shards)])
