"""Placement of documents on shards by a lookup table that the shards fill in turns.

Each shard has a preference order over the slots of a prime-sized table, a permutation given by an offset
and a step. Shards take turns: each claims its most preferred slot that is still free (a shard of weight w
claims w slots a turn). A key's slot is its hash modulo the table size, so a look-up is one array access,
load is even to within a turn, and a shard that joins or leaves moves few other keys.

The table has ``slots`` entries however large the corpus is (65,537 by default, 0.8 MB as a frame), so
it may be broadcast. It depends on the shard names and weights alone.

A null key hashes as the empty string; repeated keys go to the same shard; an empty table gives an empty
result. Columns of the input stay unless they are called slot or shard, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The shard number at each slot."""
    if not _is_prime(slots):
        raise ValueError(f"the number of slots must be prime, for each step to reach all of them: {slots}")
    if not names or len(names) > slots or len(set(names)) != len(names):
        raise ValueError("there must be one shard at least, no more than slots, each with its own name")
    weights = list(weights or [1] * len(names))
    if len(weights) != len(names) or min(weights) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    at = [_number(x, "offset") % slots for x in names]
    step = [_number(x, "step") % (slots - 1) + 1 for x in names]
    table, free = [-1] * slots, slots
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % slots
                table[at[shard]] = shard
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the MD5 of the key as text, modulo the table size: the same in every engine."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_frame(spark: SparkSession, names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill(names, slots, weights))), "slot int, shard int")


def assign(docs: DataFrame, names: Sequence[str], *, key: str = "doc_id", slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """``docs`` with slot and shard. No shuffle: the lookup table is broadcast, its size is fixed by ``slots``."""
    table = F.broadcast(table_frame(docs.sparkSession, names, slots, weights))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(table, "slot", "left")


def write_shards(docs: DataFrame, path: str, names: Sequence[str], *, key: str = "doc_id", slots: int = SLOTS, files: int = 8) -> None:
    """One folder per shard. Slots, not shards, are dealt to tasks, so one shard is written by up to ``files`` tasks."""
    placed = assign(docs, names, key=key, slots=slots)
    placed.repartition("shard", F.pmod("slot", F.lit(files))).drop("slot").write.partitionBy("shard").parquet(path)


def op9_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return assign(sized, shard_names()).select("doc_id", "slot", "shard", "n_bytes")
