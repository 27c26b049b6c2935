"""A keyed log that is written to: puts and deletions in batches, a compacted base, one commit at a time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from snapstats.operators.loads import _files


class EntryLog:
    """Entries by ``key``, the newest of which holds. ``columns`` is the payload, as a schema string.

    Below ``root`` each batch has a folder of its own, which a repeat overwrites, so a batch that comes again after a
    failure changes nothing. ``compact`` folds the batches up to the last into a base, which is written aside and
    renamed as its last step: a reader sees the old base and all batches or the new one. Of two entries of a key the one with
    the larger ``at`` holds, then the one of the later batch, then a deletion, then the larger payload; null is the
    least ``at``. The base keeps deletions, so an older put that arrives late brings nothing back.

    The newest entry is a partial aggregate: a key with a third of all rows leaves a task as one row.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, columns: str, at: str = "at long"):
        self.spark, self.root = spark, root.rstrip("/")
        self.key, self.at, self.columns = (self._names(spark, x) for x in (key, at, columns))
        self.schema = f"{key}, {at}, op string, {columns}"

    @staticmethod
    def _names(spark: SparkSession, schema: str) -> list[str]:
        return spark.createDataFrame([], schema).columns

    def _numbers(self, folder: str) -> list[int]:
        fs, at = _files(self.spark, f"{self.root}/{folder}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def write(self, entries: DataFrame, batch: int) -> None:
        """One batch: rows of key, at, payload and ``op``, which is ``put`` or ``delete``; any other is an error."""
        known = F.col("op").isin("put", "delete")
        op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))).cast("string"))
        entries.select(*self.key, *self.at, op.alias("op"), *self.columns).write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")

    def put(self, entries: DataFrame, batch: int) -> None:
        self.write(entries.withColumn("op", F.lit("put")), batch)

    def delete(self, keys: DataFrame, batch: int) -> None:
        """``keys`` has key and at."""
        kinds = self.spark.createDataFrame([], self.schema).schema
        self.write(keys.select(*self.key, *self.at, F.lit("delete").alias("op"), *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in self.columns]), batch)

    def stream(self, entries: DataFrame) -> DataStreamWriter:
        """The micro-batches of a stream as batches; the stream's checkpoint numbers them."""
        return entries.writeStream.foreachBatch(self.write)

    def entries(self) -> DataFrame:
        """(batch, key, at, op, payload): the newest base and the batches behind it."""
        bases = self._numbers("base")
        kept = [(n, f"{self.root}/batches/{n}") for n in self._numbers("batches") if not bases or n > bases[-1]]
        read = lambda path, extra: self.spark.read.schema(self.schema + extra).parquet(path)
        parts = [read(f"{self.root}/base/{bases[-1]}", ", batch long")] if bases else []
        if kept:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("long").alias("batch")
            rows = self.spark.read.schema(self.schema).parquet(*[path for _, path in kept])
            parts.append(rows.select("*", number))
        if not parts:
            return self.spark.createDataFrame([], self.schema + ", batch long")
        return reduce(DataFrame.unionByName, parts)

    def _newest(self) -> DataFrame:
        last = F.max(F.struct(*self.at, "batch", F.when(F.col("op") == "delete", 1).otherwise(0).alias("__gone"), "op", *self.columns)).alias("__x")
        return self.entries().groupBy(*self.key).agg(last).select(*self.key, "__x.*").drop("__gone")

    def current(self) -> DataFrame:
        """(key, at, payload): each key's newest entry, unless that is a deletion."""
        return self._newest().where("op = 'put'").select(*self.key, *self.at, *self.columns)

    def latest(self, n: int) -> DataFrame:
        """The ``n`` newest of ``current``, ties by key."""
        return self.current().orderBy(*[F.desc_nulls_last(c) for c in self.at], *self.key).limit(n)

    def compact(self, forget_before=None) -> int | None:
        """Fold all batches into a new base; returns its number, that of the last batch.

        Deletions with a smaller ``at`` than ``forget_before`` are left out: no put older than that may arrive later.
        """
        batches, bases = self._numbers("batches"), self._numbers("base")
        if not batches or (bases and batches[-1] <= bases[-1]):
            return bases[-1] if bases else None
        rows, aside = self._newest(), f"{self.root}/base/_{uuid.uuid4().hex}"
        if forget_before is not None:
            rows = rows.where(~F.coalesce((F.col("op") == "delete") & (F.col(self.at[0]) < F.lit(forget_before)), F.lit(False)))
        rows.write.parquet(aside)
        fs, at = _files(self.spark, aside)
        target = _files(self.spark, f"{self.root}/base/{batches[-1]}")[1]
        if fs.exists(target) or not fs.rename(at, target):
            raise RuntimeError(f"another compaction has committed {batches[-1]} meanwhile")
        return batches[-1]

    def clean(self, keep: int = 1) -> Sequence[str]:
        """Delete bases but the last ``keep`` and the batches that the oldest kept one holds; returns the folders that went.

        The last batch stays, so a stream that repeats it finds it.
        """
        bases, batches, gone = self._numbers("base"), self._numbers("batches"), []
        kept = bases[-keep:]
        gone += [f"base/{n}" for n in bases[: -keep]]
        gone += [f"batches/{n}" for n in batches[:-1] if kept and n <= kept[0]]
        for folder in gone:
            fs, at = _files(self.spark, f"{self.root}/{folder}")
            fs.delete(at, True)
        return gone
