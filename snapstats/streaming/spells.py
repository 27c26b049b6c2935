"""Dated rows as a stream: spells by session windows, and slices replaced as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from snapstats.operators.loads import replace_slices


def stream_spells(events: DataFrame, keys: Sequence[str], at: str, gap_days: int, late: str = "7 days") -> DataFrame:
    """T1 on a stream: sessions of a key's days that are ``gap_days`` apart or fewer; emitted when the watermark has passed them.

    State is one open session per key. A session window of n days merges rows exactly n days apart, like the
    batch form. Rows later than ``late`` are left out.
    """
    day = F.date_trunc("day", F.col(at))
    daily = events.withColumn("__day", day).withWatermark("__day", late)
    w = F.session_window("__day", f"{gap_days} days")
    out = daily.groupBy(*keys, w).agg(F.min("__day").alias("begin"), F.max("__day").alias("end"), F.count("*").alias("n_rows"))
    return out.select(*keys, F.to_date("begin").alias("begin"), F.to_date("end").alias("end"), "n_rows")


def stream_slices(rows: DataFrame, path: str, by: Sequence[str], load: str) -> DataStreamWriter:
    """L8 on a stream: the rows of one load replace what earlier loads wrote to the same slices.

    Below its slice a row lies in a folder of its load and of its micro-batch, and a batch overwrites only its
    own folders. So a batch that is repeated after a failure changes nothing, and a slice that arrives in several
    batches keeps them all. ``read_slices`` takes the newest load of each slice. Loads are ordered by name.
    """

    def write(batch: DataFrame, n: int) -> None:
        replace_slices(batch.withColumns({"load": F.lit(load), "batch": F.lit(n)}), path, [*by, "load", "batch"])

    return rows.writeStream.foreachBatch(write)


def read_slices(spark: SparkSession, path: str, by: Sequence[str], schema: str) -> DataFrame:
    """The rows of each slice's newest load; ``schema`` names all columns but ``load`` and ``batch``."""
    rows = spark.read.schema(f"{schema}, load string, batch long").parquet(path)
    newest = rows.select(*by, "load").distinct().groupBy(*by).agg(F.max("load").alias("load"))
    return rows.join(newest, [*by, "load"]).drop("load", "batch")
