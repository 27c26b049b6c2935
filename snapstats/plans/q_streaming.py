"""The streaming forms, run to the end of the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapstats.plans.catalog import query
from snapstats.plans.q_loads import _folder
from snapstats.sources import adapters as A
from snapstats.streaming.spells import read_slices, stream_slices, stream_spells

C = F.col


def _events(spark, d):
    schema = A.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("t1_stream_spells", "SELECT user_id, CAST(min(date) AS VARCHAR) AS begin, CAST(max(date) AS VARCHAR) AS \"end\", CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT *, sum(CASE WHEN datediff('day', prev, date) <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY date) AS g FROM (SELECT user_id, date, n, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS prev FROM (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2))) GROUP BY user_id, g")
def t1_stream(spark, d):
    """Append mode: a spell leaves when the watermark has passed it and its state is dropped.

    A closing row far ahead of the table moves the watermark past all spells; it is left out of the result.
    """
    path = _folder(spark)
    events = A.table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts")
    events.write.parquet(f"{path}/in")
    last = events.agg(F.lit(None).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 60 days")).alias("ts"))
    last.where("ts is not null").write.mode("append").parquet(f"{path}/close")
    spells = lambda folder: stream_spells(spark.readStream.schema(events.schema).parquet(folder), ["user_id"], "ts", 1)
    for folder in ("in", "close"):  # one query, restarted on more input
        spark.read.parquet(f"{path}/{folder}").write.mode("append").parquet(f"{path}/all")
        w = spells(f"{path}/all").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
        w.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    out = spark.read.schema("user_id long, begin date, end date, n_rows long").parquet(f"{path}/out").where("user_id is not null")
    return out.withColumns({"begin": C("begin").cast("string"), "end": C("end").cast("string")})


@query("l8_stream_slices", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def l8_stream(spark, d):
    path = _folder(spark)
    rows = _events(spark, d).select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"))
    for load in ("2024-01", "2024-02"):  # the second load replaces the slices of the first
        w = stream_slices(rows, f"{path}/out", ["day"], load).trigger(availableNow=True)
        w.option("checkpointLocation", f"{path}/{load}").start().awaitTermination()
    out = read_slices(spark, f"{path}/out", ["day"], "event_id long, user_id long, day string")
    return out.groupBy("day").agg(F.count("*").alias("n"))
