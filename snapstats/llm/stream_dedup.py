"""Exact duplicates by a streaming query whose keyed state lives on disk and never expires.

The stream reads the files of a table. Its state, in RocksDB below a checkpoint in the shared folder, has one entry
for each digest: the stable identifier of the row that stays (the largest key, then the last place), the locator of
its content (file and row number), and how many rows have had the digest. Rows are combined in each task before they
are dealt by digest, so a text that is a third of all rows reaches the state as one entry a task. Each micro-batch
writes the entries that it changed under its number, so a batch that is repeated after a failure overwrites itself.
``advance`` called again with the same folder goes on where it stopped: only new files are read, and what they
repeat is found in the state.

A digest proposes, the bytes decide: each row of a group is compared in full with the content at the group's
locator. Rows of a digest under which texts differ are grouped anew by their whole texts.

Texts are equal when identical after lower-casing A-Z. Null counts as empty, so nulls and empty texts are one group.
A null key is smaller than any other. Of rows with equal text and key the last in the table stays. Very long texts
travel as single values. Empty table: empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstats.llm.common import AT, FILE, stored
from snapstats.session import shared_dir

#: Bytes of input for each state store, and the fewest stores. A store takes 4 MB of local disk before its first entry, so there are no more than the input asks for.
STORE_BYTES, LEAST_STORES = 16 << 20, 12
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state store on disk; its buffers share a bounded piece of an executor's memory.
CONF = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOW)


def sha256(text: Column) -> Column:
    """The default digest, in 32 bytes."""
    return F.unhex(F.sha2(normal(text).cast("binary"), 256))


def _located(table: DataFrame, key: str, text: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    place = F.struct(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.xxhash64("_metadata.file_path").alias(FILE),
        F.coalesce("_metadata.row_index", F.lit(0)).cast("long").alias(AT),
    )
    return table.select(digest(F.col(f"`{text}`")).alias("digest"), place.alias("at"), *more)


def advance(spark: SparkSession, path: str, folder: str, *, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_at_once: int | None = None) -> None:
    """Take what is new below ``path`` into the state of ``folder``, and end. The first call settles how many stores there are."""
    table = spark.read.parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_STORES, size // STORE_BYTES))
    conf = CONF | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    source = spark.readStream.schema(table.select(key, text).schema)
    if files_at_once:
        source = source.option("maxFilesPerTrigger", files_at_once)
    # as a pattern, the path may be a file as well as a folder
    state = _located(source.parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"), key, text, digest).groupBy("digest").agg(F.max("at").alias("at"), F.count("*").alias("n"))

    def changed(entries: DataFrame, batch: int) -> None:
        entries.write.mode("overwrite").parquet(f"{folder}/changed/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(changed).trigger(availableNow=True).start()
    finally:  # the query has a copy of the settings
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    query.awaitTermination()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, at, n): the newest entry of each digest. Both values only grow, so the largest are the newest."""
    changed = spark.read.schema(f"digest binary, at struct<id: long, {FILE}: long, {AT}: long>, n long").parquet(f"{folder}/changed")
    return changed.groupBy("digest").agg(F.max("at").alias("at"), F.max("n").alias("n"))


def duplicates(spark: SparkSession, path: str, folder: str | None = None, *, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_at_once: int | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): a row for each row of the Parquet table at ``path``."""
    folder = folder or f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    advance(spark, path, folder, key=key, text=text, digest=digest, files_at_once=files_at_once)
    body = F.col(f"`{text}`").alias("body")
    own = digest is not sha256
    rows = _located(spark.read.parquet(path), key, text, digest, body, *[F.sha2(normal(body).cast("binary"), 256).alias("sha")] * own)
    sha = F.col("sha") if own else F.lower(F.hex("digest"))
    known = entries(spark, folder).select("digest", F.col("at").alias("keep"), "n")
    # one shuffle of the texts gives the rows' results and, of those in groups, the bytes to compare
    found = stored(
        rows.join(known, "digest").select("digest", "at", "keep", "n", sha.alias("text_sha256"), F.when(F.col("n") > 1, F.coalesce("body", F.lit(""))).alias("body"))
    )
    groups = found.where("n > 1")
    content = groups.where("at = keep").select("digest", F.col("body").alias("content"))
    differ = stored(groups.where("at <> keep").join(content, "digest").where(normal(F.col("body")) != normal(F.col("content"))).select("digest").distinct())
    if differ.head(1):
        found = _by_text(found, differ)
    return found.select(F.col("at.id").alias(key), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), "text_sha256")


def _by_text(found: DataFrame, differ: DataFrame) -> DataFrame:
    """Groups by whole texts where a digest stands for several."""
    mixed = found.join(differ, "digest", "left_semi").withColumn("body", normal(F.col("body"))).drop("keep", "n")
    exact = mixed.groupBy("digest", "body").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    mixed = mixed.join(exact, ["digest", "body"])
    return found.join(differ, "digest", "left_anti").select(*found.columns).unionByName(mixed.select(*found.columns))


def duplicates_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """As ``duplicates`` for any DataFrame: it is written first, for the stream to read."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).write.parquet(path)
    return duplicates(spark, path, key="key", text="text", **options).withColumnRenamed("key", key)


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark, f"{sf_dir}/documents.parquet")


OP12_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOW}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
