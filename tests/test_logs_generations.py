"""A keyed log equals its replay, whatever is compacted and repeated; files of several schemas read as one."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snapstats.operators.entries import EntryLog
from snapstats.operators.generations import merged, read_generations

SCHEMA = "k string, at long, op string, x long"


def replay(batches):
    best = {}
    for n, rows in batches.items():
        for k, at, op, x in rows:
            rank = (-1 if at is None else at, n, op == "delete", -1 if x is None else x)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, at, op, x)
    return sorted(((k, at, x) for k, (_, at, op, x) in best.items() if op == "put"), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_log_equals_replay(spark, tmp_path, seed):
    r = random.Random(seed)
    log, done = EntryLog(spark, f"{tmp_path}/log", "k string", "x long"), {}
    assert log.current().count() == 0 and log.compact() is None and log.clean() == []
    for n in range(7):
        rows = [(r.choice(["hot", "a", "b", "c", None, ""]), r.choice([None, *range(12)]), r.choice(["put", "put", "delete"]), r.choice([None, 1, 2])) for _ in range(r.randrange(9))]
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        for _ in range(r.randrange(1, 3)):  # a batch that is repeated
            log.write(df, n)
        done[n] = rows
        if r.random() < 0.5:
            assert log.compact() == n
            log.write(df, n)  # repeated after it was folded
            if r.random() < 0.5:
                log.clean()
        assert sorted(map(tuple, log.current().collect()), key=repr) == replay(done)
    assert [x.at for x in log.latest(2).collect()] == sorted((at for _, at, _ in replay(done)), key=lambda a: -1 if a is None else a, reverse=True)[:2]


def test_put_delete_and_late_entries(spark, tmp_path):
    log = EntryLog(spark, f"{tmp_path}/log", "k string, s int", "x long")
    key = lambda *rows: spark.createDataFrame(rows, "k string, s int, at long")
    log.put(key(("a", 1, 5), ("a", 2, 5)).withColumn("x", F.lit(7).cast("long")), 0)
    log.delete(key(("a", 1, 6)), 1)
    assert log.compact() == 1
    log.put(key(("a", 1, 3)).withColumn("x", F.lit(8).cast("long")), 2)  # late: older than the deletion
    assert [tuple(x) for x in log.current().collect()] == [("a", 2, 5, 7)]
    log.compact(forget_before=7)
    assert log.entries().count() == 1
    with pytest.raises(Exception, match="no such op"):
        log.write(key(("a", 1, 3)).select("*", F.lit("drop").alias("op"), F.lit(1).cast("long").alias("x")), 3)


def test_a_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    log = EntryLog(spark, f"{tmp_path}/log", "k string", "x long")
    log.write(spark.createDataFrame([("a", 1, "put", 1)], SCHEMA), 0)
    newest = EntryLog._newest
    monkeypatch.setattr(EntryLog, "_newest", lambda self: newest(self).withColumn("x", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        log.compact()
    monkeypatch.undo()
    assert [tuple(x) for x in log.current().collect()] == [("a", 1, 1)] and log.compact() == 0
    assert [tuple(x) for x in log.current().collect()] == [("a", 1, 1)]


def test_stream_of_entries(spark, tmp_path):
    rows = {n: [(f"k{i % 5}", n * 10 + i, "delete" if (i + n) % 4 == 0 else "put", i) for i in range(10)] for n in range(3)}
    log = EntryLog(spark, f"{tmp_path}/log", "k string", "x long")
    for n, held in rows.items():
        spark.createDataFrame(held, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        w = log.stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).option("checkpointLocation", f"{tmp_path}/state")
        w.trigger(availableNow=True).start().awaitTermination()
        log.compact()
        log.clean()
    assert sorted(map(tuple, log.current().collect()), key=repr) == replay(rows)


def test_generations(spark, tmp_path):
    write = lambda i, schema, *rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{i}")
    write(0, "id int, v smallint, gone string, n struct<a: int>, l array<struct<p: int>>", (1, 2, "g", (3,), [(4,)]), (None, None, None, None, None))
    write(1, "id bigint, v double, n struct<a: int, b: string>, l array<struct<p: int, q: int>>, Day date", (1 << 40, 2.5, (5, "b"), [(6, 7), None], None))
    write(2, "ID string, v float, day timestamp", ("x", 1.5, None))
    write(3, "id int", *[(9,)] * 2)
    got = read_generations(spark, [f"{tmp_path}/{i}" for i in range(4)])
    assert got.schema.simpleString() == "struct<id:string,v:double,gone:string,n:struct<a:int,b:string>,l:array<struct<p:int,q:int>>,Day:timestamp>"
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = [("1", 2.0, "g", (3, None), [(4, None)], None), (None,) * 6, (str(1 << 40), 2.5, None, (5, "b"), [(6, 7), None], None), ("x", 1.5, None, None, None, None)] + [("9",) + (None,) * 5] * 2
    assert rows == sorted(want, key=repr)


def test_generations_of_numbers_are_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) id", "cast(id as float) f").write.parquet(f"{tmp_path}/0")
    spark.range(1 << 40, (1 << 40) + 10).selectExpr("id", "cast(id as double) f", "id % 3 more").write.parquet(f"{tmp_path}/1")
    got = read_generations(spark, [f"{tmp_path}/0", f"{tmp_path}/1"])
    plan = got.where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert got.where("id > 5").count() == 14 and got.where("more is null").count() == 10


def test_kinds_that_nothing_holds():
    of = StructType.fromDDL
    assert merged(of("a decimal(5,2)"), of("a int")).simpleString() == "struct<a:decimal(12,2)>"
    for a, b in (("boolean", "int"), ("struct<x: int>", "string"), ("array<int>", "map<int, int>"), ("decimal(38,2)", "decimal(38,10)")):
        with pytest.raises(ValueError, match="a: nothing holds"):
            merged(of(f"a {a}"), of(f"a {b}"))
