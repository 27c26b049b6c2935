"""Edges that the given tables don't have, on hand-written frames, and invariants between two plans of one operator."""

import datetime as dt
import itertools
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstats.functions import scalars as S
from snapstats.operators import loads, models, relational, scoring, sequences
from snapstats.session import checkpoint
from snapstats.streaming.spells import read_slices, stream_slices, stream_spells

D = dt.date.fromisoformat


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head().x


@pytest.mark.parametrize("value, linear, tiers, proportional", [(0, 0.525, 0.5, 0.05), (1, 0.525, 0.5, 0.05), (4, 0.6, 0.5, 0.2), (5, 0.625, 0.7, 0.25), (9, 0.725, 0.7, 0.45), (10, 0.75, 0.85, 0.5), (15, 0.875, 0.95, 0.75), (17, 0.925, 0.95, 0.85), (18, 0.95, 1.0, 0.9), (20, 1.0, 1.0, 1.0), (21, 1.0, 1.0, 1.0), (None, None, None, None)])
def test_familiarity(spark, value, linear, tiers, proportional):
    for curve, want in (("linear_floor", linear), ("tiers", tiers), ("proportional", proportional)):
        got = one(spark, S.familiarity_multiplier(F.col("v").cast("int"), curve), v=value)
        assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("born, at, age", [("2000-05-10", "2020-05-09", 19), ("2000-05-10", "2020-05-10", 20), ("2000-05-10", "2020-05-11", 20), ("2000-02-29", "2021-02-28", 20), ("2000-02-29", "2021-03-01", 21)])
def test_birthdays(spark, born, at, age):
    assert one(spark, S.age_at(F.col("b"), F.col("a")), b=D(born), a=D(at)) == age


@pytest.mark.parametrize("order, on, off, minutes", [(3, 255, 255, 90), (3, 255, 60, 60), (14, 70, 255, 20), (14, 255, 255, 0), (14, 60, 80, 20)])
def test_participation(spark, order, on, off, minutes):
    assert one(spark, S.minutes(F.col("o"), F.col("n"), F.col("f")), o=order, n=on, f=off) == minutes


def test_phases(spark):
    df = spark.createDataFrame([(2020, "start"), (2020, "mid"), (2020, "end"), (2020, "2019-12-01"), (2020, "junk")], "s long, p string")
    got = [tuple(r) for r in df.select(S.phase_date(F.col("s"), F.col("p")), S.phase_key(F.col("p"))).collect()]
    assert got == [(D("2019-07-01"), "0000-00-00"), (D("2020-01-01"), "0000-00-01"), (D("2020-06-30"), "0000-00-02"), (D("2019-12-01"), "2019-12-01"), (None, "junk")]


def test_text_rules(spark):
    assert one(spark, S.fold(F.col("t")), t="KIRKLARELİ ığüş É") [:6] == "kirkla"
    assert one(spark, S.surname_key(F.col("t")), t="Jan van Dijk") == "dijk|jan van"
    assert one(spark, S.surname_key(F.col("t")), t=" ") > "zzzz"
    assert one(spark, S.parse_ratings(F.col("t")), t="DL 18, DC 12, x") == {"DL": 18, "DC": 12}
    assert one(spark, S.lines_of(F.col("t")), t="4-x-2") is None
    assert [one(spark, S.line_of_slot(F.col("t"), F.lit(s)), t="4-4-2") for s in (1, 2, 5, 6, 11, 12)] == [-1, 0, 0, 1, 2, None]
    assert one(spark, S.foot(F.lit(18), F.lit(17))) == "Either" and one(spark, S.foot(F.lit(10), F.lit(5))) == "Left only"
    assert one(spark, S.is_friendly(F.col("t").cast("string")), t=None) is False


WEIGHTS = [("m", "r", "a0", 4), ("m", "r", "zz", 9), ("m", "q", "a1", 2)]


def test_weighted_scores_agree(spark):
    r = random.Random(1)
    rows = [(i, *[r.choice([None, r.randint(1, 20)]) for _ in range(3)]) for i in range(50)] + [(99, None, None, None)]
    df, w = spark.createDataFrame(rows, "id long, a0 long, a1 long, a2 long"), spark.createDataFrame(WEIGHTS, "method string, role string, attribute string, weight long")
    fused = {(x.id, x.role): x.rating for x in scoring.weighted_scores(df, w, ["a0", "a1", "a2"]).collect()}
    plain = {(x.id, x.role): x.rating for x in scoring.weighted_scores_exploded(df, w, ["a0", "a1", "a2"], ["id"]).collect()}
    assert fused == plain and (99, "r") not in fused


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", None), ("b", 5), (None, 2), (None, 4)], "g string, v long")
    out = df.select("g", "v", scoring.percent_rank("v", ["g"], "p"), scoring.rank_desc("v", ["g"], "r"))
    columns = {"b": scoring.below_share(), "w": scoring.average_rank_percent(), "i": scoring.inclusive_percent(), "p2": scoring.share_below(), "r2": scoring.place_from_top()}
    out = scoring.with_places(out, ["g"], "v", columns)
    assert all((r.p, r.r) == (r.p2, r.r2) for r in out.collect())
    got = {(r.g, r.v): (r.p, r.r, r.b, r.w, r.i) for r in out.collect()}
    assert got["a", 1] == (0.0, 2, None, 37.5, 50.0) and got["a", None] == (100.0, 4, None, 100.0, 100.0)
    assert got["b", 5][:2] == (0.0, 1) and got[None, 4][:2] == (100.0, 1)
    index = {(r.g, r.v): r.x for r in scoring.index_within(df, "v", ["g"], "x").collect()}
    assert index["b", 5] == 100.0 and index["a", 3] > 100 > index["a", 1]


def test_standing_by_counts_is_the_window(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice(["x", "y", None]), float(r.randint(1, 9))) for _ in range(300)] + [("z", 1.0)], "g string, v double")
    a = sorted((str(x.g), x.v, x.pctile_s, x.rank_s, x.n_s) for x in scoring.standing_by_counts(df, {"s": ["g"]}, "v").collect())
    b = df.select("g", "v", scoring.percent_rank("v", ["g"], "p"), scoring.rank_desc("v", ["g"], "r"), F.count("*").over(__import__("pyspark").sql.Window.partitionBy("g")).alias("n"))
    assert a == sorted((str(x.g), x.v, x.p, x.r, x.n) for x in b.collect())
    nulls = df.unionByName(spark.createDataFrame([("x", None), ("x", None), ("w", None)], "g string, v double")).withColumn("l", F.col("v") * 7 % 5)
    c, d = (sorted((str(tuple(x)) for x in f(nulls, {"s": ["g"]}, "v", "l").select("g", "v", "pctile_s", "rank_s", "level_s", "n_s").collect())) for f in (scoring.standing, scoring.standing_by_counts))
    assert c == d


def test_mirror_dedup(spark):
    rows = [(1, 2, 3, 1, 10), (2, 1, 1, 3, 11), (1, 2, 2, 2, 12), (2, 1, 3, 1, 13)]
    df = spark.createDataFrame(rows, "a long, b long, sa long, sb long, off long")
    got = sorted(tuple(r) for r in relational.mirror_dedup(df, "a", "b", "sa", "sb", "off").collect())
    assert got == [(1, 2, 2, 2, 1, 12), (1, 2, 3, 1, 2, 10), (2, 1, 3, 1, 1, 13)]
    assert relational.mirror_dedup(df, "a", "b", "sa", "sb", "off", least=2).count() == 1


def test_votes_and_table(spark):
    votes = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "z"), ("g", None)], "k string, v string")
    assert {(r.k, r.v) for r in relational.modal(votes, "k", "v", 1).collect()} == {("e", "a"), ("f", "z")}
    assert relational.modal(votes, "k", "v", 2).count() == 0
    table = spark.createDataFrame([(1, 6, 4, 2), (2, 6, 5, 3), (3, 6, 5, 3), (4, 7, 0, 0)], "t long, points long, gf long, ga long")
    assert [r.t for r in relational.table_order(table, [], "t").orderBy("place").collect()] == [4, 2, 3, 1]


def test_as_of(spark):
    facts = spark.createDataFrame([("e", "2", "x"), ("e", "4", None), ("e", "6", "z")], "k string, at string, v string")
    asked = spark.createDataFrame([("e", a) for a in "123456"] + [("none", "3")], "k string, at string")
    got = {(r.k, r.at): r.v for r in relational.as_of(asked, facts, ["k"], "at", "v").collect()}
    assert got == {("e", "1"): None, ("e", "2"): "x", ("e", "3"): "x", ("e", "4"): "x", ("e", "5"): "x", ("e", "6"): "z", ("none", "3"): None}
    assert {r.v for r in relational.latest(facts, ["k"], "at", "v").collect()} == {"z"}


def test_upsert_and_defaults(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), spark.createDataFrame([("b", 3), ("b", 4)], "k string, v long")
    assert sorted(tuple(r) for r in relational.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", 3), ("b", 4)]
    assert sorted(tuple(r) for r in relational.insert_absent(old, spark.createDataFrame([("b", 9), ("c", 9)], "k string, v long"), ["k"]).collect()) == [("a", 1), ("b", 2), ("c", 9)]
    assert relational.upsert(old, new.limit(0), ["k"]).count() == 2


def test_spells_and_runs(spark):
    days = spark.createDataFrame([("e", D(x), 1) for x in ("2024-01-01", "2024-01-03", "2024-01-06", "2024-01-06")] + [("e", D("2024-01-01"), 2)], "k string, d date, f long")
    got = sorted((r.begin.day, r.end.day, r.n) for r in sequences.spells(days, ["k"], "d", 2).collect())
    assert got == [(1, 3, 2), (6, 6, 1)]
    both = sequences.flag_spells(days, ["k"], "d", "f", {"one": 1, "two": 2}, 9)
    assert sorted((r.kind, r.n) for r in both.collect()) == [("one", 3), ("two", 1)]
    for flags, want in (("", 0), ("000", 0), ("111", 3), ("1101", 2), ("0110111", 3), ("11011", 2)):
        df = spark.createDataFrame([("e", D("2024-01-01") + dt.timedelta(i), c == "1") for i, c in enumerate(flags)], "k string, d date, f boolean")
        got = sequences.longest_run(df, ["k"], ["d"], "f").collect()
        assert [r.length for r in got] == ([want] if flags else [])
        if want == 2 and flags == "11011":
            assert got[0].begin == D("2024-01-01")


def test_interval_union(spark):
    rows = [("2024-01-01", "2024-01-10", 1), ("2024-01-02", "2024-01-03", 5), ("2024-01-11", "2024-01-12", 2), ("2024-01-14", "2024-01-15", 3), ("2024-01-14", "2024-01-15", 3)]
    df = spark.createDataFrame([("e", D(b), D(e), w) for b, e, w in rows], "k string, b date, e date, w long")
    got = sorted((r.begin.day, r.end.day, r.weight, r.n) for r in sequences.union_intervals(df, ["k"], "b", "e", "w", 1).collect())
    assert got == [(1, 12, 5, 3), (14, 15, 3, 2)]


def test_running_score(spark):
    df = spark.createDataFrame([("m", i, s) for i, s in enumerate([-1, -1, 1, 1, 1])] + [("n", 0, -1)], "k string, i long, s long")
    got = {r.k: (r.max_lead, r.max_deficit, r.final) for r in sequences.running_extremes(df, ["k"], ["i"], F.col("s")).collect()}
    assert got == {"m": (1, 2, 1), "n": (0, 1, -1)}


def test_resample(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("a", 10, 99.0), ("a", 5, None), ("b", 3, 7.0)], "k string, t long, v double")
    got = {(r.k, r.point): r.v for r in sequences.resample(df, ["k"], "t", "v", 5).collect()}
    assert [got["a", i] for i in range(5)] == [0.0, 2.5, 5.0, 7.5, 10.0] and [got["b", i] for i in range(5)] == [7.0] * 5


def test_chains(spark):
    rows = [(i, i + 1 if i % 10 != 9 else None) for i in range(57)] + [(100, None)]
    df = spark.createDataFrame([(a, b if b != 57 else None) for a, b in rows], "id long, nxt long")
    got = {r.row: (r.head, r.position) for r in sequences.chain_positions(df, "id", "nxt", keep=checkpoint).collect()}
    assert got == {i: (i // 10 * 10, i % 10) for i in range(57)} | {100: (100, 0)}
    assert sequences.forest_faults(df, "id", "nxt").count() == 0
    bad = df.union(spark.createDataFrame([(200, 5), (201, 999)], "id long, nxt long"))
    assert sorted((r.row, r.n, r.known) for r in sequences.forest_faults(bad, "id", "nxt").collect()) == [(5, 2, True), (999, 1, False)]


@pytest.mark.parametrize("seed", range(8))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(1, 6)), 6
    score = r.integers(0, 9, (n, m)).astype(float)
    chosen = models.best_assignment(score)
    best = max(sum(score[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
    assert len(set(chosen)) == n and sum(score[i, c] for i, c in enumerate(chosen)) == best


def test_assignment_groups(spark):
    rows = [("g", "s1", "a", 10.0), ("g", "s1", "b", 9.0), ("g", "s2", "a", 9.0), ("g", "s2", "b", 1.0), ("h", "s1", "a", 1.0), ("h", "s2", "a", 2.0)]
    df = spark.createDataFrame(rows, "team string, slot string, who string, v double")
    got = sorted(tuple(r) for r in models.assign(df, "team", "slot", "who", "v").collect())
    assert got == [("g", "s1", "b", 9.0), ("g", "s2", "a", 9.0), ("h", "s2", "a", 2.0)]


def test_leaks_at_any_depth(spark):
    nested = spark.createDataFrame([([{"CA": 1}],)], "rows array<struct<CA: int>>")
    tags = spark.createDataFrame([({"ca": 1, "ok": 2},)], "m map<string, int>")
    got = sorted(tuple(r) for r in loads.leaks(spark, {"n": nested, "t": tags, "c": spark.range(1)}, ["ca"]).collect())
    assert got == [("n", "rows.[].CA"), ("t", "m{}.ca")]


def test_slices_replace(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "season long, phase string, v long"
    loads.replace_slices(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], schema), path, ["season", "phase"])
    loads.replace_slices(spark.createDataFrame([(1, "a", 9)], schema), path, ["season", "phase"])
    read = lambda: sorted((r.season, r.phase, r.v) for r in spark.read.schema(schema).parquet(path).collect())
    assert read() == [(1, "a", 9), (1, "b", 2), (2, "a", 3)]
    loads.replace_slices(spark.createDataFrame([(1, "a", 9)], schema), path, ["season", "phase"])
    assert read() == [(1, "a", 9), (1, "b", 2), (2, "a", 3)]


def test_slice_key(spark):
    key = lambda *dates, **how: tuple(loads.slice_key(spark.createDataFrame([(D(x),) for x in dates], "d date"), "d", **how).head())
    assert key("2020-07-31") == (2020, "2020-07-31") and key("2020-08-01", "2019-01-01") == (2021, "2020-08-01")
    assert key("2020-08-01", season=1999, phase="mid") == (1999, "mid") and key(season=2005) == (2005, "2005-07-01")


def test_empty_frames(spark):
    none = spark.createDataFrame([], "k string, d date, f long, b boolean, v double")
    assert sequences.spells(none, ["k"], "d", 1).count() == 0
    assert sequences.longest_run(none, ["k"], ["d"], "b").count() == 0
    assert sequences.densest_window(none, ["k"], "d", 3, 1).count() == 0
    assert scoring.index_within(none, "v", ["k"], "x").count() == 0
    assert relational.min_max_index(none, "k", "v", 1, "i").count() == 0


def _stream(spark, folder, load):
    """One file for each micro-batch, to the end."""
    rows = spark.readStream.schema("day string, x long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    w = stream_slices(rows, f"{folder}/out", ["day"], load).trigger(availableNow=True)
    w.option("checkpointLocation", f"{folder}/{load}").start().awaitTermination()
    return {(r.day, r.x) for r in read_slices(spark, f"{folder}/out", ["day"], "day string, x long").collect()}


def test_stream_slices_keeps_all_batches(spark, tmp_path):
    """A day that arrives in two files loses nothing; a repeated batch changes nothing; a newer load replaces its days only."""
    first, second = [("mon", i) for i in range(5)], [("mon", i) for i in range(5, 8)] + [("tue", 9)]
    for part in (first, second):
        spark.createDataFrame(part, "day string, x long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert _stream(spark, tmp_path, "a") == {*first, *second}
    shutil.rmtree(f"{tmp_path}/a")  # as if the batches were run again
    assert _stream(spark, tmp_path, "a") == {*first, *second}
    newer = tmp_path / "newer"
    spark.createDataFrame([("mon", 100)], "day string, x long").coalesce(1).write.parquet(f"{newer}/in")
    shutil.copytree(f"{tmp_path}/out", f"{newer}/out")
    assert _stream(spark, newer, "b") == {("mon", 100), ("tue", 9)}


def test_stream_spells_drop_late_rows(spark, tmp_path):
    """A spell leaves once the watermark has passed it; a row that comes later than that is left out."""
    ts = lambda x: dt.datetime.fromisoformat(x)
    batches = [[(1, ts("2024-01-01")), (1, ts("2024-01-02")), (2, ts("2024-01-01"))], [(1, ts("2024-02-10"))], [(2, ts("2024-01-02")), (1, ts("2024-04-01"))], [(3, ts("2024-06-01"))]]
    for batch in batches:
        spark.createDataFrame(batch, "k long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in")
        w = stream_spells(rows, ["k"], "ts", 1).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
        w.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    got = {(r.k, str(r.begin), str(r.end), r.n_rows) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "2024-01-01", "2024-01-02", 2), (2, "2024-01-01", "2024-01-01", 1), (1, "2024-02-10", "2024-02-10", 1), (1, "2024-04-01", "2024-04-01", 1)}


def test_keyed_and_commented_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("alpha", "beta"):
        (tmp_path / "t" / f"{name}.csv").write_text("x,y\n1,2\n")
    assert {tuple(r) for r in loads.read_keyed_files(spark, str(tmp_path / "t"), "x int, y int").collect()} == {(1, 2, "alpha"), (1, 2, "beta")}
    (tmp_path / "seed.csv").write_text("id, name\n# note\n\n 1, a \n,\n# 2, b\n3,c\n")
    assert sorted(tuple(r) for r in loads.read_commented(spark, str(tmp_path / "seed.csv"), "id int, name string").collect()) == [(1, "a"), (3, "c")]
    for label in ("x", "y"):
        (tmp_path / "l" / label).mkdir(parents=True)
        (tmp_path / "l" / label / ("summary.json" if label == "x" else "other.json")).write_text("{}")
    assert [r.label for r in loads.labels(spark, str(tmp_path / "l")).collect()] == ["x"]


def test_fold_takes_every_mark(spark):
    assert one(spark, S.fold(F.col("t")), t="Kırklareli ŞİŞLİ ğ Č ő ẞ e\u0301 Ǎ Straße") == "kirklareli sisli g c o ss e a strasse"


def test_reseed_refuses_a_malformed_change(spark):
    old, new, default = (spark.createDataFrame(rows, "method string, k long") for rows in ([("a", 1), ("b", 2)], [("b", 5)], [("b", 9), ("c", 3)]))
    assert sorted(tuple(r) for r in relational.reseed(old, new, default, "method", ["k"]).collect()) == [("a", 1), ("b", 5), ("c", 3)]
    for bad in ([("b", None)], [(None, 1)]):
        with pytest.raises(ValueError):
            relational.reseed(old, spark.createDataFrame([("b", 5), *bad], "method string, k long"), default, "method", ["k"])
