"""What the third round's findings showed: each of these failed before."""

from __future__ import annotations

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from snapstats import session
from snapstats.functions import scalars as S
from snapstats.operators import models, scoring, sequences
from snapstats.plans import q_awards, q_reports
from snapstats.plans.registry import QUERIES
from snapstats.sources import adapters as A


def test_an_amount_that_equals_a_code_is_an_amount(spark, tmp_path):
    spark.createDataFrame([(65534,), (65531,), (65535,), (9,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.fee for r in QUERIES["p14_fee_and_season"](spark, str(tmp_path)).collect()}
    assert got == {65534: "65534", 65531: "loan", 65535: "stay", 9: "9"}
    assert spark.range(1).select(S.fee(F.lit(65534)).alias("f")).head().f == "loan"


def test_strengths_round_as_the_sql_does(spark):
    """Four players' tenths make fortieths, whose third decimal may be a five."""
    rows = [("p", int(s), f"u{1}", t, 100.0 + (s if t == 1 else 0) / 10, 50.0) for s in range(0, 2000, 1) for t in range(1, 5)]
    squad = spark.createDataFrame(rows, "phase string, club long, unit string, tid long, pos_index double, pctile double")
    got = {r.club: r.strength for r in q_reports.team_strength(squad).where("unit = 'u1'").collect()}
    want = dict(duckdb.sql("SELECT s, round(CAST(4000 + s AS DOUBLE) / 40, 2) FROM range(2000) t(s)").fetchall())
    assert got == want


def test_of_runs_that_begin_on_one_day_the_earlier_is_the_longest(spark):
    days = [(1, "a", 1), (1, "b", 1), (1, "c", 0), (1, "d", 1), (2, "a", 1), (2, "b", 0)]
    for turned in (days, days[::-1]):  # a run of two on day 1, then one from day 1 to day 2
        df = spark.createDataFrame([(7, dt.date(2024, 1, d), n, bool(f)) for d, n, f in turned], "tid long, date date, n string, f boolean").repartition(3)
        best = sequences.longest_run(df, ["tid"], ["date", "n"], "f").head()
        assert (best.length, best.begin, best.end) == (2, dt.date(2024, 1, 1), dt.date(2024, 1, 1))
        best = q_awards._longest_runs(df, ["tid"], ["date", "n"], "f").head()
        assert (best.length, best.b, best.e) == (2, "2024-01-01", "2024-01-01")


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k3_best_role", "r18_recruitment", "t9_trajectory", "w5_strictly_below", "w2_effective_table_by_counts", "w3_position_index", "w1_percentile_and_rank", "r9_squad_frame", "r11_unit_comparison", "k11_slot_in"])
def test_scores_are_not_joined_with_positions_by_a_shuffle(spark, name):
    p = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p and (name == "t9_trajectory" or "SortMergeJoin" not in p)


def test_places_in_several_scopes_from_one_count(spark):
    rows = [(k, k % 2, k % 6, None if k % 11 == 0 else float(k * 7 % 9), None if k % 5 == 0 else k % 4) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, g long, h long, v double, l long")
    scopes = {"a": ["g"], "b": ["g", "h"]}
    a, b = (sorted(map(tuple, f.select("k", *[f"{c}_{n}" for n in scopes for c in ("pctile", "level", "rank", "n")]).collect())) for f in (scoring.standing(df, scopes, "v", "l"), scoring.standing_by_counts(df, scopes, "v", "l", keep=session.stored)))
    assert a == b


@pytest.mark.parametrize("rows, hint", [(0, ""), (200, "shuffle_hash"), (2000, "broadcast")])
def test_a_lookup_is_joined_as_its_size_asks_for(spark, monkeypatch, rows, hint):
    monkeypatch.setattr(scoring, "BROADCAST", rows if hint == "broadcast" else 0)
    monkeypatch.setattr(scoring, "HASHED", rows)
    found = scoring.looked_up(spark.range(500), session.stored)
    assert (hint in found._jdf.queryExecution().logical().toString().lower()) if hint else "hint" not in found._jdf.queryExecution().logical().toString().lower()


def test_rounds_follow_the_longest_cycle_not_the_rows_on_cycles(spark):
    rows = [(c * 10 + i, c * 10 + (i + 1) % 5) for c in range(400) for i in range(5)]
    kept = []
    got = sequences.chain_positions(spark.createDataFrame(rows, "r long, n long"), "r", "n", keep=lambda f: kept.append(1) or session.checkpoint(f))
    assert {(x.row, x.head, x.position, x.cycle) for x in got.collect()} == {(c * 10 + i, c * 10, i, True) for c in range(400) for i in range(5)}
    assert len(kept) <= 6  # 12 where reach had to pass 2,000 rows


def test_a_task_has_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    assert session.spread(spark.range(6000), "id").rdd.getNumPartitions() == 12
    assert session.spread(spark.range(600), "id").rdd.getNumPartitions() == 4


def test_faults_are_pairs_above_their_prices(spark):
    pairs = spark.createDataFrame([("t", "a", 1, 5.0), ("t", "a", 1, 5.0), ("t", "b", 2, 1.0), ("u", "a", 3, 2.0)], "g string, s string, c long, v double")
    chosen = spark.createDataFrame([("t", "a", 1, 5.0, 3.0, 0.0), ("t", "b", 2, 1.0, 1.0, 0.0), ("u", "a", 3, 2.0, 2.0, 0.0)], "g string, s string, c long, value double, slot_price double, candidate_price double")
    faults = models.assignment_faults(pairs, chosen, "g", "s", "c", "v")
    assert {(x.g, x.slots, x.twice, x.above) for x in faults.collect()} == {("t", 2, 0, 1), ("u", 1, 0, 0)}
    assert faults._jdf.queryExecution().optimizedPlan().toString().count("max(") == 0


@pytest.mark.parametrize("name", ["k3_best_role", "t9_trajectory", "r18_recruitment"])
def test_rating_is_compiled(spark, name):
    """A lambda over an array is interpreted, and so is a method of more than 8,000 bytes: each entity's ratings took four to six times as long."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan is compiled as it runs
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution()
        above = plan.executedPlan().toString().split("Join")[0]
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "lambda" not in above
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_the_best_fit_is_of_a_role_with_weights(spark):
    fit = "struct<position string, role string, familiarity long>"
    rows = [(1, 2, None, ("P1", "r1", 20), ("P0", "r1", 20)), (2, 2, 3, ("P1", "r9", 20), ("P2", "r1", 1)), (3, 2, 3, ("P1", "r9", 20), ("P2", "r9", 1)), (4, None, None, ("P1", "r1", 20), ("P2", "r1", 1))]
    wide = spark.createDataFrame(rows, f"id long, a long, b long, x {fit}, y {fit}")
    weights = spark.createDataFrame([("m", "r1", "a", 5), ("m", "r1", "b", None)], "method string, role string, attribute string, weight long")
    best = scoring.rated_fits(wide, weights, ["a", "b"], ["x", "y"]).withColumn("best", scoring.best_fit(["x", "y"]))
    assert {(r.id, r.method, r.best.position, -r.best.e) for r in best.collect()} == {(1, "m", "P0", 10.0), (2, "m", "P2", 13 * 0.525)}
    known = scoring.rated_fits(wide, weights, ["a", "b"], ["x", "y"], only=lambda f: f["familiarity"] > 1)
    assert {(r.id, r.x.eff, r.y.eff) for r in known.collect()} == {(1, 10.0, 10.0)}


@pytest.mark.parametrize("name", ["w5_strictly_below", "w2_effective_table_by_counts", "w3_position_index", "j10_targets_by_league", "r16_role_benchmarks", "r9_squad_frame", "w1_percentile_and_rank", "k4_best_n_per_unit"])
def test_rows_are_rated_and_placed_once_a_season(spark, name):
    """What takes time is made before a row is given to each phase of its season; it was made anew for each of them."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode(phases")
    assert below and not re.search("Aggregate|Window|round", above)


def test_a_row_of_a_season_is_one_in_each_of_its_phases(spark):
    every = A.entities(spark, FOLDER)
    again = A.in_phases(spark, FOLDER, A.season_entities(spark, FOLDER))
    assert again.columns == every.columns and every.exceptAll(again).isEmpty() and again.exceptAll(every).isEmpty()


def test_quarters_become_text_after_they_are_told_apart(spark):
    plan = A.slices(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan.split("Aggregate", 1)[1].split("\n", 1)[1]
