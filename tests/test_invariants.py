"""What must hold whatever the data are: orders, totals, round trips, and fits against a solver."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstats.operators import models as M
from snapstats.plans.registry import QUERIES
from snapstats.sources import adapters as A

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_league_tables_are_in_order_and_whole(spark):
    rows = QUERIES["g7_league_table"](spark, FOLDER).collect()
    n = A.fixtures(spark, FOLDER).count()
    assert sum(r.played for r in rows) == 2 * n and sum(r.gf for r in rows) == sum(r.ga for r in rows)
    for season, of in itertools.groupby(sorted(rows, key=lambda r: (r.season, r.place)), key=lambda r: r.season):
        of = list(of)
        assert [r.place for r in of] == list(range(1, len(of) + 1)), season
        order = [(-r.points, -r.gd, -r.gf, r.us) for r in of]
        assert order == sorted(order) and all(r.points == 3 * r.won + r.drawn and r.won + r.drawn + r.lost == r.played for r in of)


def test_coverage_accounts_for_everything(spark):
    e = A.table(spark, FOLDER, "events").select("user_id", "event_id", F.col("event_type").alias("kind"))
    rows = {r.kind: r for r in M.coverage(e, "user_id", "event_id", "kind").collect()}
    reach = e.groupBy("user_id").agg((F.max("event_id") - F.min("event_id")).alias("d")).agg(F.sum("d"), F.count("*")).head()
    assert (rows[None].covered, rows[None].open) == tuple(reach) and rows[None].n == e.count()
    assert all(rows[None][c] == sum(r[c] or 0 for k, r in rows.items() if k) for c in ("n", "covered", "open"))
    top = M.largest_spans(e, "user_id", "event_id", "kind").collect()
    assert len(top) == 20 and [r.span for r in top] == sorted((r.span for r in top), reverse=True) and top[0].span == rows[None].largest


def test_fits_are_those_of_a_solver(spark):
    f = A.features(spark, FOLDER)
    rows, xs = f.collect(), ["x1", "x2", "x3", "x4"]
    fits = M.exact_hits(f, M.subset_fits(f, "target", xs, "y", 3), "target", xs, "y").collect()
    assert {len(r.slopes) for r in fits} == {1, 2, 3}
    for r in fits:
        own = [x for x in rows if x.target == r.target]
        a = np.array([[1.0, *(x[c] for c in r.features.split("+"))] for x in own])
        beta, *_ = np.linalg.lstsq(a, np.array([x.y for x in own], float), rcond=None)
        assert np.allclose(beta, [r.constant, *r.slopes], atol=1e-6)
        off = np.abs(np.round(a @ np.array([r.constant, *r.slopes])) - [x.y for x in own])
        assert (r.n, r.exact, r.within_1) == (len(own), int((off == 0).sum()), int((off <= 1).sum()))


def test_units_add_up(spark):
    """The best of a side are those of its units; nobody is counted twice."""
    rows = QUERIES["r10_team_strength"](spark, FOLDER).collect()
    team = {(r.phase, r.club): r.n for r in rows if r.unit == "team"}
    for key, n in team.items():
        assert n == sum(r.n for r in rows if (r.phase, r.club) == key and r.unit != "team") <= 11


def test_reads_cover_every_role(spark):
    review, summary = (QUERIES[n](spark, FOLDER).collect() for n in ("r14_position_review", "r14_role_summary"))
    assert sum(r.owned for r in summary) == len(review)
    assert all(r.read.startswith("keep") for r in review if r.home == r.role and r.depth <= r.slots + 1)
    assert all(r.firsts > 0 for r in review if r.read == "loan")
