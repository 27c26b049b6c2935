"""Commands with arguments, and what they are planned as."""

import os

import pytest

from snapstats.plans import q_commands as K
from snapstats.plans.catalog import QUERIES
from snapstats.sources import adapters as A

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")


def test_arguments(spark):
    e = A.entities(spark, D)
    who = e.first().tid
    assert K.command(spark, D, "progression", who).count() == e.where(e.tid == who).count()
    f = A.fixtures(spark, D)
    one = f.where("comp is not null").first()
    every = f.where((f.season == one.season) & (f.phase == one.phase))
    assert K.command(spark, D, "matches", one.season, one.phase).count() == every.count()
    assert K.command(spark, D, "matches", one.season, one.phase, one.comp).count() == every.where(every.comp == one.comp).count()
    assert K.command(spark, D, "matches", one.season, "' OR 1 = 1 --").count() == 0
    top = K.command(spark, D, "top_scorers", one.season, order="goals desc, tid", limit=5).collect()
    assert len(top) == 5 and [(-x.goals, x.tid) for x in top] == sorted((-x.goals, x.tid) for x in top)
    assert K.command(spark, D, "progression", None).count() == 0
    assert {r.command for r in K.listing(spark).collect()} == set(K.COMMANDS)


def test_wrong_calls(spark):
    with pytest.raises(ValueError, match="no such command"):
        K.command(spark, D, "drop")
    with pytest.raises(ValueError, match="takes 1 arguments"):
        K.command(spark, D, "progression", 1, 2)


def test_arguments_from_a_table_are_equi_joins(spark):
    for name in [n for n in QUERIES if n.startswith("r25_") and n not in ("r25_labels", "r25_sql_views")]:
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        loops = [x for x in plan.splitlines() if "NestedLoopJoin" in x and "c_custkey" not in x]  # the frame of entities takes its number of slots that way
        assert "CartesianProduct" not in plan and not loops, name


def test_a_literal_is_a_filter(spark):
    K.commands(spark, D)
    one = spark.sql("SELECT * FROM matches(1996L, '1996-01-01')")._jdf.queryExecution().executedPlan().toString()
    assert one.count("FileScan") == 2 and "= 1996)" in one, "the branch for a competition is not planned"
    top = spark.sql("SELECT * FROM top_scorers(1996L)")._jdf.queryExecution().executedPlan().toString()
    assert top.count("= 1996)") >= 2, "below both sums"
