"""The plans that the operators are meant to have."""

import os
import re

import pytest

from snapstats.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plan(spark, name):
    df = QUERIES[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_explode_nothing(spark):
    p = plan(spark, "g1_weighted_score")
    assert "Generate" not in p and "Expand" not in p and "Python" not in p
    assert "Generate" in plan(spark, "j4_dense_score") or "Expand" in plan(spark, "j4_dense_score")


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "l23_point_filter")
    assert re.search(r"PartitionFilters: \[.*club.* IN \(3,9\)", p) and re.search(r"PushedFilters: \[.*In\(tid", p)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate" in plan(spark, "g7_league_table") or "o_totalprice" not in plan(spark, "g7_league_table")
    assert "l_tax" not in re.findall(r"ReadSchema: (.*)", plan(spark, "m7_value_hints"))[0]


def test_two_perspectives_read_once(spark):
    assert plan(spark, "u1_two_perspectives").count("FileScan") == 2  # orders and customer, each once


def test_as_of_has_no_range_join(spark):
    p = plan(spark, "j5_as_of")
    assert "NestedLoop" not in p.replace("BroadcastNestedLoopJoin BuildRight, Inner", "") and "Cartesian" not in p


@pytest.mark.parametrize("name", ["w2_effective_table", "g5_match_stats", "t1_flag_spells", "t4_interval_union", "w13_longest_run", "k5_record_holders", "g8_mirror_dedup"])
def test_stays_in_the_jvm(spark, name):
    p = plan(spark, name)
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p and "CartesianProduct" not in p


def test_many_records_one_aggregation(spark):
    assert len(re.findall("Exchange", plan(spark, "r4_records"))) <= 3
