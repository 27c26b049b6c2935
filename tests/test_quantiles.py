"""Quantiles by sketch and counts are those of the aggregates that hold a group."""

import math

import pytest
from pyspark.sql import functions as F

from snapstats.operators.quantiles import quantiles
from snapstats.session import checkpoint

PROBS = {"least": 0.0, "q1": 0.25, "med": 0.5, "p99": 0.99, "most": 1.0}


def same(a, b):
    return (a is None and b is None) or a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def compare(df, accuracy):
    got = {tuple(r[:1]): r for r in quantiles(df, ["g"], "v", PROBS, accuracy=accuracy, keep=checkpoint).collect()}
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in PROBS.items()]).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[(w.g,)]
        assert all(same(g[n], w[n]) for n in PROBS), (w, g)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equal_to_percentile(spark, accuracy):
    """Ties, two-valued and heavy-tailed pools, a hot group, nulls, NaN and infinities, a null group, one row."""
    i = F.col("id")
    v = (
        F.when(i % 3 == 0, (i * 7919 % 2).cast("double"))  # two values
        .when(i % 3 == 1, F.pow(F.lit(10.0), (i * 31 % 600) - 300))  # tails
        .otherwise((F.xxhash64("id") % 1000003).cast("double"))
    )
    g = F.when(i % 3 == 2, F.when(i % 60 == 2, F.lit(None)).otherwise(F.lit("hot"))).otherwise(F.concat(F.lit("g"), i % 3))
    df = spark.range(0, 60_000, 1, 7).select(g.alias("g"), F.when(i % 11 != 0, v).alias("v"), i.alias("__n"))
    nan, inf = float("nan"), float("inf")
    edge = [("odd", x) for x in (nan, inf, -inf, 0.0, 1.5, nan, -inf)] + [("one", 3.0), ("none", None), ("none", None), ("low", -inf), ("low", 2.0)]
    compare(df.select("g", "v").union(spark.createDataFrame(edge, "g string, v double")), accuracy)


def test_long_values_and_empty(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 48271) % 2147483647).alias("v"))
    compare(df, 100)
    assert quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).collect() == []
    whole = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [df.agg(F.median("v")).first()[0]]


def test_few_rows_are_sorted(spark):
    """The window's input is what lies within the brackets."""
    df = checkpoint(spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 48271 % 2147483647).alias("v")))
    plan = quantiles(df, ["g"], "v", {"m": 0.5}, accuracy=1000)
    assert plan.collect()[0].m == df.agg(F.median("v")).first()[0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ObjectHashAggregate") >= 2 and "percentile_approx" in text and "partial_count_if" in text.replace("partial_count(if", "partial_count_if")
