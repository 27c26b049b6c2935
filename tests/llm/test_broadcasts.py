"""What grows with the corpus is not broadcast, however small Spark thinks it is."""

import random

import pytest

from snapstats.llm import components, pipeline, quality, simhash

TEXTS = [" ".join(f"w{random.Random(k // 2).randrange(50)}" for _ in range(60)) + f"\nline {k} of its own words\nand one that all have" for k in range(60)]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are stored and of all rounds of components."""
    seen = []
    for module, name in ((simhash, "stored"), (components, "stored"), (components, "checkpoint"), (quality, "stored")):
        monkeypatch.setattr(module, name, lambda df, real=getattr(module, name): seen.append(plan(df)) or real(df))
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_op1_broadcasts_no_fingerprints(spark, plans):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plans.append(plan(simhash.near_duplicates(docs)))
    plans.append(plan(simhash.links(docs.selectExpr("xxhash64(text) AS fp"))))
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "BroadcastHashJoin" in p]


def test_near_dedup_broadcasts_nothing_that_grows(spark, plans):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plans.append(plan(pipeline.near_dedup(spark, docs, "")))
    joins = [x.split("BroadcastExchange")[1] for p in plans for x in p.split("BroadcastHashJoin")[1:]]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and all("Scan ExistingRDD[part#" in x for x in joins)  # the first number of each partition


def test_quality_rules_broadcast_no_lines(spark, plans):
    docs = spark.createDataFrame([(k, t, "host") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    p = plan(quality.keep_quality(docs))
    for x in p.split("BroadcastExchange")[1:]:
        assert "Generate" not in x.split("HashAggregate")[0]
    assert "SortMergeJoin" in p and "Generate" in p
