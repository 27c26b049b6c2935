"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from snapstats.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.astype(object).itertuples(index=False, name=None):
        out.append(tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
