"""Connected components of a graph too large for one machine: alternating large-star and small-star rounds.

A round replaces edges by edges to smaller neighbours and keeps the components; after O(log^2 n) rounds
each node is linked to the smallest of its component and to nothing else. A hub's edges stay rows (no list
of neighbours is built) and its minimum is a partial aggregate. The minima are written before they are
joined: only a join whose two sides are both plain exchanges can be split by adaptive execution where a hub
fills a partition. Each round is checkpointed, so the plan does not grow and a lost executor costs one
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import checkpoint, scratch, sorted_join, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(sorted_join(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(sorted_join(least), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has an edge; the root is the smallest node of its component. Null ends are ignored."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = checkpoint(edges), None
    while (state := _state(edges)) != before:
        with scratch(edges.sparkSession):
            edges, before = checkpoint(_small_star(_large_star(edges))), state
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
