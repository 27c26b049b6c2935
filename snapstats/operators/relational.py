"""Joins, aggregates, top-k and set operators with column names as parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """L3, K2, K3: the first row of each key in a total order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def best_n(df: DataFrame, keys: Sequence[str], quota: Column, order: Sequence, *, most: int | None = None) -> DataFrame:
    """K4: of each key as many rows as the quota allows. With ``most``, which no quota exceeds, each task leaves no more of a key before the shuffle."""
    within = F.col("__nth") <= quota
    within = within if most is None else within & (F.col("__nth") <= most)
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(within).drop("__nth")


def occurrence(keys: Sequence[str], order: Sequence) -> Column:
    """L4: 0 for the first row of a key, 1 for the second, ..."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")


def as_of(requests: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each request the value of the newest fact at or before it; a null value of the newest is passed over.

    Requests and facts become one sorted stream per key and the last known value is carried forward: one
    shuffle on the key, no range join.
    """
    both = facts.select(*keys, at, F.col(value).alias("__v"), F.lit(0).alias("__r")).unionByName(requests.select(*keys, at).distinct().withColumns({"__v": F.lit(None).cast(facts.schema[value].dataType), "__r": F.lit(1)}))
    w = Window.partitionBy(*keys).orderBy(at, "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn(value, F.last("__v", True).over(w)).where("__r = 1").select(*keys, at, value)
    return requests.join(seen, [*keys, at], "left")


def latest(facts: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """The newest value that is not null, without a bound."""
    return facts.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, at).alias(value))


def latest_slice(df: DataFrame, group: Sequence[str], phase: str) -> DataFrame:
    """The rows of each group's newest phase."""
    newest = df.groupBy(*group).agg(F.max(phase).alias(phase))
    return df.join(newest, [*group, phase])


def modal(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Each key's most frequent value, the smaller of equals, if it has ``least`` votes."""
    votes = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"))
    return first_per_key(votes.where(F.col("votes") >= least), [key], [F.desc("votes"), value])


def sides(df: DataFrame, shared: Sequence[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """Each two-sided row once from either side, in one pass; ``home`` and ``away`` give each column its name there."""
    both = F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in side.items()], F.lit(v).alias("venue")) for v, side in (("H", home), ("A", away))])).alias("__s")
    return df.select(*shared, both).select(*shared, "__s.*")


def wdl(keys: Sequence[str], df: DataFrame) -> DataFrame:
    """Played, won, drawn, lost, goals, points and points per game by any key. ``df`` has result, gf, ga, pts."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("played"),
        *[F.count_if(F.col("result") == r).alias(n) for r, n in (("W", "won"), ("D", "drawn"), ("L", "lost"))],
        F.sum("gf").alias("gf"),
        F.sum("ga").alias("ga"),
        F.sum("pts").alias("points"),
        F.round(F.sum("pts") / F.count("*"), 3).alias("ppg"),
    )


def table_order(df: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Places by points, goal difference, goals for, then the member's id."""
    df = df.withColumn("gd", F.col("gf") - F.col("ga"))
    w = Window.partitionBy(*group).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), member)
    return df.withColumn("place", F.row_number().over(w).cast("long"))


def mirror_dedup(df: DataFrame, a: str, b: str, sa: str, sb: str, offset: str, extra: Sequence[str] = (), least: int = 1) -> DataFrame:
    """One row for each unordered pair and oriented score, with its copies; the first orientation by offset is kept."""
    turn = F.col(a) > F.col(b)
    key = [F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi"), F.when(turn, F.col(sb)).otherwise(F.col(sa)).alias("__slo"), F.when(turn, F.col(sa)).otherwise(F.col(sb)).alias("__shi")]
    grouped = df.groupBy(*extra, *key).agg(F.count("*").alias("copies"), F.min_by(F.struct(a, b, sa, sb), offset).alias("__f"), F.min(offset).alias(offset))
    return grouped.where(F.col("copies") >= least).select(*extra, "__f.*", "copies", offset)


def min_max_index(df: DataFrame, key: str, value: str, least: int, out: str, scope: Sequence[str] = ()) -> DataFrame:
    """0 to 100 between the smallest and largest group mean; small groups are dropped, and so is the mean."""
    means = df.groupBy(*scope, key).agg(F.avg(value).alias("__m"), F.count(value).alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(*scope)
    lo, hi = F.min("__m").over(w), F.max("__m").over(w)
    return means.withColumn(out, F.round(100 * (F.col("__m") - lo) / F.nullif(hi - lo, F.lit(0.0)), 1)).drop("__m")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All new rows, and the old ones whose key has none."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def insert_absent(old: DataFrame, defaults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows win; defaults only for keys that are absent."""
    return old.unionByName(defaults.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def reseed(old: DataFrame, new: DataFrame, defaults: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """The named keys are replaced whole, defaults only fill in keys that are absent.

    Nothing is returned to be written if a new row lacks a required value: the whole change is refused.
    """
    lacks = F.lit(False)
    for c in (key, *required):
        lacks = lacks | F.col(c).isNull()
    if bad := new.where(lacks).limit(1).count():
        raise ValueError(f"a new row lacks one of {[key, *required]}: {bad} or more of them")
    return insert_absent(upsert(old, new, [key]), defaults, [key])


def fallback_names(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Fill a missing name from the reference table."""
    return df.join(names.select(key, F.col(name).alias("__n")), key, "left").withColumn(name, F.coalesce(name, "__n")).drop("__n")


def safe_ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """Null on a zero denominator."""
    return F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def argmax(df: DataFrame, keys: Sequence[str], value: str, who: Sequence[str], *, least: bool = False) -> DataFrame:
    """K5: the holder of each key's record; nulls don't count, ties go to the smaller id."""
    order = [F.col(value).asc() if least else F.col(value).desc(), *who]
    return first_per_key(df.where(F.col(value).isNotNull()), keys, order)
