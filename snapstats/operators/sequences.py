"""Operators over ordered rows: runs, spells, intervals, chains, resampling."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Column, out: str = "island") -> DataFrame:
    """Number the islands of each key: a row for which ``same`` (over the key's window) does not hold begins one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Each run of rows for which ``flag`` is true: its first and last order value and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.withColumn("__run", breaks).where(F.col(flag))
    return marked.groupBy(*keys, "__run").agg(F.min(order[0]).alias("begin"), F.max(order[0]).alias("end"), F.count("*").alias("length")).drop("__run")


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """The longest run of each key, the earliest of equals (of those that begin on one day the one that ends first); 0 without any."""
    best = runs(df, keys, order, flag).groupBy(*keys).agg(F.max_by(F.struct("length", "begin", "end"), F.struct("length", (-F.unix_date("begin")).alias("b"), (-F.unix_date("end")).alias("e"))).alias("r"))
    every = df.select(*keys).distinct()
    return every.join(best, list(keys), "left").select(*keys, F.coalesce("r.length", F.lit(0)).alias("length"), "r.begin", "r.end")


def spells(df: DataFrame, keys: Sequence[str], date: str, gap: int) -> DataFrame:
    """Merge a key's dates while they are ``gap`` days apart or fewer: first, last, days."""
    w = Window.partitionBy(*keys).orderBy(date)
    near = F.datediff(F.col(date), F.lag(date).over(w)) <= gap
    return islands(df.select(*keys, date).distinct(), keys, [date], near).groupBy(*keys, "island").agg(F.min(date).alias("begin"), F.max(date).alias("end"), F.count("*").alias("n")).drop("island")


def flag_spells(df: DataFrame, keys: Sequence[str], date: str, flag: str, bits: dict[str, int], gap: int) -> DataFrame:
    """T1 for each bit of a flag column: rows of interleaved copies are ORed per date first."""
    merged = or_bits(df, [*keys, date], flag)
    names = F.array(*[F.when(F.col(flag).bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in bits.items()])
    each = merged.select(*keys, date, F.explode(F.array_compact(names)).alias("kind"))
    return spells(each, [*keys, "kind"], date, gap)


def or_bits(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """All bits that any row of the key has."""
    return df.groupBy(*keys).agg(F.bit_or(flag).alias(flag))


def densest_window(df: DataFrame, keys: Sequence[str], date: str, width: int, least: int) -> DataFrame:
    """For each key the window of ``width`` days, begun by a row, with most rows (the earliest of equals); short series are dropped."""
    day = F.unix_date(F.col(date))
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(0, width)
    counted = df.withColumn("__day", day).withColumn("__n", F.count("*").over(w))
    best = counted.groupBy(*keys).agg(F.max_by("__day", F.struct("__n", (-F.col("__day")).alias("d"))).alias("__first"), F.max("__n").alias("n"), F.count("*").alias("n_all"))
    return best.where(F.col("n_all") >= least).select(*keys, F.date_from_unix_date("__first").alias("begin"), "n", "n_all")


def union_intervals(df: DataFrame, keys: Sequence[str], begin: str, end: str, weight: str, gap: int) -> DataFrame:
    """T4: merge intervals that overlap or are ``gap`` days apart or fewer, keeping the largest weight.

    The running maximum of the ends so far, not the last end, decides, so an interval inside another is fine.
    """
    w = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__reach", reach)
    near = F.datediff(F.col(begin), F.col("__reach")) <= gap
    return islands(df, keys, [begin, end], near).groupBy(*keys, "island").agg(F.min(begin).alias("begin"), F.max(end).alias("end"), F.max(weight).alias("weight"), F.count("*").alias("n")).drop("island")


def _sweep(keys: int):
    """Over rows (*keys, begin, end, id, side) in order of keys and begin: the greedy pairs, with what waits as the only state."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lefts, rights = None, deque(), deque()
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, (begin, end, name, side) = row[:keys], row[keys:]
                if key != now:
                    _pair_up(lefts, rights, None, now, found)
                    now, lefts, rights = key, deque(), deque()
                (lefts, rights)[side].append((begin, end, name))
                _pair_up(lefts, rights, begin, now, found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [*batch.schema.types[:keys], *[batch.schema.types[keys + 2]] * 2])], [*batch.schema.names[:keys], "left_id", "right_id"])
        # whoever still waits has met nobody: a pair is made as soon as both are there

    return run


def _pair_up(lefts: deque, rights: deque, begin, key, found: list[tuple]) -> None:
    """Pairs and farewells up to ``begin``, the place that the sweep has reached."""
    while lefts:
        left = lefts[0]
        while rights and rights[0][1] < left[0]:  # ended before this left and so before all that follow
            rights.popleft()
        if rights and rights[0][0] <= left[1]:
            found.append((*key, left[2], rights.popleft()[2]))
            lefts.popleft()
        elif rights or begin is None or begin > left[1]:
            lefts.popleft()  # nothing that comes later begins in time
        else:
            return
    while begin is not None and rights and rights[0][1] < begin:
        rights.popleft()


def overlap_once(left: DataFrame, right: DataFrame, keys: Sequence[str], *, begin: str = "begin", end: str = "end", key: str = "id") -> DataFrame:
    """Each left interval, in order of (begin, id), takes the first right one by (begin, id) that overlaps it and is not taken yet.

    A sweep over both sides in order of their beginnings: a right that ended before the present left serves no later
    one, and if the first that is left begins too late, so do all others. So a left looks at the first waiting
    right only, and no pair is formed but those that match. Spark sorts (and can spill); a task holds what waits, which is as
    many intervals as overlap at one place, however many rows a key has. Null keys match nothing, nor do intervals without both ends.
    """
    side = lambda df, n: df.select(*keys, F.col(begin).alias("begin"), F.col(end).alias("end"), F.col(key).alias("id"), F.lit(n).alias("side")).dropna()
    both = side(left, 0).unionByName(side(right, 1)).repartition(*keys).sortWithinPartitions(*keys, "begin", "id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema)
    of = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(_sweep(len(keys)), f"{kinds}, left_id {of}, right_id {of}")


def running_extremes(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column) -> DataFrame:
    """The running sum of ``step``: its largest lead, its largest deficit, and where it ends."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("__sum", F.sum(step).over(w)).groupBy(*keys)
    zero = F.lit(0).cast("long")
    return run.agg(F.greatest(zero, F.max("__sum")).alias("max_lead"), F.greatest(zero, -F.min("__sum")).alias("max_deficit"), F.sum(step).alias("final"))


def resample(df: DataFrame, keys: Sequence[str], at: str, value: str, n: int) -> DataFrame:
    """``n`` even points between a key's first and last (whole-number) time, with linear interpolation.

    The points and the rows are one sorted stream; each point takes the last known row before and the first
    after by window, so nothing is joined by range. Null values and all but the least value of equal times are left out.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.min(value).alias(value))
    span = known.groupBy(*keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    grid = span.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    grid = grid.select(*keys, "point", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("point") / F.lit(float(max(1, n - 1)))).alias("__t"))
    both = known.select(*keys, F.lit(None).cast("int").alias("point"), F.col(at).cast("double").alias("__t"), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__s"))
    both = both.unionByName(grid.withColumn("__s", F.lit(None).cast("struct<t:double,v:double>")))
    w = Window.partitionBy(*keys).orderBy("__t", F.col("point").asc_nulls_first())
    back = F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("__s", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.select(*keys, "point", "__t", back.alias("p"), ahead.alias("q")).where(F.col("point").isNotNull())
    flat = F.col("q").isNull() | (F.col("q.t") == F.col("p.t")) | (F.col("p.t") == F.col("__t"))
    mid = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("__t") - F.col("p.t")) / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0.0))
    return both.select(*keys, F.col("point").cast("long").alias("point"), F.round(F.when(flat, F.col("p.v")).otherwise(mid), 6).alias(value))


def chain_positions(df: DataFrame, row: str, nxt: str, *, rounds: int = 64, keep=None) -> DataFrame:
    """(row, head, position, cycle): for rows that point to the next of their chain its head and the row's position; a row each.

    Pointers double: after k rounds each row knows the row 2^k before it and the least of those between, so a chain
    of n rows takes log2(n) joins. Rows that have found no head when a round brings nobody to one are on cycles
    (of an open chain the row behind the last that was brought would have been); once such a round lowers no row's least either, each has
    that of its cycle, which counts as its head: so cycles take log2 of the longest one, too, however many rows are on them. Of several rows that point to one the least
    goes before it; the chains of the others end with them, so a fork multiplies no row. Pointers to rows that do not exist
    are ends. ``keep`` cuts the lineage of a round (a checkpoint into shared storage).
    """
    before = df.where(F.col(nxt).isNotNull()).groupBy(F.col(nxt).alias("row")).agg(F.min(row).alias("back"))
    state = df.select(F.col(row).alias("row")).join(before, "row", "left")
    # ``far`` rows back stands ``head``; the least row from this one to there, without it, stands ``least_at`` back
    state = state.select("row", F.coalesce("back", "row").alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("back").isNull().alias("done"), F.col("row").alias("least"), F.lit(0).cast("long").alias("least_at"))
    state = keep(state) if keep else state
    open_rows = state.where("not done").count()
    for _ in range(rounds):
        if not open_rows:
            break
        a, b = state.alias("a"), state.alias("b")
        lower = F.col("b.least") < F.col("a.least")
        state = a.join(b, F.col("a.head") == F.col("b.row")).select(
            "a.row",
            F.col("b.head").alias("head"),
            (F.col("a.far") + F.col("b.far")).alias("far"),
            (F.col("a.done") | F.col("b.done")).alias("done"),
            F.when(lower, F.col("b.least")).otherwise(F.col("a.least")).alias("least"),
            F.when(lower, F.col("a.far") + F.col("b.least_at")).otherwise(F.col("a.least_at")).alias("least_at"),
            lower.alias("lowered"),
        )
        state = keep(state) if keep else state
        left, lowered = state.where("not done").agg(F.count("*"), F.count_if("lowered")).head()
        state = state.drop("lowered")
        if left == open_rows and not lowered:
            break  # cycles only, each of them covered
        open_rows = left
    else:
        raise RuntimeError(f"rows still move after {rounds} rounds")
    cycle = ~F.col("done")
    return state.select("row", F.when(cycle, F.col("least")).otherwise(F.col("head")).alias("head"), F.when(cycle, F.col("least_at")).otherwise(F.col("far")).alias("position"), cycle.alias("cycle"))


def forest_faults(df: DataFrame, row: str, nxt: str) -> DataFrame:
    """T13's check: rows that two or more point to, and pointers to rows that do not exist."""
    to = df.where(F.col(nxt).isNotNull()).groupBy(F.col(nxt).alias("row")).agg(F.count("*").alias("n"))
    known = df.select(F.col(row).alias("row"), F.lit(True).alias("known"))
    return to.join(known, "row", "left").where((F.col("n") > 1) | F.col("known").isNull()).select("row", "n", F.coalesce("known", F.lit(False)).alias("known"))
