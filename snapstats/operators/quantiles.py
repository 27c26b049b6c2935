"""Exact quantiles of large groups: a sketch says where they are, counts say which values they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, scope: Sequence[str], value: str, probs: dict[str, float], *, accuracy: int = 10_000, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(*scope, *probs): for each scope the quantiles of its known values, interpolated between the two nearest ranks.

    No task holds a scope's rows. A first aggregation takes a sketch of bounded size, merged from task to task, whose ranks are
    off by one in ``accuracy`` at most; it brackets each quantile by two values four times as far from it in rank as that.
    A second one counts: rows between the brackets by gap, rows within one by their value. What is sorted, by a window that adds
    up these counts, is the distinct values within the brackets: about 8 of ``accuracy`` rows, and all those of a scope
    that has fewer than ``accuracy``. The counts are exact, so is the result; a rank that fell outside its bracket
    would be an error, not another value.

    Null values count for nothing, a scope without others has null quantiles; NaN is the largest value; nulls in the
    scope are a scope. ``keep`` stores the input, which is read twice.
    """
    df = df.select(*scope, F.col(value).alias("__v"))
    df = keep(df) if keep else df
    names, slack = [f"__k{i}" for i in range(len(scope))], 4.0 / accuracy
    near = [p for q in probs.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    d = F.col("__v").cast("double")
    sketch = df.groupBy(*[F.col(c).alias(k) for c, k in zip(scope, names)]).agg(
        F.count("__v").alias("__n"), F.min(d).alias("__min"), F.max(d).alias("__max"), F.percentile_approx(d, near, accuracy).alias("__near")
    )
    few = F.col("__n") < accuracy  # there a step of one rank is more than the slack: all values are within
    edges = [F.when(few, F.col("__max" if i % 2 else "__min")).when(F.lit(p) <= 0, F.col("__min")).when(F.lit(p) >= 1, F.col("__max")).otherwise(F.col("__near")[i]) for i, p in enumerate(near)]
    sketch = sketch.select(*names, "__n", *[e.alias(f"__e{i}") for i, e in enumerate(edges)])
    on = F.lit(True)
    for c, k in zip(scope, names):
        on = on & F.col(c).eqNullSafe(F.col(k))
    pairs = [(F.col(f"__e{2 * i}"), F.col(f"__e{2 * i + 1}")) for i in range(len(probs))]
    within = F.lit(False)
    for lo, hi in pairs:
        within = within | ((d >= lo) & (d <= hi))
    # a row in no bracket stands directly behind the last bracket below it
    behind = F.array_max(F.array(*[F.when(hi < d, hi) for _, hi in pairs]))
    within, known = F.coalesce(within, F.lit(False)), F.col("__v").isNotNull()
    placed = df.join(sketch, on).select(
        *names, "__n", F.when(within, F.col("__v")).alias("__v"), F.when(within, d).otherwise(behind).alias("__at"), (~within).alias("__out"), known.alias("__known")
    )
    counts = placed.groupBy(*names, "__n", "__at", "__out", "__v").agg(F.count_if("__known").alias("__c"))
    order = Window.partitionBy(*names).orderBy(F.asc_nulls_first("__at"), "__out", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("__upto", F.sum("__c").over(order)).withColumn("__from", F.col("__upto") - F.col("__c"))
    parts, out = [], []
    for i, (name, q) in enumerate(probs.items()):
        at = F.lit(float(q)) * (F.col("__n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("__from") <= rank) & (rank < F.col("__upto")) & ~F.col("__out")
            parts.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
        lo, hi, pos = F.col(f"__lo{i}").cast("double"), F.col(f"__hi{i}").cast("double"), F.lit(float(q)) * (F.col("__n") - 1)
        missed = (F.col("__n") > 0) & (lo.isNull() | hi.isNull())
        mixed = F.when(F.floor(pos) == F.ceil(pos), lo).when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)
        out.append(F.when(missed, F.raise_error(F.lit(f"{name}: rank outside its bracket")).cast("double")).otherwise(mixed).alias(name))
    found = upto.groupBy(*names, "__n").agg(*parts)
    return found.select(*[F.col(k).alias(c) for c, k in zip(scope, names)], *out)
