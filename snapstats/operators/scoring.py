"""Weighted scores, their adjustment by familiarity, and where an entity stands among others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapstats.functions.scalars import familiarity_multiplier


def _weight_rows(weights: DataFrame, combo: Sequence[str], attributes: Sequence[str], attribute: str, weight: str) -> DataFrame:
    """A row for each combination with ``__w``, a struct of the weight of each attribute; what is absent is 1. No key is searched for when a row is rated."""
    one = [F.sum(F.when(F.col(attribute) == a, F.coalesce(F.col(weight), F.lit(1)))).alias(f"__w{i}") for i, a in enumerate(attributes)]
    each = F.struct(*[F.coalesce(f"__w{i}", F.lit(1)).alias(a) for i, a in enumerate(attributes)])
    return weights.groupBy(*combo).agg(*one).select(*combo, each.alias("__w"))


def _values(wide: DataFrame, attributes: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows that have any value, with columns in which a null value counts as 0: told once for a row, not once for each combination."""
    own = {f"__v{i}": F.coalesce(F.col(a), F.lit(0)) for i, a in enumerate(attributes)}
    return wide.where(_known(attributes)).withColumns(own), list(own)


def _total(weights: Column, attributes: Sequence[str], values: Sequence[str]) -> Column:
    return sum((F.col(v) * weights[a] for a, v in zip(attributes[1:], values[1:])), F.col(values[0]) * weights[attributes[0]]).cast("long")


def _known(attributes: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(a) for a in attributes]).isNotNull()


def weighted_scores(wide: DataFrame, weights: DataFrame, attributes: Sequence[str], *, combo: Sequence[str] = ("method", "role"), attribute: str = "attribute", weight: str = "weight", out: str = "rating", on: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """G1: for each row and combination, the sum of value times weight; a weight that is absent is 1, a null value is left out.

    The wide rows are never exploded by attribute: the weights become one row per combination, and the sum
    is one expression over the row. The weight table is configuration (combinations, not data), so it is
    broadcast. Rows without any value give no score. Columns of a combination that the rows have themselves are named by
    ``on``: a row then has the combinations that agree with it. ``keep`` leaves the attributes.
    """
    rows, (some, values) = F.broadcast(_weight_rows(weights, combo, attributes, attribute, weight)), _values(wide, attributes)
    both = some.join(rows, list(on)) if on else some.crossJoin(rows)
    return both.withColumn(out, _total(F.col("__w"), attributes, values)).drop("__w", *values, *([] if keep else attributes))


def rated_fits(wide: DataFrame, weights: DataFrame, attributes: Sequence[str], fits: Sequence[str], *, only=None, by: str = "method", role: str = "role", attribute: str = "attribute", weight: str = "weight") -> DataFrame:
    """A row for each row of ``wide`` and method, whose structs ``fits`` of (position, role, familiarity) become (eff, position, role, familiarity).

    What is chosen among an entity's own positions is chosen within its row, without a shuffle, and by plain expressions, which are
    compiled; a lambda over an array is interpreted. A role without weights and a fit that ``only`` does not take have no eff; a row without any drops out.
    """
    maps = _weight_rows(weights, [by, role], attributes, attribute, weight).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(role, "__w"))).alias("__w"))
    some, values = _values(wide, attributes)
    both, own = some.crossJoin(F.broadcast(maps)), {f: f"__w_{f}" for f in fits}
    weighed = lambda f: F.col("__w")[F.col(f)[role]] if only is None else F.when(only(F.col(f)), F.col("__w")[F.col(f)[role]])
    # told by the weights, not by eff: a filter is moved below what it is made of, which would be rated twice
    both = both.withColumns({w: weighed(f) for f, w in own.items()}).where(F.coalesce(*own.values()).isNotNull())
    eff = lambda f: _total(F.col(own[f]), attributes, values) * familiarity_multiplier(F.col(f)["familiarity"])
    rated = {f: F.struct(eff(f).alias("eff"), *[F.col(f)[c].alias(c) for c in ("position", role, "familiarity")]) for f in fits}
    return both.withColumns(rated).drop("__w", *own.values(), *values, *attributes)


def best_fit(fits: Sequence[str]) -> Column:
    """K3: of a row's ``fits`` that of the largest eff, the smaller position of equals; its eff is negative here."""
    best = [F.when(F.col(f)["eff"].isNotNull(), F.struct((-F.col(f)["eff"]).alias("e"), F.col(f)["position"].alias("position"), F.col(f)["role"].alias("role"))) for f in fits]
    return F.least(*best) if len(best) > 1 else best[0]


def weighted_scores_exploded(wide: DataFrame, weights: DataFrame, attributes: Sequence[str], keys: Sequence[str], *, combo: Sequence[str] = ("method", "role"), attribute: str = "attribute", weight: str = "weight", out: str = "rating") -> DataFrame:
    """The same by unpivot, all combinations and a left join; for weights that are data themselves, so nothing is told to be broadcast."""
    long = wide.unpivot(list(keys), list(attributes), attribute, "__value").where(F.col("__value").isNotNull())
    every = long.crossJoin(weights.select(*combo).distinct())
    joined = every.join(weights, [*combo, attribute], "left")
    return joined.groupBy(*keys, *combo).agg(F.sum(F.col("__value") * F.coalesce(weight, F.lit(1))).cast("long").alias(out))


def effective_score(rating: str, familiarity: str, curve: str = "linear_floor", floor: float = 0.5) -> Column:
    """A score times the familiarity multiplier."""
    return F.col(rating) * familiarity_multiplier(F.col(familiarity), curve, floor)


def effective(scores: DataFrame, fits: DataFrame, on: Sequence[str], *, curve: str = "linear_floor", floor: float = 0.5) -> DataFrame:
    """A score in each position an entity can take, times the familiarity multiplier; for positions that are a table of their own."""
    return scores.join(fits, list(on)).withColumn("eff", effective_score("rating", "familiarity", curve, floor))


#: Rows of a stored table of places up to which it is broadcast, and rows for each partition up to which a task may hash its part.
BROADCAST, HASHED = 300_000, 200_000


def looked_up(table: DataFrame, keep=None) -> DataFrame:
    """A table of what is known of each value or scope, to be joined to all rows: stored once by ``keep``, it is broadcast if it has few rows,
    hashed where a task's part is small, and otherwise left to a join that sorts and can spill."""
    if keep is None:
        return table
    table = keep(table)
    rows, parts = table.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.broadcast(table) if rows <= BROADCAST else table.hint("shuffle_hash") if rows <= HASHED * parts else table


def percent_rank(value: str, scope: Sequence[str], out: str, digits: int = 1):
    """100 * percent_rank within the scope, nulls last."""
    w = Window.partitionBy(*scope).orderBy(F.col(value).asc_nulls_last())
    return F.round(100 * F.percent_rank().over(w), digits).alias(out)


def rank_desc(value: str, scope: Sequence[str], out: str):
    return F.rank().over(Window.partitionBy(*scope).orderBy(F.col(value).desc_nulls_last())).cast("long").alias(out)


def rank_from_below(value: str, scope: Sequence[str], out: str):
    """``rank_desc`` over the order of ``percent_rank``, so both share one sort: the known rows of the scope less those up to this value."""
    pool = Window.partitionBy(*scope)
    upto = F.count("*").over(pool.orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    known = F.count(value).over(pool)
    return F.when(F.col(value).isNull(), known + 1).otherwise(known - upto + 1).alias(out)


def standing(df: DataFrame, scopes: dict[str, Sequence[str]], fit: str, level: str) -> DataFrame:
    """For each named scope the percentile by fit and by level, the rank by fit and the pool size; the level itself is dropped.

    A scope takes one shuffle and two sorts: whatever is told by fit comes from the same one. Windows spill,
    and pools are many; for few and very large ones there is ``standing_by_counts``.
    """
    columns = []
    for name, scope in scopes.items():
        columns += [
            percent_rank(fit, scope, f"pctile_{name}"),
            rank_from_below(fit, scope, f"rank_{name}"),
            percent_rank(level, scope, f"level_{name}"),
            F.count("*").over(Window.partitionBy(*scope)).alias(f"n_{name}"),
        ]
    return df.select("*", *columns).drop(level)


def histogram_places(df: DataFrame, scope: Sequence[str], value: str) -> DataFrame:
    """(*scope, __v, __below, __same, __n, __nulls) for each distinct value of a scope: rows below it, rows equal to it, all rows, and those that are null.

    Nulls come last, so all known values are below them. A task counts its own rows first; what is sorted is
    the distinct values of a scope, not its rows.
    """
    counts = df.groupBy(*scope, F.col(value).alias("__v")).agg(F.count("*").alias("__same"))
    w = Window.partitionBy(*scope)
    below = F.coalesce(F.sum("__same").over(w.orderBy(F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__same"))).over(w), F.lit(0))
    return counts.select(*scope, "__v", "__same", below.alias("__below"), F.sum("__same").over(w).alias("__n"), nulls.alias("__nulls"))


def with_places(df: DataFrame, scope: Sequence[str], value: str, columns: dict, *, of: DataFrame | None = None, keep=None) -> DataFrame:
    """``df`` with columns made of ``__below``, ``__same``, ``__n`` and ``__nulls`` of its value in its scope; the scope's rows are those of ``of``, if it is given.

    With ``keep`` the histogram is stored first and joined as its size asks for (``looked_up``). Otherwise it is joined
    without a hint: adaptive execution broadcasts it once its size is known to be small, and shuffles otherwise.
    """
    return _join_places(df, histogram_places(df if of is None else of, scope, value), scope, value, columns, keep)


def _join_places(df: DataFrame, places: DataFrame, scope: Sequence[str], value: str, columns: dict, keep=None) -> DataFrame:
    out = places.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(scope)], F.col("__v"), *[c.alias(n) for n, c in columns.items()])
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(scope)] + [F.col(value).eqNullSafe(F.col("__v"))]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(looked_up(out, keep), on).drop("__v", *[f"__k{i}" for i in range(len(scope))])


def _scope_places(counts: DataFrame, scope: Sequence[str], name: str) -> list[Column]:
    """Below, same, all and null rows of a scope, from counts of a finer one."""
    w, at = Window.partitionBy(*scope), Window.partitionBy(*scope, "__v")
    upto = F.sum("__c").over(w.orderBy(F.col("__v").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("__c").over(at)
    nulls = F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))).over(w), F.lit(0))
    return [(upto - same).alias(f"__below_{name}"), same.alias(f"__same_{name}"), F.sum("__c").over(w).alias(f"__n_{name}"), nulls.alias(f"__nulls_{name}")]


def _of(column: str, name: str) -> Column:
    return F.col(f"{column}_{name}" if name else column)


def share_below(digits: int = 1, name: str = ""):
    """W1 from a histogram: 100 * percent_rank."""
    n = _of("__n", name)
    return F.when(n > 1, F.round(100 * (_of("__below", name) / (n - 1)), digits)).otherwise(0.0)


def place_from_top(name: str = ""):
    """The rank of a value from the largest, nulls last."""
    known = _of("__n", name) - _of("__nulls", name)
    return F.when(F.col("__v").isNull(), known + 1).otherwise(known - _of("__below", name) - _of("__same", name) + 1)


def standing_by_counts(df: DataFrame, scopes: dict[str, Sequence[str]], fit: str, level: str | None = None, keep=None) -> DataFrame:
    """W2 for large pools: ``standing`` from histograms, so no window holds a pool's rows and no pool is sorted.

    Rows are counted once by the columns of all scopes and the value; the places in every scope come from these counts and are one
    join for each value, whatever the number of scopes. It pays where a pool has many more rows than distinct values.

    ``keep`` stores the places (``looked_up``); ``df`` itself is read once for each value and once for the result.
    """
    every, out = list(dict.fromkeys(c for scope in scopes.values() for c in scope)), df
    for value, what in ((fit, "fit"), (level, "level")):
        if value is None:
            continue
        counts = df.groupBy(*every, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
        places = counts.select(*every, "__v", *[c for name, scope in scopes.items() for c in _scope_places(counts, scope, name)])
        columns = {}
        for name in scopes:
            if what == "fit":
                columns |= {f"pctile_{name}": share_below(name=name), f"rank_{name}": place_from_top(name), f"n_{name}": F.col(f"__n_{name}")}
            else:
                columns |= {f"level_{name}": share_below(name=name)}
        out = _join_places(out, places, every, value, columns, keep)
    return out.drop(level) if level else out


def places_in_pools(targets: DataFrame, pool: DataFrame, at: Sequence[str], group: str, key: str, value: str) -> DataFrame:
    """For each target row, which names a group: 1 + the group's rows strictly above it, and 1 + the group's other rows.

    Targets join the pool as further rows and one window ranks them all, so no pair of a target and a rival is
    made. A row of the pool with the target's key is the target itself. ``targets`` and ``pool`` have at, group, key and value.
    """
    columns = [*at, group, key, value]
    both = pool.select(*columns, F.lit(0).alias("__t")).unionByName(targets.select(*columns, F.lit(1).alias("__t")))
    mine, w = F.count_if(F.col("__t") == 0), Window.partitionBy(*at, group)
    upto = mine.over(w.orderBy(F.col(value).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = mine.over(Window.partitionBy(*at, group, value))
    own = mine.over(Window.partitionBy(*at, group, key))
    placed = both.select("*", (1 + upto - same).alias("rank"), (1 + mine.over(w) - own).alias("n")).where("__t = 1")
    return placed.drop("__t")


def index_within(df: DataFrame, value: str, scope: Sequence[str], out: str, *, mean: float = 100, spread: float = 15, of: DataFrame | None = None, keep=None) -> DataFrame:
    """The value standardised within its scope (sample deviation); the mean where there is no spread. The scope's rows are those of ``of``, if it is given.

    Mean and deviation are partial aggregates, joined back; no window holds a scope's rows. ``keep`` stores them
    (``looked_up``), so that few scopes are broadcast and the rows are not shuffled.
    """
    names = [f"__k{i}" for i in range(len(scope))]
    stats = (df if of is None else of).groupBy(*[F.col(c).alias(k) for c, k in zip(scope, names)]).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    on = F.lit(True)
    for c, k in zip(scope, names):
        on = on & F.col(c).eqNullSafe(F.col(k))
    z = mean + spread * (F.col(value) - F.col("__mean")) / F.when(F.col("__sd") > 0, F.col("__sd"))
    return df.join(looked_up(stats, keep), on).withColumn(out, F.round(F.coalesce(z, F.lit(float(mean))), 1)).drop("__mean", "__sd", *names)


def below_share(least: int = 8):
    """W5 from a histogram: share of the others in the scope strictly below; null with fewer than ``least`` others."""
    n = F.col("__n") - 1
    return F.when(n >= least, F.round(100 * F.col("__below") / n, 1))


def rank_percent(rank, n):
    """100 for the first of n, 0 for the last; null for fewer than two."""
    return F.when(n >= 2, F.round(F.lit(100.0) * (n - rank) / (n - 1), 1))


def average_rank_percent():
    """W7 from a histogram: the mean rank of ties, as a share of the pool."""
    return F.round(100 * (F.col("__below") + 1 + (F.col("__same") - 1) / F.lit(2.0)) / F.col("__n"), 4)


def inclusive_percent():
    """W8 from a histogram: the share of the reference that is not above."""
    return F.round(100 * ((F.col("__below") + F.col("__same")) / F.col("__n")), 4)
