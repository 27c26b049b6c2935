"""Linear scoring and fitting, evaluation, profiles of tagged records, and assignment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_scores(df: DataFrame, coefficients: dict[str, dict[str, float]], low: int = 1, high: int = 20) -> DataFrame:
    """M1: each target's terms as one column expression; ``a*b`` is a product, ``1`` the constant. Rounded half to even, then clamped."""

    def term(name: str, c: float):
        out = F.lit(float(c))
        for part in name.split("*"):
            out = out if part == "1" else out * F.col(part)
        return out

    for target, terms in coefficients.items():
        total = sum((term(n, c) for n, c in terms.items()), F.lit(0.0))
        df = df.withColumn(target, F.greatest(F.lit(low), F.least(F.lit(high), F.bround(total, 0).cast("long"))))
    return df


def moments(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """All sums of products of (1, x..., y), the sufficient statistics of every subset's fit, in one pass."""
    names = ["1", *xs, y]
    col = lambda n: F.lit(1) if n == "1" else F.col(n)
    sums = [F.sum((col(a) * col(b)).cast("double")).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.groupBy(*keys).agg(*sums)


def subset_fits(df: DataFrame, key: str, xs: Sequence[str], y: str, largest: int = 2) -> DataFrame:
    """M2: a least-squares fit of each subset of ``xs``: constant, the coefficient of each of its features, and R².

    Rows are read once, for sums; a target's few subsets are then solved from a matrix of sums in a task of
    their own. Singular subsets give no row.
    """
    names, n = list(xs), len(xs) + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            m = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
            spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
            for size in range(1, largest + 1):
                for some in combinations(range(len(names)), size):
                    use = [0, *(i + 1 for i in some)]
                    a, b = m[np.ix_(use, use)], m[use, -1]
                    if np.linalg.matrix_rank(a) < len(use):
                        continue
                    beta = np.linalg.solve(a, b)
                    rest = m[-1, -1] - 2 * beta @ b + beta @ a @ beta
                    out.append((row[key], "+".join(names[i] for i in some), size, float(beta[0]), [float(x) for x in beta[1:]], float(1 - rest / spread) if spread > 0 else None))
        return pd.DataFrame(out, columns=[key, "features", "size", "constant", "slopes", "r2"])

    kind = df.schema[key].dataType.simpleString()
    return moments(df, [key], xs, y).groupBy(key).applyInPandas(solve, f"{key} {kind}, features string, size long, constant double, slopes array<double>, r2 double")


def exact_hits(df: DataFrame, fits: DataFrame, key: str, xs: Sequence[str], y: str) -> DataFrame:
    """M2's second pass: ``fits`` with the rows of their target, and those whose rounded estimate is exact or off by one at most.

    A target's fits are a few dozen whatever its rows are, so each row meets them through a join on the target
    (the fits in one row, as an array) and the hits are added up before they are shuffled.
    """
    held = fits.groupBy(key).agg(F.collect_list(F.struct("features", "constant", F.split("features", "\\+").alias("names"), "slopes")).alias("__fits"))
    value = F.create_map(*[x for n in xs for x in (F.lit(n), F.col(n).cast("double"))])
    each = df.where(F.col(y).isNotNull()).join(held, key).select(key, F.col(y).alias("__y"), value.alias("__x"), F.explode("__fits").alias("__f"))
    terms = F.zip_with("__f.names", "__f.slopes", lambda n, b: F.col("__x")[n] * b)
    estimate = F.bround(F.aggregate(terms, F.col("__f.constant"), lambda a, x: a + x), 0)
    off = F.abs(F.col("__y") - estimate)
    hits = each.groupBy(key, F.col("__f.features").alias("features")).agg(F.count("*").alias("n"), F.count_if(off == 0).alias("exact"), F.count_if(off <= 1).alias("within_1"))
    return fits.join(hits, [key, "features"], "left")


def evaluate(df: DataFrame, actual: str, estimate: str, keys: Sequence[str] = ()) -> DataFrame:
    """M3: rows, share exact, share within one, and R²."""
    a, e = F.col(actual), F.col(estimate)
    share = lambda k: F.round(F.lit(100.0) * F.count_if(F.abs(a - e) <= k) / F.count("*"), 2)
    spread = F.sum(a * a) - F.sum(a) * F.sum(a) / F.count("*")
    return df.where(a.isNotNull() & e.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), share(0).alias("exact"), share(1).alias("within_1"), F.round(1 - F.sum((a - e) * (a - e)) / F.nullif(spread, F.lit(0.0)), 6).alias("r2"))


def tag_profile(df: DataFrame, entity: str, tag: str, value: str, samples: int = 10) -> DataFrame:
    """M5: for each tag: rows, entities, share of entities, distinct values, smallest, largest, its most frequent values, and how many are null, 0, positive and negative.

    Values are counted first, so neither the distinct count nor the samples hold a tag's rows together.
    """
    counts = df.groupBy(tag, value).agg(F.count("*").alias("__n"))
    v, of = F.col(value), lambda ok: F.coalesce(F.sum(F.when(ok, F.col("__n"))), F.lit(0))
    kinds = {"nulls": v.isNull(), "zeros": v == 0, "positive": v > 0, "negative": v < 0}
    stats = counts.groupBy(tag).agg(F.sum("__n").alias("n"), F.count("*").alias("n_distinct"), F.min(value).alias("least"), F.max(value).alias("most"), *[of(ok).alias(n) for n, ok in kinds.items()])
    w = Window.partitionBy(tag).orderBy(F.desc("__n"), value)
    top = counts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= samples)
    top = top.groupBy(tag).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", value))), lambda x: x[value].cast("string")), ",").alias("top"))
    held = df.select(tag, entity).distinct().groupBy(tag).agg(F.count("*").alias("entities"))
    every = df.select(entity).distinct().agg(F.count("*").alias("__all"))
    return stats.join(held, tag).join(top, tag).crossJoin(F.broadcast(every)).withColumn("presence", F.round(F.lit(100.0) * F.col("entities") / F.col("__all"), 2)).drop("__all")


def value_hint(least, most, distinct):
    """M7: what a column of whole numbers may mean, from its range; the first rule that fits."""
    return (
        F.when((least >= 0) & (most <= 1), "bool")
        .when((least >= 1) & (most <= 12), "month")
        .when((least >= 1900) & (most <= 2100), "year")
        .when((least >= 0) & (most <= 20), "rating")
        .when((least >= 0) & (most <= 366) & (distinct > 300), "day of the year")
        .when((least >= 0) & (most <= 100) & (distinct > 60), "percentage")
        .when((least >= 0) & (most <= 2359) & (distinct > 100), "clock or count")
        .when((least >= 19000101) & (most <= 21001231), "packed date")
        .when((least >= 0) & (most > 65535) & (distinct <= 4096), "packed code")
        .when(distinct <= 32, "enum")
        .otherwise("number")
    )


def coverage(df: DataFrame, group: str, at: str, kind: str) -> DataFrame:
    """M8: what lies between a record's place and the next one's, by kind; of all together a row with kind null."""
    span = _spans(df, group, at)
    of = lambda g: g.agg(F.count("*").alias("n"), F.sum("__span").alias("covered"), F.max("__span").alias("largest"), F.count_if(F.col("__span").isNull()).alias("open"))
    return of(span.groupBy(kind)).unionByName(of(span.groupBy(F.lit(None).cast("string").alias(kind))))


def _spans(df: DataFrame, group: str, at: str) -> DataFrame:
    return df.withColumn("__span", F.lead(at).over(Window.partitionBy(group).orderBy(at)) - F.col(at))


def largest_spans(df: DataFrame, group: str, at: str, kind: str, n: int = 20) -> DataFrame:
    """M8: the ``n`` longest stretches, which are a report's length; the earlier of equals."""
    top = _spans(df, group, at).where(F.col("__span").isNotNull()).orderBy(F.desc("__span"), group, at).limit(n)
    return top.select(group, at, kind, F.col("__span").alias("span"))


def best_assignment(score: np.ndarray) -> list[int]:
    """The column of each row, all different, of the largest total; rows are few, columns at least as many."""
    return priced_assignment(score)[0]


def priced_assignment(score: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """As ``best_assignment``, with prices of rows and columns that prove it.

    No score is above the sum of its two prices, a column that is left has price 0, and the prices of all together are the
    total: so no other choice has a larger one.

    Successive shortest augmenting paths with potentials: each new row takes a column, and rows before it
    move along the cheapest path. Equal totals: the order of the columns decides.
    """
    n, m = score.shape
    cost = score.max() - score
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        now, spent, last = row, 0.0, -1
        while True:
            step = spent + cost[now] - u[now] - v
            better = ~done & (step < reach - 1e-12)
            reach[better], via[better] = step[better], last
            last = int(np.argmin(np.where(done, np.inf, reach)))
            spent, done[last] = reach[last], True
            if owner[last] < 0:
                break
            now = owner[last]
        u[row] += spent
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                u[owner[c]] += spent - reach[c]
            v[c] -= spent - reach[c]
        while via[last] >= 0:
            owner[last] = owner[via[last]]
            last = via[last]
        owner[last] = row
    out = [-1] * n
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out, score.max() - u, -v


def assign(df: DataFrame, group: str, slot: str, candidate: str, score: str, per_slot: int = 12) -> DataFrame:
    """M9: in each group one candidate per slot, none twice, of the largest total."""
    return priced(df, group, slot, candidate, score, per_slot).where(F.col(candidate).isNotNull()).select(group, slot, candidate, score)


def assignment_faults(df: DataFrame, chosen: DataFrame, group: str, slot: str, candidate: str, score: str) -> DataFrame:
    """M9's proof from the rows of ``priced``: for each group the slots, the scores above their two prices, candidates used twice, and what total and prices differ by."""
    used = chosen.where(F.col(candidate).isNotNull()).select(group, candidate, "candidate_price")
    pairs = df.where(F.col(score).isNotNull()).select(group, slot, candidate, score)
    pairs = pairs.join(chosen.select(group, slot, "slot_price"), [group, slot]).join(used.select(group, candidate, "candidate_price"), [group, candidate], "left")
    # only the pairs above their prices are told apart: there should be none, so nothing but those is shuffled
    above = pairs.where(F.col(score) > F.col("slot_price") + F.coalesce("candidate_price", F.lit(0.0)) + 1e-6).select(group, slot, candidate).distinct()
    over = above.groupBy(group).agg(F.count("*").alias("above"))
    sums = chosen.groupBy(group).agg(F.count("*").alias("slots"), (F.count(candidate) - F.count_distinct(candidate)).alias("twice"), F.round(F.sum(F.col("value") - F.col("slot_price") - F.col("candidate_price")), 3).alias("gap"))
    return sums.join(over, group, "left").fillna(0, ["above"]).select(group, "slots", "twice", "above", (F.abs("gap") > 0.001).alias("open"))


def priced(df: DataFrame, group: str, slot: str, candidate: str, score: str, per_slot: int = 12) -> DataFrame:
    """A row for each slot of each group: its candidate (null if the slot stays empty) and score, the value that counts, and the prices that prove the choice.

    Only a slot's best candidates can matter, as many as there are slots, so each group is cut to those in
    Spark (exactly, ``per_slot`` must not be below the number of slots) before it goes to a task. Groups with
    fewer candidates than slots leave the worst slots empty.
    """
    w = Window.partitionBy(group, slot).orderBy(F.desc(score), candidate)
    few = df.where(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_slot).drop("__k")
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, slot, candidate)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=slot, columns=candidate, values=score, aggfunc="max").sort_index().sort_index(axis=1)
        if len(table) > per_slot:
            raise ValueError(f"{len(table)} slots, but only {per_slot} candidates of each were kept")
        # a column for leaving a slot empty, worse than any candidate
        values = table.to_numpy(float)
        worst = np.nanmin(values) - (np.nanmax(values) - np.nanmin(values) + 1) * (len(table) + 1)
        padded = np.hstack([np.where(np.isnan(values), worst * 2 - abs(worst), values), np.full((len(table), len(table)), worst)])
        chosen, slots, candidates = priced_assignment(padded)
        rows = []
        for i, (s, c) in enumerate(zip(table.index, chosen)):
            filled = c < values.shape[1] and not np.isnan(values[i, c])
            rows.append((pdf[group].iloc[0], s, table.columns[c] if filled else None, values[i, c] if filled else None, padded[i, c], slots[i], candidates[c]))
        return pd.DataFrame(rows, columns=[group, slot, candidate, score, "value", "slot_price", "candidate_price"]).convert_dtypes()

    # the rows are few but each group is work: a set number of partitions is not merged into one for being small
    few = few.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    return few.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, {slot} {kinds[slot]}, {candidate} {kinds[candidate]}, {score} double, value double, slot_price double, candidate_price double")


def leaf_paths(schema, prefix: str = "") -> Iterable[str]:
    """Every field of a schema at any depth, with arrays and maps passed through."""
    kind = schema.typeName()
    if kind == "struct":
        for f in schema.fields:
            yield f"{prefix}{f.name}"
            yield from leaf_paths(f.dataType, f"{prefix}{f.name}.")
    elif kind == "array":
        yield from leaf_paths(schema.elementType, f"{prefix}[].")
    elif kind == "map":
        yield from leaf_paths(schema.valueType, f"{prefix}{{}}.")
