"""M: numeric, model and profiling jobs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapstats.operators import models as M
from snapstats.operators import scoring
from snapstats.operators.documents import nested_profile, nesting, walk
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.session import checkpoint, stored
from snapstats.sources import adapters as A

C = F.col
COEFFICIENTS = {"t0": {"1": 8.25, "x1": 0.015, "x2": -0.01}, "t1": {"1": 10.0, "x3": 0.02, "x1*x2": 0.00005}}


@query("m1_linear_scores", "SELECT id, CAST(greatest(1, least(20, round_even(8.25::DOUBLE + x1 * 0.015::DOUBLE + x2 * -0.01::DOUBLE, 0))) AS BIGINT) AS t0, CAST(greatest(1, least(20, round_even(10.0::DOUBLE + x3 * 0.02::DOUBLE + x1 * 0.00005::DOUBLE * x2, 0))) AS BIGINT) AS t1 FROM feat")
def m1(spark, d):
    return M.linear_scores(A.features(spark, d), COEFFICIENTS).select("id", C("t0").cast("long").alias("t0"), C("t1").cast("long").alias("t1"))


_FIT = " UNION ALL ".join(f"SELECT target, 'x{k}' AS features, CAST(1 AS BIGINT) AS size, round(regr_intercept(y, x{k}), 6) AS constant, round(regr_slope(y, x{k}), 6) AS slope, round(regr_r2(y, x{k}), 6) AS r2 FROM feat GROUP BY target" for k in range(1, 5))


@query("m2_one_feature_fits", _FIT)
def m2(spark, d):
    fits = M.subset_fits(A.features(spark, d), "target", ["x1", "x2", "x3", "x4"], "y", 1)
    return fits.select("target", "features", "size", F.round("constant", 6).alias("constant"), F.round(C("slopes")[0], 6).alias("slope"), F.round("r2", 6).alias("r2"))


_CENTRED = "(SELECT target, y, x1, x2, x3, x4, y - avg(y) OVER t AS cy, " + ", ".join(f"x{k} - avg(x{k}) OVER t AS c{k}" for k in range(1, 5)) + " FROM feat WINDOW t AS (PARTITION BY target))"


def _pair_sql(i: int, j: int) -> str:
    """Both coefficients of a fit with two features, by Cramer's rule on centred sums, and its exact hits."""
    sums = f"SELECT target, avg(y) AS my, avg(x{i}) AS mi, avg(x{j}) AS mj, sum(c{i} * c{i}) AS a, sum(c{i} * c{j}) AS b, sum(c{j} * c{j}) AS c, sum(c{i} * cy) AS p, sum(c{j} * cy) AS q FROM {_CENTRED} GROUP BY target"
    fit = f"SELECT target, (p * c - q * b) / (a * c - b * b) AS u, (q * a - p * b) / (a * c - b * b) AS v, my, mi, mj FROM ({sums})"
    return f"SELECT f.target, 'x{i}+x{j}' AS features, round(any_value(u), 6) AS slope_1, round(any_value(v), 6) AS slope_2, count(*) FILTER (round_even(my - u * mi - v * mj + u * x{i} + v * x{j}, 0) = y) AS exact, count(*) AS n FROM ({fit}) f JOIN feat USING (target) GROUP BY f.target"


@query("m2_subset_search", " UNION ALL ".join(_pair_sql(i, j) for i in range(1, 5) for j in range(i + 1, 5)))
def m2_all(spark, d):
    """The fits with two features, with both coefficients and their exact hits; ``m2_ranked_subsets`` has all sizes in their order."""
    return _searched(spark, d).where("size = 2").select("target", "features", F.round(C("slopes")[0], 6).alias("slope_1"), F.round(C("slopes")[1], 6).alias("slope_2"), "exact", "n")


def _searched(spark, d):
    f, xs = A.features(spark, d), ["x1", "x2", "x3", "x4"]
    return M.exact_hits(f, M.subset_fits(f, "target", xs, "y", 3), "target", xs, "y")


def _determinant(m: list[list[str]]) -> str:
    """A determinant as an expression, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"{'-' if j % 2 else ''}{m[0][j]} * {_determinant([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"


def _subset_sql(some: tuple[int, ...]) -> str:
    """The fit of one subset, by Cramer's rule on centred sums: its coefficients in order, then one for each of the four features."""
    a = [[f"s{min(i, j)}{max(i, j)}" for j in some] for i in some]
    whole = _determinant(a)
    swapped = [_determinant([[f"p{i}" if c == k else a[r][c] for c in range(len(some))] for r, i in enumerate(some)]) for k in range(len(some))]
    slopes = [f"{x} / {whole} AS b{k + 1}" for k, x in enumerate(swapped)] + [f"NULL::DOUBLE AS b{k + 1}" for k in range(len(some), 3)]
    each = [f"b{some.index(k) + 1} AS u{k}" if k in some else f"0.0::DOUBLE AS u{k}" for k in range(1, 5)]
    constant = "my" + "".join(f" - b{k + 1} * m{i}" for k, i in enumerate(some))
    fitted = " + ".join(f"b{k + 1} * p{i}" for k, i in enumerate(some))
    name = "+".join(f"x{i}" for i in some)
    return f"SELECT target, '{name}' AS features, CAST({len(some)} AS BIGINT) AS size, b1, b2, b3, {', '.join(each)}, {constant} AS constant, CASE WHEN yy > 0 THEN round(({fitted}) / yy, 6) END AS r2 FROM (SELECT *, {', '.join(slopes)} FROM s WHERE {whole} <> 0)"


_SUBSETS = [some for size in (1, 2, 3) for some in combinations(range(1, 5), size)]
_SUMS = ", ".join([f"avg(x{k}) AS m{k}" for k in range(1, 5)] + [f"sum(c{k} * cy) AS p{k}" for k in range(1, 5)] + [f"sum(c{i} * c{j}) AS s{i}{j}" for i in range(1, 5) for j in range(i, 5)])
_RANKED = f"""
WITH s AS (SELECT target, avg(y) AS my, sum(cy * cy) AS yy, {_SUMS} FROM {_CENTRED} GROUP BY target),
fits AS ({' UNION ALL '.join(map(_subset_sql, _SUBSETS))}),
off AS (SELECT target, features, abs(y - round_even(constant + u1 * x1 + u2 * x2 + u3 * x3 + u4 * x4, 0)) AS off FROM fits JOIN feat USING (target)),
hits AS (SELECT target, features, count(*) AS n, count(*) FILTER (off = 0) AS exact, count(*) FILTER (off <= 1) AS within_1 FROM off GROUP BY ALL)
SELECT target, features, size, round(constant, 6) AS constant, round(b1, 6) AS slope_1, round(b2, 6) AS slope_2, round(b3, 6) AS slope_3, r2, n, exact, within_1,
  row_number() OVER (PARTITION BY target ORDER BY exact DESC, within_1 DESC, r2 DESC, size, features) AS place
FROM fits JOIN hits USING (target, features)
"""


@query("m2_ranked_subsets", _RANKED)
def m2_ranked(spark, d):
    """Every subset up to three features, ranked within its target by exact hits, those off by one, R² to six places, size, name."""
    order = Window.partitionBy("target").orderBy(F.desc("exact"), F.desc("within_1"), F.desc("r2"), "size", "features")
    slopes = [F.round(F.get("slopes", F.lit(k)), 6).alias(f"slope_{k + 1}") for k in range(3)]
    r = _searched(spark, d).select("target", "features", "size", F.round("constant", 6).alias("constant"), *slopes, F.round("r2", 6).alias("r2"), "n", "exact", "within_1")
    return r.withColumn("place", F.row_number().over(order).cast("long"))


@query("m3_evaluate", "SELECT target, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (abs(y - e) <= 0) / count(*), 2) AS exact, round(100.0::DOUBLE * count(*) FILTER (abs(y - e) <= 1) / count(*), 2) AS within_1, round(1 - sum((y - e) * (y - e))::DOUBLE / nullif((sum(y * y) - sum(y) * sum(y) / count(*)::DOUBLE), 0), 6) AS r2 FROM (SELECT target, y, y + x1 % 3 AS e FROM feat) GROUP BY target")
def m3(spark, d):
    return M.evaluate(A.features(spark, d).withColumn("e", C("y") + C("x1") % 3), "y", "e", ["target"])


@query("m4_calibration_table", "SELECT season, phase, tid, a0, a1, ability * 5 AS raw0, ability * 7 % 100 AS raw1 FROM attr WHERE ability IS NOT NULL")
def m4(spark, d):
    e = A.entities(spark, d)
    raw = e.where("ability is not null").select("season", "phase", "tid", (C("ability") * 5).alias("raw0"), (C("ability") * 7 % 100).alias("raw1"))
    return A.with_attributes(e).select("season", "phase", "tid", "a0", "a1").join(raw, ["season", "phase", "tid"])


_COUNTS = "(SELECT tag, value, count(*) AS k FROM kv GROUP BY 1, 2)"


@query("m5_tag_profile", f"SELECT s.tag, s.n, n_distinct, least, most, nulls, zeros, positive, negative, entities, top, round(100.0::DOUBLE * entities / (SELECT count(DISTINCT entity) FROM kv), 2) AS presence FROM (SELECT tag, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_distinct, min(value) AS least, max(value) AS most, CAST(coalesce(sum(k) FILTER (value IS NULL), 0) AS BIGINT) AS nulls, CAST(coalesce(sum(k) FILTER (value = 0), 0) AS BIGINT) AS zeros, CAST(coalesce(sum(k) FILTER (value > 0), 0) AS BIGINT) AS positive, CAST(coalesce(sum(k) FILTER (value < 0), 0) AS BIGINT) AS negative FROM {_COUNTS} GROUP BY 1) s JOIN (SELECT tag, count(DISTINCT entity) AS entities FROM kv GROUP BY 1) USING (tag) JOIN (SELECT tag, string_agg(CAST(value AS VARCHAR), ',' ORDER BY i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY k DESC, value) AS i FROM {_COUNTS}) WHERE i <= 10 GROUP BY 1) USING (tag)")
def m5(spark, d):
    return M.tag_profile(A.key_values(spark, d), "entity", "tag", "value")


_DOC = "SELECT event_id, '{\"user\":{\"id\":' || user_id || ',\"seen\":[{\"at\":{\"day\":' || event_id % 31 || ',\"kinds\":[\"' || event_type || '\",null,true]}},' || event_id % 7 || ']},\"props\":' || props || ',\"rate\":0.25}' AS doc FROM events"
_TREE = f"(SELECT event_id, key AS tag, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind, CASE WHEN type LIKE '%BIGINT' THEN CAST(atom AS BIGINT) END AS whole, id, parent FROM ({_DOC}) d, json_tree(d.doc))"
_NODES = f"(SELECT c.event_id, CASE WHEN p.kind = 'array' THEN '[]' ELSE c.tag END AS tag, c.kind, c.whole, c.depth, CASE WHEN p.parent IS NULL THEN '$' WHEN p.in_array THEN '[]' ELSE p.tag END AS parent FROM nodes c JOIN nodes p ON p.event_id = c.event_id AND p.id = c.parent)"
_WALK = f"WITH RECURSIVE t AS MATERIALIZED {_TREE}, nodes AS (SELECT *, 0 AS depth, false AS in_array FROM t WHERE parent IS NULL UNION ALL SELECT t.*, n.depth + 1, n.kind = 'array' FROM t JOIN nodes n ON n.event_id = t.event_id AND t.parent = n.id), v AS {_NODES}"
_MIX = "(SELECT tag, string_agg(x || ':' || k, ',' ORDER BY k DESC, x) AS {name} FROM (SELECT tag, {what} AS x, count(*) AS k, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, {what}) AS i FROM v GROUP BY 1, 2) WHERE i <= {most} GROUP BY 1)"


def _documents(spark, d):
    """Documents six levels deep, with the events' own JSON inside."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    doc = text('{"user":{"id":', C("user_id"), ',"seen":[{"at":{"day":', C("event_id") % 31, ',"kinds":["', C("event_type"), '",null,true]}},', C("event_id") % 7, ']},"props":', C("props"), ',"rate":0.25}')
    return A.table(spark, d, "events").select("event_id", doc.alias("doc"))


@query("m5_nested_profile", f"{_WALK} SELECT tag, count(*) AS n, count(*) FILTER (kind IN ('object', 'array')) AS as_container, count(DISTINCT whole) AS distinct_values, min(whole) AS least, max(whole) AS most, CAST(min(depth) AS BIGINT) AS least_depth, CAST(max(depth) AS BIGINT) AS most_depth, count(DISTINCT event_id) AS entities, any_value(kinds) AS kinds, any_value(parents) AS parents FROM v JOIN {_MIX.format(name='kinds', what='kind', most=99)} USING (tag) JOIN {_MIX.format(name='parents', what='parent', most=8)} USING (tag) GROUP BY tag")
def m5_nested(spark, d):
    return nested_profile(walk(_documents(spark, d), ["event_id"], "doc", keep=checkpoint), "event_id")


@query("m5_nesting", f"{_WALK} SELECT parent, tag, count(*) AS n FROM v GROUP BY 1, 2")
def m5_nesting(spark, d):
    return nesting(walk(_documents(spark, d), ["event_id"], "doc", keep=checkpoint))


@query("m6_reverse_index", "SELECT value, tag, count(*) AS n FROM kv WHERE value IN (SELECT DISTINCT length(text) FROM benchmark) GROUP BY 1, 2")
def m6(spark, d):
    known = A.table(spark, d, "benchmark").select(F.length("text").cast("long").alias("value")).distinct()
    return A.key_values(spark, d).join(known, "value", "left_semi").groupBy("value", "tag").agg(F.count("*").alias("n"))


_HINT = "CASE WHEN lo >= 0 AND hi <= 1 THEN 'bool' WHEN lo >= 1 AND hi <= 12 THEN 'month' WHEN lo >= 1900 AND hi <= 2100 THEN 'year' WHEN lo >= 0 AND hi <= 20 THEN 'rating' WHEN lo >= 0 AND hi <= 366 AND n > 300 THEN 'day of the year' WHEN lo >= 0 AND hi <= 100 AND n > 60 THEN 'percentage' WHEN lo >= 0 AND hi <= 2359 AND n > 100 THEN 'clock or count' WHEN lo >= 19000101 AND hi <= 21001231 THEN 'packed date' WHEN lo >= 0 AND hi > 65535 AND n <= 4096 THEN 'packed code' WHEN n <= 32 THEN 'enum' ELSE 'number' END"
_HINTED = ("l_linenumber", "l_suppkey", "l_partkey", "l_orderkey")


@query("m7_value_hints", f"SELECT name, lo AS least, hi AS most, n AS n_distinct, {_HINT} AS hint FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi, count(DISTINCT {c}) AS n FROM lineitem" for c in _HINTED) + ")")
def m7(spark, d):
    long = A.table(spark, d, "lineitem").select(*[C(c).cast("long").alias(c) for c in _HINTED]).unpivot([], list(_HINTED), "name", "v")
    s = long.distinct().groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n_distinct"))
    return s.withColumn("hint", M.value_hint(C("least"), C("most"), C("n_distinct")))


@query("m8_coverage", "SELECT kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS covered, max(s) AS largest, count(*) FILTER (s IS NULL) AS open FROM (SELECT event_type AS kind, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS s FROM events) GROUP BY ROLLUP (kind)")
def m8(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_id", C("event_type").alias("kind"))
    return M.coverage(e, "user_id", "event_id", "kind")


@query("m8_largest_spans", "SELECT user_id, event_id, event_type AS kind, s AS span FROM (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS s FROM events) WHERE s IS NOT NULL ORDER BY s DESC, user_id, event_id LIMIT 20")
def m8_largest(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_id", C("event_type").alias("kind"))
    return M.largest_spans(e, "user_id", "event_id", "kind")


@query("m9_assignment")
def m9(spark, d):
    """For each club and slice: one entity for each position, none twice, of the largest total."""
    e = X.effective(spark, d).where("method = 'm0'")
    grouped = e.select(F.concat_ws("/", "phase", C("club").cast("string")).alias("team"), "position", "tid", "eff")
    return M.assign(grouped, "team", "position", "tid", "eff", 14)


@query("m9_proof", "SELECT phase || '/' || club AS team, count(DISTINCT position) AS slots, 0 AS twice, 0 AS above, false AS open FROM eff WHERE method = 'm0' AND eff IS NOT NULL GROUP BY phase, club")
def m9_proof(spark, d):
    """That the assignments are the best: by the prices of slots and candidates, over all pairs of the table."""
    e = X.effective(spark, d).where("method = 'm0'")
    grouped = e.select(F.concat_ws("/", "phase", C("club").cast("string")).alias("team"), "position", "tid", "eff")
    chosen = stored(M.priced(grouped, "team", "position", "tid", "eff", 14))
    return M.assignment_faults(grouped, chosen, "team", "position", "tid", "eff")


@query("m10_hidden_level", "SELECT season, phase, tid, method, position, round(100 * percent_rank() OVER (PARTITION BY season, phase, position, method ORDER BY ability NULLS LAST), 1) AS level_pos FROM eff")
def m10(spark, d):
    """The level leaves as a percentile only."""
    e = X.effective(spark, d).select("season", "phase", "tid", "method", "position", "ability")
    return e.select("*", scoring.percent_rank("ability", ["season", "phase", "position", "method"], "level_pos")).drop("ability")
