"""T: temporal and stateful sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapstats.functions import scalars as S
from snapstats.operators import relational as R
from snapstats.operators import sequences as Q
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.session import stored
from snapstats.sources import adapters as A

C = F.col
BITS = {"error": 1, "click": 2, "purchase": 32}
_ISLANDS = "sum(CASE WHEN datediff('day', prev, date) <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY date) AS g"


@query("t1_flag_spells", "SELECT tid, kind, CAST(min(date) AS VARCHAR) AS b, CAST(max(date) AS VARCHAR) AS e, count(*) AS n FROM (SELECT *, " + _ISLANDS.format(gap=2, keys="tid, kind") + " FROM (SELECT tid, date, kind, lag(date) OVER (PARTITION BY tid, kind ORDER BY date) AS prev FROM (SELECT DISTINCT tid, date, kind FROM wk JOIN (VALUES ('error', 1), ('click', 2), ('purchase', 32)) v(kind, bit) ON flag & bit <> 0))) GROUP BY tid, kind, g")
def t1(spark, d):
    s = Q.flag_spells(A.weekly_status(spark, d), ["tid"], "date", "flag", BITS, 2)
    return s.select("tid", "kind", C("begin").cast("string").alias("b"), C("end").cast("string").alias("e"), "n")


@query("t2_or_bits", "SELECT tid, CAST(date AS VARCHAR) AS date, CAST(bit_or(flag) AS BIGINT) AS flag FROM wk GROUP BY 1, 2")
def t2(spark, d):
    return Q.or_bits(A.weekly_status(spark, d), ["tid", "date"], "flag").withColumn("date", C("date").cast("string"))


@query("t3_densest_window", "SELECT tid, CAST(date AS VARCHAR) AS begin, n, n_all FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, date) AS k, count(*) OVER (PARTITION BY tid) AS n_all FROM (SELECT tid, date, count(*) OVER (PARTITION BY tid ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 5 DAY FOLLOWING) AS n FROM wk)) WHERE k = 1 AND n_all >= 20")
def t3(spark, d):
    return Q.densest_window(A.weekly_status(spark, d), ["tid"], "date", 5, 20).withColumn("begin", C("begin").cast("string"))


def _intervals(spark, d):
    e = A.weekly_status(spark, d).where("flag > 0")
    return e.select("tid", C("date").alias("b"), F.date_add("date", (C("event_id") % 4).cast("int")).alias("e"), (C("event_id") % 10).alias("w"), "event_id")


_IV = "(SELECT tid, date AS b, CAST(date + CAST(event_id % 4 AS INTEGER) AS DATE) AS e, event_id % 10 AS w, event_id FROM wk WHERE flag > 0)"


@query("t4_interval_union", f"SELECT tid, CAST(min(b) AS VARCHAR) AS begin, CAST(max(e) AS VARCHAR) AS \"end\", max(w) AS weight, count(*) AS n FROM (SELECT *, sum(CASE WHEN datediff('day', reach, b) <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY b, e, event_id) AS g FROM (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY b, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_IV})) GROUP BY tid, g")
def t4(spark, d):
    u = Q.union_intervals(_intervals(spark, d), ["tid"], "b", "e", "w", 1)
    return u.withColumns({"begin": C("begin").cast("string"), "end": C("end").cast("string")})


def _spells(spark, d, kind):
    s = Q.flag_spells(A.weekly_status(spark, d), ["tid"], "date", "flag", {kind: BITS[kind]}, 2)
    return s.select("tid", "begin", "end", F.concat_ws("@", C("tid"), C("begin")).alias("id"))


_SP = "(SELECT tid, min(date) AS b, max(date) AS e, tid || '@' || min(date) AS id FROM (SELECT *, " + _ISLANDS.format(gap=2, keys="tid") + " FROM (SELECT tid, date, lag(date) OVER (PARTITION BY tid ORDER BY date) AS prev FROM (SELECT DISTINCT tid, date FROM wk WHERE flag & {bit} <> 0))) GROUP BY tid, g)"
# each spell in turn takes the first window that is not in the list of those used
_MET = f"(WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY b, id) AS n FROM {_SP.format(bit=2)}), y AS (SELECT tid, list({{'b': b, 'e': e, 'id': id}} ORDER BY b, id) AS ws FROM {_SP.format(bit=32)} GROUP BY tid), walk AS (SELECT tid, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS left_id, CAST(NULL AS VARCHAR) AS right_id FROM y UNION ALL SELECT tid, n, CASE WHEN r IS NULL THEN used ELSE list_append(used, r) END, id, r FROM (SELECT x.tid, x.n, w.used, x.id, list_filter(y.ws, lambda z: z.b <= x.e AND x.b <= z.e AND NOT list_contains(w.used, z.id))[1].id AS r FROM walk w JOIN x ON x.tid = w.tid AND x.n = w.n + 1 JOIN y ON y.tid = w.tid)) SELECT tid, left_id, right_id FROM walk WHERE right_id IS NOT NULL)"


@query("j12_interval_overlap", f"SELECT tid, left_id, right_id FROM {_MET}")
def j12(spark, d):
    return Q.overlap_once(_spells(spark, d, "click"), _spells(spark, d, "purchase"), ["tid"])


_NEWEST = "(SELECT max(date) FROM wk)"


@query("t5_timeline", f"SELECT tid, source, CAST(b AS VARCHAR) AS b, CAST(e AS VARCHAR) AS e, folded, e >= {_NEWEST} - 1 AS ongoing FROM (SELECT x.tid, 'exact' AS source, x.b, x.e, m.right_id AS folded FROM {_SP.format(bit=2)} x LEFT JOIN {_MET} m ON m.left_id = x.id UNION ALL SELECT tid, 'window', b, e, NULL FROM {_SP.format(bit=32)} y WHERE y.id NOT IN (SELECT right_id FROM {_MET}) UNION ALL SELECT o.tid, 'observed', o.b, o.e, NULL FROM {_SP.format(bit=1)} o WHERE NOT EXISTS (SELECT 1 FROM {_SP.format(bit=2)} x WHERE x.tid = o.tid AND x.b <= o.e AND o.b <= x.e))")
def t5(spark, d):
    """Exact spells, with the window that each absorbs; the windows that none does; the observed runs that no exact spell touches. Those that reach the newest day are ongoing."""
    a, b, seen = (_spells(spark, d, kind) for kind in ("click", "purchase", "error"))
    met = Q.overlap_once(a, b, ["tid"])
    row = lambda df, source, folded: df.select("tid", F.lit(source).alias("source"), "begin", "end", folded.cast("string").alias("folded"))
    exact = row(a.join(met.select(C("left_id").alias("id"), C("right_id").alias("folded")), "id", "left"), "exact", C("folded"))
    alone = row(b.join(met.select(C("right_id").alias("id")), "id", "left_anti"), "window", F.lit(None))
    o, x = seen.alias("o"), a.alias("x")
    runs = o.join(x, (C("o.tid") == C("x.tid")) & (C("x.begin") <= C("o.end")) & (C("o.begin") <= C("x.end")), "left_anti")
    every = exact.unionByName(alone).unionByName(row(runs, "observed", F.lit(None)))
    newest = A.weekly_status(spark, d).agg(F.max("date").alias("newest"))
    out = every.crossJoin(F.broadcast(newest))  # one row
    return out.select("tid", "source", C("begin").cast("string").alias("b"), C("end").cast("string").alias("e"), "folded", (C("end") >= F.date_sub("newest", 1)).alias("ongoing"))


_AT = "lpad(CAST(season AS VARCHAR), 4, '0') || phase"


@query("t6_person_filter", f"SELECT a.season, a.phase, a.anchor, a.tid FROM part a JOIN ent e USING (season, phase, tid) JOIN (SELECT tid, arg_max(dob, {_AT}) AS dob FROM ent GROUP BY tid) c ON c.tid = a.tid WHERE c.dob = e.dob UNION ALL SELECT a.season, a.phase, a.anchor, a.tid FROM part a WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.season = a.season AND e.phase = a.phase AND e.tid = a.tid)")
def t6(spark, d):
    """Facts of a slot's present owner; facts whose owner is unknown stay."""
    e = A.entities(spark, d)
    owner = e.select("season", "phase", "tid", "dob")
    present = e.groupBy("tid").agg(F.max_by("dob", S.ordinal(C("season"), C("phase"))).alias("now"))
    facts = X.participation(spark, d).join(owner, ["season", "phase", "tid"], "left").join(present, "tid", "left")
    return facts.where(C("dob").isNull() | (C("dob") == C("now"))).select("season", "phase", "anchor", "tid")


@query("t7_identity_audit", f"SELECT tid, CAST(dob AS VARCHAR) AS dob, n, row_number() OVER (PARTITION BY tid ORDER BY f) AS turn FROM (SELECT tid, dob, min({_AT}) AS f, count(*) AS n FROM ent GROUP BY 1, 2)")
def t7(spark, d):
    p = X.persons(A.entities(spark, d))
    turn = F.row_number().over(Window.partitionBy("tid").orderBy("first_seen")).cast("long")
    return p.select("tid", C("dob").cast("string").alias("dob"), C("slices").alias("n"), turn.alias("turn"))


_SERIES = "(SELECT tid, epoch(CAST(date AS TIMESTAMP))::BIGINT // 86400 AS t, min(event_id % 50) AS v FROM wk GROUP BY 1, 2)"


@query("t8_resample", f"WITH s AS {_SERIES}, span AS (SELECT tid, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1), grid AS (SELECT tid, k AS point, lo + (hi - lo) * k / 4.0::DOUBLE AS g FROM span, range(5) r(k)), ends AS (SELECT tid, point, g, (SELECT max(t) FROM s WHERE s.tid = grid.tid AND s.t <= g) AS t0, (SELECT min(t) FROM s WHERE s.tid = grid.tid AND s.t >= g) AS t1 FROM grid) SELECT ends.tid, point, round(CASE WHEN t0 = t1 THEN p.v ELSE p.v + (q.v - p.v) * (g - t0) / (t1 - t0) END, 6) AS v FROM ends JOIN s p ON p.tid = ends.tid AND p.t = t0 JOIN s q ON q.tid = ends.tid AND q.t = t1")
def t8(spark, d):
    s = A.weekly_status(spark, d).select("tid", F.unix_date("date").cast("long").alias("t"), (C("event_id") % 50).alias("v"))
    return Q.resample(s, ["tid"], "t", "v", 5)


@query("t9_trajectory", f"SELECT season, phase, e.tid, method, max(eff) AS score FROM eff e JOIN (SELECT tid, arg_max(dob, {_AT}) AS now FROM ent GROUP BY tid) c ON c.tid = e.tid AND c.now = e.dob WHERE familiarity >= 8 GROUP BY ALL")
def t9(spark, d):
    e = A.entities(spark, d)
    present = e.groupBy("tid").agg(F.max_by("dob", S.ordinal(C("season"), C("phase"))).alias("dob"))
    own = X.rated_fits(spark, d, lambda e: e.join(present, ["tid", "dob"]), only=lambda f: f["familiarity"] >= 8)
    return own.select("season", "phase", "tid", "method", F.greatest(*[C(f)["eff"] for f in X.FITS]).alias("score"))


_TOTAL = " + ".join(f"coalesce(a{k}, 0)" for k in range(8))


@query("t10_growth", f"SELECT season, tid, arg_max({_TOTAL}, phase) - arg_min({_TOTAL}, phase) AS growth, count(*) AS n FROM attr GROUP BY 1, 2")
def t10(spark, d):
    a = A.with_attributes(A.entities(spark, d))
    total = sum((F.coalesce(C(x), F.lit(0)) for x in A.ATTRS), F.lit(0))
    t = a.select("season", "tid", S.phase_key(C("phase")).alias("k"), total.cast("long").alias("total"))
    return t.groupBy("season", "tid").agg((F.max_by("total", "k") - F.min_by("total", "k")).alias("growth"), F.count("*").alias("n"))


@query("t11_stale_flags", "SELECT f.tid, since FROM (SELECT tid, min(season) AS since, count(DISTINCT season) AS k FROM ent WHERE is_staff GROUP BY tid) f LEFT JOIN (SELECT DISTINCT tid, season FROM part WHERE appeared) p ON p.tid = f.tid AND p.season >= since WHERE k >= 2 GROUP BY f.tid, since HAVING count(p.tid) = 0")
def t11(spark, d):
    """Flagged in two seasons or more, and not active since: one job, not a query per id."""
    flagged = A.entities(spark, d).where("is_staff").groupBy("tid").agg(F.min("season").alias("since"), F.countDistinct("season").alias("k")).where("k >= 2")
    last = X.participation(spark, d).where("appeared").groupBy("tid").agg(F.max("season").alias("last"))
    return flagged.join(last, "tid", "left").where("last is null or last < since").select("tid", "since")


@query("t12_previous_season", "SELECT e.season, e.tid, starts, minutes FROM (SELECT DISTINCT season, tid FROM ent) e JOIN (SELECT season + 1 AS season, tid, count(*) FILTER (started) AS starts, CAST(sum(minutes) AS BIGINT) AS minutes FROM cur WHERE appeared GROUP BY ALL) p USING (season, tid)")
def t12(spark, d):
    use = X.current(spark, d).where("appeared").groupBy((C("season") + 1).alias("season"), "tid").agg(F.count_if("started").alias("starts"), F.sum("minutes").alias("minutes"))
    return A.entities(spark, d).select("season", "tid").distinct().join(use, ["season", "tid"])


@query("t13_chain", "WITH RECURSIVE walk(row_id, head, position) AS (SELECT row_id, row_id, CAST(0 AS BIGINT) FROM chn WHERE row_id NOT IN (SELECT next_id FROM chn WHERE next_id IS NOT NULL) UNION ALL SELECT c.next_id, w.head, w.position + 1 FROM walk w JOIN chn c ON c.row_id = w.row_id WHERE c.next_id IS NOT NULL) SELECT w.row_id AS \"row\", head, position, p.stat AS stat_before FROM walk w LEFT JOIN chn p ON p.next_id = w.row_id")
def t13(spark, d):
    """Heads and positions by pointer doubling, then the reading rule: a row's club goes with the statistics of the row before."""
    c = A.chain(spark, d)
    placed = Q.chain_positions(c, "row_id", "next_id", keep=stored)
    before = c.where(C("next_id").isNotNull()).select(C("next_id").alias("row"), C("stat").alias("stat_before"))
    return placed.join(before, "row", "left").select("row", "head", "position", "stat_before")


@query("t13_cycles", "WITH o AS (SELECT o_orderkey AS r, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), l AS (SELECT c, arg_min(i, r) AS pl, min(r) AS least FROM o GROUP BY c) SELECT r AS \"row\", CASE WHEN c % 3 = 0 THEN least ELSE first_value(r) OVER (PARTITION BY c ORDER BY i) END AS head, CASE WHEN c % 3 = 0 THEN (i - pl + n) % n ELSE i END AS position, c % 3 = 0 AS cycle FROM o JOIN l USING (c)")
def t13_cycles(spark, d):
    """The chains of a third of the customers are closed to cycles: their last order points to the first."""
    orders = A.table(spark, d, "orders").select(C("o_orderkey").alias("row_id"), C("o_custkey").alias("c"), "o_orderdate")
    w = Window.partitionBy("c").orderBy("o_orderdate", "row_id")
    first = F.first("row_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closed = orders.withColumn("next_id", F.coalesce(F.lead("row_id").over(w), F.when(C("c") % 3 == 0, first)))
    return Q.chain_positions(closed, "row_id", "next_id", keep=stored)


@query("t13_forest_check", "SELECT next_id AS \"row\", count(*) AS n, bool_or(r.row_id IS NOT NULL) AS known FROM (SELECT CASE WHEN row_id % 50 = 0 THEN 1 ELSE next_id END AS next_id FROM chn) c LEFT JOIN (SELECT row_id FROM chn) r ON r.row_id = c.next_id WHERE next_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 OR NOT bool_or(r.row_id IS NOT NULL)")
def t13_check(spark, d):
    c = A.chain(spark, d).withColumn("next_id", F.when(C("row_id") % 50 == 0, F.lit(1).cast("long")).otherwise(C("next_id")))
    return Q.forest_faults(c, "row_id", "next_id")


@query("t14_best_month", "SELECT us, CAST(m AS VARCHAR) AS month, pts, n FROM (SELECT *, row_number() OVER (PARTITION BY us ORDER BY pts / n DESC, n DESC, m) AS k FROM (SELECT us, CAST(date_trunc('month', date) AS DATE) AS m, CAST(sum(pts) AS BIGINT) AS pts, count(*) AS n FROM res GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE k = 1")
def t14(spark, d):
    m = X.results(spark, d).groupBy("us", F.trunc("date", "month").alias("m")).agg(F.sum("pts").alias("pts"), F.count("*").alias("n")).where("n >= 2")
    best = R.first_per_key(m, ["us"], [F.desc(C("pts") / C("n")), F.desc("n"), "m"])
    return best.select("us", C("m").cast("string").alias("month"), "pts", "n")


@query("t14_crowd_and_run", "SELECT us, max(crowd) AS crowd, arg_max(anchor, (crowd, -anchor)) AS at, arg_max(comp, (date, anchor)) FILTER (result = 'W' AND comp IS NOT NULL) AS last_win FROM res WHERE venue = 'H' GROUP BY us")
def t14_crowd(spark, d):
    r = X.results(spark, d).where("venue = 'H'")
    won = (C("result") == "W") & C("comp").isNotNull()
    return r.groupBy("us").agg(F.max("crowd").alias("crowd"), F.max_by("anchor", F.struct("crowd", (-C("anchor")).alias("a"))).alias("at"), F.max_by(F.when(won, C("comp")), F.when(won, F.struct("date", "anchor"))).alias("last_win"))
