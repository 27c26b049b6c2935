"""R: reports about a squad's future: positions, growth, contracts, comparison, and the views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapstats.functions import scalars as S
from snapstats.operators import relational as R
from snapstats.operators import scoring
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.plans.q_reports import _SQUAD, US, squad_frame
from snapstats.session import checkpoint
from snapstats.sources import adapters as A

C = F.col

#: Fixed values of the position review: least familiarity, players of a role that start, least squad of a host at the position, least pool of a fit.
FLOOR, SLOTS, HOST_SQUAD, POOL = 8, {"r0": 1, "r1": 4, "r2": 3, "r3": 3}, 3, 8
#: Fixed values of its reads, the first that fits: ages and percentiles.
YOUNG_STARTER, LOAN_AGE, RESERVE_AGE, SELL_AGE, IDLE_AGE, UPGRADE, WEAK = 19, 24, 18, 23, 20, 40, 33

_SLOTS = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLOTS.items()) + " END"
_REVIEW = f"""
WITH pool AS (SELECT season, phase, tid, club, league, dob, role, position, eff FROM eff WHERE method = 'm0' AND familiarity >= {FLOOR}),
own AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY phase, tid, role ORDER BY eff DESC, position) AS k FROM pool WHERE club = {US}) WHERE k = 1),
placed AS (
  SELECT o.season, o.phase, o.tid, o.role, o.position, o.eff, o.dob, count(*) FILTER (p.eff > o.eff) + 1 AS r, count(*) AS n, count(*) FILTER (p.eff < o.eff) AS below
  FROM own o JOIN pool p ON p.phase = o.phase AND p.position = o.position AND p.league = o.league GROUP BY ALL),
hosts AS (
  SELECT phase, tid, role, count(*) AS firsts FROM (
    SELECT o.phase, o.tid, o.role, h.club, count(*) FILTER (h.eff > o.eff) AS above, count(*) + 1 AS n
    FROM own o JOIN pool h ON h.phase = o.phase AND h.position = o.position AND h.league <> o.league GROUP BY ALL)
  WHERE above = 0 AND n >= {HOST_SQUAD} GROUP BY ALL),
home AS (SELECT phase, tid, arg_max(role, (eff, -CAST(substr(role, 2) AS BIGINT))) AS home, string_agg(role, ',' ORDER BY role) AS roles FROM own GROUP BY ALL),
review AS (
  SELECT p.season, p.phase, p.tid, p.role, p.position, rank() OVER (PARTITION BY p.phase, p.role ORDER BY p.eff DESC) AS depth, {_SLOTS.replace('role', 'p.role')} AS slots,
    CASE WHEN n >= 2 THEN round(100.0::DOUBLE * (n - r) / (n - 1), 1) END AS pct, CASE WHEN n > {POOL} THEN round(100 * (below / (n - 1)), 1) END AS fit,
    CAST(p.season - year(dob) AS BIGINT) AS age, coalesce(firsts, 0) AS firsts, home, roles
  FROM placed p LEFT JOIN hosts USING (phase, tid, role) JOIN home USING (phase, tid)),
told AS (
  SELECT phase, tid, role, depth, slots, pct, fit, age, firsts, home, roles, CASE
    WHEN home <> role THEN CASE WHEN depth <= slots THEN 'keep: starter here, at home in ' ELSE 'cover only: at home in ' END || home
    WHEN depth <= slots THEN CASE WHEN age <= {YOUNG_STARTER} THEN 'keep: young starter' WHEN pct < {UPGRADE} THEN 'keep: upgrade' ELSE 'keep: starter' END
    WHEN depth = slots + 1 THEN 'keep: cover' WHEN age < {LOAN_AGE} AND firsts > 0 THEN 'loan' WHEN age <= {RESERVE_AGE} THEN 'keep: reserve'
    WHEN age >= {SELL_AGE} AND pct < {WEAK} THEN 'sell' WHEN firsts = 0 AND age >= {IDLE_AGE} THEN 'sell: starts nowhere' ELSE 'surplus' END AS read
  FROM review)
"""


def review(spark, d):
    """Each owned player in each role: depth, standing in the league, hosts that would start him, and what the rules advise."""
    pool = X.effective(spark, d).where(f"method = 'm0' and familiarity >= {FLOOR}").select("season", "phase", "tid", "club", "league", "dob", "role", "position", "eff")
    pool = checkpoint(pool)
    pct = F.when(C("__n") >= 2, F.round(F.lit(100.0) * (C("__n") - scoring.place_from_top()) / (C("__n") - 1), 1))
    placed = scoring.with_places(pool, ["phase", "position", "league"], "eff", {"pct": pct, "fit": scoring.below_share(POOL)})
    own = checkpoint(R.first_per_key(placed.where(C("club") == US), ["phase", "tid", "role"], [F.desc("eff"), "position"]))  # one squad, read three times
    at = ["phase", "position"]
    # first at a host is who is not below its best, so a host is known by its best and its size: nobody is ranked among its players
    best = pool.groupBy(*at, "league", "club").agg(F.max("eff").alias("best"), F.count("*").alias("n"))
    met = own.select(*at, "tid", "role", "eff", C("league").alias("ours")).join(best, at).where("league <> ours")
    met = met.groupBy("phase", "tid", "role", "eff", "club").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    hosts = met.where((C("best") <= C("eff")) & (C("n") + 1 >= HOST_SQUAD)).groupBy("phase", "tid", "role").agg(F.count("*").alias("firsts"))
    home = own.groupBy("phase", "tid").agg(F.max_by("role", F.struct("eff", (-F.substring("role", 2, 2).cast("long")).alias("r"))).alias("home"), F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))
    r = own.join(hosts, ["phase", "tid", "role"], "left").join(home, ["phase", "tid"]).fillna(0, ["firsts"])
    r = r.select("phase", "tid", "role", scoring.rank_desc("eff", ["phase", "role"], "depth"), S.lookup(C("role"), SLOTS).cast("long").alias("slots"), "pct", "fit", S.season_age(C("season"), C("dob")).alias("age"), "firsts", "home", "roles")
    starts, age = C("depth") <= C("slots"), C("age")
    rules = [
        (C("home") != C("role"), F.concat(F.when(starts, "keep: starter here, at home in ").otherwise("cover only: at home in "), "home")),
        (starts & (age <= YOUNG_STARTER), F.lit("keep: young starter")),
        (starts & (C("pct") < UPGRADE), F.lit("keep: upgrade")),
        (starts, F.lit("keep: starter")),
        (C("depth") == C("slots") + 1, F.lit("keep: cover")),
        ((age < LOAN_AGE) & (C("firsts") > 0), F.lit("loan")),
        (age <= RESERVE_AGE, F.lit("keep: reserve")),
        ((age >= SELL_AGE) & (C("pct") < WEAK), F.lit("sell")),
        ((C("firsts") == 0) & (age >= IDLE_AGE), F.lit("sell: starts nowhere")),
    ]
    read = F.coalesce(*[F.when(ok, text) for ok, text in rules], F.lit("surplus"))
    return r.withColumn("read", read)


@query("r14_position_review", f"{_REVIEW} SELECT * FROM told")
def r14(spark, d):
    return review(spark, d)


@query("r14_role_summary", f"{_REVIEW} SELECT phase, role, count(*) AS owned, max(slots) AS slots, arg_min(tid, (depth, tid)) AS best, arg_min(pct, (depth, tid)) AS pct, round(avg(age) FILTER (depth <= greatest(1, slots)), 1) AS mean_age, CASE WHEN arg_min(coalesce(pct, 100), (depth, tid)) < {UPGRADE} THEN CASE WHEN arg_min(age, (depth, tid)) <= {YOUNG_STARTER} THEN 'prospect starts: cover him' ELSE 'needs a starter' END WHEN count(*) <= max(slots) THEN 'thin' WHEN count(*) > max(slots) + 2 THEN 'stocked' ELSE 'settled' END AS read FROM told GROUP BY phase, role")
def r14_summary(spark, d):
    """A line for each role, from its best player and its numbers."""
    first = lambda c: F.min_by(c, F.struct("depth", "tid"))
    g = review(spark, d).groupBy("phase", "role").agg(
        F.count("*").alias("owned"), F.max("slots").alias("slots"), first("tid").alias("best"), first("pct").alias("pct"), F.round(F.avg(F.when(C("depth") <= F.greatest(F.lit(1), C("slots")), C("age"))), 1).alias("mean_age"), first("age").alias("age")
    )
    weak = F.coalesce(C("pct") < UPGRADE, F.lit(False))
    read = F.when(weak & (C("age") <= YOUNG_STARTER), "prospect starts: cover him").when(weak, "needs a starter").when(C("owned") <= C("slots"), "thin").when(C("owned") > C("slots") + 2, "stocked").otherwise("settled")
    return g.withColumn("read", read).drop("age")


_SUM8 = " + ".join(f"coalesce(a{k}, 0)" for k in range(8))


@query("r15_growth_steps", f"SELECT tid, ck, phase, total, total - first(total) OVER w AS since_first, total - lag(total) OVER w AS recent, lag(total) OVER w - lag(total, 2) OVER w AS prior, datediff('day', CAST(lag(phase) OVER w AS DATE), CAST(phase AS DATE)) AS gap, CASE WHEN datediff('day', CAST(lag(phase) OVER w AS DATE), CAST(phase AS DATE)) >= 14 THEN round((total - lag(total) OVER w) * 365.0::DOUBLE / datediff('day', CAST(lag(phase) OVER w AS DATE), CAST(phase AS DATE)), 2) END AS yearly FROM (SELECT tid, ck, phase, {_SUM8} AS total FROM attr) WINDOW w AS (PARTITION BY tid, ck ORDER BY phase)")
def r15_steps(spark, d):
    """Each person's total at each snapshot, and what it gained: in all, in the last step, in the one before, and a year."""
    total = sum((F.coalesce(C(a), F.lit(0)) for a in A.ATTRS), F.lit(0)).alias("total")
    a, w = A.with_attributes(A.entities(spark, d)).select("tid", "ck", "phase", total), Window.partitionBy("tid", "ck").orderBy("phase")
    before, gap = F.lag("total").over(w), F.datediff(F.to_date("phase"), F.lag(F.to_date("phase")).over(w)).cast("long")
    return a.select("tid", "ck", "phase", "total", (C("total") - F.first("total").over(w)).alias("since_first"), (C("total") - before).alias("recent"), (before - F.lag("total", 2).over(w)).alias("prior"), gap.alias("gap"), F.when(gap >= 14, F.round((C("total") - before) * 365.0 / gap, 2)).alias("yearly"))


_ENDS = "make_date(season + ck % 4, 6, 30)"


@query("r15_contract_watch", f"SELECT phase, tid, club, CAST({_ENDS} AS VARCHAR) AS ends, CAST(datediff('day', CAST(phase AS DATE), {_ENDS}) AS BIGINT) AS days_left, CASE WHEN {_ENDS} < CAST(phase AS DATE) THEN 'ended' WHEN datediff('day', CAST(phase AS DATE), {_ENDS}) <= 182 THEN 'may sign elsewhere' WHEN datediff('day', CAST(phase AS DATE), {_ENDS}) <= 365 THEN 'last year' ELSE 'safe' END AS state FROM ent WHERE NOT is_staff")
def r15_contracts(spark, d):
    """Who is near the end of a contract at each snapshot."""
    e = A.entities(spark, d).where("not is_staff")
    ends = F.make_date((C("season") + C("ck") % 4).cast("int"), F.lit(6), F.lit(30))
    left = F.datediff(ends, F.to_date("phase")).cast("long")
    state = F.when(left < 0, "ended").when(left <= 182, "may sign elsewhere").when(left <= 365, "last year").otherwise("safe")
    return e.select("phase", "tid", "club", ends.cast("string").alias("ends"), left.alias("days_left"), state.alias("state"))


_MEANS = "(SELECT season, n_regionkey AS region, club, league, count(ability) AS n, sum(ability) / count(ability)::DOUBLE AS m FROM ent JOIN nation ON n_nationkey = club GROUP BY ALL HAVING count(ability) > 0)"


@query("r17_pyramid", f"SELECT season, CAST(region AS BIGINT) AS region, tier, count(*) AS clubs, string_agg(club, ',' ORDER BY m DESC, club) AS who FROM (SELECT *, 1 + (row_number() OVER (PARTITION BY season, region ORDER BY m DESC, club) - 1) // 2 AS tier FROM {_MEANS}) GROUP BY ALL")
def r17_pyramid(spark, d):
    """The clubs of each region by the mean of their players, two to a tier."""
    n = A.table(spark, d, "nation").select(C("n_nationkey").cast("long").alias("club"), C("n_regionkey").cast("long").alias("region"))
    m = A.entities(spark, d).groupBy("season", "club").agg((F.sum("ability") / F.count("ability")).alias("m")).where("m is not null").join(n, "club")
    k = F.row_number().over(Window.partitionBy("season", "region").orderBy(F.desc("m"), "club"))
    tiers = m.select("season", "region", "club", "m", (1 + F.floor((k - 1) / 2)).cast("long").alias("tier"))
    who = F.transform(F.array_sort(F.collect_list(F.struct((-C("m")).alias("m"), "club"))), lambda x: x["club"].cast("string"))
    return tiers.groupBy("season", "region", "tier").agg(F.count("*").alias("clubs"), F.array_join(who, ",").alias("who"))


@query("r17_division_over_time", f"SELECT season, league, club, place, lag(place) OVER (PARTITION BY club ORDER BY season) - place AS gained, lag(league) OVER (PARTITION BY club ORDER BY season) AS came_from FROM (SELECT season, league, club, row_number() OVER (PARTITION BY season, league ORDER BY m DESC, club) AS place FROM {_MEANS})")
def r17_over_time(spark, d):
    """A club's place in its division, season by season."""
    m = A.entities(spark, d).groupBy("season", "league", "club").agg((F.sum("ability") / F.count("ability")).alias("m")).where("m is not null")
    p = m.select("season", "league", "club", F.row_number().over(Window.partitionBy("season", "league").orderBy(F.desc("m"), "club")).cast("long").alias("place"))
    w = Window.partitionBy("club").orderBy("season")
    return p.select("season", "league", "club", "place", (F.lag("place").over(w) - C("place")).alias("gained"), F.lag("league").over(w).alias("came_from"))


_NOW = "(SELECT tid, arg_max(dob, phase) AS dob, arg_max(club, phase) AS now FROM ent GROUP BY tid)"


@query("r28_history_export", "SELECT tid, " + ", ".join(f"string_agg(coalesce(CAST(a{k} AS VARCHAR), '-'), ',' ORDER BY phase) AS a{k}" for k in range(8)) + f", count(*) AS n, max(career) AS career FROM attr JOIN {_NOW} c USING (tid, dob) LEFT JOIN (SELECT tid, string_agg(season || ':' || games || '/' || goals, ' ' ORDER BY season) AS career FROM (SELECT season, tid, count(*) AS games, sum(goals) AS goals FROM cur WHERE appeared GROUP BY 1, 2) GROUP BY tid) k USING (tid) WHERE now = {US} GROUP BY tid")
def r28(spark, d):
    """Every attribute of the present squad over the snapshots of the same person, and the career by season."""
    e = A.entities(spark, d)
    now = e.groupBy("tid").agg(F.max_by("dob", "phase").alias("dob"), F.max_by("club", "phase").alias("now")).where(C("now") == US)
    own = A.with_attributes(e).join(now, ["tid", "dob"])
    series = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("phase", F.coalesce(C(c).cast("string"), F.lit("-")).alias("v")))), lambda x: x["v"]), ",").alias(c)
    s = X.current(spark, d).where("appeared").groupBy("season", "tid").agg(F.count("*").alias("games"), F.sum("goals").alias("goals"))
    line = F.concat(C("season"), F.lit(":"), C("games"), F.lit("/"), C("goals"))
    career = s.groupBy("tid").agg(F.array_join(F.array_sort(F.collect_list(line)), " ").alias("career"))
    return own.groupBy("tid").agg(*[series(c) for c in A.ATTRS], F.count("*").alias("n")).join(career, "tid", "left")


def views(spark, d) -> dict:
    """The views of the store, by name."""
    e = A.entities(spark, d)
    w = Window.partitionBy("tid", "dob").orderBy("season", "phase")
    moved = e.select("tid", "dob", "season", "phase", "club", F.lag("club").over(w).alias("came_from")).where("came_from <> club")
    return {
        "attributes": A.with_attributes(e).unpivot(["season", "phase", "tid"], A.ATTRS, "attribute", "value").where("value is not null"),
        "progression": e.where("not is_staff").select("tid", "name", "season", S.phase_key(C("phase")).alias("phase"), "club", "ability"),
        "transfers": moved,
        "league_table": R.table_order(R.wdl(["season", "us"], X.results(spark, d)), ["season"], "us"),
        "results": X.results(spark, d).select("anchor", "date", "us", "them", "gf", "ga", "result"),
    }


@query("r30_views", "SELECT 'attributes' AS view, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (UNPIVOT (SELECT a0, a1, a2, a3, a4, a5, a6, a7 FROM attr) ON a0, a1, a2, a3, a4, a5, a6, a7 INTO NAME attribute VALUE value) UNION ALL SELECT 'progression', count(*), CAST(sum(ability) AS BIGINT) FROM ent WHERE NOT is_staff UNION ALL SELECT 'transfers', count(*), CAST(sum(club * 100 + before) AS BIGINT) FROM (SELECT club, lag(club) OVER (PARTITION BY tid, dob ORDER BY season, phase) AS before FROM ent) WHERE before <> club UNION ALL SELECT 'league_table', count(*), CAST(sum(place * points) AS BIGINT) FROM (SELECT row_number() OVER (PARTITION BY season ORDER BY points DESC, gd DESC, gf DESC, us) AS place, points FROM (SELECT season, us, sum(pts) AS points, sum(gf) AS gf, sum(gf - ga) AS gd FROM res GROUP BY 1, 2)) UNION ALL SELECT 'results', count(*), CAST(sum(gf * 10 + ga) AS BIGINT) FROM res")
def r30_views(spark, d):
    """The views as SQL sees them: rows and a sum of each."""
    sums = {"attributes": "sum(value)", "progression": "sum(ability)", "transfers": "sum(club * 100 + came_from)", "league_table": "sum(place * points)", "results": "sum(gf * 10 + ga)"}
    for name, frame in views(spark, d).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n, {s} AS total FROM {n}" for n, s in sums.items()))


@query("r30_transfers_view", "SELECT tid, CAST(dob AS VARCHAR) AS dob, season, phase, club, came_from FROM (SELECT tid, dob, season, phase, club, lag(club) OVER (PARTITION BY tid, dob ORDER BY season, phase) AS came_from FROM ent) WHERE came_from <> club")
def r30_transfers(spark, d):
    return views(spark, d)["transfers"].withColumn("dob", C("dob").cast("string"))


_TOP = f"(SELECT phase, club, tid, q, pos_index, pctile FROM (SELECT *, row_number() OVER (PARTITION BY phase, club ORDER BY pos_index DESC, tid) AS q FROM ({_SQUAD})) WHERE q <= 4)"
_LINES = f"(SELECT t.phase, t.club, t.q, metric, v FROM {_TOP} t JOIN (UNPIVOT (SELECT phase, tid, " + ", ".join(f"a{k}::DOUBLE AS a{k}" for k in range(8)) + f" FROM attr) ON a0, a1, a2, a3, a4, a5, a6, a7 INTO NAME metric VALUE v) USING (phase, tid) UNION ALL SELECT phase, club, q, 'index', pos_index FROM {_TOP} UNION ALL SELECT phase, club, q, 'standing', pctile FROM {_TOP})"


@query("r31_side_by_side", "SELECT phase, club, metric, " + ", ".join(f"max(v) FILTER (q = {k}) AS p{k}" for k in range(1, 5)) + ", CAST(arg_max(q, (v, -q)) AS BIGINT) AS leader FROM " + _LINES + " GROUP BY phase, club, metric")
def r31(spark, d):
    """The four best of every side at every snapshot beside each other: attributes, index, standing, and who leads."""
    top = R.best_n(squad_frame(spark, d, *A.ATTRS), ["phase", "club"], F.lit(4), [F.desc("pos_index"), "tid"])
    top = top.withColumn("q", F.row_number().over(Window.partitionBy("phase", "club").orderBy(F.desc("pos_index"), "tid")))
    top = checkpoint(top.select("phase", "club", "q", "pos_index", "pctile", *A.ATTRS))  # four rows a side
    lines = top.select("phase", "club", "q", *[C(c).cast("double").alias(c) for c in A.ATTRS]).unpivot(["phase", "club", "q"], A.ATTRS, "metric", "v").where("v is not null")
    own = top.select("phase", "club", "q", F.explode(F.array(F.struct(F.lit("index").alias("metric"), C("pos_index").alias("v")), F.struct(F.lit("standing").alias("metric"), C("pctile").alias("v")))).alias("x")).select("phase", "club", "q", "x.*")
    side = lambda k: F.max(F.when(C("q") == k, C("v"))).alias(f"p{k}")
    return lines.unionByName(own).groupBy("phase", "club", "metric").agg(*[side(k) for k in range(1, 5)], F.max_by("q", F.struct("v", (-C("q")).alias("q"))).cast("long").alias("leader"))
