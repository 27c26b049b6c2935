"""R: records, streaks, comebacks and awards. Each record is an aggregate over a struct that ends with its tie-break; none needs a sort of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapstats.operators import relational as R
from snapstats.operators import sequences as Q
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.session import checkpoint
from snapstats.sources import adapters as A

C = F.col

#: The least appearances of a best rating, of a young player's, the share of the season's matches that they must be at least, and the greatest age of a young player.
REGULAR, YOUNG, REGULAR_SHARE, YOUNG_SHARE, YOUNG_AGE = 5, 3, 0.35, 0.2, 21
#: The least shots of a conversion rate and the least passes of a pass rate.
LEAST_SHOTS, LEAST_PASSES = 10, 20

_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in A.COUNTS)


def best(ok, value, who: str = "tid", *ties: str):
    """The holder of the largest value among rows for which ``ok`` holds; of equals the one with the smallest ties."""
    order = F.struct(value.alias("v"), *[(-C(t)).alias(f"t{i}") for i, t in enumerate(ties or (who,))])
    return F.max_by(F.when(ok, C(who)), F.when(ok, order))


# --- G5: every counting statistic of a season, with rates ---

_RATES = {"pass_rate": ("pass_c", "pass_a"), "tackle_rate": ("tack_w", "tack_a"), "header_rate": ("head_w", "head_a"), "cross_rate": ("cross_c", "cross_a"), "shot_rate": ("on_target", "shots"), "conversion": ("goals", "shots")}
_EACH = ("goals", "assists", "shots", "key_pass", "dribbles", "intercept")


@query("g5_match_stats", f"SELECT *, games - starts AS subs, goals + assists AS involved, tack_w + intercept + head_w AS defended, round(minutes / games, 6) AS minutes_a_game, " + ", ".join(f"round(100.0::DOUBLE * {a} / nullif({b}, 0), 0) AS {n}" for n, (a, b) in _RATES.items()) + ", " + ", ".join(f"round({c} / games, 6) AS {c}_a_game, round(90.0::DOUBLE * {c} / nullif(minutes, 0), 6) AS {c}_a_90" for c in _EACH) + f" FROM (SELECT season, tid, count(*) AS games, count(*) FILTER (started) AS starts, CAST(sum(minutes) AS BIGINT) AS minutes, round(sum(rating) / count(*), 6) AS rating, {_SUMS} FROM cur WHERE appeared GROUP BY 1, 2)")
def g5(spark, d):
    a = X.current(spark, d).where("appeared").groupBy("season", "tid").agg(
        F.count("*").alias("games"), F.count_if("started").alias("starts"), F.sum("minutes").alias("minutes"), F.round(F.sum("rating") / F.count("*"), 6).alias("rating"), *[F.sum(c).alias(c) for c in A.COUNTS]
    )
    rates = [R.safe_ratio(F.lit(100.0) * C(x), C(y), 0).alias(n) for n, (x, y) in _RATES.items()]
    each = [e for c in _EACH for e in (R.safe_ratio(C(c), C("games"), 6).alias(f"{c}_a_game"), R.safe_ratio(F.lit(90.0) * C(c), C("minutes"), 6).alias(f"{c}_a_90"))]
    more = [(C("games") - C("starts")).alias("subs"), (C("goals") + C("assists")).alias("involved"), (C("tack_w") + C("intercept") + C("head_w")).alias("defended"), R.safe_ratio(C("minutes"), C("games"), 6).alias("minutes_a_game")]
    return a.select("*", *more, *rates, *each)


# --- R4: records of players in one match, and of careers ---

_GAME = [*A.COUNTS, "rating", "pass_rate"]
_PASSES = f"CASE WHEN pass_a >= {LEAST_PASSES} THEN CAST(round(100.0::DOUBLE * pass_c / pass_a) AS BIGINT) END AS pass_rate"


@query("r4_player_records", f"SELECT season, record, arg_max(tid, (v, -anchor, -tid)) AS tid, arg_max(anchor, (v, -anchor, -tid)) AS anchor, max(v) AS value FROM (UNPIVOT (SELECT season, anchor, tid, {', '.join(A.COUNTS)}, rating, {_PASSES} FROM cur WHERE appeared) ON {', '.join(_GAME)} INTO NAME record VALUE v) GROUP BY 1, 2")
def r4_players(spark, d):
    """The best single match of a season in every statistic."""
    passes = F.when(C("pass_a") >= LEAST_PASSES, F.round(F.lit(100.0) * C("pass_c") / C("pass_a")).cast("long")).alias("pass_rate")
    rows = X.current(spark, d).where("appeared").select("season", "anchor", "tid", *A.COUNTS, "rating", passes)
    long = rows.unpivot(["season", "anchor", "tid"], _GAME, "record", "v").where("v is not null")
    some = F.lit(True)
    return long.groupBy("season", "record").agg(best(some, C("v"), "tid", "anchor", "tid").alias("tid"), best(some, C("v"), "anchor", "anchor", "tid").alias("anchor"), F.max("v").alias("value"))


_CAREER = ["goals", "assists", "involved", "apps", "minutes", "best_rating", "conversion", "shots", "key_pass", "tack_w", "yellow"]


@query("r4_career_records", f"SELECT record, arg_max(tid, (v, -tid)) AS tid, max(v) AS value FROM (UNPIVOT (SELECT tid, goals, assists, goals + assists AS involved, apps::DOUBLE AS apps, minutes, CASE WHEN apps >= {REGULAR} THEN rating END AS best_rating, CASE WHEN shots >= {LEAST_SHOTS} THEN round(100 * goals / shots, 0) END AS conversion, shots, key_pass, tack_w, yellow FROM (SELECT tid, count(*) AS apps, sum(minutes)::DOUBLE AS minutes, round(sum(rating) / count(*), 6) AS rating, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in ("goals", "assists", "shots", "key_pass", "tack_w", "yellow")) + f" FROM cur WHERE appeared GROUP BY tid)) ON {', '.join(_CAREER)} INTO NAME record VALUE v) GROUP BY record")
def r4_careers(spark, d):
    """Leaders over all seasons."""
    sums = [F.sum(c).cast("double").alias(c) for c in ("goals", "assists", "shots", "key_pass", "tack_w", "yellow", "minutes")]
    t = X.current(spark, d).where("appeared").groupBy("tid").agg(F.count("*").alias("n"), F.round(F.sum("rating") / F.count("*"), 6).alias("rating"), *sums)
    t = t.select("tid", "goals", "assists", (C("goals") + C("assists")).alias("involved"), C("n").cast("double").alias("apps"), "minutes", F.when(C("n") >= REGULAR, C("rating")).alias("best_rating"), F.when(C("shots") >= LEAST_SHOTS, F.round(100 * C("goals") / C("shots"), 0)).alias("conversion"), "shots", "key_pass", "tack_w", "yellow")
    long = t.unpivot(["tid"], _CAREER, "record", "v").where("v is not null")
    return long.groupBy("record").agg(best(F.lit(True), C("v")).alias("tid"), F.max("v").alias("value"))


# --- R5: runs, comebacks, penalties ---


def _run_sql(keys: str, flag: str, order: str, rows: str) -> str:
    return f"SELECT {keys}, count(*) AS length, min(date) AS b, max(date) AS e FROM (SELECT {keys}, date, {flag} AS f, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - row_number() OVER (PARTITION BY {keys}, {flag} ORDER BY {order}) AS g FROM {rows}) WHERE f GROUP BY {keys}, g"


def _longest(keys: str, flag: str, order: str, rows: str) -> str:
    return f"SELECT {keys}, max(length) AS length, CAST(arg_max(b, (length, -epoch(b))) AS VARCHAR) AS b, CAST(arg_max(e, (length, -epoch(b))) AS VARCHAR) AS e FROM ({_run_sql(keys, flag, order, rows)}) GROUP BY {keys}"


def _longest_runs(df, keys, order, flag):
    # runs of a key do not overlap, so of two that begin on one day the earlier one ends first
    at = F.struct("length", (-F.unix_date("begin")).alias("b"), (-F.unix_date("end")).alias("e"))
    return Q.runs(df, keys, order, flag).groupBy(*keys).agg(F.max("length").alias("length"), F.max_by("begin", at).cast("string").alias("b"), F.max_by("end", at).cast("string").alias("e"))


_KINDS = {"wins": "(result = 'W')", "unbeaten": "(result <> 'L')", "winless": "(result <> 'W')", "scoring": "(gf > 0)", "clean": "(ga = 0)"}


@query("r5_streaks", " UNION ALL ".join(f"SELECT us, '{n}' AS kind, length, b, e FROM ({_longest('us', f, 'date, anchor, venue', 'res')})" for n, f in _KINDS.items()))
def r5(spark, d):
    """The longest run of each kind, with its first and last day; all kinds in one pass."""
    r = X.results(spark, d)
    kinds = {"wins": C("result") == "W", "unbeaten": C("result") != "L", "winless": C("result") != "W", "scoring": C("gf") > 0, "clean": C("ga") == 0}
    long = r.select("us", "date", "anchor", "venue", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), f.alias("flag")) for n, f in kinds.items()])).alias("k")).select("us", "date", "anchor", "venue", "k.*")
    return _longest_runs(long, ["us", "kind"], ["date", "anchor", "venue"], "flag")


@query("r5_goal_streaks", _longest("tid", "(goals >= 1)", "date, anchor", "(SELECT * FROM cur WHERE appeared)"))
def r5_goals(spark, d):
    """Each player's longest run of matches with a goal."""
    return _longest_runs(X.current(spark, d).where("appeared").withColumn("f", C("goals") >= 1), ["tid"], ["date", "anchor"], "f")


_PENALTIES = "(SELECT tid, date, event_id, kind FROM sev WHERE kind IN ('purchase', 'error'))"


@query("r5_penalties", " UNION ALL ".join(f"SELECT tid, '{n}' AS kind, length, b, e FROM ({_longest('tid', f, 'date, event_id', _PENALTIES)})" for n, f in (("made", "(kind = 'purchase')"), ("missed", "(kind = 'error')"))))
def r5_penalties(spark, d):
    """The longest runs of penalties made and missed."""
    p = A.score_events(spark, d).where("kind in ('purchase', 'error')").select("tid", "date", "event_id", C("kind").alias("k"))
    two = F.explode(F.array(F.struct(F.lit("made").alias("kind"), (C("k") == "purchase").alias("f")), F.struct(F.lit("missed").alias("kind"), (C("k") == "error").alias("f")))).alias("x")
    return _longest_runs(p.select("tid", "date", "event_id", two).select("tid", "date", "event_id", "x.*"), ["tid", "kind"], ["date", "event_id"], "f")


_SCORE = "(SELECT anchor, tid, CAST(greatest(0, max(s)) AS BIGINT) AS lead, CAST(greatest(0, -min(s)) AS BIGINT) AS deficit, CAST(sum(step) AS BIGINT) AS final FROM (SELECT anchor, tid, step, sum(step) OVER (PARTITION BY anchor ORDER BY seq) AS s FROM (SELECT anchor, tid, seq, CASE WHEN ours <> (kind = 'error') THEN 1 ELSE -1 END AS step FROM sev)) GROUP BY anchor, tid)"
_BACK = {"comeback_win": ("final > 0 AND deficit >= 1", "deficit"), "comeback_draw": ("final = 0 AND deficit >= 1", "deficit"), "lead_lost": ("final <= 0 AND lead >= 1", "lead")}


@query("r5_comebacks", " UNION ALL ".join(f"SELECT tid, '{n}' AS kind, max({v}) AS size, min(anchor) FILTER ({v} = m) AS anchor FROM (SELECT *, max({v}) OVER (PARTITION BY tid) AS m FROM {_SCORE} WHERE {c}) GROUP BY tid" for n, (c, v) in _BACK.items()))
def r5_comebacks(spark, d):
    """The largest deficit that was won or drawn from, and the largest lead that was not won, from the running score."""
    step = F.when(C("ours") != (C("kind") == "error"), 1).otherwise(-1)
    s = Q.running_extremes(A.score_events(spark, d), ["anchor", "tid"], ["seq"], step)
    kinds = {"comeback_win": ((C("final") > 0) & (C("max_deficit") >= 1), "max_deficit"), "comeback_draw": ((C("final") == 0) & (C("max_deficit") >= 1), "max_deficit"), "lead_lost": ((C("final") <= 0) & (C("max_lead") >= 1), "max_lead")}
    each = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(n).alias("kind"), C(v).alias("size"))) for n, (ok, v) in kinds.items()]))
    rows = s.select("tid", "anchor", F.explode(each).alias("x")).select("tid", "anchor", "x.*")
    top = rows.groupBy("tid", "kind").agg(F.max(F.struct("size")).alias("m"))
    return rows.join(top, ["tid", "kind"]).where("size = m.size").groupBy("tid", "kind").agg(F.max("size").alias("size"), F.min("anchor").alias("anchor"))


# --- R6: the awards of a season ---

#: Of each award its SQL condition and value over a season's totals.
_AWARDS = {
    "best": (f"apps >= greatest({REGULAR}, round({REGULAR_SHARE} * games))", "rating"), "young": (f"season - born <= {YOUNG_AGE} AND apps >= greatest({YOUNG}, round({YOUNG_SHARE} * games))", "rating"),
    "scorer": ("goals > 0", "goals"), "provider": ("assists > 0", "assists"), "maestro": ("key_pass > 0", "key_pass"), "crosser": ("cross_c > 0", "cross_c"), "aerial": ("head_w > 0", "head_w"),
    "quick_feet": ("dribbles > 0", "dribbles"), "metronome": ("pass_c > 0", "pass_c"), "wall": ("tack_w + intercept > 0", "tack_w + intercept"), "deadeye": (f"shots >= {LEAST_SHOTS} AND goals > 0", "round(100 * goals / shots, 0)"),
    "iron_man": ("minutes > 0", "minutes"), "super_sub": ("bench > 0", "bench"), "liability": ("mistakes > 0", "mistakes"), "enforcer": ("yellow > 0", "yellow"),
}
_TOTALS = f"(SELECT season, tid, count(*) AS apps, sum(rating) / count(*) AS rating, CAST(sum(minutes) AS BIGINT) AS minutes, {_SUMS}, CAST(sum(CASE WHEN started THEN 0 ELSE goals + assists END) AS BIGINT) AS bench, min(year(dob)) AS born, max(count(*)) OVER (PARTITION BY season) AS games FROM cur LEFT JOIN (SELECT season, phase, tid, dob FROM ent) USING (season, phase, tid) WHERE appeared GROUP BY season, tid)"
_GLOVE = "(SELECT season, arg_max(tid, (n, -tid)) AS glove FROM (SELECT cur.season, tid, count(*) AS n FROM cur JOIN (SELECT anchor, score_home, score_away FROM fix) USING (anchor) WHERE started AND pos_order = 2 AND CASE WHEN is_home THEN score_away ELSE score_home END = 0 GROUP BY 1, 2) GROUP BY season)"
_TOTAL_OF = " + ".join(f"coalesce(a{k}, 0)" for k in range(8))
_IMPROVED = f"(SELECT season, arg_max(tid, (g, -tid)) FILTER (g > 0) AS improved FROM (SELECT season, tid, arg_max({_TOTAL_OF}, phase) - arg_min({_TOTAL_OF}, phase) AS g FROM attr WHERE NOT is_staff GROUP BY 1, 2) GROUP BY season)"
_MATCHES = "(SELECT season, arg_max(tid, (goals, -anchor, -tid)) FILTER (goals >= 1) AS hat_trick, arg_max(tid, (shots, -anchor, -tid)) FILTER (goals = 0 AND shots > 0) AS storm FROM cur WHERE appeared GROUP BY season)"


_R6 = "SELECT * FROM (SELECT season, " + ", ".join(f"arg_max(tid, ({v}, -tid)) FILTER ({c}) AS {n}" for n, (c, v) in _AWARDS.items()) + f" FROM {_TOTALS} GROUP BY season) LEFT JOIN {_GLOVE} USING (season) LEFT JOIN {_IMPROVED} USING (season) LEFT JOIN {_MATCHES} USING (season)"


@query("r6_awards", _R6)
def r6(spark, d):
    """A season's totals once; every award of them is one aggregate of the same pass."""
    cur, ent = checkpoint(X.current(spark, d)), A.entities(spark, d)  # totals, clean sheets and matches all read it
    rows = cur.where("appeared")
    keys = ["season", "phase", "tid"]
    t = rows.join(ent.select(*keys, "dob"), keys, "left").groupBy("season", "tid").agg(
        F.count("*").alias("apps"), (F.sum("rating") / F.count("*")).alias("rating"), F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in A.COUNTS],
        F.sum(F.when(C("started"), 0).otherwise(C("goals") + C("assists"))).alias("bench"), F.min(F.year("dob")).alias("born"),
    )
    t = checkpoint(t)
    games = t.groupBy("season").agg(F.max("apps").alias("games"))
    t = t.join(games, "season")
    regular = C("apps") >= F.greatest(F.lit(REGULAR), F.round(REGULAR_SHARE * C("games")))
    young = (C("season") - C("born") <= YOUNG_AGE) & (C("apps") >= F.greatest(F.lit(YOUNG), F.round(YOUNG_SHARE * C("games"))))
    plain = {"scorer": "goals", "provider": "assists", "maestro": "key_pass", "crosser": "cross_c", "aerial": "head_w", "quick_feet": "dribbles", "metronome": "pass_c", "iron_man": "minutes", "super_sub": "bench", "liability": "mistakes", "enforcer": "yellow"}
    defended, rate = C("tack_w") + C("intercept"), F.round(100 * C("goals") / C("shots"), 0)
    awards = t.groupBy("season").agg(
        best(regular, C("rating")).alias("best"), best(young, C("rating")).alias("young"), *[best(C(c) > 0, C(c)).alias(n) for n, c in plain.items()],
        best(defended > 0, defended).alias("wall"), best((C("shots") >= LEAST_SHOTS) & (C("goals") > 0), F.when(C("shots") > 0, rate)).alias("deadeye"),
    )
    ga = F.when(C("is_home"), C("score_away")).otherwise(C("score_home"))
    clean = cur.where("started and pos_order = 2").join(A.fixtures(spark, d).select("anchor", "score_home", "score_away"), "anchor").where(ga == 0)
    glove = clean.groupBy("season", "tid").agg(F.count("*").alias("n")).groupBy("season").agg(best(F.lit(True), C("n")).alias("glove"))
    total = sum((F.coalesce(C(a), F.lit(0)) for a in A.ATTRS), F.lit(0))
    growth = A.with_attributes(ent.where("not is_staff")).groupBy("season", "tid").agg((F.max_by(total, "phase") - F.min_by(total, "phase")).alias("g"))
    improved = growth.groupBy("season").agg(best(C("g") > 0, C("g")).alias("improved"))
    match = rows.groupBy("season").agg(best(C("goals") >= 1, C("goals"), "tid", "anchor", "tid").alias("hat_trick"), best((C("goals") == 0) & (C("shots") > 0), C("shots"), "tid", "anchor", "tid").alias("storm"))
    return awards.join(glove, "season", "left").join(improved, "season", "left").join(match, "season", "left")


@query("r8_player_honours", f"SELECT award, tid, count(*) AS won, string_agg(season, ' ' ORDER BY season) AS seasons FROM (UNPIVOT ({_R6}) ON COLUMNS(* EXCLUDE season) INTO NAME award VALUE tid) GROUP BY award, tid")
def r8_players(spark, d):
    """R8 over all awards of players: who won what, how often and when."""
    won = r6(spark, d)
    long = won.unpivot(["season"], [c for c in won.columns if c != "season"], "award", "tid").where("tid IS NOT NULL")
    seasons = F.array_join(F.transform(F.array_sort(F.collect_list("season")), lambda x: x.cast("string")), " ")
    return long.groupBy("award", "tid").agg(F.count("*").alias("won"), seasons.alias("seasons"))


@query("r6_sick_note", "SELECT month, arg_max(tid, (days, -tid)) AS tid, max(days) AS days FROM (SELECT strftime(date, '%Y-%m') AS month, tid, count(DISTINCT date) AS days FROM wk WHERE flag & 1 <> 0 GROUP BY 1, 2) GROUP BY month")
def r6_sick(spark, d):
    """Who was out longest in each month."""
    out = A.weekly_status(spark, d).where("flag & 1 <> 0").select(F.date_format("date", "yyyy-MM").alias("month"), "tid", "date").distinct()
    n = out.groupBy("month", "tid").agg(F.count("*").alias("days"))
    return n.groupBy("month").agg(best(F.lit(True), C("days")).alias("tid"), F.max("days").alias("days"))


# --- R7: a side's season ---

_PPG = "round(sum(pts) / count(*), 3)"
_MONTH = "(SELECT season, us, m AS month, p AS month_ppg FROM (SELECT *, row_number() OVER (PARTITION BY season, us ORDER BY s / n DESC, n DESC, m DESC) AS k FROM (SELECT season, us, strftime(date, '%Y-%m') AS m, sum(pts) AS s, count(*) AS n, round(sum(pts) / count(*), 3) AS p FROM res GROUP BY ALL HAVING count(*) >= 2)) WHERE k = 1)"
_CUP = "(SELECT season, us, comp AS cup, n AS cup_games, CASE WHEN last[1] = 'W' THEN 'won it' ELSE 'out ' || last[2] || '-' || last[3] END AS cup_end FROM (SELECT *, row_number() OVER (PARTITION BY season, us ORDER BY n DESC, comp) AS k FROM (SELECT season, us, comp, count(*) AS n, arg_max([result, CAST(gf AS VARCHAR), CAST(ga AS VARCHAR)], (date, anchor)) AS last FROM res WHERE comp IN ('1-URGENT', '2-HIGH') GROUP BY ALL)) WHERE k = 1)"
_SEASON_RUNS = " LEFT JOIN ".join(["", *(f"(SELECT season, us, max(length) AS {n} FROM ({_run_sql('season, us', f, 'date, anchor, venue', 'res')}) GROUP BY ALL) USING (season, us)" for n, f in (("win_run", "(result = 'W')"), ("unbeaten_run", "(result <> 'L')"), ("clean_run", "(ga = 0)")))])


@query("r7_season_record", f"SELECT * REPLACE (coalesce(win_run, 0) AS win_run, coalesce(unbeaten_run, 0) AS unbeaten_run, coalesce(clean_run, 0) AS clean_run) FROM (SELECT season, us, count(*) AS played, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'D') AS drawn, count(*) FILTER (result = 'L') AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(pts) AS BIGINT) AS points, {_PPG} AS ppg, count(*) FILTER (ga = 0) AS clean_sheets, arg_max(anchor, (gf - ga, -anchor)) FILTER (result = 'W') AS biggest_win, arg_max(anchor, (gf + ga, -anchor)) AS most_goals, arg_max(anchor, (crowd, -anchor)) AS biggest_crowd, round(sum(pts) FILTER (venue = 'H') / count(*) FILTER (venue = 'H'), 3) AS home_ppg, round(sum(pts) FILTER (venue = 'A') / count(*) FILTER (venue = 'A'), 3) AS away_ppg FROM res GROUP BY season, us) LEFT JOIN {_MONTH} USING (season, us) LEFT JOIN {_CUP} USING (season, us) {_SEASON_RUNS}")
def r7_season(spark, d):
    """Everything that a side's season is remembered for: totals, best days, best month, cup, runs."""
    r, at = X.results(spark, d), ["season", "us"]
    of = lambda v: R.safe_ratio(F.sum(F.when(C("venue") == v, C("pts"))), F.count_if(C("venue") == v))
    some = F.lit(True)
    more = r.groupBy(*at).agg(
        F.count_if(C("ga") == 0).alias("clean_sheets"), best(C("result") == "W", C("gf") - C("ga"), "anchor").alias("biggest_win"), best(some, C("gf") + C("ga"), "anchor").alias("most_goals"),
        best(some, C("crowd"), "anchor").alias("biggest_crowd"), of("H").alias("home_ppg"), of("A").alias("away_ppg"),
    )
    m = r.groupBy(*at, F.date_format("date", "yyyy-MM").alias("m")).agg(F.sum("pts").alias("s"), F.count("*").alias("n")).where("n >= 2")
    month = m.groupBy(*at).agg(F.max(F.struct((C("s") / C("n")).alias("p"), "n", "m")).alias("x")).select(*at, C("x.m").alias("month"), F.round("x.p", 3).alias("month_ppg"))
    cups = r.where(C("comp").isin("1-URGENT", "2-HIGH")).groupBy(*at, "comp").agg(F.count("*").alias("n"), F.max_by(F.struct("result", "gf", "ga"), F.struct("date", "anchor")).alias("last"))
    cup = R.first_per_key(cups, at, [F.desc("n"), "comp"])
    end = F.when(C("last.result") == "W", "won it").otherwise(F.concat(F.lit("out "), C("last.gf"), F.lit("-"), C("last.ga")))
    cup = cup.select(*at, C("comp").alias("cup"), C("n").alias("cup_games"), end.alias("cup_end"))
    kinds = {"win_run": C("result") == "W", "unbeaten_run": C("result") != "L", "clean_run": C("ga") == 0}
    long = r.select(*at, "date", "anchor", "venue", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), f.alias("flag")) for n, f in kinds.items()])).alias("k")).select(*at, "date", "anchor", "venue", "k.*")
    runs = Q.runs(long, [*at, "kind"], ["date", "anchor", "venue"], "flag").groupBy(*at).agg(*[F.max(F.when(C("kind") == n, C("length"))).alias(n) for n in kinds])
    out = R.wdl(at, r).join(more, at).join(month, at, "left").join(cup, at, "left").join(runs, at, "left")
    return out.fillna(0, list(kinds))
