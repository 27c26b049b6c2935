"""P: scalar rules, each over the rows of a domain frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapstats.functions import scalars as S
from snapstats.plans.catalog import query
from snapstats.session import spread
from snapstats.sources import adapters as A

C = F.col
_ID = ("season", "phase", "tid")
#: Mixed phases: two of seven rows carry a word instead of a date, one nothing readable.
def _phase():
    return F.when(C("ck") % 7 == 0, "start").when(C("ck") % 7 == 1, "end").when(C("ck") % 7 == 2, "late").otherwise(C("phase"))



_PHASE_SQL = "CASE ck % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'late' ELSE phase END"


def _over(name, frame, ids, columns, sql_from, sql):
    """Register ids and one expression."""
    ids_sql = ", ".join(ids)
    body = f"SELECT {ids_sql}, {sql} FROM {sql_from}"

    @query(name, body)
    def run(spark, d):
        return frame(spark, d).select(*ids, *columns())


_over("p1_phase_key", A.entities, _ID, lambda: [S.phase_key(_phase()).alias("k")], "ent", f"CASE {_PHASE_SQL} WHEN 'start' THEN '0000-00-00' WHEN 'mid' THEN '0000-00-01' WHEN 'end' THEN '0000-00-02' ELSE {_PHASE_SQL} END AS k")
_over("p2_ordinal", A.entities, _ID, lambda: [S.ordinal(C("season"), _phase()).alias("o")], "ent", f"lpad(CAST(season AS VARCHAR), 4, '0') || CASE {_PHASE_SQL} WHEN 'start' THEN '0000-00-00' WHEN 'end' THEN '0000-00-02' ELSE {_PHASE_SQL} END AS o")
_over("p3_phase_date", A.entities, _ID, lambda: [S.phase_date(C("season"), _phase()).cast("string").alias("at")], "ent", "CAST(CASE ck % 7 WHEN 0 THEN make_date(season - 1, 7, 1) WHEN 1 THEN make_date(season, 6, 30) WHEN 2 THEN NULL ELSE CAST(phase AS DATE) END AS VARCHAR) AS at")
_over("p4_age_at", A.entities, _ID, lambda: [S.age_at(C("dob"), F.to_date("phase")).alias("age")], "ent", "CAST(datediff('year', dob, CAST(phase AS DATE)) - CASE WHEN (month(CAST(phase AS DATE)), day(CAST(phase AS DATE))) < (month(dob), day(dob)) THEN 1 ELSE 0 END AS BIGINT) AS age")
_over("p5_season_age", A.entities, _ID, lambda: [S.season_age(C("season"), C("dob")).alias("age")], "ent", "CAST(season - year(dob) AS BIGINT) AS age")
_over("p6_age_band", A.entities, _ID, lambda: [S.age_band(F.when(C("ck") % 9 != 0, S.season_age(C("season"), C("dob")))).alias("band")], "ent", "CASE WHEN ck % 9 = 0 THEN '?' WHEN season - year(dob) < 21 THEN 'U21' WHEN season - year(dob) <= 24 THEN '21-24' WHEN season - year(dob) <= 28 THEN '25-28' ELSE '29+' END AS band")
_over("p7_label", A.entities, _ID, lambda: [S.label(F.when(C("ck") % 5 == 0, "").when(C("ck") % 5 != 1, C("name")), C("tid")).alias("label")], "ent", "CASE WHEN ck % 5 IN (0, 1) THEN '#' || tid ELSE name END AS label")
_over("p8_surname_key", lambda s, d: A.table(s, d, "documents"), ("doc_id",), lambda: [F.md5(S.surname_key(C("text"))).alias("k")], r"(SELECT doc_id, regexp_replace(text, '^ +| +$', '', 'g') AS t, string_split_regex(lower(regexp_replace(text, '^ +| +$', '', 'g')), '\s+') AS w FROM documents)", "md5(CASE WHEN t = '' THEN chr(1114111) ELSE w[-1] || '|' || array_to_string(w[:-2], ' ') END) AS k")
_over("p9_status", A.entities, _ID, lambda: [S.status(C("ck") % 6 == 0, C("ck") % 4 == 0).alias("status")], "ent", "CASE WHEN ck % 6 = 0 THEN 'loan' WHEN ck % 4 = 0 THEN 'reserve' ELSE 'first' END AS status")
_over("p10_familiarity", lambda s, d: A.positions(A.entities(s, d)).withColumn("f", C("familiarity") * 2 - 10), (*_ID, "position"), lambda: [S.familiarity_multiplier(C("f")).alias("linear"), S.familiarity_multiplier(C("f"), "tiers").alias("tiers"), S.familiarity_multiplier(C("f"), "proportional").alias("proportional")], "(SELECT *, greatest(1, least(20, familiarity * 2 - 10))::DOUBLE AS f FROM pos)", "0.5::DOUBLE + 0.5::DOUBLE * (f / 20) AS linear, (CASE WHEN f >= 18 THEN 1.0 WHEN f >= 15 THEN 0.95 WHEN f >= 10 THEN 0.85 WHEN f >= 5 THEN 0.7 ELSE 0.5 END)::DOUBLE AS tiers, f / 20 AS proportional")
_over("p12_person_id", A.entities, _ID, lambda: [S.person_id(C("tid"), F.when(C("ck") % 8 != 0, C("dob"))).alias("person")], "ent", "tid || '-' || CASE WHEN ck % 8 = 0 THEN '?' ELSE CAST(dob AS VARCHAR) END AS person")
_over("p13_participation", A.appearances, ("anchor", "tid"), lambda: [S.started(C("pos_order")).alias("started"), S.appeared(C("pos_order"), C("sub_on")).alias("appeared"), S.minutes(C("pos_order"), C("sub_on"), C("sub_off")).alias("minutes")], "part", "started, appeared, minutes")


def _fee():
    return F.when(C("o_orderkey") % 5 == 0, 65535).when(C("o_orderkey") % 5 == 1, 65534).when(C("o_orderkey") % 5 == 2, 65533).when(C("o_orderkey") % 5 == 3, 0)


_over("p14_fee_and_season", lambda s, d: A.table(s, d, "orders"), ("o_orderkey",), lambda: [S.fee(_fee(), C("o_orderkey")).alias("fee"), S.season_from_code(C("o_orderkey") % 60).alias("season")], "orders", "CASE o_orderkey % 5 WHEN 0 THEN 'stay' WHEN 1 THEN 'loan' WHEN 2 THEN 'free' WHEN 3 THEN 'free' ELSE CAST(o_orderkey AS VARCHAR) END AS fee, 1971 + o_orderkey % 60 AS season")


def _order_days(s, d):
    """The distinct durations of an order: lines by order once, for the join and for what is distinct."""
    li = spread(A.table(s, d, "lineitem"), "l_orderkey").select("l_orderkey", F.to_date("l_shipdate").alias("to"))
    o = A.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("from"))
    return li.join(o, C("l_orderkey") == C("o_orderkey")).select("l_orderkey", S.inclusive_days(C("from"), C("to")).alias("days")).distinct()


_over("p16_fold", lambda s, d: A.table(s, d, "documents"), ("doc_id",), lambda: [F.md5(S.fold(C("text"))).alias("folded")], "documents", "md5(strip_accents(replace(lower(translate(text, 'ıİI', 'iii')), 'ß', 'ss'))) AS folded")
_over("p18_friendly", lambda s, d: A.fixtures(s, d), ("anchor",), lambda: [S.is_friendly(F.when(C("anchor") % 4 == 0, F.lit("A Friendly Cup")).otherwise(C("comp"))).alias("friendly")], "fix", "coalesce(contains(lower(CASE WHEN anchor % 4 = 0 THEN 'A Friendly Cup' ELSE comp END), 'friend'), false) AS friendly")
_over("p19_storage_key", A.fixtures, ("anchor",), lambda: [S.storage_key(C("home"), C("comp")).alias("k")], "fix", "concat_ws('-', CAST(home AS VARCHAR), regexp_replace(comp, '[^A-Za-z0-9_.-]', '_', 'g')) AS k")
_over("p20_foot", A.entities, _ID, lambda: [S.foot(C("ck") % 20 + 1, C("ck") * 3 % 20 + 1).alias("foot")], "(SELECT *, ck % 20 + 1 AS l, ck * 3 % 20 + 1 AS r FROM ent)", "CASE WHEN least(l, r) >= 16 AND greatest(l, r) - least(l, r) <= 3 THEN 'Either' ELSE CASE WHEN l > r THEN 'Left' ELSE 'Right' END || CASE WHEN l <> r AND least(l, r) <= 7 THEN ' only' ELSE '' END END AS foot")
_over("p22_day_of_year", lambda s, d: A.table(s, d, "orders"), ("o_orderkey",), lambda: [S.day_of_year(F.year("o_orderdate"), C("o_orderkey") % 366).cast("string").alias("at")], "orders", "CAST(CAST(make_date(year(o_orderdate), 1, 1) + CAST(o_orderkey % 366 AS INTEGER) AS DATE) AS VARCHAR) AS at")
_over("p23_durations", _order_days, ("l_orderkey", "days"), lambda: [S.months_long(C("days")).alias("months")], "(SELECT DISTINCT l_orderkey, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) + 1 AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "CAST(greatest(1, round(days / 30.0)) AS BIGINT) AS months")
_over("p26_formation_lines", lambda s, d: A.fixtures(s, d).select("anchor", "formation", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(11).cast("long"))).alias("slot")), ("anchor", "slot"), lambda: [F.array_join(S.lines_of(C("formation")).cast("array<string>"), ",").alias("sizes"), S.line_of_slot(C("formation"), C("slot")).alias("line")], "(SELECT anchor, formation, slot, string_split(formation, '-') AS p FROM fix, range(1, 12) r(slot))", "array_to_string(p, ',') AS sizes, CAST(CASE WHEN slot = 1 THEN -1 WHEN slot <= 1 + p[1]::INT THEN 0 WHEN slot <= 1 + p[1]::INT + p[2]::INT THEN 1 WHEN slot <= 1 + p[1]::INT + p[2]::INT + p[3]::INT THEN 2 END AS BIGINT) AS line")
_over("l7_safe_casts", lambda s, d: A.table(s, d, "orders").withColumn("t", F.when(C("o_orderkey") % 3 == 0, C("o_orderkey").cast("string")).when(C("o_orderkey") % 3 == 1, F.concat(C("o_orderkey").cast("string"), F.lit(".5"))).otherwise(F.to_date("o_orderdate").cast("string"))), ("o_orderkey",), lambda: [S.safe_long(C("t")).alias("n"), S.safe_date(C("t")).cast("string").alias("at")], "orders", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS n, CASE WHEN o_orderkey % 3 = 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS at")
_over("l21_clean_numbers", lambda s, d: A.table(s, d, "orders"), ("o_orderkey",), lambda: [S.clean_number(F.when(C("o_orderkey") % 4 == 0, float("nan")).when(C("o_orderkey") % 4 == 1, float("inf")).otherwise(C("o_totalprice"))).alias("x")], "orders", "CASE WHEN o_orderkey % 4 IN (2, 3) THEN o_totalprice END AS x")


@query("p11_code_maps", "SELECT season, phase, tid, position, 'r' || (CAST(substr(position, 2) AS BIGINT) % 4) AS role, 'u' || (CAST(substr(position, 2) AS BIGINT) % 4) AS unit FROM pos")
def p11(spark, d):
    codes = spark.createDataFrame([(f"P{i}", f"r{i % 4}", f"u{i % 4}") for i in range(A.POSITIONS)], "position string, role string, unit string")
    return A.positions(A.entities(spark, d)).join(codes, "position").select(*_ID, "position", "role", "unit")


@query("p15_our_side", "SELECT anchor, us, them, gf, ga, venue, result, pts FROM res WHERE us = 7")
def p15(spark, d):
    f, us = A.fixtures(spark, d).where("home = 7 or away = 7"), C("home") == 7
    own = f.select("anchor", F.lit(7).cast("long").alias("us"), F.when(us, C("away")).otherwise(C("home")).alias("them"), F.when(us, C("score_home")).otherwise(C("score_away")).alias("gf"), F.when(us, C("score_away")).otherwise(C("score_home")).alias("ga"), F.when(us, "H").otherwise("A").alias("venue"))
    return own.select("*", S.result(C("gf"), C("ga")).alias("result"), S.points(C("gf"), C("ga")).alias("pts"))


@query("p17_contains_search", "SELECT tid, name, season FROM (SELECT DISTINCT tid, name, season FROM ent) WHERE contains(lower(name), '0000012') ORDER BY name, season LIMIT 50")
def p17(spark, d):
    found = A.entities(spark, d).select("tid", "name", "season").distinct().where(S.contains_folded(C("name"), "0000012"))
    return found.orderBy("name", "season").limit(50)


@query("p21_parse_ratings", "SELECT season, phase, tid, max(familiarity) FILTER (position = 'P1') AS p1, max(familiarity) FILTER (position = 'P2') AS p2, count(*) AS n FROM pos GROUP BY ALL")
def p21(spark, d):
    text = F.array_join(F.collect_list(F.concat_ws(" ", F.translate("position", "P0123456789", "Pabcdefghij"), "familiarity")), ", ")
    packed = A.positions(A.entities(spark, d)).groupBy(*_ID).agg(text.alias("t"))
    found = S.parse_ratings(C("t"))
    return packed.select(*_ID, found["Pb"].alias("p1"), found["Pc"].alias("p2"), F.size(found).cast("long").alias("n"))


@query("p24_distinct_from", "SELECT anchor, comp FROM fix WHERE comp IS DISTINCT FROM '1-URGENT'")
def p24(spark, d):
    return A.fixtures(spark, d).where(~C("comp").eqNullSafe("1-URGENT")).select("anchor", "comp")


#: Column presets: identity, attributes, totals.
PRESETS = {"identity": ["season", "phase", "tid", "name"], "values": A.ATTRS, "place": ["club", "league"]}


def preset(df, *names):
    """Columns of the named presets, in order, each once, those that exist."""
    columns = dict.fromkeys(c for n in names for c in PRESETS[n] if c in df.columns)
    return df.select(*columns)


@query("p25_column_presets", "SELECT season, phase, tid, name, club, league, a0, a1, a2, a3, a4, a5, a6, a7 FROM attr")
def p25(spark, d):
    return preset(A.with_attributes(A.entities(spark, d)), "identity", "place", "values")
