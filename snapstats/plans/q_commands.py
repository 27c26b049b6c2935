"""The fixed commands as table functions of SQL, called with literals, parameter markers, or the columns of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstats.operators import relational as R
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.sources import adapters as A

C = F.col

#: name, parameters, result, body. A parameter that may be left out is null by default and then filters nothing.
COMMANDS = {
    "labels": ("", "season BIGINT, phase STRING, entities BIGINT", "SELECT season, phase, count(*) FROM cmd_entities GROUP BY season, phase"),
    "progression": ("who BIGINT", "name STRING, season BIGINT, phase STRING, club BIGINT, ability BIGINT", "SELECT name, season, phase, club, ability FROM cmd_entities WHERE tid = who"),
    "transfers": (
        "of_season BIGINT, of_phase STRING, to_season BIGINT, to_phase STRING",
        "tid BIGINT, name STRING, from_club BIGINT, to_club BIGINT",
        """SELECT a.tid, b.name, a.club, b.club FROM cmd_entities a JOIN cmd_entities b ON a.tid = b.tid AND a.dob = b.dob
           WHERE a.season = of_season AND a.phase = of_phase AND b.season = to_season AND b.phase = to_phase AND a.club <> b.club""",
    ),
    "top_scorers": (
        "of_season BIGINT, of_comp STRING DEFAULT NULL",
        "tid BIGINT, goals BIGINT, assists BIGINT, apps BIGINT",
        "SELECT tid, goals, assists, apps FROM cmd_scorers WHERE season = of_season AND comp <=> of_comp",
    ),
    "matches": (
        "of_season BIGINT, of_phase STRING, of_comp STRING DEFAULT NULL",
        "anchor BIGINT, date DATE, home BIGINT, score_home BIGINT, score_away BIGINT, away BIGINT, comp STRING",
        """SELECT anchor, date, home, score_home, score_away, away, comp FROM cmd_fixtures WHERE season = of_season AND phase = of_phase AND comp = of_comp
           UNION ALL SELECT anchor, date, home, score_home, score_away, away, comp FROM cmd_fixtures WHERE season = of_season AND phase = of_phase AND of_comp IS NULL""",
    ),
    "league_table": (
        "of_season BIGINT",
        "place BIGINT, club BIGINT, points BIGINT, gf BIGINT, ga BIGINT",
        "SELECT place, us, points, gf, ga FROM cmd_tables WHERE season = of_season",
    ),
}


def commands(spark: SparkSession, d: str) -> None:
    """Create the commands over the tables of ``d`` as temporary functions, and the views that they read.

    A function is a macro of SQL: a call is planned with the query around it, so a literal argument is a filter
    that reaches the scan, and arguments from a table are an equi-join. So that they are, a body compares a parameter with
    a column and nothing else: what a null parameter means is a branch of its own, or rows of a view.
    """
    played = X.participation(spark, d).where("appeared")
    sums = [F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), F.count("*").alias("apps")]
    all_ = played.groupBy("season", "tid").agg(*sums).withColumn("comp", F.lit(None).cast("string"))
    scorers = all_.unionByName(played.where("comp IS NOT NULL").groupBy("season", "comp", "tid").agg(*sums))
    tables = R.table_order(R.wdl(["season", "us"], X.results(spark, d)), ["season"], "us")
    views = {"cmd_entities": A.entities(spark, d), "cmd_scorers": scorers, "cmd_fixtures": A.fixtures(spark, d), "cmd_tables": tables}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    for name, (given, result, body) in COMMANDS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({result}) RETURN {body}")


def command(spark: SparkSession, d: str, name: str, *args, order: str | None = None, limit: int | None = None) -> DataFrame:
    """One command with its arguments, as parameters of the statement and never as text within it."""
    if name not in COMMANDS:
        raise ValueError(f"no such command: {name}; there are {', '.join(COMMANDS)}")
    commands(spark, d)
    kinds = [p.split()[1] for p in COMMANDS[name][0].split(", ") if p]
    if len(args) > len(kinds):
        raise ValueError(f"{name} takes {len(kinds)} arguments")
    out = spark.sql(f"SELECT * FROM {name}({', '.join(f'CAST(? AS {k})' for k in kinds[: len(args)])})", args=list(args))
    out = out.orderBy(*[F.expr(o) if " " not in o else _ordered(o) for o in order.split(", ")]) if order else out
    return out.limit(limit) if limit is not None else out


def _ordered(text: str):
    column, way = text.rsplit(" ", 1)
    return F.desc_nulls_last(column) if way.lower() == "desc" else F.asc_nulls_first(column)


def listing(spark: SparkSession) -> DataFrame:
    """What commands there are, with parameters and results."""
    return spark.createDataFrame([(n, g, r) for n, (g, r, _) in COMMANDS.items()], "command string, parameters string, result string")


def _all(spark, d, sql: str) -> DataFrame:
    commands(spark, d)
    return spark.sql(sql)


_SLICES = "(SELECT DISTINCT season, phase FROM cmd_entities)"


@query("r25_labels", "SELECT season, phase, count(*) AS entities FROM ent GROUP BY ALL")
def r25_labels(spark, d):
    return command(spark, d, "labels")


@query("r25_progression", "SELECT tid AS who, name, season, phase, club, ability FROM ent")
def r25_progression(spark, d):
    """Every entity's, by arguments from a table."""
    return _all(spark, d, "SELECT w.tid AS who, p.* FROM (SELECT DISTINCT tid FROM cmd_entities) w, LATERAL progression(w.tid) p").select("who", "name", "season", "phase", "club", "ability")


@query("r25_transfers", "SELECT a.season, a.phase, tid, b.name, a.club AS from_club, b.club AS to_club FROM (SELECT season, phase, lead(season) OVER w AS s2, lead(phase) OVER w AS p2 FROM slices WINDOW w AS (ORDER BY season, phase)) s JOIN ent a ON a.season = s.season AND a.phase = s.phase JOIN ent b USING (tid) WHERE b.season = s2 AND b.phase = p2 AND a.dob = b.dob AND a.club <> b.club")
def r25_transfers(spark, d):
    """From each snapshot to the next."""
    steps = f"(SELECT *, lead(season) OVER (ORDER BY season, phase) AS s2, lead(phase) OVER (ORDER BY season, phase) AS p2 FROM {_SLICES})"
    return _all(spark, d, f"SELECT s.season, s.phase, t.* FROM {steps} s, LATERAL transfers(s.season, s.phase, s.s2, s.p2) t")


@query("r25_top_scorers", "SELECT season, comp, tid, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, count(*) AS apps FROM part WHERE appeared GROUP BY GROUPING SETS ((season, tid), (season, comp, tid))")
def r25_top_scorers(spark, d):
    """Of each season, and of each season's competitions."""
    return _all(spark, d, "SELECT s.season, s.comp, t.* FROM (SELECT DISTINCT season, comp FROM cmd_scorers) s, LATERAL top_scorers(s.season, s.comp) t")


@query("r25_matches", "SELECT season, phase, comp AS asked, anchor, CAST(date AS VARCHAR) AS date, home, score_home, score_away, away, comp FROM fix WHERE comp IS NOT NULL")
def r25_matches(spark, d):
    """Of every slice and competition."""
    by = "(SELECT DISTINCT season, phase, comp AS asked FROM cmd_fixtures WHERE comp IS NOT NULL)"
    return _all(spark, d, f"SELECT s.*, m.* FROM {by} s, LATERAL matches(s.season, s.phase, s.asked) m").withColumn("date", C("date").cast("string"))


@query("r25_league_table", "SELECT season, row_number() OVER (PARTITION BY season ORDER BY points DESC, gf - ga DESC, gf DESC, us) AS place, us AS club, points, gf, ga FROM (SELECT season, us, CAST(sum(pts) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga FROM res GROUP BY ALL)")
def r25_league_table(spark, d):
    return _all(spark, d, "SELECT s.season, t.* FROM (SELECT DISTINCT season FROM cmd_entities) s, LATERAL league_table(s.season) t")
