"""L: sources, loads and sinks. What a query writes goes to a new folder in the shared place and is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapstats.operators import loads as L
from snapstats.operators import relational as R
from snapstats.operators import scoring
from snapstats.operators.entries import EntryLog
from snapstats.operators.generations import read_generations
from snapstats.plans import frames as X
from snapstats.plans.catalog import query
from snapstats.session import shared_dir
from snapstats.sources import adapters as A
from snapstats.sources.bundle import scan_bundle

C = F.col


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("l1_bundle_loader", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def l1(spark, d):
    n = A.table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("k"), F.struct(C("n_name").alias("name"), C("n_regionkey").cast("long").alias("region")).alias("v"))
    path = _folder(spark)
    n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("clubs"))).alias("value")).write.text(path)
    return L.read_bundle(spark, path, "clubs", "name string, region long")


_SECTIONS = {
    "clubs": ("nation", "n_nationkey", "n_name", "n_regionkey"), "leagues": ("region", "r_regionkey", "r_name", "r_regionkey"), "players": ("customer", "c_custkey", "c_name", "c_nationkey"),
    "staff": ("supplier", "s_suppkey", "s_name", "s_nationkey"), "competitions": ("orders", "o_orderkey", "o_orderpriority", "o_custkey"),
}


@query("l1_bundle_sections", " UNION ALL ".join(f"SELECT '{s}' AS section, CAST({k} AS VARCHAR) AS key, {n} AS name, CAST({v} AS BIGINT) AS number, CASE WHEN {k} % 3 = 0 THEN {n} END AS tag FROM {t}" for s, (t, k, n, v) in _SECTIONS.items()))
def l1_sections(spark, d):
    """Five bundles of five sections each, written as lines of JSON, read in one pass by as many tasks as there are blocks.

    A bundle's file is written by a task in order, so neither writer nor reader holds one.
    """
    rows = None
    for i, (section, (t, k, n, v)) in enumerate(_SECTIONS.items()):
        more = F.when(C(k) % 3 == 0, F.struct(C(n).alias("tag")))
        entry = F.concat(F.lit('"'), C(k).cast("string"), F.lit('":'), F.to_json(F.struct(C(n).alias("name"), C(v).cast("long").alias("number"), more.alias("more"))))
        own = A.table(spark, d, t).select((C(k) % 5).alias("bundle"), F.lit(3 * i + 1).alias("part"), F.concat(entry, F.lit(",")).alias("value"))
        # an entry at the end of each section that has no name is left out when it is read
        for part, text in ((3 * i, f'"{section}":{{'), (3 * i + 2, '"":null}' + ("," if i < 4 else "}"))):
            mark = F.lit(("{" if part == 0 else "") + text)
            own = own.unionByName(spark.range(5).select(C("id").alias("bundle"), F.lit(part).alias("part"), mark.alias("value")))
        rows = own if rows is None else rows.unionByName(own)
    path = _folder(spark)
    rows.repartition("bundle").sortWithinPartitions("bundle", "part", "value").drop("part").write.partitionBy("bundle").text(path)
    got = scan_bundle(spark, path).where("key <> ''")
    body = F.from_json("body", "struct<name: string, number: long, more: struct<tag: string>>").alias("b")
    return got.select("section", "key", body).select("section", "key", "b.name", "b.number", "b.more.tag")


@query("l2_nested_explode", "SELECT anchor, is_home AS ours, l_tid AS tid, seq, goals FROM (SELECT anchor, is_home, tid AS l_tid, goals, row_number() OVER (PARTITION BY anchor, is_home ORDER BY pos_order, tid) - 1 AS seq FROM app)")
def l2(spark, d):
    a = A.appearances(spark, d)
    row = F.struct("pos_order", "tid", "goals")
    nested = a.groupBy("anchor").agg(*[F.array_sort(F.collect_list(F.when(C("is_home") == v, row))).alias(n) for n, v in (("home", True), ("away", False))])
    both = nested.select("anchor", F.explode(F.array(*[F.struct(F.lit(n == "home").alias("ours"), C(n).alias("rows")) for n in ("home", "away")])).alias("s"))
    return both.select("anchor", "s.ours", F.posexplode("s.rows").alias("seq", "r")).select("anchor", "ours", "r.tid", C("seq").cast("long").alias("seq"), "r.goals")


@query("l3_first_per_key", "SELECT anchor, tid, pos_order FROM app UNION ALL SELECT o_orderkey, -1, NULL FROM orders WHERE o_orderkey NOT IN (SELECT anchor FROM app)")
def l3(spark, d):
    """First row of each key; a second pass adds what the first has not seen."""
    a = A.appearances(spark, d).select("anchor", "tid", "pos_order")
    rest = A.table(spark, d, "orders").select(C("o_orderkey").alias("anchor")).join(a, "anchor", "left_anti")
    return a.unionByName(rest.select("anchor", F.lit(-1).cast("long").alias("tid"), F.lit(None).cast("long").alias("pos_order")))


@query("l4_occurrence_number", "SELECT anchor, row_number() OVER (PARTITION BY season, home, away ORDER BY date, anchor) - 1 AS n FROM fix")
def l4(spark, d):
    return A.fixtures(spark, d).select("anchor", R.occurrence(["season", "home", "away"], ["date", "anchor"]).alias("n"))


@query("l5_key_from_file_name", "SELECT CAST(league AS VARCHAR) AS key, club, count(*) AS n FROM ent GROUP BY ALL")
def l5(spark, d):
    """CSV files by league. Spark's writer puts the league in the folder's name, so the key is taken from there."""
    n = A.entities(spark, d).groupBy("league", "club").agg(F.count("*").alias("n"))
    path = _folder(spark)
    n.repartition("league").write.partitionBy("league").option("header", "true").csv(path)
    return L.read_keyed_files(spark, path, "club long, n long", "league=([^/]+)/").select("key", "club", "n")


@query("l6_commented_seed", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def l6(spark, d):
    n = A.table(spark, d, "nation").select(F.concat_ws(",", C("n_nationkey").cast("string"), "n_name").alias("value"))
    lines = n.union(n.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.lit("  "))).alias("value")).distinct())
    path = _folder(spark)
    lines.write.text(path)
    return L.read_commented(spark, path, "id int, name string", header=False)


@query("l8_slice_replace", "SELECT season, phase, league, count(*) AS n, CAST(sum(CASE WHEN season = 1999 THEN tid + 1000 ELSE tid END) AS BIGINT) AS ids FROM ent GROUP BY ALL")
def l8(spark, d):
    """The state after two loads: all slices, then 1999 again with other ids; nothing else moves."""
    e, path = A.entities(spark, d).select("season", "phase", "league", "tid"), _folder(spark)
    L.replace_slices(e, path, ["season", "phase"])
    L.replace_slices(e.where("season = 1999").withColumn("tid", C("tid") + 1000), path, ["season", "phase"])
    out = spark.read.schema("league long, tid long, season long, phase string").parquet(path)
    return out.groupBy("season", "phase", "league").agg(F.count("*").alias("n"), F.sum("tid").alias("ids"))


@query("l9_archive", "SELECT 'season-' || season AS label, count(*) AS n, count(a0) AS with_a0 FROM attr WHERE season < (SELECT max(season) FROM ent) GROUP BY season")
def l9(spark, d):
    """Every season that a newer one supersedes; the first of them is archived twice."""
    e = A.entities(spark, d)
    old = e.crossJoin(F.broadcast(e.agg(F.min("season").alias("oldest"), F.max("season").alias("newest")))).where("season < newest")
    values = A.with_attributes(e).select("season", "phase", "tid", "a0")
    path, keys = _folder(spark), ["season", "phase", "tid"]
    for rows in (old, old.where("season = oldest")):
        L.archive(rows.select(*keys, "name"), values, keys, F.concat(F.lit("season-"), C("season")), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.count("a0").alias("with_a0"))


@query("l10_slice_key", "SELECT us, CAST(CASE WHEN month(m) >= 8 THEN year(m) + 1 ELSE year(m) END AS BIGINT) AS season, CAST(m AS VARCHAR) AS phase FROM (SELECT us, max(date) AS m FROM res GROUP BY us)")
def l10(spark, d):
    return L.slice_key(X.results(spark, d), "date", ["us"])


@query("l11_label_discovery", "SELECT DISTINCT 'league-' || league AS label FROM ent WHERE league <> 3")
def l11(spark, d):
    path = _folder(spark)
    e = A.entities(spark, d).where("league <> 3").select(F.concat(F.lit("league-"), C("league")).alias("label"), F.lit("{}").alias("value")).distinct()
    e.write.partitionBy("label").text(path)
    return L.labels(spark, path, "*.txt", "label=([^/]+)/")


@query("l12_reconcile", "SELECT season, coalesce(n, 0) AS loaded, coalesce(e, 0) AS expected FROM (SELECT season, count(*) AS n FROM ent GROUP BY 1) FULL JOIN (SELECT CAST(year(o_orderdate) AS BIGINT) AS season, count(*) AS e FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (season) WHERE coalesce(n, 0) <> coalesce(e, 0)")
def l12(spark, d):
    o = A.table(spark, d, "orders").where("o_orderstatus = 'P'")
    return L.reconcile(A.entities(spark, d), o.groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("expected")), ["season"])


@query("l13_slice_collisions", "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS phase, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS labels, count(DISTINCT o_orderstatus) AS n, max(o_orderstatus) AS kept FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def l13(spark, d):
    """Labels that load into the same slice; the last one wins."""
    o = A.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("season"), F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd").alias("phase"), C("o_orderstatus").alias("label")).distinct()
    s = o.groupBy("season", "phase").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"), F.count("*").alias("n"), F.max("label").alias("kept"))
    return s.where("n > 1")


@query("l14_manifest_merge", "SELECT o_custkey, o_orderkey, 'old' AS src FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'")
def l14(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old, new = (o.where(C("o_orderstatus") == s).select("o_custkey", "o_orderkey", F.lit(n).alias("src")) for s, n in (("F", "old"), ("P", "new")))
    return R.upsert(old, new, ["o_custkey"])


@query("l15_fallback_names", "SELECT season, phase, tid, coalesce(CASE WHEN ck % 3 <> 0 THEN name END, n_name) AS name FROM ent LEFT JOIN nation ON n_nationkey = club")
def l15(spark, d):
    n = A.table(spark, d, "nation").select(C("n_nationkey").cast("long").alias("club"), C("n_name").alias("name"))
    e = A.entities(spark, d).withColumn("name", F.when(C("ck") % 3 != 0, C("name")))
    return R.fallback_names(e, n, "club", "name").select("season", "phase", "tid", "name")


@query("l15_child_names", "SELECT anchor, app.tid, e.name FROM app LEFT JOIN (SELECT season, phase, tid, coalesce(CASE WHEN ck % 3 <> 0 THEN name END, n_name) AS name FROM ent LEFT JOIN nation ON n_nationkey = club) e USING (season, phase, tid)")
def l15_children(spark, d):
    """The names, filled in where they were missing, on every row that belongs to the entity."""
    names = l15(spark, d)
    return A.appearances(spark, d).select("anchor", "season", "phase", "tid").join(names, ["season", "phase", "tid"], "left").select("anchor", "tid", "name")


@query("l16_keyed_reseed", "SELECT o_orderstatus AS method, o_orderkey AS k, 'old' AS src FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderstatus <> 'O' UNION ALL SELECT 'O', o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 UNION ALL SELECT 'P', o_orderkey, 'default' FROM orders WHERE o_orderstatus = 'P'")
def l16(spark, d):
    """Named methods are replaced whole; defaults only fill in methods that are absent."""
    o = A.table(spark, d, "orders").select(C("o_orderstatus").alias("method"), C("o_orderkey").alias("k"))
    old = o.where("method in ('F', 'O')").withColumn("src", F.lit("old"))
    new = o.where("method = 'O' and k % 2 = 0").withColumn("src", F.lit("new"))
    return R.reseed(old, new, o.withColumn("src", F.lit("default")), "method", ["k"])


@query("l17_clone_weights", "SELECT season, phase, tid, 'm0-copy' AS method, role, CAST(sum(value * coalesce(weight, 1)) AS BIGINT) AS rating FROM (SELECT * FROM (UNPIVOT (SELECT season, phase, tid, a0, a1, a2, a3, a4, a5, a6, a7 FROM attr) ON a0, a1, a2, a3, a4, a5, a6, a7 INTO NAME attribute VALUE value), (SELECT DISTINCT role FROM wgt WHERE method = 'm0' AND weight > 2)) v LEFT JOIN (SELECT role, attribute, weight FROM wgt WHERE method = 'm0' AND weight > 2) w USING (role, attribute) GROUP BY ALL")
def l17(spark, d):
    """A weight-set under another name, by way of the matrix form; only what differs from the default is kept. All entities are scored with it."""
    w = A.weights(spark).where("method = 'm0'").withColumn("method", F.concat("method", F.lit("-copy")))
    wide = w.groupBy("method", "role").pivot("attribute", A.ATTRS).agg(F.first("weight"))
    long = wide.unpivot(["method", "role"], A.ATTRS, "attribute", "weight").where("weight > 2")
    return scoring.weighted_scores(A.with_attributes(A.entities(spark, d)), long, A.ATTRS).select("season", "phase", "tid", "method", "role", "rating")


@query("l18_schema_evolution", "SELECT season, phase, tid, name, CASE WHEN season >= 1998 THEN club END AS club, CAST(NULL AS BIGINT) AS squad FROM ent")
def l18(spark, d):
    e = A.entities(spark, d)
    old = e.where("season < 1998").select("season", "phase", "tid", "name")
    new = e.where("season >= 1998").select("season", "phase", "tid", "name", "club", "league")
    return L.evolve(old, new, {"season": "long", "phase": "string", "tid": "long", "name": "string", "club": "long", "squad": "long"})


@query("l18_generations", "SELECT season, phase, tid, name, CASE WHEN season < 1997 THEN CAST(ability AS DOUBLE) ELSE ability / 2.0 END AS ability, CASE WHEN season < 1999 THEN club END AS club, CASE WHEN season >= 1997 THEN CAST(league AS VARCHAR) END AS league, CASE WHEN season >= 1999 THEN ck % 7 END AS squad_no, CASE WHEN season >= 1997 THEN tid % 3 END AS tier FROM ent")
def l18_generations(spark, d):
    """Three generations of files: short numbers; a fraction, a new column and a struct; a column gone, one as text, the struct with another field."""
    e, path = A.entities(spark, d), _folder(spark)
    keys, more = ["season", "phase", "name"], F.struct((C("tid") % 3).alias("tier"))
    first = e.where("season < 1997").select(*keys, C("tid").cast("int").alias("tid"), C("ability").cast("int").alias("ability"), C("club").cast("smallint").alias("club"))
    second = e.where("season >= 1997 and season < 1999").select(*keys, "tid", (C("ability") / 2).alias("ability"), "club", "league", more.alias("more"))
    third = e.where("season >= 1999").select(*keys, "tid", (C("ability") / 2).alias("ability"), C("league").cast("string").alias("league"), F.struct((C("ck") % 7).alias("squad_no"), (C("tid") % 3).alias("tier")).alias("more"))
    for i, g in enumerate((first, second, third)):
        g.write.parquet(f"{path}/{i}")
    out = read_generations(spark, [f"{path}/{i}" for i in range(3)])
    return out.select(*keys, "tid", "ability", C("club").cast("long").alias("club"), "league", "more.squad_no", "more.tier")


@query("l19_positional_json", "SELECT season, phase, club, '{\"fields\":[\"tid\",\"name\"],\"rows\":[' || string_agg('[\"' || tid || '\",\"' || name || '\"]', ',' ORDER BY tid, name) || ']}' AS json, count(*) AS n FROM ent GROUP BY season, phase, club")
def l19(spark, d):
    """One document for each squad, so each is bounded by a squad's size."""
    return L.positional_json(A.entities(spark, d), ["season", "phase", "club"], ["tid", "name"], ["tid", "name"])


@query("l19_dropped_groups", "SELECT count(*) AS known, count(p.club) AS published, count(*) FILTER (p.club IS NULL) AS dropped FROM (SELECT DISTINCT club FROM ent) g LEFT JOIN (SELECT DISTINCT club FROM ent WHERE ability > 190) p USING (club)")
def l19_dropped(spark, d):
    """Squads that an export of the best leaves out, as they have none."""
    e = A.entities(spark, d)
    return L.dropped_groups(e.select("club"), e.where("ability > 190"), ["club"])


@query("l20_leak_audit", "SELECT 'nested' AS output, 'rows.[].ability' AS path FROM (SELECT DISTINCT 1 AS x FROM customer) UNION ALL SELECT DISTINCT 'tags', 'm{}.ABILITY' FROM ent WHERE ability IS NOT NULL UNION ALL SELECT DISTINCT 'deep', 'a.[].m{}.ability' FROM ent WHERE club = 3 UNION ALL SELECT DISTINCT 'json', 'body.rows.[].' || CASE WHEN club % 2 = 0 THEN 'Ability' ELSE 'x.ability' END FROM ent")
def l20(spark, d):
    e = A.entities(spark, d)
    nested = e.groupBy("season").agg(F.collect_list(F.struct("tid", "ability")).alias("rows"))
    tags = e.where("ability is not null").select("tid", F.create_map(F.lit("ABILITY"), C("ability")).alias("m"))
    key = F.when(C("club") == 3, F.lit("ability")).otherwise(F.lit("level"))
    deep = e.select("tid", F.array(F.struct(F.create_map(key, C("tid")).alias("m"))).alias("a"))
    body = e.select(F.concat(F.lit('{"rows":[{'), F.when(C("club") % 2 == 0, F.lit('"Ability":1')).otherwise(F.lit('"x":{"ability":2},"note":"ability"')), F.lit("}]}")).alias("body"))
    return L.leaks(spark, {"nested": nested, "tags": tags, "deep": deep, "json": body, "clean": e.select("tid", "name")}, ["ability"])


@query("l22_ordered_export", "SELECT season, phase, tid, string_agg(position || ' ' || familiarity, ';' ORDER BY familiarity DESC, position) AS positions, row_number() OVER (PARTITION BY season, phase ORDER BY ability IS NULL, ability DESC, tid) AS line FROM pos JOIN ent USING (season, phase, tid) GROUP BY season, phase, tid, ability")
def l22(spark, d):
    from pyspark.sql import Window

    e = A.entities(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-C("familiarity")).alias("f"), "position"))), lambda x: F.concat_ws(" ", x["position"], (-x["f"]).cast("string"))), ";")
    p = A.positions(e).groupBy("season", "phase", "tid").agg(text.alias("positions"))
    line = F.row_number().over(Window.partitionBy("season", "phase").orderBy(C("ability").desc_nulls_last(), "tid")).cast("long")
    return p.join(e.select("season", "phase", "tid", "ability"), ["season", "phase", "tid"]).select("season", "phase", "tid", "positions", line.alias("line"))


@query("l23_point_filter", "SELECT season, phase, tid, club, name FROM ent WHERE club IN (3, 9) AND tid IN (5, 17, 40, 111)")
def l23(spark, d):
    """From a table partitioned by club and sorted by id, so both lists reach the scan."""
    path = _folder(spark)
    e = A.entities(spark, d).select("season", "phase", "tid", "club", "name")
    e.repartition("club").sortWithinPartitions("tid").write.partitionBy("club").parquet(path)
    out = spark.read.schema("season long, phase string, tid long, name string, club long").parquet(path)
    return out.where(C("club").isin(3, 9) & C("tid").isin(5, 17, 40, 111))


@query("l24_entry_log", "SELECT user_id AS k, event_id AS at, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def l24(spark, d):
    log = A.table(spark, d, "events").select(C("user_id").alias("k"), C("event_id").alias("at"), F.when(C("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return L.entry_log(log, ["k"], "at", "op")


@query("l24_compacted_log", "SELECT user_id, event_id AS at, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def l24_log(spark, d):
    """The table's rows in eight batches, out of order, with two compactions between them; errors are deletions."""
    e = A.table(spark, d, "events").select("user_id", C("event_id").alias("at"), F.when(C("event_type") == "error", "delete").otherwise("put").alias("op"), "value", "event_type")
    log = EntryLog(spark, _folder(spark), "user_id long", "value double, event_type string")
    for n in range(8):
        log.write(e.where(C("at") % 8 == (n * 5 + 3) % 8), n)
        if n in (2, 5):
            log.compact()
            log.clean()
    return log.current()


@query("l25_config_bundle", "SELECT '{\"nations\":[' || (SELECT string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) FROM nation) || '],\"regions\":[' || (SELECT string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) FROM region) || ']}' AS bundle")
def l25(spark, d):
    n, r = A.table(spark, d, "nation").select("n_nationkey", "n_name"), A.table(spark, d, "region").select("r_regionkey", "r_name")
    return L.config_bundle({"nations": n, "regions": r})


_LIST = "string_agg(DISTINCT season || '/' || phase, ',' ORDER BY season || '/' || phase)"


@query("l26_output_manifest", f"SELECT 'entities' AS output, count(*) AS rows, {_LIST} AS snapshots FROM ent UNION ALL SELECT 'slices', count(*), {_LIST} FROM slices")
def l26(spark, d):
    """Files and bytes depend on the writer; the operator has them, the query shows what SQL can tell."""
    path = _folder(spark)
    A.entities(spark, d).write.parquet(f"{path}/entities")
    A.slices(spark, d).write.parquet(f"{path}/slices")
    return L.output_manifest(spark, path).where("files > 0 and bytes > 0").select("output", "rows", "snapshots")


@query("l8_group_load", "SELECT season, phase, src, count(*) AS n, CAST(sum(CASE WHEN season = 1999 AND src = 'b' THEN tid + 1000 ELSE tid END) AS BIGINT) AS ids FROM (SELECT season, phase, tid, CASE WHEN ck % 2 = 0 THEN 'a' ELSE 'b' END AS src FROM ent) GROUP BY ALL")
def l8_groups(spark, d):
    """Two tables of a label, one of them with a source; then only that one again, for one season and source."""
    path = _folder(spark)
    e = A.entities(spark, d).select("season", "phase", "tid", F.when(C("ck") % 2 == 0, "a").otherwise("b").alias("src"))
    by = {"entities": ["season", "phase", "src"], "slices": ["season", "phase"]}
    L.load_label({"entities": e, "slices": e.groupBy("season", "phase").agg(F.count("*").alias("n"))}, f"{path}/store", by)
    again = e.where("season = 1999 and src = 'b'").withColumn("tid", C("tid") + 1000)
    L.load_label({"entities": again, "slices": again.select("season", "phase", C("tid").alias("n"))}, f"{path}/store", by, ["entities"])
    L.forget_versions(spark, f"{path}/store", list(by))
    out = L.read_store(spark, f"{path}/store", "entities", by["entities"], "tid long, season long, phase string, src string")
    whole = L.read_store(spark, f"{path}/store", "slices", by["slices"], "n long, season long, phase string")  # untouched by the second load
    out = out.groupBy("season", "phase", "src").agg(F.count("*").alias("n"), F.sum("tid").alias("ids"))
    return out.join(whole.select("season", "phase"), ["season", "phase"])
