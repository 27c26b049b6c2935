"""The domain frames again, as SQL for the oracle; written apart from the Spark ones on purpose."""

from __future__ import annotations

import re

_ATTR = ", ".join(f"CASE WHEN (ck + {k}) % 11 <> 0 THEN 1 + (ck * 7 + season * 3 + {k * 5}) % 20 END AS a{k}" for k in range(8))
_Q = "strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d')"

CTES = {
    "slices": f"SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS season, {_Q} AS phase FROM orders",
    "ent": """SELECT season, phase, c_custkey % s AS tid, c_name AS name, CAST(DATE '1975-01-01' + CAST(c_custkey * 13 % 9000 AS INTEGER) AS DATE) AS dob,
      (c_nationkey + season) % 25 AS club, ((c_nationkey + season) % 25) % 5 AS league,
      CASE WHEN c_custkey % 13 <> 0 THEN 1 + c_custkey * 17 % 200 END AS ability, c_custkey % 10 = 0 AS is_staff, c_custkey AS ck
      FROM customer, (SELECT count(*) // 4 AS s FROM customer), slices WHERE c_custkey // s = (season - 1995) // 2""",
    "attr": f"SELECT *, {_ATTR} FROM ent",
    "wgt": """SELECT 'm' || m AS method, 'r' || r AS role, 'a' || k AS attribute, CAST(2 + (m * 4 + r * 3 + k) % 4 AS BIGINT) AS weight
      FROM range(3) a(m), range(4) b(r), range(8) c(k) WHERE (m + r + k) % 3 = 0""",
    "pos": """SELECT season, phase, tid, 'P' || ((ck + k * 5) % 14) AS position, 1 + (ck * 13 + season + k * 7) % 20 AS familiarity
      FROM ent, range(3) x(k)""",
    "fix": f"""SELECT o_orderkey AS anchor, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS season, {_Q} AS phase,
      CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS comp, CAST(c_nationkey AS BIGINT) AS home,
      (c_nationkey + 1 + o_orderkey % 24) % 25 AS away, o_orderkey % 5 AS score_home, (o_orderkey // 5) % 4 AS score_away,
      ['4-4-2', '4-3-3', '3-5-2'][o_orderkey % 3 + 1] AS formation, CAST(floor(o_totalprice) AS BIGINT) AS crowd
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "app": f"""SELECT l_orderkey AS anchor, l_suppkey AS tid, CAST(l_linenumber * 2 AS BIGINT) AS pos_order,
      CAST(CASE WHEN l_linenumber >= 6 AND q % 2 = 0 THEN 70 ELSE 255 END AS BIGINT) AS sub_on,
      CAST(CASE WHEN l_linenumber < 6 AND q % 3 = 0 THEN 60 ELSE 255 END AS BIGINT) AS sub_off, 50 + l_partkey % 50 AS rating, q % 4 AS goals, q % 3 AS assists,
      q % 11 AS shots, q % 7 AS on_target,
      10 + l_partkey % 40 AS pass_a, 10 + l_partkey % 40 - q % 9 AS pass_c, q % 5 AS key_pass, q % 6 AS cross_a, least(q % 6, l_partkey % 4) AS cross_c,
      l_partkey % 8 AS tack_a, least(l_partkey % 8, q % 5) AS tack_w, q % 9 AS head_a, least(q % 9, l_partkey % 6) AS head_w, (q + l_partkey) % 7 AS dribbles,
      (q * 3 + l_partkey) % 5 AS intercept, (q + l_partkey) % 3 AS mistakes, CAST((q + l_partkey) % 10 = 0 AS BIGINT) AS yellow, l_linenumber % 2 = 1 AS is_home, CAST(year(o_orderdate) AS BIGINT) AS season, {_Q} AS phase,
      CAST(o_orderdate AS DATE) AS date, o_orderpriority AS comp, l_suppkey % 25 AS club
      FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey, l_suppkey
        ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS nth FROM lineitem)
      JOIN orders ON l_orderkey = o_orderkey WHERE nth = 1""",
    "wk": """SELECT user_id AS tid, CAST(ts AS DATE) AS date,
      CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 32 ELSE 0 END AS BIGINT) AS flag, event_id FROM events""",
    "sev": """SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS anchor, event_id, user_id AS tid, CAST(ts AS DATE) AS date, event_id % 2 = 0 AS ours,
      event_type AS kind, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS seq
      FROM events WHERE event_type IN ('click', 'purchase', 'error')""",
    "chn": """SELECT o_orderkey AS row_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id,
      o_orderkey % 25 AS club, o_orderkey % 7 AS stat FROM orders""",
    "kv": "SELECT conv_id AS entity, role AS tag, CAST(length(text) AS BIGINT) AS value, CAST(turn AS BIGINT) AS n FROM conversations",
    "feat": "SELECT vec_id AS id, CAST(label % 3 AS BIGINT) AS target, "
    + ", ".join(f"CAST(floor(CAST(embedding[{k}] AS DOUBLE) * 1000) AS BIGINT) AS x{k}" for k in range(1, 5))
    + ", CAST(label * 3 + floor(CAST(embedding[1] AS DOUBLE) * 100) AS BIGINT) AS y FROM embeddings",
    # derived: the hub of the reports
    "combo": "SELECT DISTINCT method, role FROM wgt",
    "score": """SELECT season, phase, tid, club, league, ability, name, dob, l.method, l.role, CAST(sum(value * coalesce(weight, 1)) AS BIGINT) AS rating
      FROM (SELECT * FROM (UNPIVOT (SELECT season, phase, tid, club, league, ability, name, dob, a0, a1, a2, a3, a4, a5, a6, a7 FROM attr)
        ON a0, a1, a2, a3, a4, a5, a6, a7 INTO NAME attribute VALUE value), combo) l
      LEFT JOIN wgt ON wgt.method = l.method AND wgt.role = l.role AND wgt.attribute = l.attribute GROUP BY ALL""",
    "eff": """SELECT season, phase, tid, club, league, ability, name, dob, method, role, position, familiarity, rating,
      rating * (0.5::DOUBLE + 0.5::DOUBLE * (greatest(1, least(20, familiarity))::DOUBLE / 20)) AS eff
      FROM score JOIN (SELECT *, 'r' || (CAST(substr(position, 2) AS BIGINT) % 4) AS role FROM pos) USING (season, phase, tid, role)""",
    "prim": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY season, phase, method, tid ORDER BY familiarity DESC, position) AS rn FROM eff) WHERE rn = 1""",
    "side": """SELECT anchor, date, season, phase, comp, formation, crowd, home AS us, away AS them, score_home AS gf, score_away AS ga, 'H' AS venue FROM fix
      UNION ALL SELECT anchor, date, season, phase, comp, formation, crowd, away, home, score_away, score_home, 'A' FROM fix""",
    "res": """SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' ELSE 'D' END AS result,
      CAST(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS BIGINT) AS pts FROM side""",
    "part": """SELECT *, pos_order <= 11 AS started, pos_order <= 11 OR sub_on <> 255 AS appeared,
      CAST(CASE WHEN pos_order <= 11 OR sub_on <> 255 THEN (CASE WHEN sub_off = 255 THEN 90 ELSE sub_off END) - (CASE WHEN sub_on = 255 THEN 0 ELSE sub_on END)
        ELSE 0 END AS BIGINT) AS minutes FROM app""",
    "lastp": "SELECT season, max(phase) AS phase FROM app GROUP BY 1",
    "cur": "SELECT part.* FROM part JOIN lastp USING (season, phase)",
}


def with_tables(body: str) -> str:
    """``body`` behind the frames it names, each after those it needs."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name, sql in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(sql)
                order.append(name)

    need(body)
    if not order:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
