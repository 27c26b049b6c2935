"""Greedy intervals, chains with cycles and forks, loads that commit at once, audits and profiles at any depth."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snapstats.operators import documents, loads, models, sequences
from snapstats.session import checkpoint

SPAN = "g string, begin long, end long, id string"


def by_hand(left, right):
    """Each left in order takes the first right that overlaps and is not taken."""
    out = set()
    for g in {x[0] for x in left if x[0] is not None}:
        free = sorted((x for x in right if x[0] == g and None not in x), key=lambda x: (x[1], x[3]))
        for _, begin, end, name in sorted((x for x in left if x[0] == g and None not in x), key=lambda x: (x[1], x[3])):
            met = next((x for x in free if x[1] <= end and begin <= x[2]), None)
            if met:
                free.remove(met)
                out.add((g, name, met[3]))
    return out


def test_two_spells_over_two_windows_both_match(spark):
    left = [("k", 1, 10, "x1"), ("k", 2, 11, "x2")]
    right = [("k", 0, 20, "w1"), ("k", 3, 20, "w2")]
    got = {tuple(r) for r in sequences.overlap_once(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ["g"]).collect()}
    assert got == {("k", "x1", "w1"), ("k", "x2", "w2")}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_overlap_is_the_loop(spark, seed):
    r = random.Random(seed)
    some = lambda n, p: [(r.choice(["a", "b", "c", None]), b := r.randrange(60), None if r.random() < 0.05 else b + r.randrange(r.choice([1, 4, 30])), f"{p}{i}") for i in range(n)]
    left, right = some(90, "x"), some(90, "w")
    got = [tuple(x) for x in sequences.overlap_once(spark.createDataFrame(left, SPAN).repartition(3), spark.createDataFrame(right, SPAN), ["g"]).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(left, right)


def test_overlap_of_a_hot_key_forms_no_pairs(spark):
    """60,000 intervals on each side of one key, each over hundreds of the other side: all pairs would be millions."""
    one = spark.range(60_000).select(F.lit("k").alias("g"), F.col("id").alias("begin"), (F.col("id") + 500).alias("end"), F.concat(F.lit("x"), "id").alias("name"))
    left, right = (one.select("g", "begin", "end", F.col("name").alias("id")) for _ in range(2))
    found = sequences.overlap_once(left, right, ["g"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("left_id = right_id").count() == 60_000
    assert sequences.overlap_once(left.limit(0), right, ["g"]).count() == 0


CHAIN = "id long, nxt long"


def places(spark, rows):
    out = sequences.chain_positions(spark.createDataFrame(rows, CHAIN), "id", "nxt", keep=checkpoint).collect()
    assert len(out) == len(rows)
    return {r.row: (r.head, r.position, r.cycle) for r in out}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 65])
def test_cycles_come_back_as_such(spark, n):
    r = random.Random(n)
    ids = r.sample(range(1000), n)
    least = ids.index(min(ids))
    tail = [(2000 + i, 2001 + i if i < 70 else None) for i in range(71)]
    got = places(spark, [(x, ids[(i + 1) % n]) for i, x in enumerate(ids)] + tail)
    assert all(got[x] == (min(ids), (i - least) % n, True) for i, x in enumerate(ids))
    assert all(got[2000 + i] == (2000, i, False) for i in range(71))


def test_forks_multiply_nothing(spark):
    got = places(spark, [(1, 3), (2, 3), (3, 4), (4, None), (9, 2), (50, 77), (60, 60)])
    assert got == {1: (1, 0, False), 3: (1, 1, False), 4: (1, 2, False), 9: (9, 0, False), 2: (9, 1, False), 50: (50, 0, False), 60: (60, 0, True)}
    # a cycle with a tail that leads into it
    assert places(spark, [(5, 6), (6, 7), (7, 5), (8, 6)]) == {5: (5, 0, True), 6: (5, 1, True), 7: (5, 2, True), 8: (8, 0, False)}
    assert places(spark, []) == {}


BY = {"good": ["season", "src"], "bad": ["season"], "third": ["season"]}
SCHEMAS = {"good": "season long, src string, x long", "bad": "season long, x long", "third": "season long, x long"}


def store(spark, root):
    out = {}
    for name in BY:
        try:
            out[name] = sorted(map(tuple, loads.read_store(spark, root, name, BY[name], SCHEMAS[name]).select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).collect()), key=repr)
        except Exception as e:  # a table that no load has written yet
            assert "PATH_NOT_FOUND" in str(e)
    return out


def label(spark, factor, failing=None):
    good = spark.createDataFrame([(1, "a", 5 * factor), (2, None, 6 * factor)], SCHEMAS["good"])
    more = good.select("season", "x")
    fail = lambda df, name: df.withColumn("x", F.raise_error(F.lit("no")).cast("long")) if failing == name else df
    return {"good": fail(good, "good"), "bad": fail(more, "bad"), "third": fail(more, "third")}


@pytest.mark.parametrize("failing", ["good", "bad", "third"])
def test_a_load_that_fails_anywhere_leaves_the_old_state(spark, tmp_path, failing):
    root = f"{tmp_path}/store"
    loads.load_label(label(spark, 1), root, BY)
    before = store(spark, root)
    assert before["good"] == [(1, "a", 5), (2, None, 6)]
    with pytest.raises(Exception, match="no"):
        loads.load_label(label(spark, 10, failing), root, BY)
    assert store(spark, root) == before
    loads.load_label(label(spark, 10), root, BY)
    after = store(spark, root)
    loads.load_label(label(spark, 10), root, BY)
    assert store(spark, root) == after and after["third"] == [(1, 50), (2, 60)]
    assert loads.forget_versions(spark, root, list(BY))
    assert store(spark, root) == after


def test_a_load_that_fails_before_its_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    loads.load_label(label(spark, 1), root, BY)
    before = store(spark, root)
    real = loads.manifest

    def broken(*args, **kw):
        raise OSError("lost")

    monkeypatch.setattr(loads, "manifest", broken)
    with pytest.raises(OSError):
        loads.load_label(label(spark, 10), root, BY)
    monkeypatch.setattr(loads, "manifest", real)
    assert store(spark, root) == before


def test_loads_of_groups_and_of_slices(spark, tmp_path):
    root = f"{tmp_path}/store"
    loads.load_label(label(spark, 1), root, BY)
    with pytest.raises(ValueError):
        loads.load_label(label(spark, 1), root, BY, ["other"])
    part = {n: df.where("season = 2") for n, df in label(spark, 7).items()}
    assert loads.load_label(part, root, BY, ["good"]) == ["good"]
    got = store(spark, root)
    assert got["good"] == [(1, "a", 5), (2, None, 42)] and got["bad"] == [(1, 5), (2, 6)]
    old = loads.read_store(spark, root, "good", BY["good"], SCHEMAS["good"], commit=0)
    assert sorted(r.x for r in old.collect()) == [5, 6]
    assert loads.load_label({n: df.limit(0) for n, df in label(spark, 1).items()}, root, BY) == list(BY)
    assert store(spark, root) == got


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    loads.load_label(label(spark, 1), root, BY)
    stale = loads._commits(spark, root)
    loads.load_label(label(spark, 2), root, BY)
    monkeypatch.setattr(loads, "_commits", lambda *a: stale)
    with pytest.raises(RuntimeError, match="meanwhile"):
        loads.load_label(label(spark, 3), root, BY)


def test_audit_at_any_depth(spark):
    text = json.dumps({"ok": [{"x": {" Ability ": 1}}], "inner": json.dumps({"deep": [{"ABILITY": 2}]}), "note": "ability"})
    row = spark.createDataFrame(
        [(({"ability": 1},), [{"in": [{"Ability": 2}]}], {"k": {"ABILITY": 3}}, [(text, {"level": "plain"})], "ability", "{broken ability", '{"fine": 1}')],
        "s struct<m: map<string, int>>, a array<map<string, array<map<string, int>>>>, mm map<string, map<string, int>>, t array<struct<body: string, tags: map<string, string>>>, word string, broken string, fine string",
    )
    got = sorted(tuple(r) for r in loads.leaks(spark, {"o": row, "c": spark.range(1)}, ["Ability"]).collect())
    assert got == sorted(
        ("o", p) for p in ("s.m{}.ability", "a.[]{}.[]{}.Ability", "mm{}{}.ABILITY", "t.[].body.ok.[].x. Ability ", "t.[].body.inner.deep.[].ABILITY")
    )
    named = spark.createDataFrame([([{"CA": 1}],)], "rows array<struct<CA: int>>")
    tags = spark.createDataFrame([({"ca": 1, "ok": 2},)], "m map<string, int>")
    assert sorted(tuple(r) for r in loads.leaks(spark, {"n": named, "t": tags}, ["ca"]).collect()) == [("n", "rows.[].CA"), ("t", "m{}.ca")]


def flat(value, parent="$", depth=1):
    items = value.items() if isinstance(value, dict) else (("[]", x) for x in value) if isinstance(value, list) else ()
    for tag, x in items:
        kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number" if isinstance(x, float) else "string"
        yield depth, parent, tag, kind, x if kind == "integer" else None
        yield from flat(x, tag, depth + 1)


def test_walk_and_profile_of_planted_trees(spark):
    r = random.Random(1)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([None, True, 7, r.randrange(50), -3, 1.5, "s", "", {}, []])
        return {f"k{r.randrange(5)}": tree(depth - 1) for _ in range(r.randrange(4))} if r.random() < 0.6 else [tree(depth - 1) for _ in range(r.randrange(4))]

    trees = [tree(6) for _ in range(60)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(100, None), (101, "no json {"), (102, "3")]
    df = spark.createDataFrame(rows, "e long, doc string")
    values = documents.walk(df, ["e"], "doc", keep=checkpoint)
    want = Counter((i, *x) for i, t in enumerate(trees) for x in flat(t))
    assert Counter(tuple(x) for x in values.select("e", "depth", "parent", "tag", "kind", "whole").collect()) == want
    assert max(x[1] for x in want) == 6
    got = {x.tag: x for x in documents.nested_profile(values, "e").collect()}
    for tag in {x[3] for x in want}:
        own = [x for x in want.elements() if x[3] == tag]
        assert got[tag].n == len(own) and got[tag].entities == len({x[0] for x in own})
        assert got[tag].as_container == sum(x[4] in ("object", "array") for x in own)
        whole = [x[5] for x in own if x[5] is not None]
        assert (got[tag].least, got[tag].most, got[tag].distinct_values) == (min(whole, default=None), max(whole, default=None), len(set(whole)))
        parents = sorted(Counter(x[2] for x in own).items(), key=lambda x: (-x[1], x[0]))[:8]
        assert got[tag].parents == ",".join(f"{p}:{k}" for p, k in parents)
    assert {(x.parent, x.tag): x.n for x in documents.nesting(values).collect()} == Counter((x[2], x[3]) for x in want.elements())


def test_prices_prove_an_assignment(spark):
    r = random.Random(6)
    rows = [(f"g{g}", f"s{s}", c, float(r.randrange(20))) for g in range(8) for s in range(4) for c in range(g + 1) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "team string, slot string, who long, v double")
    chosen = models.priced(df, "team", "slot", "who", "v")
    ok = models.assignment_faults(df, chosen, "team", "slot", "who", "v").collect()
    assert len(ok) == len({x[0] for x in rows}) and all((x.twice, x.above, x.open) == (0, 0, False) for x in ok)
    assert {(x.team, x.slots) for x in ok} == {(g, len({x[1] for x in rows if x[0] == g})) for g in {x[0] for x in rows}}
    # a choice that is not the best can't have such prices: a better pair stands above them, or they do not add up
    worse = chosen.withColumns({"value": F.col("value") - F.when(F.col("slot") == "s0", 1.0).otherwise(0.0)})
    assert any(x.open for x in models.assignment_faults(df, worse, "team", "slot", "who", "v").collect())
    cheap = chosen.withColumn("slot_price", F.col("slot_price") - 5.0)
    assert any(x.above for x in models.assignment_faults(df, cheap, "team", "slot", "who", "v").collect())
