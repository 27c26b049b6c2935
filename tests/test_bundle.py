"""Bundles read by blocks of any size are what a JSON parser says."""

import json
import random

import pytest

from snapstats.sources import bundle as B


def words(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", " ", "a", "bc"]) for _ in range(r.randrange(9)))


def value(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice([None, True, 1, -2.5, words(r), {}, []])
    return {words(r): value(r, depth - 1) for _ in range(r.randrange(4))} if r.random() < 0.6 else [value(r, depth - 1) for _ in range(r.randrange(4))]


def planted(r, n):
    out = {words(r) + str(i): {words(r) + str(k): value(r, 3) for k in range(r.randrange(n))} for i in range(5)}
    return out | {"version": 3, "note": words(r), "list": [value(r, 2) for _ in range(4)], "none": {}}


def expected(bundle):
    for section, held in bundle.items():
        for key, body in held.items() if isinstance(held, dict) else ((None, x) for x in held) if isinstance(held, list) else ():
            yield section, key, json.dumps(body, sort_keys=True)


def found(rows):
    return sorted(((s, k, json.dumps(json.loads(b), sort_keys=True)) for s, k, b in rows), key=repr)


def outlined(path, block):
    """``outline`` without a session, for very many blocks."""

    class Frame:
        def __init__(self, rows):
            self.rows = rows

        def repartition(self, *a):
            return self

        def mapInPandas(self, f, schema):
            import pandas as pd

            self.out = [x for f_ in f(iter([pd.DataFrame(self.rows)])) for x in f_.itertuples()]
            return self

        def collect(self):
            return self.out

    class Session:
        def createDataFrame(self, rows, schema):
            return Frame(rows)

    return B.outline(Session(), path, block)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_any_size(tmp_path, monkeypatch, seed):
    r = random.Random(seed)
    bundle = planted(r, 8)
    path = tmp_path / "b.json"
    path.write_text(json.dumps(bundle, ensure_ascii=False, indent=r.choice([None, 1]), separators=r.choice([(",", ":"), (" , ", " : ")])))
    want = sorted(expected(bundle), key=repr)
    for block, chunk in ((5, 16), (50, 7), (400, 1 << 20), (1 << 20, 33)):
        monkeypatch.setattr(B, "CHUNK", chunk)
        blocks = outlined(str(path), block)
        assert [b.start for b in blocks] == list(range(0, path.stat().st_size, block))
        assert found(x for b in blocks for x in B._entries(b, None)) == want
        some = list(bundle)[1]
        kept = [b for b in blocks if not b.whole or b.name == some]
        assert found(x for b in kept for x in B._entries(b, [some])) == [x for x in want if x[0] == some]


def test_scan_by_several_tasks(spark, tmp_path):
    (tmp_path / "in/x=1").mkdir(parents=True)
    big = {"players": {str(i): {"name": f'n"{i}', "club": i % 7, "more": "x" * 50} for i in range(3000)}, "clubs": {str(i): {"name": f"c{i}"} for i in range(7)}}
    (tmp_path / "in/x=1/a.json").write_text(json.dumps(big))
    (tmp_path / "in/b.json").write_text('{"clubs":{"9":{"name":null}},"staff":{}}')
    (tmp_path / "in/_hidden").write_text("no json")
    (tmp_path / "in/empty.json").write_text("")
    all_ = B.scan_bundle(spark, str(tmp_path / "in"), block=20_000)
    assert all_.rdd.getNumPartitions() > 10
    assert {r.section: r["count"] for r in all_.groupBy("section").count().collect()} == {"players": 3000, "clubs": 8}
    clubs = B.bundle_section(all_, "clubs", "name string, club int")
    assert clubs.rdd.getNumPartitions() < 4, "blocks that hold only players are left out"
    assert sorted(map(tuple, clubs.collect())) == sorted([(str(i), f"c{i}", None) for i in range(7)] + [("9", None, None)])
    names = B.bundle_section(all_, "players", "name string, club int").select("name")
    plan = names._jdf.queryExecution().toString()
    assert "struct<name:string>" in plan.replace("StructField(name,StringType,true)", "struct<name:string>") and names.count() == 3000


def test_what_is_no_bundle(spark, tmp_path):
    for i, text in enumerate(('{"a":{"1":{}', '{"a":{"1":"x', "{}}", '{"a":{}}]')):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(ValueError):
            B.scan_bundle(spark, str(tmp_path / f"{i}.json"))
    with pytest.raises(FileNotFoundError):
        B.scan_bundle(spark, str(tmp_path / "none"))
    (tmp_path / "ok.json").write_text(" {} ")
    assert B.scan_bundle(spark, str(tmp_path / "ok.json")).count() == 0
