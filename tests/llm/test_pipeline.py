"""The pipeline's stages one after another, each against a plain version of itself on a small table."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapstats.llm import pipeline as corpus_pipeline
from snapstats.llm import registry
from snapstats.llm.common import shared_dir, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    line = lambda n=14: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    passage = line(40)
    rows = []
    for i in range(60):
        rows.append([i, "\n".join(line() for _ in range(8)), "en", f"s{i % 3}"])
    rows[10][1] = rows[3][1]  # a copy
    rows[11][1] = "\n".join([line(), *rows[4][1].split("\n")[:4], line(), line(), line(), line()])  # three-line windows of another
    rows[12][1] += "\n" + passage
    rows[13][1] = "too short"
    rows[14][1] = None
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), {x[0]: x[1] for x in rows}, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        steps.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
        assert name == "packing" or docs.columns == COLUMNS
    good, lines, near, clean, packed = steps
    assert set(good) == set(texts) - {13, 14} and all(good[k].text == texts[k] for k in good)
    assert lines[11].text.split("\n") == [x for i, x in enumerate(texts[11].split("\n")) if not 1 <= i <= 4]
    assert 10 not in lines and lines[3].text == texts[3]  # of a copy nothing is left
    assert set(near) == set(lines) == set(good) - {10}
    assert passage in near[12].text and passage not in clean[12].text and clean[12].n_chars == len(clean[12].text)
    assert all(clean[k].text == near[k].text for k in clean if k != 12)
    assert {r.doc_id for r in packed} == set(clean)
    ran = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert ran == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_near_dedup_keeps_one(spark):
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(4000)}" for _ in range(300))
    rows = [(i, text, "en", "s", 1) for i in range(5)] + [(9, text + " " + text[::-1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 9]


def test_rows_that_share_a_doc_id(spark):
    r = random.Random(3)
    line = lambda n=14: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    common = line(30)
    bodies = ["\n".join(line() for _ in range(9)) for _ in range(40)]
    texts = [f"{common}\n{b}" for b in bodies[:20]] + bodies[20:]
    ids = [None if i % 2 else 7 for i in range(40)]
    docs = lambda texts: spark.createDataFrame([(k, t, "en", "s", 1) for k, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.quality_rules(spark, docs(texts), "").collect()), key=str)
    assert got == sorted(zip(ids, bodies), key=str)
    assert len(corpus_pipeline.near_dedup(spark, docs(bodies[:20] * 2), "").collect()) == 20
    kept = [x.text for x in corpus_pipeline.line_dedup(spark, docs(bodies[:20] * 2), "").collect()]
    assert sorted(kept) == sorted(bodies[:20])
    unlike = docs([f"{line()}\n{bodies[0]}", *bodies[1:4], f"{bodies[0]}\n{line()}"])
    assert sum(bodies[0] in x.text for x in corpus_pipeline.line_dedup(spark, unlike, "").collect()) == 1


def test_clashing_columns(spark):
    r = random.Random(9)
    body = lambda: "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(14)) for _ in range(9))
    names = ["drop", "__key", "key", "row", "ROW2", "at", "host", "packed", "sketch", "root", "lines", "__null"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names)
    some = [body() for _ in range(6)]
    docs = spark.createDataFrame([(k, t, "s", *range(len(names))) for k, t in zip([None, None, None, 7, 7, 8], some)], schema)
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(folder := f"{shared_dir(spark)}/clash/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder.rsplit("/", 1)[0])
        assert out.columns == docs.columns, name
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str), name
    assert corpus_pipeline.pack(spark, docs, "").count() == 6


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_links_what_is_alike(spark):
    """Pairs of 300 words with single words replaced: those alike by 0.85 or more are found, those below 0.7 are not."""
    r = random.Random(5)
    rows, pairs = [], []
    for i in range(600):
        w = [f"w{r.randrange(10**5)}" for _ in range(300)]
        v = list(w)
        for at in r.sample(range(300), r.randint(1, 14)):
            v[at] = f"x{r.randrange(10**5)}"
        a, b = ({tuple(t[j : j + 5]) for j in range(296)} for t in (w, v))
        rows += [(2 * i, " ".join(w), "en", "s", 1), (2 * i + 1, " ".join(v), "en", "s", 1)]
        pairs.append((2 * i + 1, len(a & b) / len(a | b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(range(0, 1200, 2)) <= kept
    near, far, edge = ([k for k, x in pairs if f(x)] for f in (lambda x: x >= 0.85, lambda x: x < 0.7, lambda x: 0.8 <= x < 0.85))
    assert len(near) > 100 and sum(k not in kept for k in near) >= 0.98 * len(near)
    assert len(edge) > 20 and sum(k not in kept for k in edge) >= 0.9 * len(edge)
    assert len(far) > 100 and all(k in kept for k in far)


def test_near_dedup_from_files_and_rows(spark, tmp_path):
    """Rows of a file are known by their place there, others by a number; the result is the same."""
    r = random.Random(6)
    some = [" ".join(f"w{r.randrange(10**5)}" for _ in range(80)) for _ in range(5)]
    rows = [(None, some[0]), (None, some[1]), (None, some[2]), (7, some[3]), (7, some[4]), (7, some[4]), (8, some[4] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        assert sorted(x.text for x in corpus_pipeline.near_dedup(spark, table, "").collect()) == sorted(some)
    path = str(tmp_path / "docs")
    twice = spark.read.parquet(path, path)
    assert twice.count() == 14 and corpus_pipeline.near_dedup(spark, twice, "").count() == 5
    assert corpus_pipeline.line_dedup(spark, twice, "").count() == corpus_pipeline.line_dedup(spark, docs.union(docs), "").count() == 14


def test_registry_has_one_query_for_each_operator():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def _quality(docs):
    """{id: (text, host)} to the kept texts without common lines."""
    lines = {k: [(i, " ".join(_words(x.translate(LOW)))) for i, x in enumerate((t or "").split("\n")) if _words(x)] for k, (t, _) in docs.items()}
    mark = {k: tuple(x for _, x in v) for k, v in lines.items()}
    of_line, of_host = defaultdict(set), defaultdict(set)
    for k, v in lines.items():
        for _, x in v:
            of_line[docs[k][1], x].add(mark[k])
            of_host[docs[k][1]].add(mark[k])
    out = {}
    for k, (t, host) in docs.items():
        w = _words(t or "")
        n = Counter(zip(w, w[1:], w[2:]))
        repeat = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for j in (i, i + 1, i + 2)}
        gone = {i: x for i, x in lines[k] if len(of_line[host, x]) > max(10, 0.02 * len(of_host[host]))}
        left = len(w) - sum(len(x.split()) for x in gone.values())
        if len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and left >= 0.3 * len(w):
            out[k] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def _line_dedup(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        lines = texts[k].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for i in range(len(full) - 2):
            g = tuple(lines[j].strip(" \t\r\x0b\x0c") for j in full[i : i + 3])
            if g in seen:
                gone |= set(full[i : i + 3])
            seen.add(g)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if _words(left):
            out[k] = left
    return out


def _near_dedup(texts):
    def shingles(t):
        w = _words(t.translate(LOW))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    groups: list[set] = []
    for k in sorted(sets):
        near = [g for g in groups if any(alike(sets[k], sets[o]) for o in g)]
        groups = [g for g in groups if g not in near] + [{k}.union(*near)]
    return {min(g): texts[min(g)] for g in groups}


def _decontaminate(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = set()
    for t in items:
        w = word.findall(t.translate(LOW))
        n = min(10, len(w))
        phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    out = {}
    for k, t in texts.items():
        at = list(word.finditer(t.translate(LOW)))
        hit = {j for n in {len(p) for p in phrases} for i in range(len(at) - n + 1) if tuple(m[0] for m in at[i : i + n]) in phrases for j in range(i, i + n)}
        for j in sorted(hit, reverse=True):
            end = at[j + 1].start() if j + 1 in hit else at[j].end()
            t = t[: at[j].start()] + t[end:]
        out[k] = t
    return out


def test_all_stages_against_brute_force(spark, tmp_path):
    r = random.Random(23)
    line = lambda n=12: " ".join(f"w{r.randrange(3000)}é" for _ in range(n))
    passage, common = line(30), "All Rights   reserved by nobody in particular."
    docs = {}
    for i in range(90):
        body = [line() for _ in range(r.randint(3, 9))]
        if i % 2:
            body.insert(1, common)
        if i % 6 == 0 and i:
            body[1:1] = docs[i - 6][0].split("\n")[:4]
        if i % 7 == 0:
            body.append(f"{line(3)} {passage[: r.randint(60, 400)]}. {line(3)}")
        docs[i] = ("\n".join(body), f"s{i % 2}")
    long = "\n".join(line() for _ in range(9))
    docs |= {96: (long, "s0"), 90: (docs[4][0], "s0"), 91: (None, "s1"), 92: ("", None), 93: (long.replace("\n", " "), None), 94: (long.replace("\n", "  "), "s0"), 95: ("again and " * 90, "s1")}
    spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, (t, s) in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, line(4))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = _quality(docs)
    deduped = _line_dedup(kept)
    single = _near_dedup(deduped)
    clean = _decontaminate(single, [passage, *(x.text for x in spark.read.parquet(str(tmp_path / "benchmark.parquet")).where("item_id = 2").collect())])
    assert len(kept) < len(docs) and deduped != kept and len(single) < len(deduped) and clean != single

    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, deduped, single, clean)):
        rows = stored(stage(spark, rows, str(tmp_path)))
        assert {x.doc_id: x.text for x in rows.collect()} == want, name

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.length) for x in packed) == sorted(lengths.items())
    assert len({x.sequence_id for x in packed}) <= -(-sum(lengths.values()) // 2048) + 1
