"""Collocations, runs and streaming dedup against brute force; hashes without structural collisions; the secret scan's forms and time; near dedup of pages with a template."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstats.llm import collocations, decontaminate, quality, repeats, runs, secret_scan, simhash, stream_dedup
from snapstats.llm.common import pack_sorted, unpack_sorted, windows_of, word_ids

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, score string, key long, bucket int, id string"


def table(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3, "y") for i, t, lang in rows], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- collocations ---


def brute_phrases(rows, least, top, taken=(80, 100)):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in (1, 2, 3, 4):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = set()
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            inside = [q for q in cands if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(taken[1] * cands[q] >= taken[0] * a for q in inside):
                continue
            score, _, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, p.decode(), a, left, right, total[lang], -s))
    return out


def text_rows():
    r = random.Random(4)
    words = [f"{c}{d}" for c in "abé" for d in "xyZ"] + ["x" * 90, "\x1c\x00"]
    rows = []
    for i in range(150):
        body = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((i if i % 9 else None, body + r.choice(["", " one Two three four five"]), [None, "und", "en", "fr"][i % 4]))
    return rows + [(200, None, "en"), (201, "", None), (202, " \t.,", "de"), (203, "lone", "de"), (1, "ab cd", "en"), (1, "ab cd", "en")]


@pytest.mark.parametrize("held", [1_000_000, 300])
def test_collocations(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD", held)
    rows = text_rows()
    for least, top in ((3, 40), (8, 2000)):
        got = {tuple(x) for x in collocations.collocations(table(spark, rows).repartition(4), least=least, top=top).collect()}
        assert got == brute_phrases(rows, least, top)


def test_collocations_of_nothing_and_of_large_counts(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None)])).count() == 0
    rows = [(i, "hot pair " + "tail " * (i % 5), "en") for i in range(400)]
    got = {tuple(x) for x in collocations.collocations(table(spark, rows)).collect()}
    assert got == brute_phrases(rows, 30, 2000)


def test_packed_ids():
    v = np.sort(np.random.default_rng(1).integers(0, 2**56, 500, np.uint64))
    for part in (v, v[:1], v[:0], np.repeat(v[:3], 4)):
        assert (unpack_sorted(pack_sorted(part)) == part).all()


# --- streaming dedup ---


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[(text or "").translate(LOW)].append(i)
    return groups


def check_groups(rows, got):
    groups = brute_groups(rows)
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for doc_id, keep, n, kept, digest in got:
        members = groups[sha[digest]]
        known = [x for x in members if x is not None]
        assert doc_id in members and n == len(members) and keep == (max(known) if known else None)
        assert not kept or doc_id == keep
    assert sum(x[3] for x in got) == len(groups)


def dup_rows():
    r = random.Random(2)
    texts = ["Same", "same", "SAME", "É", "é", None, "", "a b", "x" * 100_000] + [f"t{i}" for i in range(20)]
    return [(None if i % 17 == 0 else i // 2, r.choice(texts), "en") for i in range(300)]


def test_stream_dedup(spark):
    rows = dup_rows()
    check_groups(rows, [tuple(x) for x in stream_dedup.duplicates_of(table(spark, rows).repartition(3)).collect()])
    assert stream_dedup.duplicates_of(table(spark, [])).count() == 0


def test_bytes_decide_where_digests_agree(spark):
    rows = dup_rows()
    weak = lambda text: F.concat(F.lit("d"), (F.length(F.coalesce(text, F.lit(""))) % 3).cast("string")).cast("binary")
    check_groups(rows, [tuple(x) for x in stream_dedup.duplicates_of(table(spark, rows), digest=weak).collect()])


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows, path, folder = dup_rows(), str(tmp_path / "docs"), str(tmp_path / "state")
    for part in (rows[:150], rows[150:]):
        table(spark, part).repartition(2).write.mode("append").parquet(path)
        stream_dedup.advance(spark, path, folder, files_at_once=1)
    state = stream_dedup.entries(spark, folder)
    assert state.agg(F.sum("n")).head()[0] == len(rows) and state.count() == len(brute_groups(rows))
    batches = spark.read.parquet(f"{folder}/changed").select("batch").distinct().count()
    assert batches == 4
    check_groups(rows, [tuple(x) for x in stream_dedup.duplicates(spark, path, folder).collect()])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stream_dedup.STORE


# --- runs ---


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(12, 2 * q):
                best.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in best.items())


def brute_row(doc_id, text, plant):
    w = split(text)
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    found = sorted(found, key=lambda x: (x[0], x[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    r, ids = random.Random(5), np.random.default_rng(0).integers(0, 2**64, 9, np.uint64)
    for _ in range(300):
        docs = []
        for _ in range(3):
            k, kind = r.choice([1, 2, 2, 3, 4]), r.random()
            unit = [r.randrange(k) for _ in range(r.randint(1, 9 if kind < 0.7 else 40))]
            w = [r.randrange(k) for _ in range(r.randint(0, 90))] if kind < 0.4 else unit * r.randint(1, 8) + [r.randrange(k) for _ in range(r.randint(0, 3))] + unit * r.randint(1, 6)
            docs.append(w)
        cut = np.cumsum([0, *map(len, docs)])
        of, s, n, q = runs.runs_of(ids[np.array(sum(docs, []), np.int64)], cut)
        for i, w in enumerate(docs):
            assert sorted(zip(s[of == i].tolist(), n[of == i].tolist(), q[of == i].tolist())) == brute_runs(w)


@pytest.mark.parametrize("plant", [False, True])
def test_runs(spark, plant):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "b", "É", "d\x1c"]) for _ in range(r.randint(0, 120))), "en") for i in range(120)]
    rows += [(None, "z " * 40, None), (500, None, None), (501, "", None), (502, " \n", None), (503, "x y z " * 5, None), (503, "x y z " * 5, None), (504, "w" * 5000 + " end", None)]
    got = sorted((tuple(x) for x in runs.periodic_runs(table(spark, rows), plant=plant).drop("runs").collect()), key=repr)
    assert got == sorted((brute_row(i, t, plant) for i, t, _ in rows), key=repr)
    assert runs.periodic_runs(table(spark, [])).count() == 0


def test_runs_take_linear_time():
    """Fibonacci words have a run for about each fifth word, of all lengths; a constant text has one."""
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    ids = np.random.default_rng(0).integers(0, 2**64, 2, np.uint64)
    began = time.perf_counter()
    assert len(runs.runs_of(ids[np.array(b)], np.array([0, len(b)]))[0]) > len(b) // 6
    assert [int(x[0]) for x in runs.runs_of(ids[np.zeros(300_000, int)], np.array([0, 300_000]))] == [0, 0, 300_000, 1]
    assert time.perf_counter() - began < 60


# --- hashes ---


def thue_morse(n, one="a", two="b"):
    return [two if bin(i).count("1") % 2 else one for i in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_arrangements_that_defeat_a_polynomial_hash(spark, n):
    word, swapped = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
    ids = word_ids(np.frombuffer((word + swapped).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))
    assert ids[0] != ids[1]
    letters = np.random.default_rng(3).integers(0, 2**64, 2, np.uint64)
    one = np.array([bin(i).count("1") % 2 for i in range(n)])
    assert windows_of(letters[one], n)[0] != windows_of(letters[1 - one], n)[0]
    tail = [f"t{i}" for i in range(60)]
    docs = table(spark, [(1, " ".join([word, *tail[:19]]), "en"), (2, " ".join([swapped, *tail[:19]]), "en"), (3, " ".join([word, "p", "q", swapped, "p", "q"]), "en")])
    removed = {x.doc_id: x.n_removed for x in repeats.word_dedup(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0}
    tests = spark.createDataFrame([("i", " ".join([word, *tail[:9]]))], "item_id string, text string")
    assert {x.doc_id: x.n_hit for x in decontaminate.contamination(docs, tests).collect()} == {1: 10, 2: 0, 3: 0}
    assert {x.doc_id: x.n_repeat_words for x in quality.quality(docs).collect()} == {1: 0, 2: 0, 3: 0}
    mixed = table(spark, [(1, " ".join([*tail[:5], word]), "en"), (2, " ".join([*tail[5:10], swapped]), "en")])
    assert simhash.keep_one(mixed).count() == 2


# --- secrets ---

SECRET, OTHER = "Zx81kQ9pLm2v", "QwErTy42uIoP"


@pytest.mark.parametrize(
    "text, found",
    [
        (f'passwords = ["{SECRET}", "{OTHER}"]', [SECRET, OTHER]),
        (f'passwords = [\n  "{SECRET}",\n  "{OTHER}",\n]', [SECRET, OTHER]),
        (f'password = x if y else "{SECRET}"', [SECRET]),
        (f'p = os.environ.get("P") or "{SECRET}"\ntoken = p', [SECRET]),
        (f'const t = env.T ?? "{SECRET}"; token = t', [SECRET]),
        ("db.password=Zx81kQ9\\\n    pLm2vW7", ["Zx81kQ9", "pLm2vW7"]),
        (f"secret = <<~EOS\n  {SECRET}\nEOS\n", [SECRET]),
        (f'obj.setPassword("{SECRET}")', [SECRET]),
        (f"postgres://user:{SECRET}@host/db", [SECRET]),
        (f'{{"Authorization": "Bearer {SECRET}"}}', [SECRET]),
        (f"Authorization: Bearer {SECRET}", [SECRET]),
        (f"CREATE USER u IDENTIFIED BY '{SECRET}'", [SECRET]),
        ('A = "Zx81"; B = "QwErTy42"; password = A + B', ["Zx81", "QwErTy42"]),
        (f'x, y, password = 1, 2, "{SECRET}"', [SECRET]),
        (f'{{"password": {{"a": ["{SECRET}"]}}}}', []),
        ('colors = ["Zx81kQ9pLm2v"]', []),
        ("see http://host:8080/path@x", []),
        ("note: hello, world, this is prose", []),
        ("secret = <<EOS\nno end in sight", []),
    ],
)
def test_secret_forms(text, found):
    assert [text[i:j] for i, j, _ in sorted(secret_scan.literal_spans(text))] == found


N = 100_000


@pytest.mark.parametrize(
    "part",
    ['"ab1", ', '"ab1",', "word, ", r"\"a\":\"b\",", r'\"""a', r"\"b: ", "a[b]", "a[b", "a = b if c ", "a = <<EOS\n", "a='", 'f("a", ', 'a=["b",', "a.b.", "a=b&", "a=b+c+", "a: b[", "a = b or ", "a=b\\\n", "a: bearer ", "://a:b"],
)
def test_secret_scan_takes_linear_time(part):
    """Four times the text takes less than seven times as long; the scan of a quadratic form would take sixteen times."""

    def took(n):
        text, best = "note: x " + part * n, 9e9
        for _ in range(2):
            began = time.perf_counter()
            secret_scan.literal_spans(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(N // 2) < max(0.5, 7 * took(N // 8))


# --- near dedup ---


@pytest.mark.parametrize("share", [0, 0.75, 0.85])
def test_near_duplicates_behind_a_template(spark, share):
    """Pairs of similarity 0.82 to 0.84 among pages of one template, which alone makes others alike by 0.6 and 0.74."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    template, pairs, rows = words(int(400 * share)), 1000, []
    for i in range(pairs):
        one = words(400 - len(template))
        changed = 34 + i % 5
        rows += [(2 * i, " ".join(template + one), "en"), (2 * i + 1, " ".join(template + one[:-changed] + words(changed)), "en")]
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows).repartition(4)).select("doc_id").collect()}
    met = sum(2 * i in kept and 2 * i + 1 not in kept for i in range(pairs))
    wrong = sum(2 * i not in kept for i in range(pairs))
    assert met >= 0.95 * pairs and wrong <= 0.02 * pairs
