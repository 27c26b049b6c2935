"""The pipeline's near-dedup goes through the anchors."""

import random
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

from snapstats.llm import simhash


def test_anchor_pairs_are_those_within_two_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(40)]
    prints = [(k, f) for k, f in enumerate(base)]
    for f in base:
        for bits in (0, 1, 2, 3):
            prints.append((len(prints), f ^ sum(1 << b for b in r.sample(range(63), bits))))
    r.shuffle(prints)
    got = {(min(x), max(x)) for x in simhash.anchor_pairs(spark.createDataFrame(prints, "key long, fp long")).collect()}
    keys: dict = {}
    for k, f in prints:
        keys.setdefault(f, []).append(k)
    want = {(min(x, y), max(x, y)) for f, g in combinations(keys, 2) if (f ^ g).bit_count() <= 2 for x in {min(keys[f]), max(keys[f])} for y in {min(keys[g]), max(keys[g])}}
    assert got == want and len(want) > 80


def test_near_dedup_compares_what_meets_at_anchors(spark, monkeypatch):
    """Near copies whose fingerprints differ by one or two bits are candidates by them."""
    r = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(900)]
        texts += [words, [*words[:-1], "other"]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    near = [(bin(int(simhash.fingerprints([" ".join(texts[i]).encode()])[0]) ^ int(simhash.fingerprints([" ".join(texts[i + 1]).encode()])[0])).count("1")) for i in range(0, 24, 2)]
    asked, real = [], simhash.anchor_pairs
    monkeypatch.setattr(simhash, "anchor_pairs", lambda prints: asked.append(real(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().count()) or real(prints))
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert kept == set(range(0, 24, 2)) and asked == [sum(0 < n <= 2 for n in near)] and asked[0] > 3


def _near(prints):
    return {(min(x, y), max(x, y)) for (x, f), (y, g) in combinations(prints, 2) if 0 < (f ^ g).bit_count() <= 2}


def test_keys_between_the_first_and_the_last_are_paired(spark):
    """Of fingerprints that several documents share, and at dense anchors, too."""
    f = 0x5A5A5A5A5A5A5A5
    prints = [(k, f ^ (0, 1, 6, 1 << 40)[k % 4]) for k in range(24)]
    got = [(min(x), max(x)) for x in simhash.anchor_pairs(spark.createDataFrame(prints, "key long, fp long")).collect()]
    assert sorted(got) == sorted(_near(prints)) and len(got) > 100
    roots = [(k, f, k // 8) for k, f in prints]  # those of one component need no comparison
    got = [(min(x), max(x)) for x in simhash.anchor_pairs(spark.createDataFrame(roots, "key long, fp long, root long")).collect()]
    assert sorted(got) == sorted((x, y) for x, y in _near(prints) if x // 8 != y // 8)


def test_every_pair_at_a_dense_anchor(spark):
    r = random.Random(8)
    prints = {(k, (1 << 50) ^ (sum(1 << b for b in r.sample(range(46, 63), 2)))) for k in range(80)}
    distinct = spark.createDataFrame([(f,) for f in {f for _, f in prints}], "fp long")
    want = {(a, b) for a, b in combinations(sorted({f for _, f in prints}), 2) if (a ^ b).bit_count() <= 2}
    got = [tuple(x) for x in simhash.links(distinct, dense=8, every=True).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200
    assert len(simhash.links(distinct, dense=8).collect()) < len(want)


def test_near_dedup_compares_all_that_share_a_fingerprint(spark, monkeypatch):
    """A passage that is repeated gives all documents one fingerprint; only neighbours by number are alike, and only the anchors find them."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(9)] * 40
    texts = []
    for _ in range(8):
        tail = [f"w{r.randrange(10**6)}" for _ in range(120)]
        texts += [passage + tail, passage + tail[:-1] + ["other"]]
    r.shuffle(texts)
    texts = [" ".join(x) for x in texts]
    prints = simhash.fingerprints([x.encode() for x in texts]).tolist()
    assert max(prints.count(f) for f in prints) > 8
    real = simhash._sketched

    def without_samples(batches):
        for batch in real(batches):
            own = batch.column(simhash.AT).to_pylist()
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["samples"] = pa.array([[k] for k in own], pa.list_(pa.int64()))
            columns["few"] = pa.array([[] for _ in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    monkeypatch.setattr(simhash, "_sketched", without_samples)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.keep_one(docs).collect())
    tails = [x.split()[360] for x in texts]
    assert kept == sorted(tails.index(t) for t in set(tails))
