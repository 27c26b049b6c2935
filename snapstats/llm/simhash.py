"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits. The anchors are the words of the product code Golay(23) x Golay(23) x {0}^18:
the perfect binary Golay code covers its 23 bits with radius 3, so each fingerprint has exactly one anchor
within radius 3 in both blocks, its home. If x and y differ in t bits or fewer, y is within 3 + e1 and
3 + e2 of x's home in the two blocks, with e1 + e2 <= t. So each distinct fingerprint is replicated to
every anchor within covering radius plus threshold (about 60 of 2^24 for t = 2), and compared there with the
fingerprints at home. Each pair meets at the smaller one's home.

Comparisons must not grow with the square of a dense anchor. An anchor that is home to more than ``DENSE``
distinct fingerprints is refined: its members are dealt to the anchors of the trivial code (all 2^64 words,
radius 0), where two fingerprints that differ in two bits or fewer meet at a word one bit from both. A fine
anchor has 65 members at most. So each replica is compared with ``DENSE`` fingerprints at most.

``keep_one`` links documents whose sets of five-word shingles are alike by 0.8 or more. Its candidates are those that
the anchors find, documents whose fingerprints differ in two bits or fewer, and more: one fingerprint of a
whole document cannot tell all, as at 0.8 about ten of 64 bits differ, and no code covers ten bits with few
anchors. So it takes, too, ``SAMPLES`` fingerprints, each of the ``SAMPLE`` shingles that are least under a hash of
its own; documents with the same sample have the same fingerprint and meet at it (the trivial code, threshold
0). At 0.8 a sample agrees with 0.26, one of 16 with 0.99. Where pages share a template most samples fall into it and
tell nothing of what else two pages share; so some ``FEW`` shingles of a document, those whose hash is least for its
length, are samples of one shingle as well: what only a few pages have, they meet at. Those that meet are compared
with two of the anchor, not with each other: at an anchor of up to ``CROWD`` documents with two that the anchor's
hash draws, so that another shared shingle draws others; at a larger one with the first and last, who are the same at
all anchors of a template or passage. The comparison is by a sketch: the least shingle in each of 512 ranges of a
hash, whose share of agreement is the similarity. Documents with equal samples and sketches are copies; one of them
stands for all. What the anchors find is compared whole: of two fingerprints that differ in two bits or fewer, or of one,
every document with every other. Only what is in one component already is left out, as it could link nothing new;
so a large group of near copies costs no pairs, and documents of one fingerprint that are no near copies cost what
telling them apart takes.

Exact copies collapse to one fingerprint before anything is replicated. Null text: no words, fingerprint
zero, linked like any other. Null key: keeps its row; a component's id is the smallest known key. Repeated
rows are rows of the same component. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import AT, FILE, LOWER, arrow, blocks, frame, keys_of, mix, numbers, placed, sorted_join, split_runs, stored, windows_of, word_ids, words_of
from snapstats.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 2
DENSE = 512

#: Of near-duplicates: words in a shingle and least similarity of the sets of shingles.
WIDTH, SIMILARITY = 5, 0.8
SAMPLES, SAMPLE = 16, 6
#: Shingles of a document that are anchors of their own, about, and documents at an anchor up to which it draws whom to compare with.
FEW, CROWD = 48, 32
#: Ranges of a sketch, and how far an estimate may fall short: 1.3 standard deviations of it at 0.8.
RANGES, SLACK = 512, 0.023

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GENERATOR = 0b101011100011
BLOCK_BITS, CHECK_BITS, RADIUS = 23, 11, 3


def shingles(words: list[bytes], width: int) -> Iterable[bytes]:
    """Runs of ``width`` words, repeats included; of fewer words the whole sequence; of none nothing."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half the shingles' hashes."""
    hashes, cut = [], [0]
    for text in texts:
        found = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text.translate(LOWER).split(), width), repeat(SEED)), np.uint64)
        hashes.append(found)
        cut.append(cut[-1] + len(found))
    out = np.zeros(len(texts), np.uint64)
    n = np.diff(cut)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.array(cut[:-1])[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, at, first, batch in blocks(batches):
            raw = data.tobytes()
            found = fingerprints([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], width)
            yield pa.RecordBatch.from_arrays([keys_of(batch, first, keys), pa.array(found.view(np.int64))], ["key", "fp"])

    return run


def syndrome(block: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word modulo the generator: zero for the words of the code."""
    left = block.astype(np.int64)
    for bit in range(BLOCK_BITS - 1, CHECK_BITS - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - CHECK_BITS)), left)
    return left


@lru_cache
def errors(extra: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the words of weight 3 + extra (for 0: up to 3) with that syndrome, and where each one's begin."""
    weights = range(RADIUS + 1) if extra == 0 else [RADIUS + extra]
    words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(BLOCK_BITS), w)], np.int64)
    of = syndrome(words)
    order = np.argsort(of, kind="stable")
    return words[order], np.searchsorted(of[order], np.arange((1 << CHECK_BITS) + 1))


def _near(block: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, anchor): the code words at radius 3 + extra of each block."""
    words, begin = errors(extra)
    s = syndrome(block)
    n = begin[s + 1] - begin[s]
    which = np.repeat(np.arange(len(block)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[s[which]]
    return which, block[which] ^ words[place]


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << BLOCK_BITS) - 1
    return fp & mask, fp >> BLOCK_BITS & mask


def home(fp: np.ndarray) -> np.ndarray:
    one, two = (_near(x, 0)[1] for x in _blocks(fp))
    return one | two << BLOCK_BITS


def anchors(fp: np.ndarray, threshold: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, anchor): every anchor within covering radius plus threshold, each once."""
    a, b = _blocks(fp)
    for e1 in range(threshold + 1):
        w1, c1 = _near(a, e1)
        for e2 in range(threshold + 1 - e1):
            w2, c2 = _near(b[w1], e2)
            yield w1[w2], c1[w2] | c2 << BLOCK_BITS


def _homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(home(fp)), pa.array(fp)], ["anchor", "fp"])


def _replicas(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(i, 4096).to_numpy()
                for which, anchor in anchors(fp, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[which])], ["anchor", "fp"])

    return run


def links(distinct: DataFrame, threshold: int = BITS, dense: int = DENSE, every: bool = False) -> DataFrame:
    """(a, b), a < b: distinct fingerprints that differ in ``threshold`` bits or fewer.

    At dense anchors as many as connect all such, or with ``every`` all of them there, too.
    """
    if threshold != BITS:
        raise ValueError("the refinement of dense anchors is exact for a threshold of 2")
    homes = arrow(distinct, _homes, "anchor long, fp long")
    replicas = arrow(distinct, _replicas(threshold), "anchor long, fp long")
    crowded = stored(homes.groupBy("anchor").count().where(F.col("count") > dense).select("anchor"))
    refine = bool(crowded.head(1))
    sparse = homes.join(crowded, "anchor", "left_anti") if refine else homes
    near = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= threshold
    met = (F.col("h.anchor") == F.col("r.anchor")) & near & (F.col("h.fp") != F.col("r.fp"))
    found = sparse.alias("h").join(sorted_join(replicas).alias("r"), met).select(F.least("h.fp", "r.fp").alias("a"), F.greatest("h.fp", "r.fp").alias("b"))
    if refine:
        found = found.unionByName(_fine_links(replicas.join(crowded, "anchor", "left_semi").select("fp").distinct(), every))
    return found.distinct()


def _fine_links(members: DataFrame, every: bool) -> DataFrame:
    """Links that connect all members within two bits: a star at each fine anchor, all of whose members are that near, or with ``every`` all its pairs."""
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    at = members.select("fp", F.explode(F.concat(F.array("fp"), one_bit)).alias("fine"))
    met = at.groupBy("fine").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    if every:  # 65 members at most
        return met.select("fps", F.posexplode("fps").alias("nth", "a")).select("a", F.explode(F.slice("fps", F.col("nth") + 2, F.lit(65))).alias("b"))
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = BITS, dense: int = DENSE) -> DataFrame:
    """(key, fp, component): a row for each document; the component is the smallest known key reachable over links."""
    prints = stored(arrow(frame(docs, key=key, text=text), _fingerprint(width), "key long, fp long"))
    least = F.min("key").alias("least")
    distinct = stored(prints.groupBy("fp").agg(least))
    root = components(links(distinct.select("fp"), threshold, dense), "a", "b")
    rooted = distinct.join(sorted_join(root), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.select("fp", "root").join(sorted_join(of_root), "root").select("fp", "component")
    return prints.join(sorted_join(named), "fp").select("key", "fp", "component")


_LOWER = np.frombuffer(LOWER, np.uint8)
_SKETCHED = f"{FILE} long, {AT} long, fp long, samples array<long>, few array<long>, sketch binary"


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted: the distinct shingles of each text, in lower case; of fewer words the whole sequence, of none nothing."""
    data = _LOWER[data]
    start, end, cut = words_of(data, at)
    n = np.diff(cut)
    of_word = word_ids(data, start, end, 11)
    row = np.repeat(np.arange(len(n)), n)
    hashed = windows_of(of_word, width)
    inside = row[: len(hashed)] == row[len(row) - len(hashed) :]
    few = np.flatnonzero((n > 0) & (n < width))
    whole = np.array([windows_of(of_word[cut[i] : cut[i + 1]], int(n[i]))[0] for i in few.tolist()], np.uint64)
    row, hashed = np.concatenate([row[: len(hashed)][inside], few]), np.concatenate([hashed[inside], whole])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = split_runs(row) | split_runs(hashed)
    return row[new], hashed[new]


def sample_prints(row: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
    """For each row the SimHash fingerprints of its ``SAMPLES`` samples; of few shingles all are the sample."""
    out = np.zeros((rows, SAMPLES), np.uint64)
    if not len(row):
        return out
    begin = np.flatnonzero(split_runs(row))
    own = row[begin]
    draw = np.random.default_rng(12).integers(0, 2**64, (SAMPLES, SAMPLE, 2), np.uint64)
    for i in range(SAMPLES):
        least = np.stack([np.minimum.reduceat(mix(hashed * (a | np.uint64(1)) + b), begin) for a, b in draw[i]], 1)
        ones = np.unpackbits(least.view(np.uint8).reshape(len(own), SAMPLE, 8), axis=2, bitorder="little").sum(1)
        out[own, i] = np.packbits(2 * ones > SAMPLE, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def few_shingles(row: np.ndarray, hashed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``FEW`` shingles of each row, and where each row's begin: those below a bound that falls with its number of shingles.

    Of two rows the shorter has the higher bound, so what both have below the lower one, both choose.
    """
    own = mix(hashed ^ np.uint64(0x2545F4914F6CDD1D))
    bound = np.minimum(1.0, FEW / np.maximum(1, np.bincount(row, minlength=rows))) * 2.0**64
    chosen = own.astype(np.float64) < bound[row]
    return own[chosen], np.searchsorted(row[chosen], np.arange(rows + 1))


def sketches(row: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
    """For each row ``RANGES`` bytes: one of the least shingle in the range, 0 if there is none."""
    out = np.zeros((rows, RANGES), np.uint8)
    place = (hashed >> np.uint64(64 - (RANGES.bit_length() - 1))).astype(np.int64)
    first = split_runs(row) | split_runs(place)
    out[row[first], place[first]] = hashed[first] % np.uint64(255) + np.uint64(1)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity of the sets behind two rows of sketches."""
    some = (a > 0) | (b > 0)
    return ((a == b) & some).sum(1) / np.maximum(1, some.sum(1))


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, data, at, first, batch in blocks(batches):
        row, hashed = shingle_sets(data, at)
        prints = sample_prints(row, hashed, len(keys)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, SAMPLES, dtype=np.int32)), pa.array(prints.ravel()))
        few, begin = few_shingles(row, hashed, len(keys))
        fews = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(few.view(np.int64)))
        parts = [x.tobytes() for x in sketches(row, hashed, len(keys))]
        raw = data.tobytes()
        fp = fingerprints([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(keys)), batch.column(AT).slice(first, len(keys)), pa.array(fp), lists, fews, pa.array(parts, pa.binary())], [FILE, AT, "fp", "samples", "few", "sketch"])


def _verified(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                one, two = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("one", "two"))
                near = pa.array(alike(one, two) >= least)
                yield pa.RecordBatch.from_arrays([some.column("a").filter(near), some.column("b").filter(near)], ["a", "b"])

    return run


def each_with_each(prints: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b): for each row (a, b) of ``met``, two fingerprints or twice the same, every key of one with every key of the other.

    ``prints`` has key and fp. Where it has root, too, the component so far, keys of one root are not paired: the components of a
    fingerprint are, and only those that differ are opened, so no more rows are made than there are pairs to compare.
    """
    members = prints if "root" in prints.columns else prints.withColumn("root", F.col("key"))
    parts = members.select("fp", "root").distinct()
    apart = F.when(F.col("a") == F.col("b"), F.col("root_a") < F.col("root_b")).otherwise(F.col("root_a") != F.col("root_b"))
    for k in "ab":
        met = met.join(sorted_join(parts.select(F.col("fp").alias(k), F.col("root").alias(f"root_{k}"))), k)
    met = met.where(apart)
    for k in "ab":
        met = met.join(sorted_join(members.select(F.col("fp").alias(k), F.col("root").alias(f"root_{k}"), F.col("key").alias(f"key_{k}"))), [k, f"root_{k}"])
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def anchor_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): of every two fingerprints that differ by one or two bits each key of one with each key of the other.

    ``prints`` has key and fp, and may have root, see ``each_with_each``. Two that have one key each are paired as they are.
    """
    own = stored(prints.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    met = links(own.select("fp"), every=True)
    for k in "ab":
        met = met.join(sorted_join(own.select(F.col("fp").alias(k), F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}"))), k)
    met, alone = stored(met), F.greatest("n_a", "n_b") == 1
    return met.where(alone).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).unionByName(each_with_each(prints, met.where(~alone).select("a", "b")))


def similar(rows: DataFrame, ids: DataFrame, *, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(place, key, root): the numbers of ``placed`` rows, and the least number among all that links reach."""
    texts = rows.select(F.col(FILE).alias("key"), AT, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = stored(arrow(texts, _sketched, _SKETCHED).join(sorted_join(ids), [FILE, AT]).withColumn("print", F.md5(F.concat(F.array_join("samples", ","), F.hex("sketch")))))
    copies = stored(known.groupBy("print").agg(F.min("key").alias("rep")))
    reps = stored(known.join(sorted_join(copies), "print").where("key = rep").select("key", "fp", "samples", "few", "sketch"))
    at = reps.select("key", F.posexplode("samples").alias("nth", "sample")).unionByName(reps.select("key", F.lit(SAMPLES).alias("nth"), F.explode("few").alias("sample")))
    at = at.unionByName(reps.select("key", F.lit(SAMPLES + 1).alias("nth"), F.col("fp").alias("sample")))  # equal fingerprints
    drawn = F.xxhash64("key", "sample")
    ends = at.groupBy("nth", "sample").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.min_by("key", drawn).alias("one"), F.max_by("key", drawn).alias("two"))
    crowd = F.col("n") > CROWD
    # written, so that adaptive execution can split the join where a sample is that of a third of all rows
    ends = stored(ends.where("n > 1").select("nth", "sample", F.when(crowd, F.col("low")).otherwise(F.col("one")).alias("low"), F.when(crowd, F.col("high")).otherwise(F.col("two")).alias("high")))
    met = at.join(sorted_join(ends), ["nth", "sample"]).select(F.col("key").alias("b"), F.explode(F.array("low", "high")).alias("a")).where("a <> b")
    one, two = (sorted_join(reps.select(F.col("key").alias(k), F.col("sketch").alias(name))) for k, name in (("a", "one"), ("b", "two")))

    def alike_of(met: DataFrame) -> DataFrame:
        pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two"), _verified(similarity - SLACK), "a long, b long")

    root = components(alike_of(met), "a", "b")
    prints = stored(reps.select("key", "fp").join(sorted_join(root), F.col("key") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "key").alias("root")))
    same = prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    found = alike_of(anchor_pairs(prints).unionByName(each_with_each(prints, same)))  # two bits apart or fewer: all of them
    for k in "ab":
        found = found.join(sorted_join(prints.select(F.col("key").alias(k), F.col("root").alias(f"root_{k}"))), k)
    joint = components(found, "root_a", "root_b").select("node", F.col("root").alias("joint"))  # of components
    root = prints.join(sorted_join(joint), F.col("root") == F.col("node"), "left").select(F.col("key").alias("node"), F.coalesce("joint", "root").alias("root"))
    named = known.select(FILE, AT, "key", "print").join(sorted_join(copies), "print").join(sorted_join(root), F.col("rep") == F.col("node"), "left")
    return named.select(FILE, AT, "key", F.coalesce("root", "rep").alias("root"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest key, with the columns of ``docs``.

    Similarity is that of the sets of five-word shingles. Rows without a key come last; rows that share a key
    or have none follow the order of their places, and each is a document of its own. Texts without a word
    are alike.
    """
    rows = placed(docs)
    ids = numbers(rows.select(FILE, AT, F.col(f"`{key}`").cast("long").alias("by")), F.col("by").asc_nulls_last())
    kept = similar(rows, ids, text=text, similarity=similarity).where("key = root").select(FILE, AT)
    whole = rows.select(FILE, AT, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(sorted_join(kept), [FILE, AT], "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
