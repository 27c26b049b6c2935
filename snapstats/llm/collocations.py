"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and words. The nodes of the graph are runs of three words of one language, its edges runs of
four, weighted by how often they occur: an edge leads from its first three words to its last three. A run that ends
a piece goes on nowhere, so its node gets an edge to the end, the piece-end correction. Everything shorter is flow: a
run of three occurs as often as edges leave its node; a run of two as often as flow leaves the runs of three that
begin with it, plus how often it ends a piece; a word likewise.

Two passes read the texts. The first counts words; one of them in fewer than ``least`` places is in no phrase, so for the
graph it ends a piece as punctuation does. Tasks tell such words by a bitmap of a fixed 2 MB that is broadcast: a rare word
whose bit is set costs some edges and changes no result.

A task aggregates the edges of a million words and their flow before it sends them, so a passage in a third of all
documents arrives once a batch. Edges are dealt by node, pairs by pair, words by word: a hot pair's edges are
spread over its nodes, and its own count arrives as partial sums. On the wire a batch has a dictionary of the words it
uses, and numbers into it. Where edges meet, a node with one edge only is compacted into it: it leaves no row of its
own, as the edge has its weight. Only runs that occur ``least`` times leave this step; the rest (scores, containment,
ranks) are joins and windows over these in the JVM.

Words are ids of (language, word) on the way, checked to be unique; their texts come from one row a frequent word. Scores are whole
numbers by decimals of 38 digits, so nothing overflows. The first ``top`` of a language are taken by a window whose
rows Spark cuts to ``top`` a task before it shuffles them.

Null and empty texts have no words. Null language: ``und``, together with that name. Repeated rows count each. A very
long text is a batch of its own. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapstats.llm.common import LOWER, _spans, arrow, blocks, bucketwise, mix, pack_ints, pack_sorted, paired, split_runs, stored, to_buckets, unpack_ints, unpack_sorted, word_ids, words_of

ORDER, LEAST, TOP = 4, 30, 2000
#: How much a longer phrase may take of a shorter one's occurrences, as a fraction: 80 of 100.
TAKEN = (80, 100)
NO_LANG = "und"
#: Words that a task holds before it sends them, and bytes of input for each bucket: with few buckets a dictionary serves many edges.
HELD, BUCKET = 1_000_000, 16 << 20
#: Stands for the end of a piece; no word has it.
END = 0
#: Bits of an id. The word pass fails if two words share one, so a result never mixes words.
ID_BITS = 56
#: Bits of the map of words that occur often enough.
MAP_BITS = 1 << 24

#: What parts pieces, and what parts words.
PIECE = np.zeros(256, bool)
PIECE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
GAP = PIECE.copy()
GAP[[9, 32]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)

_WORDS = "bucket int, ids binary, n binary, lang binary, langs array<string>, texts array<binary>"
#: Words that occur often enough; without an id and a text, how many words a language has.
_NAMED = "w long, lang string, text string, n long"
_SENT = "bucket int, kind int, words binary, a binary, b binary, c binary, d binary, n binary"
#: Runs of a size, 0 for words that are not there; ``alone`` marks an edge that is all of its node.
_COUNTED = "size int, w1 long, w2 long, w3 long, w4 long, n long, alone boolean"


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, start and end of each word, and how many words of its piece are left, itself included."""
    data = _LOWER[data]
    start, end, cut = words_of(np.where(GAP[data], np.uint8(32), data), at)
    breaks = np.concatenate([[0], np.cumsum(PIECE[data])])
    of_row = np.repeat(np.arange(len(at) - 1), np.diff(cut))
    piece = breaks[start] + of_row  # grows with every break and every row
    new = np.flatnonzero(split_runs(piece)) if len(piece) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(piece)))
    left = np.repeat(new + size, size) - np.arange(len(piece))
    return data, start, end, left


def _ids(batch: pa.RecordBatch, first: int, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-case bytes; of each word its start, end, row, how many are left in its piece, and its id, which tells languages apart; the languages of the rows."""
    langs = [x if x is not None else NO_LANG for x in batch.column("lang").slice(first, len(at) - 1).to_pylist()]
    salt = np.array([xxhash.xxh3_64_intdigest(x, 5) for x in langs], np.uint64)
    data, start, end, left = pieces(data, at)
    of = np.searchsorted(at, start, "right") - 1
    ids = np.maximum(mix(word_ids(data, start, end, 11) ^ salt[of]) >> np.uint64(64 - ID_BITS), END + 1)
    return data, start, end, of, left, ids, langs


def _words(n_buckets: int):
    shift = np.uint64(ID_BITS - (n_buckets.bit_length() - 1))

    def sent(held: list[tuple]) -> pa.RecordBatch:
        ids, where, n = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
        block = np.searchsorted(np.cumsum([len(x[0]) for x in held]), where, "right")
        where = where - np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])[block]
        langs: dict[str, int] = {}
        texts, lang = [], np.zeros(len(ids), np.int64)
        for i, (b, w) in enumerate(zip(block.tolist(), where.tolist())):
            _, raw, start, end, of, names = held[b]
            texts.append(raw[start[w] : end[w]])
            lang[i] = langs.setdefault(names[of[w]], len(langs))
        bucket = (ids >> shift).astype(np.int32)  # in order, as the ids are
        at = np.flatnonzero(split_runs(bucket))
        spans = list(zip(at.tolist(), [*at[1:].tolist(), len(ids)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[at]),
                pa.array([pack_sorted(ids[i:j]) for i, j in spans], pa.binary()),
                pa.array([pack_ints(n[i:j]) for i, j in spans], pa.binary()),
                pa.array([pack_ints(lang[i:j]) for i, j in spans], pa.binary()),
                pa.array([list(langs)] * len(spans), pa.list_(pa.string())),
                pa.array([texts[i:j] for i, j in spans], pa.list_(pa.binary())),
            ],
            ["bucket", "ids", "n", "lang", "langs", "texts"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, data, at, first, batch in blocks(batches):
            data, start, end, of, _, ids, langs = _ids(batch, first, data, at)
            if len(ids):
                held.append((ids, data.tobytes(), start, end, of, langs))
                n += len(ids)
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    return run


def _named(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in bucketwise(batches):
            ids, n, lang, texts, names = [], [], [], [], {}
            for batch in some:
                for i in range(batch.num_rows):
                    own = batch.column("langs")[i].as_py()
                    number = np.array([names.setdefault(x, len(names)) for x in own])
                    ids.append(unpack_sorted(batch.column("ids")[i].as_py()))
                    n.append(unpack_ints(batch.column("n")[i].as_py()))
                    lang.append(number[unpack_ints(batch.column("lang")[i].as_py())])
                    texts += batch.column("texts")[i].as_py()
            ids, n, lang = np.concatenate(ids), np.concatenate(n), np.concatenate(lang)
            totals = np.bincount(lang, n, len(names)).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            begin = np.flatnonzero(split_runs(ids[order]))
            for i in np.setdiff1d(np.arange(len(ids)), begin).tolist():
                if texts[order[i]] != texts[order[i - 1]] or lang[order[i]] != lang[order[i - 1]]:
                    raise RuntimeError("two words have the same id: take another seed for word_ids")
            sums = np.add.reduceat(n[order], begin)
            first = order[begin][sums >= least]
            listed = list(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids[first].view(np.int64).tolist(), *[None] * len(listed)], pa.int64()),
                    pa.array([*(listed[i] for i in lang[first].tolist()), *listed], pa.string()),
                    pa.array([*(texts[i].decode() for i in first.tolist()), *[None] * len(listed)], pa.string()),
                    pa.array([*sums[sums >= least].tolist(), *totals.tolist()], pa.int64()),
                ],
                ["w", "lang", "text", "n"],
            )

    return run


def _slot(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(MAP_BITS - 1)).astype(np.int64)


def often_map(words: DataFrame) -> np.ndarray:
    """A bit for each word of ``words``, by the low bits of its id; what is collected are MAP_BITS / 64 pairs of numbers at most."""
    slot = F.col("w").bitwiseAND(F.lit(MAP_BITS - 1))
    rows = words.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _grouped(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows that are equal in all columns as one, in an order in which those that share the first ones stand together; its sums; a hash of the columns but the last."""
    node = columns[0]
    for i, x in enumerate(columns[1:-1]):
        node = paired(node, x, i + 1)
    order = np.lexsort((columns[-1], node)) if len(columns) > 1 else np.argsort(node, kind="stable")
    columns, node = [x[order] for x in columns], node[order]
    new = split_runs(columns[0])
    for x in columns[1:]:
        new |= split_runs(x)
    begin = np.flatnonzero(new)
    return [x[begin] for x in columns], np.add.reduceat(n[order], begin) if len(begin) else n[:0], node[begin]


def _message(kind: int, n_buckets: int, columns: list[np.ndarray], n: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket."""
    if not len(n):
        return
    order, which, spans = _spans((mix(node ^ np.uint64(kind)) >> np.uint64(64 - (n_buckets.bit_length() - 1))).astype(np.int32))
    columns, n = [x[order] for x in columns], n[order]
    out: dict[str, list] = {x: [] for x in ("words", "a", "b", "c", "d", "n")}
    for i, j in spans:
        own = [x[i:j] for x in columns]
        words, place = np.unique(np.concatenate(own), return_inverse=True)
        place = place.reshape(len(own), -1)
        place = place[:, by := np.argsort(place[0], kind="stable")]  # the first column has small steps then
        out["words"].append(pack_sorted(words))
        for name, x in zip("abcd", [*place, *[None] * (4 - len(own))]):
            out[name].append(b"" if x is None else pack_ints(x, name == "a"))
        out["n"].append(pack_ints(n[i:j][by]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(which), pa.array(np.full(len(which), kind, np.int32)), *(pa.array(x, pa.binary()) for x in out.values())], ["bucket", "kind", *out]
    )


def _flow(ids: np.ndarray, left: np.ndarray, size: int, more: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of ``size`` words as flow: the runs one longer without their last word, and those that end a piece."""
    ends = np.flatnonzero(left == size)
    return [np.concatenate([x, ids[ends + i]]) for i, x in enumerate(more[:size])], np.concatenate([n, np.ones(len(ends), np.int64)])


def _send(ids: np.ndarray, left: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    full = np.flatnonzero(left >= ORDER)
    edges, n, _ = _grouped([ids[full + i] for i in range(ORDER)], np.ones(len(full), np.int64))
    # the piece-end correction of a node is an edge to the end
    ends = np.flatnonzero(left == ORDER - 1)
    stops, m, _ = _grouped([ids[ends + i] for i in range(ORDER - 1)], np.ones(len(ends), np.int64))
    edges, n = [np.concatenate([x, y]) for x, y in zip(edges, [*stops, np.full(len(m), END, np.uint64)])], np.concatenate([n, m])
    edges, n, node = _grouped(edges, n)
    yield from _message(4, n_buckets, edges, n, node)
    pairs, n, _ = _grouped(*_flow(ids, left, 2, edges, n))
    yield from _message(2, n_buckets, pairs, n, paired(pairs[0], pairs[1], 9))
    words, n, node = _grouped(*_flow(ids, left, 1, pairs, n))
    yield from _message(1, n_buckets, words, n, node)


def _edges(n_buckets: int, shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held, n = shared.value, [], 0
        for _, data, at, first, batch in blocks(batches):
            *_, left, ids, _ = _ids(batch, first, data, at)
            slot = _slot(ids)
            keep = (often[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            piece = np.cumsum(np.append(True, (left[:-1] == 1) | ~keep[:-1]))[keep] if len(ids) else left
            size = np.bincount(piece)[piece]
            nth = np.arange(len(piece)) - np.flatnonzero(split_runs(piece))[np.cumsum(split_runs(piece)) - 1] if len(piece) else piece
            held.append((ids[keep], size - nth))
            n += len(piece)
            if n >= HELD:
                yield from _send(*map(np.concatenate, zip(*held)), n_buckets)
                held, n = [], 0
        if n:
            yield from _send(*map(np.concatenate, zip(*held)), n_buckets)

    return run


def _received(some: list[pa.RecordBatch], kind: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    columns, sums = [[np.zeros(0, np.uint64)] for _ in range(size)], [np.zeros(0, np.int64)]
    for batch in some:
        kinds = batch.column("kind").to_pylist()
        for i in (i for i, k in enumerate(kinds) if k == kind):
            words = unpack_sorted(batch.column("words")[i].as_py())
            for parts, name in zip(columns, "abcd"):
                parts.append(words[unpack_ints(batch.column(name)[i].as_py(), name == "a")])
            sums.append(unpack_ints(batch.column("n")[i].as_py()))
    return [np.concatenate(x) for x in columns], np.concatenate(sums)


def _count(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in bucketwise(batches):
            edges, n, _ = _grouped(*_received(some, 4, 4))
            if len(n):
                new = split_runs(edges[0]) | split_runs(edges[1]) | split_runs(edges[2])
                begin = np.flatnonzero(new)
                flow = np.add.reduceat(n, begin)
                single = np.diff(np.append(begin, len(n))) == 1
                compact = single & (edges[3][begin] != END)
                alone = np.zeros(len(n), bool)
                alone[begin[compact]] = True
                yield _runs([x for x in edges], n, (n >= least) & (edges[3] != END), alone)
                yield _runs([x[begin] for x in edges[:3]], flow, (flow >= least) & ~compact)
            pairs, n, _ = _grouped(*_received(some, 2, 2))
            yield _runs(pairs, n, n >= least)
            words, n, _ = _grouped(*_received(some, 1, 1))
            yield _runs(words, n, n >= least)

    return run


def _runs(columns: list[np.ndarray], n: np.ndarray, keep: np.ndarray, alone: np.ndarray | None = None) -> pa.RecordBatch:
    at = np.flatnonzero(keep)
    words = [pa.array(x[at].view(np.int64)) for x in columns] + [pa.array(np.zeros(len(at), np.int64))] * (4 - len(columns))
    whole = pa.array(np.zeros(len(at), bool) if alone is None else alone[at])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), len(columns), np.int32)), *words, pa.array(n[at]), whole], ["size", "w1", "w2", "w3", "w4", "n", "alone"])


def counted(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(w, lang, text, n): words that occur ``least`` times, and a row without a word for each language with all its words; and
    (size, w1, w2, w3, w4, n, alone): runs of one to four words that do; runs of three that one edge has whole are in that edge."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_buckets = min(1 << (max(64, size // BUCKET) - 1).bit_length(), 1 << 16)
    narrow = docs.select(F.lit(0).cast("long").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = stored(arrow(to_buckets(arrow(narrow, _words(n_buckets), _WORDS)), _named(least), _NAMED))
    shared = docs.sparkSession.sparkContext.broadcast(often_map(words.where("w IS NOT NULL")))
    runs = stored(arrow(to_buckets(arrow(narrow, _edges(n_buckets, shared), _SENT)), _count(least), _COUNTED))
    shared.destroy()
    return words, runs


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, taken: tuple[int, int] = TAKEN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    named, runs = counted(docs, lang=lang, text=text, least=least)
    totals = named.where("w IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    words = named.where("w IS NOT NULL").select("w", "lang", "text")
    no = F.lit(0).cast("long")
    # compacted nodes are read from their edges
    within = runs.where("size = 4 and alone").select(F.lit(3).alias("size"), "w1", "w2", "w3", no.alias("w4"), "n")
    every = runs.select("size", "w1", "w2", "w3", "w4", "n").unionByName(within)
    phrases, shorter = every.where("size > 1"), every.where("size < 4").select("w1", "w2", "w3", "n")

    w = [F.col(f"w{i}") for i in range(1, 5)]

    def part(first: int, count: int, prefix: str):
        """A run of words of a phrase as three columns."""
        return [(w[first + i] if i < count else no).alias(f"{prefix}{i + 1}") for i in range(3)]

    def piece(size: int, first: int, count: int):
        return F.struct(*part(first, count, "w"))

    cuts = {m: [F.struct(F.lit(k).alias("k"), piece(m, 0, k).alias("one"), piece(m, k, m - k).alias("two")) for k in range(1, m)] for m in (2, 3, 4)}
    each = F.explode(F.when(F.col("size") == 2, F.array(*cuts[2])).when(F.col("size") == 3, F.array(*cuts[3])).otherwise(F.array(*cuts[4])))
    cut = phrases.select("size", *w, F.col("n").alias("a"), each.alias("cut")).select("size", *w, "a", "cut.k", *[F.col(f"cut.{x}.w{i}").alias(f"{x}{i}") for x in ("one", "two") for i in (1, 2, 3)])
    for name, count in (("one", "l"), ("two", "r")):
        side = shorter.select(*[F.col(f"w{i}").alias(f"{name}{i}") for i in (1, 2, 3)], F.col("n").alias(count))
        cut = cut.join(side, [f"{name}{i}" for i in (1, 2, 3)])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    scored = cut.withColumn("score", score).groupBy("size", "w1", "w2", "w3", "w4", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    # what a longer phrase takes, of each phrase inside it
    inside = {3: [(i, 2) for i in range(2)], 4: [(i, 3) for i in range(2)] + [(i, 2) for i in range(3)]}
    subs = {m: F.array(*[piece(m, i, c) for i, c in spans]) for m, spans in inside.items()}
    longer = phrases.where("size > 2").select("n", F.explode(F.when(F.col("size") == 3, subs[3]).otherwise(subs[4])).alias("s"))
    most = longer.groupBy("s.w1", "s.w2", "s.w3").agg(F.max("n").alias("most"))
    part_of, whole = taken
    kept = scored.join(most.withColumn("w4", no), ["w1", "w2", "w3", "w4"], "left").where(F.coalesce(whole * F.col("most") < part_of * F.col("a"), F.lit(True)))

    # only words that some candidate has are looked up, one row a word of a phrase
    spelled = kept.withColumn("phrase_id", F.struct("w1", "w2", "w3", "w4")).select("phrase_id", "a", "best", F.posexplode(F.slice(F.array(*w), 1, F.col("size"))).alias("nth", "w"))
    spelled = spelled.join(words, "w").groupBy("phrase_id", "a", "best", "lang").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("parts"))
    spelled = spelled.select("lang", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_de_bruijn(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH p AS (
  SELECT doc_id, coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, ws[i:i + m - 1] AS ws FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, ws, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {LEAST}),
s AS (
  SELECT c.lang, c.m, c.ws, c.a, k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:c.m]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
sub AS (SELECT lang, ws[i:i + h - 1] AS ws, max(a) AS most FROM (SELECT c.*, h, unnest(range(1, m - h + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS h) WHERE h < m) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.ws, ' ') AS phrase FROM best LEFT JOIN sub USING (lang, ws) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
