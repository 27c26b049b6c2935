"""Benchmark passages in training text, found with an FM-index of each training shard.

A shard is up to 2 MB of whole documents. Its words become symbols: those that occur in the test
items keep a number, all others are one separator, which no phrase contains. Runs of test words too short
for any phrase can't hold one and are left out; the rest is indexed. All phrases of the test set step
backwards through the shard's wavelet ranks together; their occurrences come from sampled suffix positions,
and the spans merge per document.

The test set, not the corpus, is what is broadcast, as arrays of numbers: a hash for each distinct word, a
number for each word of a phrase, and the items of each phrase. Tasks turn the items into word hashes and cut
long ones where their pieces overlap by a word less than a window; a block is a bounded number of words, whatever
the items are, so its arrays stay below some 40 MB; the driver and a worker hold one block at a time. With one
block nothing but the items is shuffled. With more, the documents are scanned once for each, only the rows with
hits are kept, and those are joined by place.

Null or empty text: no words, no hits. Items without a word never occur; an item that repeats counts once.
Items without an id are one item, which counts and has no place in the digest of ids. Repeated documents each get
their own row. An empty test set leaves everything clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from snapstats.llm.common import AT, FILE, arrow, blocks, few_rows, frame, numbers, placed, stored, word_ids, words_of
from snapstats.llm.fmindex import FMIndex

WINDOW = 10
#: Words of test items in one broadcast.
AT_ONCE = 700_000
#: Messages of words of test items in one broadcast, each a row that a task has filled.
MESSAGES = 16
#: Fixed value: the bytes of a word are digits, letters and all beyond ASCII; A-Z count as a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of whole texts in one index.
SHARD = 2 << 20
_FOUND = StructType().add("n_words", "long").add("spans", "binary").add("items", ArrayType(StringType()))


_WORDS = np.frombuffer(WORD_BYTES, np.uint8)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the words before each row."""
    data = _WORDS[data]
    start, end, cut = words_of(data, at)
    return word_ids(data, start, end, 10), cut


@dataclass
class Phrases:
    """The windows of a block of test items: the hashes of their words in order; by length, the symbols of each distinct one and the items that have it.

    A word's symbol is its place among the hashes, from 1. The items of phrase i are ``of[begin[i] : begin[i + 1]]``.
    """

    known: np.ndarray
    names: list[str | None]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], width: int = WINDOW) -> Phrases:
        """From (item, the hashes of its words or of a piece of them)."""
        names = sorted({item for item, _ in items}, key=lambda x: (x is None, x or ""))
        number = {item: i for i, item in enumerate(names)}
        owner = np.array([number[item] for item, _ in items], np.int64)
        cut = np.concatenate([[0], np.cumsum([len(words) // 8 for _, words in items])]).astype(np.int64)
        hashed = np.frombuffer(b"".join(words for _, words in items), np.uint64)
        known, place = np.unique(hashed, return_inverse=True)
        symbol, n, by_length = (place + 1).astype(np.int32), np.diff(cut), {}
        for length in (x for x in np.unique(np.minimum(n, width)).tolist() if x):
            rows = np.flatnonzero(np.minimum(n, width) == length)
            each = n[rows] - length + 1
            start = np.repeat(cut[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
            phrases, which = np.unique(symbol[start[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * len(names) + np.repeat(owner[rows], each))
            begin = np.searchsorted(pairs // len(names), np.arange(len(phrases) + 1))
            by_length[length] = (phrases, begin, (pairs % len(names)).astype(np.int32))
        return cls(known, names, by_length)

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for those that no item has."""
        if not len(self.known):
            return np.zeros(len(hashed), np.int32)
        place = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return np.where(self.known[place] == hashed, place + 1, 0).astype(np.int32)

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def _runs(symbols: np.ndarray, cut: np.ndarray, shortest: int) -> np.ndarray:
    """Which words are in a run of test words, within a document, that is long enough for a phrase."""
    known = symbols > 0
    new = np.zeros(len(symbols) + 1, bool)
    new[cut] = True
    begin = known & (new[:-1] | np.concatenate([[True], ~known[:-1]])) if len(symbols) else known
    run = np.cumsum(begin) - 1
    if not begin.any():
        return np.zeros(len(symbols), bool)
    length = np.bincount(run[known], minlength=int(begin.sum()))
    return known & (length[np.maximum(run, 0)] >= shortest)


def _merge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union of spans; those that touch become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1) if len(start) else np.zeros((0, 2), np.int64)


def _shard(phrases: Phrases, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """For each text: its words, the word spans of all occurrences, the items that occur."""
    hashed, cut = word_hashes(data, at)
    symbols, rows = phrases.symbols(hashed), len(at) - 1
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * rows
    items: list[list[str]] = [[]] * rows
    kept = np.flatnonzero(_runs(symbols, cut, phrases.shortest)) if phrases.by_length else np.zeros(0, np.int64)
    if not len(kept):
        return np.diff(cut), spans, items
    doc = np.searchsorted(cut, kept, "right") - 1
    gap = np.ones(len(kept), bool)
    gap[1:] = (np.diff(kept) > 1) | (np.diff(doc) > 0)
    place = np.arange(len(kept)) + np.cumsum(gap)  # a separator before each run
    separator = len(phrases.known) + 1
    text = np.full(place[-1] + 1, separator, np.int64)
    text[place] = symbols[kept]
    back = np.zeros(len(text), np.int64)
    back[place] = np.arange(len(kept))
    index = FMIndex(text, separator)
    found: list[tuple[np.ndarray, ...]] = []
    owners: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (patterns, begin, of) in phrases.by_length.items():
        which, at_ = index.occurrences(patterns)
        at_ = back[at_]
        start = kept[at_] - cut[doc[at_]]
        found.append((doc[at_], start, start + n))
        size = begin[which + 1] - begin[which]
        owners.append((np.repeat(doc[at_], size), of[np.repeat(begin[which] - np.cumsum(size) + size, size) + np.arange(size.sum())]))
    of_row, start, end = (np.concatenate(x) for x in zip(*found))
    own, item = (np.concatenate(x) for x in zip(*owners))
    pairs = np.unique(own * len(phrases.names) + item)
    order = np.argsort(of_row, kind="stable")
    start, end = start[order], end[order]
    hit, begin = np.unique(of_row[order], return_index=True)
    for row, i, j in zip(hit.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        spans[row] = _merge(start[i:j], end[i:j])
        some = slice(*np.searchsorted(pairs, [row * len(phrases.names), (row + 1) * len(phrases.names)]))
        items[row] = [phrases.names[i] for i in (pairs[some] % len(phrases.names)).tolist()]
    return np.diff(cut), spans, items


def _search(shared, hits_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in few_rows(batches, SHARD):
            counts, spans, items = _shard(phrases, *next((data, at) for _, data, at, _, _ in blocks([batch], 1 << 62)))
            found = [pa.array(counts, pa.int64()), pa.array([s.tobytes() for s in spans], pa.binary()), pa.array(items, pa.list_(pa.string()))]
            rest = [x for x in batch.schema.names if not hits_only or x != "text"]
            out = pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), *found], [*rest, "n_words", "spans", "items"])
            yield out.filter(pa.array([len(s) > 0 for s in spans])) if hits_only else out

    return run


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of all blocks of a row as one list."""
    for batch in batches:
        spans = [np.frombuffer(b"".join(s), np.int64).reshape(-1, 2) if s else np.zeros((0, 2), np.int64) for s in batch.column("spans").to_pylist()]
        at = batch.schema.names.index("spans")
        yield batch.set_column(at, "spans", pa.array([_merge(s[:, 0], s[:, 1]).tobytes() for s in spans], pa.binary()))


def _item_words(window: int, most: int):
    """Each item's word hashes, in pieces of at most ``most`` words; every window lies in exactly one piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            names, words = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                hashed, _ = word_hashes(data, np.array([0, len(data)]))
                for i in range(0, max(1, len(hashed) - window + 1), most - window + 1):
                    names.append(item)
                    words.append(hashed[i : i + most].tobytes())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], ["item", "words"])
            yield out.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))

    return run


def _messages(most: int):
    """Rows of several items, ``most`` words each at the most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str | None] = []
        words: list[bytes] = []
        n = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary()))], ["items", "words"])

        for batch in batches:
            for item, own in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                if n and n + len(own) // 8 > most:
                    yield full()
                    names, words, n = [], [], 0
                names.append(item)
                words.append(own)
                n += len(own) // 8
        if n:
            yield full()

    return run


def _test_blocks(tests: DataFrame, window: int, at_once: int) -> list[DataFrame]:
    """The pieces of all items as frames of (items, words), each of at most ``at_once`` words and ``MESSAGES`` rows; equal pieces of an item are one."""
    most = max(2 * window, at_once // MESSAGES)
    pieces = arrow(tests, _item_words(window, most), "item string, words binary").distinct()
    rows = "items array<string>, words array<binary>"
    n = pieces.agg(F.sum(F.length("words")) / 8).head()[0] or 0
    if n <= at_once:
        return [arrow(pieces, _messages(at_once), rows)]
    held = placed(stored(arrow(pieces, _messages(most), rows)))
    held = stored(held.join(numbers(held.select(FILE, AT)), [FILE, AT]).drop(FILE, AT))
    each = max(1, at_once // most)
    return [held.where(F.col("key").between(i, i + each - 1)) for i in range(0, held.count(), each)]


def found_phrases(docs: DataFrame, tests: DataFrame, *more, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, at_once: int = AT_ONCE) -> DataFrame:
    """(key, text, *more, n_words, spans, items) of each document; spans are pairs of packed 64-bit word numbers, end exclusive."""
    spark = docs.sparkSession
    tests = tests.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    parts = _test_blocks(tests, window, at_once)

    def block(part: DataFrame):
        return spark.sparkContext.broadcast(Phrases.of([x for r in part.select("items", "words").collect() for x in zip(r[0], map(bytes, r[1]))], window))

    if len(parts) == 1:
        out = frame(docs, *more, key=key, text=text)
        return arrow(out, _search(block(parts[0]), False), StructType([*out.schema.fields, *_FOUND.fields]))
    rows = placed(docs)
    out = frame(rows, FILE, AT, *more, key=key, text=text)
    narrow, hits = out.select("key", FILE, AT, "text"), None
    for part in parts:
        shared = block(part)
        some = stored(arrow(narrow, _search(shared, True), StructType([*narrow.drop("text").schema.fields, *_FOUND.fields])).select(FILE, AT, "spans", "items"))
        shared.destroy()
        hits = some if hits is None else hits.unionByName(some)
    lists = hits.groupBy(FILE, AT).agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = arrow(out, _counted, StructType([*out.schema.fields, _FOUND["n_words"]])).join(lists, [FILE, AT], "left").drop(FILE, AT)
    joined = joined.withColumns({"spans": F.coalesce("spans", F.array().cast("array<binary>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return arrow(joined, _united, StructType([*joined.drop("spans", "items").schema.fields, _FOUND["spans"], _FOUND["items"]]))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches, SHARD):
        for _, data, at, _, _ in blocks([batch], 1 << 62):
            yield batch.append_column("n_words", pa.array(np.diff(word_hashes(data, at)[1])))


def _summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2)).sum()) for s in batch.column("spans").to_pylist()]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in items], pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
            ],
            ["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, tests: DataFrame, **names) -> DataFrame:
    """A row per document: words, words hit, items that occur, a digest of their ids, whether any word is hit."""
    found = found_phrases(docs, tests, **names).drop("text")
    summary = arrow(found, _summary, "key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return summary.withColumnRenamed("key", names.get("key", "doc_id"))


def cut_words(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    plain = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    begin = np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))
    end = np.flatnonzero(plain & ~np.concatenate([plain[1:], [False]])) + 1
    out, at = [], 0
    for i, j in spans.tolist():
        out.append(text[at : begin[i]])
        at = int(end[j - 1])
    return b"".join([*out, text[at:]])


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        texts = batch.column("text").to_pylist()
        for i, s in enumerate(batch.column("spans").to_pylist()):
            if s:
                texts[i] = cut_words(texts[i].encode(), np.frombuffer(s, np.int64).reshape(-1, 2)).decode()
        rest = [batch.column(x) for x in batch.schema.names if x not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*(x for x in batch.schema.names if x not in ("text", "spans")), "text"])


def clean(docs: DataFrame, tests: DataFrame, *, text: str = "text", **names) -> DataFrame:
    """``docs`` without the words of test passages. The other columns travel along as one struct, so nothing is joined."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")
    whole = F.struct(rest, F.col(f"`{text}`").isNull().alias("null")).alias("row")
    found = found_phrases(docs, tests, whole, text=text, **names).drop("items", "n_words")
    out = arrow(found, _clean, StructType([f for f in found.schema.fields if f.name not in ("text", "spans")]).add("text", "string"))
    kept = F.when(~F.col("row.null"), F.col("text")).alias(text)
    return out.select(*[kept if c == text else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns])


def op10_fm_index_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, tests = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    return contamination(docs, tests)


OP10_SQL = rf"""
WITH lowered AS (
  SELECT 0 AS side, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
  UNION ALL SELECT 1, CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
w AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
items AS (SELECT id, ws, least({WINDOW}, len(ws)) AS n FROM w WHERE side = 1 AND len(ws) > 0),
phrase AS (
  SELECT DISTINCT id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
grams AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM phrase) WHERE side = 0 AND len(ws) >= n)),
hits AS (SELECT grams.doc_id, grams.i, grams.n, phrase.id FROM grams JOIN phrase USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) WHERE side = 0
"""
