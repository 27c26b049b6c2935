"""Repeated windows of words and of lines: the later occurrence of each goes.

``earliest stays``: a window is a run of consecutive units (words or lines) of one document; a unit is
removed if a window that covers it has occurred before, in a document with a smaller key or earlier in the
same one. Windows are judged on the input, so overlapping windows merge into one covered range.

Words use difference-cover anchors. D = {0, 1, 3, 9} is a perfect difference set modulo 13: any two
positions have an offset below 13 at which both are in D modulo 13. A repeated run of 20 words therefore
holds, at the same offset from both starts, a run of 8 words that begins at a cover position of its own
document. So a first pass hashes 8-word runs at 4 of 13 positions only; the second extends each repeated
anchor to the 20-word windows around it and compares those, by 128 bits of hash.

Lines use overlapping three-line windows directly: there are few lines.

Both passes ship packed hashes (``common``): a hash that a task has seen many times leaves it once, so
neither a passage that a third of the documents share nor a large group of copies gathers in one task.

Each row is a document of its own, known by its number in the order of keys. Null text: empty, nothing to
remove. Documents shorter than a window keep all. Rows without a key come first; rows that share a key, or
have none, follow the order of their places in the table, so of two such rows that are alike the later one
repeats the earlier one, and nothing is cut from a row that another row repeats. Empty table: empty
result. Columns other than key and text never enter a comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import (
    AT,
    FILE,
    KEYED,
    OCCURRENCES,
    Occurrences,
    arrow,
    at_places,
    blocks,
    buckets,
    by_key,
    few_rows,
    later,
    numbers,
    placed,
    repeated,
    to_buckets,
    unpacked,
    windows_of,
    word_ids,
    words_of,
)

WINDOW = 20
#: A perfect difference set and its period: each difference modulo the period occurs among its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
LINES = 3


def _places(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit its row, its number in the row and how many follow in the row, itself included."""
    n = np.diff(cut)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(cut[-1]) - np.repeat(cut[:-1], n)
    return row, nth, np.repeat(n, n) - nth


def _anchors(n_buckets: int, window: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    width = window - PERIOD + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Occurrences(n_buckets, all_known=True)
        for keys, data, at, _, _ in blocks(batches):
            start, end, cut = words_of(data, at)
            row, nth, left = _places(cut)
            use = np.flatnonzero(cover[nth % PERIOD] & (left >= width))
            if len(use):
                h = windows_of(word_ids(data, start, end, 6), width, 6)
                yield from found.add(h[use], None, keys[row[use]], nth[use])
        yield from found.flush()

    return run


def _extend(n_buckets: int, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Occurrences(n_buckets)
        for keys, data, at, first, batch in blocks(batches):
            start, end, cut = words_of(data, at)
            row, nth, left = _places(cut)
            near = np.zeros(len(start) + 1, np.int32)
            for i, parts in enumerate(batch.column("packed").slice(first, len(keys)).to_pylist()):
                n = cut[i + 1] - cut[i]
                anchor = unpacked(parts)
                anchor = anchor[anchor < n]
                np.add.at(near, cut[i] + np.maximum(0, anchor - PERIOD + 1), 1)
                np.add.at(near, cut[i] + anchor + 1, -1)
            use = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= window))
            if len(use):
                h, g = (windows_of(word_ids(data, start, end, seed), window, seed) for seed in (60, 61))  # 128 bits
                yield from found.add(h[use], g[use], keys[row[use]], nth[use])
        yield from found.flush()

    return run


def _matched(sent: DataFrame, match: Callable) -> DataFrame:
    return by_key(arrow(to_buckets(sent), match, KEYED))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units a window covers."""
    step = np.zeros(n + 1, np.int32)
    starts = starts[(starts >= 0) & (starts + width <= n)]
    step[starts] = 1
    ends = np.zeros(n + 1, np.int32)
    ends[starts + width] = 1
    return np.cumsum(step - ends)[:n] > 0


def _texts(docs: DataFrame, key: str, text: str, *rest) -> tuple[DataFrame, DataFrame]:
    """(place, *rest, text), and the numbers of the rows in the order of keys.

    Every later step joins the first by place and reads all its columns, down to the fields of a struct, so that
    one shuffle of the texts serves all of them.
    """
    rows = placed(docs)
    ids = numbers(rows.select(FILE, AT, F.col(f"`{key}`").cast("long").alias("by")), F.col("by").asc_nulls_first())
    return rows.select(FILE, AT, *rest, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), ids


def _id(key: str):
    return F.col(f"`{key}`").cast("long").alias("id")


def _back(found: DataFrame, ids: DataFrame) -> DataFrame:
    """What is known of a row, by its place."""
    return found.join(ids, "key").select(FILE, AT, "key", "packed")


def later_word_windows(texts: DataFrame, ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """(place, key, packed): packed word numbers at which a window starts that has started before."""
    if window < PERIOD:
        raise ValueError(f"a window must have {PERIOD} words or more, for an anchor to fit at any offset")
    n_buckets = buckets(texts)
    near = _back(_matched(arrow(at_places(texts, ids), _anchors(n_buckets, window), OCCURRENCES), repeated(n_buckets)), ids)
    found = arrow(texts.join(near, [FILE, AT]), _extend(n_buckets, window), OCCURRENCES)
    return _back(_matched(found, later(n_buckets)), ids)


def _kept_words(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            counts, removed, digests = [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("packed").to_pylist()):
                words = text.encode().split()
                gone = covered(unpacked(parts), window, len(words)) if parts else ()
                counts.append(len(words))
                removed.append(int(sum(gone)) if parts is None else int(np.sum(gone)))
                kept = [w for w, x in zip(words, gone) if not x] if parts else words
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def word_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: words, words removed, a digest of the words kept."""
    texts, ids = _texts(docs, key, text, _id(key))
    joined = texts.join(later_word_windows(texts, ids, window), [FILE, AT], "left").select("id", "text", "packed")
    out = arrow(joined, _kept_words(window), "id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def text_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line and not line.isspace()]


def _line_windows(n_buckets: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Occurrences(n_buckets)
        for keys, data, at, _, _ in blocks(batches):
            raw, digests, key, place = data.tobytes(), [], [], []
            for k, i, j in zip(keys.tolist(), at[:-1].tolist(), at[1:].tolist()):
                lines, full = text_lines(raw[i:j])
                own = [lines[x].strip(b" \t\r\x0b\x0c") for x in full]
                for n in range(len(own) - width + 1):
                    digests.append(hashlib.md5(b"\n".join(own[n : n + width])).digest())
                    key.append(k)
                    place.append(n)
            if digests:
                both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
                yield from found.add(both[:, 0].copy(), both[:, 1].copy(), np.array(key, np.int64), np.array(place, np.int64))
        yield from found.flush()

    return run


def later_line_windows(texts: DataFrame, ids: DataFrame, width: int = LINES) -> DataFrame:
    """(place, key, packed): packed numbers of the non-blank lines at which a window starts that has started before."""
    n_buckets = buckets(texts)
    return _back(_matched(arrow(at_places(texts, ids), _line_windows(n_buckets, width), OCCURRENCES), later(n_buckets)), ids)


def cut_lines(text: bytes, starts: np.ndarray, width: int) -> tuple[bytes, int, int]:
    """(what is left, non-blank lines, lines removed). Blank lines stay."""
    lines, full = text_lines(text)
    gone = np.array(full, np.int64)[covered(starts, width, len(full))] if len(starts) else np.zeros(0, np.int64)
    if not len(gone):
        return text, len(full), 0
    drop = set(gone.tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in drop), len(full), len(drop)


def _kept_lines(width: int, summary: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            cut = [cut_lines(t.encode(), unpacked(p), width) for t, p in zip(batch.column("text").to_pylist(), batch.column("packed").to_pylist())]
            if not summary:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t.decode() for t, _, _ in cut], pa.string())], ["row", "text"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([n for _, n, _ in cut], pa.int64()),
                    pa.array([n for _, _, n in cut], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in cut], pa.string()),
                ],
                ["id", "n_lines", "n_removed", "kept_sha256"],
            )

    return run


def line_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """A row per document: non-blank lines, lines removed, a digest of the text that is left."""
    texts, ids = _texts(docs, key, text, _id(key))
    joined = texts.join(later_line_windows(texts, ids, width), [FILE, AT], "left").select("id", "text", "packed")
    out = arrow(joined, _kept_lines(width, True), "id long, n_lines long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def without_later_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """``docs`` with the removed lines cut out of their texts; all rows and columns stay, and a null text stays null."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")
    texts, ids = _texts(docs, key, text, F.struct(rest, F.col(f"`{text}`").isNull().alias("null")).alias("row"))
    joined = texts.join(later_line_windows(texts, ids, width), [FILE, AT], "left").select("row", "text", "packed")
    out = arrow(joined, _kept_lines(width, False), joined.select("row", "text").schema)
    kept = F.when(~F.col("row.null"), F.col("text")).alias(text)
    return out.select(*[kept if c == text else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns])


def op6_difference_cover(spark, sf_dir: str) -> DataFrame:
    return word_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_line_windows(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM late),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS j, unnest(ws) AS x FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT word.* FROM word ANTI JOIN gone USING (doc_id, j)) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = rf"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM raw)),
full_line AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM line WHERE t <> ''),
win AS (
  SELECT doc_id, n, t || chr(10) || lead(t, 1) OVER d || chr(10) || lead(t, 2) OVER d AS g FROM full_line WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
late AS (
  SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, n) AS k FROM win WHERE g IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest([n, n + 1, n + 2]) AS n FROM late),
kept AS (
  SELECT line.doc_id, string_agg(line.x, chr(10) ORDER BY line.i) AS t
  FROM line LEFT JOIN full_line f ON f.doc_id = line.doc_id AND f.i = line.i LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.n = f.n
  WHERE gone.n IS NULL GROUP BY 1)
SELECT raw.doc_id, (SELECT count(*) FROM full_line f WHERE f.doc_id = raw.doc_id) AS n_lines,
  (SELECT count(*) FROM gone WHERE gone.doc_id = raw.doc_id) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""
