"""Quality rules from the corpus itself: lines that too many documents of a host share are boilerplate.

Each line is normalised and hashed; for each (host, line) the distinct documents are counted; lines above
the limit are removed; a document of which too little is left is rejected, as is one that fails the base
rules. A document is known by 128 bits of its whole normalised text, so exact copies count once and
documents that share lines but differ in any other count each.

One pass over the texts writes what the rest needs (counts, line hashes, words in each line), a few per
cent of the input; all later joins and shuffles move only that.

Null text: no words, so the base rules reject it. Null host: a host of its own. Each row has its own verdict,
known by its place in the table: rows that repeat a doc_id, or have none, count each, unless their texts are
alike. A very long text is one block of work of its own; its lines leave as three arrays of numbers. Empty
table: empty result. Columns of the caller, whatever their names, stay apart in a struct.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import AT, FILE, LOWER, SPACE, arrow, blocks, mix, placed, sorted_join, split_runs, stored, windows_of, word_ids, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in more than so many documents of its host, and in more than this share of them.
LINE_DOCS = 10
LINE_SHARE = 0.02
#: A document with less than this share of its words left is depleted.
LEAST_LEFT = 0.3

#: Fixed values of the base rules: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_COUNTED = np.zeros(256, bool)
_COUNTED[list(SYMBOLS)] = True
_STATS = (
    f"{FILE} long, {AT} long, key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " document binary, lines array<struct<hash: long, at: int, words: int>>"
)


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(LOWER).split())


def _repeat_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each row: words inside three-word windows that the row has twice or more."""
    rows = len(cut) - 1
    if len(start) < 3:
        return np.zeros(rows, np.int64)
    hashed = windows_of(word_ids(data, start, end, 4), 3)
    row = np.repeat(np.arange(rows), np.diff(cut))
    inside = row[:-2] == row[2:]
    at = np.flatnonzero(inside)
    keyed = hashed[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    first = split_runs(keyed[order])
    twice = at[order[~(first & np.append(first[1:], True))]]
    marked = np.zeros(len(start), bool)
    for k in range(3):
        marked[twice + k] = True
    covered = np.concatenate([[0], np.cumsum(marked)])
    return covered[cut[1:]] - covered[cut[:-1]]


def _stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, data, at, first, batch in blocks(batches):
        start, end, cut = words_of(data, at)
        letters = np.concatenate([[0], np.cumsum(~SPACE[data] & ((data & 0xC0) != 0x80))])
        symbols = np.concatenate([[0], np.cumsum(_COUNTED[data])])
        dups, documents, cuts = [], [], [0]
        hashes, places, sizes = [], array("i"), array("i")
        raw = data.tobytes()
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            seen, n_dup, whole = set(), 0, hashlib.md5()
            for n, line in enumerate(raw[i:j].split(b"\n")):
                words = normal_line(line)
                if words:
                    n_dup += line in seen
                    seen.add(line)
                    whole.update(words + b"\n")
                    hashes.append(hashlib.md5(words).digest()[:8])
                    places.append(n)
                    sizes.append(words.count(b" ") + 1)
            dups.append(n_dup)
            documents.append(whole.digest())
            cuts.append(len(places))
        fields = [pa.array(np.frombuffer(b"".join(hashes), ">i8").astype(np.int64)), pa.array(np.frombuffer(places, np.int32)), pa.array(np.frombuffer(sizes, np.int32))]
        lines = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["hash", "at", "words"]))
        rest = [batch.column(x).slice(first, len(keys)) for x in (FILE, AT, "key", "host")]
        counts = [np.diff(cut), letters[at[1:]] - letters[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], np.array(dups, np.int64), _repeat_words(data, start, end, cut)]
        yield pa.RecordBatch.from_arrays(
            [*rest, *(pa.array(x) for x in counts), pa.array(documents, pa.binary()), lines],
            [FILE, AT, "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "document", "lines"],
        )


def frequent_lines(lines: DataFrame, docs_of_line: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, hash) of the lines above the limits; ``lines`` has host, hash and document.

    Both counts collapse to distinct (host, line, document) before they count, so Spark adds up partial
    counts in each task and no task holds a host or a line.
    """
    of_host = lines.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    of_line = lines.select("host", "hash", "document").distinct().groupBy("host", "hash").agg(F.count("*").alias("docs"))
    often = of_line.where(F.col("docs") > docs_of_line).alias("l")
    return (
        often.join(of_host.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
        .where(F.col("docs") > share * F.col("host_docs"))
        .select("l.host", "l.hash")
    )


def _verdicts(rows: DataFrame, key: str, text: str, host: str, docs_of_line: int, share: float, least_left: float) -> DataFrame:
    """What ``quality`` returns, with the places of the ``placed`` rows."""
    narrow = rows.select(FILE, AT, F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{host}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    stats = stored(arrow(narrow, _stats, _STATS))
    lines = stats.select(FILE, AT, "host", "document", F.explode("lines").alias("line")).select(FILE, AT, "host", "document", "line.*")
    often = frequent_lines(lines, docs_of_line, share)
    a, b = sorted_join(lines).alias("a"), often.alias("b")
    removed = (
        a.join(b, (F.col("a.hash") == F.col("b.hash")) & F.col("a.host").eqNullSafe(F.col("b.host")))
        .groupBy(FILE, AT)
        .agg(F.sum("words").alias("lost"), F.array_sort(F.collect_list("at")).alias("drop"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.greatest(F.col("n_words") - F.coalesce("lost", F.lit(0)), F.lit(0))
    return stats.drop("lines", "document", "host").join(removed, [FILE, AT], "left").select(
        FILE,
        AT,
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        left.alias("n_left"),
        F.coalesce("drop", F.array().cast("array<int>")).alias("drop"),
        (~failed & (left >= least_left * F.col("n_words"))).alias("kept"),
    )


def quality(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    docs_of_line: int = LINE_DOCS,
    share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """A row for each document: its base counts, base_failed, n_left (words after the removal), drop (numbers of the removed lines), kept."""
    return _verdicts(placed(docs), key, text, host, docs_of_line, share, least_left).drop(FILE, AT)


def keep_quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, without their boilerplate lines, with the columns of ``docs``.

    Each row has its own verdict, whatever its doc_id.
    """
    rows = placed(docs)
    verdict = _verdicts(rows, key, text, host, LINE_DOCS, LINE_SHARE, LEAST_LEFT).where("kept").select(FILE, AT, "drop")
    whole = rows.select(FILE, AT, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(sorted_join(verdict), [FILE, AT])
    body = F.col(f"row.`{text}`")
    lines = F.filter(F.split(body, "\n", -1), lambda _, i: ~F.array_contains("drop", i))
    left = F.when(F.size("drop") == 0, body).otherwise(F.array_join(lines, "\n")).alias(text)
    return whole.select(*[left if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls, source FROM d),
tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY 1),
ln AS (SELECT doc_id, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM w),
lw AS (
  SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM ln),
lh AS (SELECT doc_id, source, i, raw, len(ws) AS n, substr(md5(array_to_string(ws, ' ')), 1, 16) AS h FROM lw WHERE len(ws) > 0),
sig AS (SELECT doc_id, md5(string_agg(array_to_string(ws, ' ') || chr(10), '' ORDER BY i)) AS s FROM lw WHERE len(ws) > 0 GROUP BY 1),
ls AS (SELECT lh.*, s FROM lh JOIN sig USING (doc_id)),
host AS (SELECT source, count(DISTINCT s) AS docs FROM ls GROUP BY 1),
freq AS (
  SELECT l.source, h FROM (SELECT source, h, count(DISTINCT s) AS n FROM ls GROUP BY 1, 2) l
  JOIN host ON host.source IS NOT DISTINCT FROM l.source WHERE n > {LINE_DOCS} AND n > {LINE_SHARE} * docs),
lost AS (SELECT doc_id, sum(n) AS n_lost FROM ls JOIN freq ON ls.h = freq.h AND ls.source IS NOT DISTINCT FROM freq.source GROUP BY 1),
dup AS (
  SELECT doc_id, count(*) AS n_dup
  FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, raw ORDER BY i) AS k FROM lh) WHERE k > 1 GROUP BY 1),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_lost >= {LEAST_LEFT} * n_words AS kept, n_words - n_lost AS n_left
FROM v
"""
