"""Language identification with one Bloom filter per language, bit-sliced into one table.

A slot of the table is a bit mask of languages. An n-gram sets its language's bit in a few slots; a look-up
ANDs those slots' masks and so returns all languages that hold the n-gram at once. A document's n-grams are
looked up; for each language the set bits are counted, and the count is corrected for the filter's false
positives: with ``f = fill**hashes``, ``(hits - n*f) / (1 - f)``. The largest corrected count decides, the
smaller language name on ties; the score is its share of all corrected counts.

Training counts, over all training rows, in how many documents of a language a character trigram occurs,
and keeps those in at least ``least_share`` of them. A document of d distinct trigrams passes on at most
d / least_share kept trigrams per language, so the model's size depends on the length of documents and not
on their number; the table has a fixed number of slots.

Null text, or a text without a letter: ``und``, score 0. Rows with a null language don't train. Repeated
rows count again in training and get the same prediction. No training rows: all ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import arrow, frame, mix, split_runs

UNKNOWN = "und"
SLOTS = 1 << 20
HASHES = 4
LEAST_SHARE = 0.05
#: Code points of text that are encoded at once.
AT_ONCE = 1 << 18

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, row) of all texts in order, and whether each row has a letter. Runs of other characters count as one space."""
    letter = _is_letter()
    points = np.frombuffer((" ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    length = np.array([len(t.lower()) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), length + 1)[: len(points)]
    kept = letter[points]
    has = np.zeros(len(texts), bool)
    has[row[kept]] = True
    chars = np.where(kept, points, 32).astype(np.uint64)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    use = kept.copy()
    use[1:] |= kept[:-1]
    use |= new & ~kept
    chars, row = chars[use], row[use]
    if len(chars) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    grams = chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:]
    inside = row[:-2] == row[2:]
    return grams[inside], row[:-2][inside], has


def _few(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Rows in groups of a bounded number of code points; a longer text is a group of its own."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > AT_ONCE:
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) of a partition; partial counts leave when they are many."""
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    size = 0

    def reduced(parts):
        grams, inverse = np.unique(np.concatenate(parts[0]), return_inverse=True)
        return grams, np.bincount(inverse, np.concatenate(parts[1]), len(grams)).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, n = reduced(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "docs"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, texts in _few(batch.column("text").to_pylist()):
            grams, row, _ = trigrams(texts)
            order = np.lexsort((grams, row))
            grams, row = grams[order], row[order]
            once = split_runs(grams) | split_runs(row)
            grams, row = grams[once], row[once]
            names = np.array(langs[first : first + len(texts)], object)[row]
            for lang in set(names.tolist()):
                values, n = np.unique(grams[names == lang], return_counts=True)
                parts = held.setdefault(lang, ([], []))
                parts[0].append(values)
                parts[1].append(n)
                size += len(values)
        if size > 2_000_000:
            for lang, parts in held.items():
                grams, n = reduced(parts)
                held[lang] = ([grams], [n])
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


@dataclass
class Model:
    """The bit-sliced table: ``words`` 64-bit masks for each slot, so any number of languages."""

    languages: list[str]
    table: np.ndarray
    hashes: int

    @property
    def false_positives(self) -> np.ndarray:
        fill = [((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill, float) ** self.hashes

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        one, two = mix(grams), mix(grams ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((one + np.uint64(i) * two) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def add(self, lang: int, grams: np.ndarray) -> None:
        for slot in self.slots(grams):
            self.table[slot, lang // 64] |= np.uint64(1) << np.uint64(lang % 64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for slot in self.slots(grams):
            found = self.table[slot]
            out = found if out is None else out & found
        return out


def fit(rows: DataFrame, *, least_share: float = LEAST_SHARE, slots: int = SLOTS, hashes: int = HASHES) -> Model:
    """``rows`` has lang and text, neither null. The driver gets the kept trigrams only, whose number is bounded (see above)."""
    counted = arrow(rows.select("lang", "text"), _count, "lang string, gram long, docs long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    of_lang = rows.groupBy("lang").agg(F.count("*").alias("all_docs"))
    kept = counted.join(of_lang, "lang").where(F.col("docs") >= least_share * F.col("all_docs")).select("lang", "gram").toArrow()
    langs = np.array(kept.column("lang").to_pylist(), object)
    grams = kept.column("gram").to_numpy().view(np.uint64)
    model = Model(sorted(set(langs.tolist())), np.zeros((slots, max(1, -(-len(set(langs.tolist())) // 64))), np.uint64), hashes)
    for i, lang in enumerate(model.languages):
        model.add(i, grams[langs == lang])
    return model


def _predict(model: Model, false: np.ndarray, texts: list[str]) -> tuple[list[str], list[float]]:
    n = len(model.languages)
    grams, row, has = trigrams(texts)
    total = np.bincount(row, minlength=len(texts)).astype(float)
    counts = np.zeros((len(texts), n))
    if len(grams) and n:
        masks = model.masks(grams)
        for i in range(n):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(row, bit.astype(float), len(texts))
            counts[:, i] = np.maximum(0, (hits - total * false[i]) / (1 - false[i])) if false[i] < 1 else 0
    langs, scores = [], []
    for c, known in zip(counts, has):
        if not known or not n:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(np.argmax(c))
        langs.append(model.languages[best])
        scores.append(float(c[best] / c.sum()) if c.sum() else 0.0)
    return langs, scores


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. The table goes to each worker once; its size is fixed by the number of slots."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.false_positives))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, false = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, texts in _few(batch.column("text").to_pylist()):
                a, b = _predict(model, false, texts)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    found = arrow(frame(docs, key=key, text=text), run, "key long, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def fold(key: Column, n: int = 4) -> Column:
    """CRC-32 of the key as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(key: int | None, n: int = 4) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % n


def op8_language_bitmask(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs.select("doc_id", "text"), fit(train))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
