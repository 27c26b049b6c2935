"""Packing of tokenized documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so the packing problem is its histogram, of at most
``capacity`` entries for any corpus. The driver packs the histogram: lengths above a third of the capacity
go at most two to a bin and are matched greedily, the longest with the longest that fits; shorter ones, in
descending order, go to the smallest gap that holds them. Bins of the same content are one run with a
count, so the work and the plan depend on the capacity alone. Tasks then look up each piece's place from its
rank among the pieces of its length; ranks come from counts for each (task, length) and a running sum.

Documents are tokenized once, into a table of pieces without their text. Words repeat, so a word's ids are
kept in two bounded generations of a cache; what is in neither is encoded many words at a time.

Null text: empty, so its only id is 0. Repeated rows are packed as often as they occur. Empty table: empty
result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapstats.llm.common import arrow, blocks, frame, keys_of, stored

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: The id after each document.
END = 0
#: Bytes of whole texts that are encoded at once.
AT_ONCE = 1 << 20
#: Words in one generation of the cache, and the longest that is kept.
CACHED = 400_000
LONG = 256

_PIECES = "key long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """The ids of words, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, splits at white space and merges within words only, so a text's ids are those
    of its words, one after another.
    """

    def __init__(self, path: str, limit: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _letters_only(self, word: bytes) -> bool:
        """A word of composed letters (below U+0300) is one pre-token, so it goes to the merges as it is; three quarters of the time for a word are spent before those."""
        text = word.decode("utf-8", "replace").lower()
        if not text.isalpha() or not (text.isascii() or max(text) < "\u0300"):
            return False
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        self.young[word] = array("I", [t.id for t in self.merge(text)]).tobytes()
        return True

    def _encode(self, words: list[bytes]) -> None:
        words = [w for w in words if not self._letters_only(w)]
        if not words:
            return
        text = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        begin = np.cumsum([0] + [len(t) + 1 for t in text])
        at = np.searchsorted([a for a, _ in found.offsets], begin)
        for i, w in enumerate(words):
            self.young[w] = ids[at[i] : at[i + 1]].tobytes()

    def _learn(self, words: set[bytes]) -> None:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new, joined = set(), []
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.young[w] = known
            elif 1 < len(w) <= LONG and w[-1:] in b",." and w[-2:-1].isalnum():  # a comma or full stop after a letter or digit is a token of its own
                joined.append(w)
                for x in (w[:-1], w[-1:]):
                    if x in self.old:
                        self.young[x] = self.old[x]
                    elif x not in self.young:
                        new.add(x)
            else:
                new.add(w)
        todo = sorted(new)
        for i in range(0, len(todo), 4096):
            self._encode(todo[i : i + 4096])
        for w in joined:
            self.young[w] = self.young[w[:-1]] + self.young[w[-1:]]

    def of(self, texts: list[bytes]) -> list[bytes]:
        words = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
        out = []
        for own in words:
            found = list(map(self.young.get, own))
            if None in found:
                new = {w for w, x in zip(own, found) if x is None}
                self._learn(new)
                found = [self.young[w] if x is None else x for w, x in zip(own, found)]  # a new generation may have begun
                for w in new:
                    if len(w) > LONG:
                        del self.young[w]
            out.append(b"".join(found))
        return out


def _tokenize(path: str | None, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids = WordIds(path or public_tokenizers.path(TOKENIZER))
        part, count, end, width = TaskContext.get().partitionId(), Counter(), int(END).to_bytes(4, "little"), 4 * capacity
        for keys, data, at, first, batch in blocks(batches, AT_ONCE):
            raw = data.tobytes()
            rows: list[tuple] = []
            for key, own in zip(keys_of(batch, first, keys).to_pylist(), ids.of([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())])):
                own += end
                for piece, i in enumerate(range(0, len(own), width)):
                    now = own[i : i + width]
                    length = len(now) // 4
                    rows.append((key, piece, i // 4, length, zlib.crc32(now), part, count[length]))
                    count[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["key", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def match_large(count: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, lengths in each): lengths above a third of the capacity, at most two to a bin, the longest with the longest that fits."""
    left = {x: n for x, n in count.items() if 3 * x > capacity and n}
    lengths, out = sorted(left), []
    while lengths:
        a = lengths[-1]
        fit = bisect_left(lengths, capacity - a + 1) - 1
        b = lengths[fit] if fit >= 0 else None
        if b == a and left[a] == 1:  # alone of its length: the next shorter one fits as well
            b = lengths[fit - 1] if fit else None
        if b is None:
            n, items = left[a], (a,)
        else:
            n, items = (left[a] // 2 if a == b else min(left[a], left[b])), (a, b)
        out.append((n, items))
        for x in items:
            left[x] -= n
        for x in set(items):
            if not left[x]:
                lengths.remove(x)
    return out


def pack(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal bins: (bins, [(length, how many of it in a bin), ...])."""
    if any(not 0 < x <= capacity for x in count):
        raise ValueError("lengths must be from 1 to the capacity")
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(gap: int, bins: int, items: list[tuple[int, int]]) -> None:
        if bins:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append((bins, items))

    for n, items in match_large(count, capacity):
        put(capacity - sum(items), n, [(x, k) for x, k in Counter(items).items()])
    for x in sorted((x for x in count if 3 * x <= capacity), reverse=True):
        n = count[x]
        while n:
            i = bisect_left(gaps, x)
            if i < len(gaps):
                gap = gaps[i]
                bins, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[i]
            else:
                gap, bins, items = capacity, max(1, n // (capacity // x)), []
            each = min(n, gap // x)
            used = min(bins, n // each)
            put(gap - each * x, used, [*items, (x, each)])
            put(gap, bins - used, items)
            n -= used * each
    return [run for gap in gaps for run in by_gap[gap]]


def slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, how many in a bin, first sequence, first offset), ordered by length and rank."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for bins, items in runs:
        offset = 0
        for x, each in items:
            out.append((x, rank[x], each, sequence, offset))
            rank[x] += bins * each
            offset += each * x
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 44
        begins = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            row = table[np.searchsorted(begins, length * wide + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(x) for x in ("key", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: its place in its document, its length and ids' CRC-32, its sequence and offset there.

    ``tokenizer`` is the path of a vocabulary file that each worker can read; by default the public one.
    """
    pieces = stored(arrow(frame(docs, key=key, text=text), _tokenize(tokenizer, capacity), _PIECES))
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    count = {x: n for x, n in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    placed = arrow(
        ranked, _place(slots(pack(count, capacity))), "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("key", key)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
