"""Runs: stretches of words that repeat with a period, found with a dictionary of basic factors.

A basic factor is a run of 2^k words; the dictionary names the factors of each power of two, and the names of one
level are pairs of names of the level below. At the level of length L the occurrences of a factor that follow each
other within L/2 form an arithmetic progression, a *chain*, whose step is the factor's period. A run of period q with
L <= q < 2L starts with a factor that occurs again q later, in another chain; sliding both occurrences together stays
inside the run until one is the first or last of its chain, and the left one can't move before the run's start. So
all runs are proposed by the pairs (occurrence, later occurrence at a distance in [L, 2L)) of which one is the end of
a chain. Ends of chains of one factor stand over L/2 apart, so these pairs are a constant number per word and level.
Runs of periods up to 4, which have 12 words at least, are proposed by the chains of the factors of 8 words; periods
5 to 7 by pairs of factors of 4. A level looks only at factors that occur twice in their document, since every factor
of a run does: prose is done after two levels.

Each proposal (place, period) is extended to both sides by comparing names from large factors to small, and runs of
one stretch keep the smallest period. The longest common extension takes log2(words) steps for all proposals of a
block at once.

Documents are worked on in blocks of half a megabyte, a longer one alone; the dictionary takes 8 bytes a word and
level. Nothing is shuffled. Words are compared by 64-bit ids (``common.word_ids``). Null and empty texts have no
words and no runs; a null key plants nothing. Repeated rows get a row each. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import arrow, blocks, joined, mix, paired, split_runs, word_ids, words_of

LEAST = 12
_OUT = "key long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs binary"


def planted(key: int | None, n: int) -> tuple[int, int] | None:
    """Fixed rule: from which word on, and with which period, the words of a document are made to repeat; None where they are not."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Factors:
    """The dictionary of a sequence: ``names[k][i]`` stands for the 2^k values from i."""

    def __init__(self, values: np.ndarray):
        self.names = [values]

    def at(self, k: int) -> np.ndarray:
        while len(self.names) <= k:
            size, now = 1 << len(self.names) - 1, self.names[-1]
            self.names.append(paired(now[: max(0, len(now) - size)], now[size:], 0x9E3779B97F4A7C15 + len(self.names)))
        return self.names[k]

    def common(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many values from x and from y agree (with ``back``: before x and before y), x < y."""
        n, out, top = len(self.names[0]), np.zeros(len(x), np.int64), len(self.names) - 1
        while top and (1 << top) > n:
            top -= 1
        for k in range(top, -1, -1):
            size, names, todo = 1 << k, self.names[k], np.arange(len(x))
            while len(todo):
                a, b = (x[todo] - out[todo] - size, y[todo] - out[todo] - size) if back else (x[todo] + out[todo], y[todo] + out[todo])
                inside = (a >= 0) & (b < len(names))
                todo, a, b = todo[inside], a[inside], b[inside]
                todo = todo[names[a] == names[b]]
                out[todo] += size
                if k < top:  # at a lower level one step at most is left
                    break
        return out


def _pairs(group: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, distance): pairs of occurrences at a distance in [size, 2 size) of which one is the end of a chain. Sorted by group and place."""
    same = group[1:] == group[:-1]
    near = same & (2 * np.diff(place) <= size)
    first, last = np.append(True, ~near), np.append(~near, True)
    ends = np.flatnonzero(first | last)
    wide = int(place.max()) + 4 * size + 1
    at = group * wide + place + 2 * size  # no other group within reach
    out = []
    for low, high in ((size, 2 * size), (1 - 2 * size, 1 - size)):
        begin, end = np.searchsorted(at, at[ends] + low), np.searchsorted(at, at[ends] + high)
        n = end - begin
        e = np.repeat(ends, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        out.append((np.minimum(place[e], place[other]), np.abs(place[e] - place[other])))
    return np.concatenate([x for x, _ in out]), np.concatenate([d for _, d in out])


def _chains(group: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, step) of each chain."""
    gap = np.diff(place)
    near = (group[1:] == group[:-1]) & (2 * gap <= size)
    heads = np.flatnonzero(near & ~np.append(False, near[:-1]))
    return place[heads], gap[heads]


def runs_of(ids: np.ndarray, cut: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of the rows ``ids[cut[i] : cut[i + 1]]``, by row, start and period."""
    rows = len(cut) - 1
    none = (np.zeros(0, np.int64),) * 4
    if least < 12 or not len(ids):
        if least < 12:
            raise ValueError("short periods are found by factors of eight words, so runs must have twelve")
        return none
    # a value of its own after each row, which no factor of two places has in common
    row = np.repeat(np.arange(rows), np.diff(cut))
    values = np.empty(len(ids) + rows, np.uint64)
    place = np.arange(len(ids)) + row
    values[place] = mix(ids ^ np.uint64(0x51ED270B7A3C9F11))
    values[cut[1:] + np.arange(rows)] = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1 << 62))
    of_row = np.repeat(np.arange(rows), np.diff(cut) + 1)
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(77))
    factors, k = Factors(values), 2
    active = np.arange(max(0, len(values) - 3))
    xs, qs = [], []
    while len(active):
        size, names = 1 << k, factors.at(k)
        active = active[active < len(names)]
        if not len(active):
            break
        key = names[active] ^ salt[of_row[active]]  # the same factor in another document is another
        order = np.argsort(key, kind="stable")
        key, spot = key[order], active[order]
        new = split_runs(key)
        alone = new & np.append(new[1:], True)
        spot, group = spot[~alone], np.cumsum(new)[~alone]
        if not len(spot):
            break
        x, q = _pairs(group, spot, size)
        xs.append(x)
        qs.append(q)
        if size == 8:
            x, q = _chains(group, spot, size)
            xs.append(x)
            qs.append(q)
        active, k = np.sort(spot), k + 1
    x, q = joined(xs), joined(qs)
    if not len(x):
        return none
    # equal pairs of one stretch follow each other closely: the first stands for all
    order = np.lexsort((x, q))
    x, q = x[order], q[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (np.diff(x) > 4)
    x, q = x[fresh], q[fresh]
    left, right = factors.common(x, x + q, back=True), factors.common(x, x + q)
    start, length = x - left, left + right + q
    good = length >= np.maximum(least, 2 * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = split_runs(start) | split_runs(length)
    start, length, q = start[first], length[first], q[first]
    of = of_row[start]
    start = start - cut[of] - of
    order = np.lexsort((q, start, of))
    return of[order], start[order], length[order], q[order]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words outside all runs, and the first period of each, joined by a space."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def _block(keys: list[int | None], data: np.ndarray, at: np.ndarray, plant: bool) -> Iterator[tuple]:
    begin, end, cut = words_of(data, at)
    ids = word_ids(data, begin, end)
    order = np.arange(len(ids))
    for i, key in enumerate(keys):
        n = int(cut[i + 1] - cut[i])
        if plant and (rule := planted(key, n)):
            a, p = rule
            order[cut[i] + a : cut[i + 1]] = cut[i] + a + np.arange(n - a) % p
    of, start, length, period = runs_of(ids[order], cut)
    spans = np.searchsorted(of, np.arange(len(keys) + 1))
    raw = data.tobytes()
    for i in range(len(keys)):
        words = raw[at[i] : at[i + 1]].split()
        mine = order[cut[i] : cut[i + 1]] - cut[i]
        if len(mine) and (mine != np.arange(len(mine))).any():
            words = [words[j] for j in mine.tolist()]
        s, m, q = (x[spans[i] : spans[i + 1]] for x in (start, length, period))
        yield words, s, m, q


def _rows(plant: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at, first, batch in blocks(batches):
            keys = batch.column("id").slice(first, len(at) - 1).to_pylist()
            out: list[tuple] = []
            for key, (words, s, m, q) in zip(keys, _block(keys, data, at, plant)):
                best = (None,) * 4
                if len(s):
                    b = np.lexsort((q, s, -m))[0]
                    best = (int(s[b]), int(m[b]), int(q[b]), int(1000 * m[b] // q[b]))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), m.tolist(), q.tolist()))
                kept = _collapsed(words, s, m, q) if len(s) else b" ".join(words)
                packed = np.stack([s, m, q], 1).astype(np.int64).tobytes()
                out.append((key, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), packed))
            columns = list(zip(*out))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()]
            names = ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """A row for each document: how many runs, the longest, digests of all and of the words left, and ``runs``: packed 64-bit (start, length, period).

    ``plant`` makes the words of some documents repeat first, by the rule of ``planted``.
    """
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return arrow(narrow, _rows(plant), _OUT).withColumnRenamed("key", key)


def op13_basic_factors(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("runs")
