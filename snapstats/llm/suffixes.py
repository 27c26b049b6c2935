"""Repeated byte strings: every byte under a 200-byte string that also starts elsewhere goes.

A suffix array of the corpus is built in shards. Each 200-byte window belongs to the shard of the smallest
hash among its 64-byte grams; neighbouring windows mostly share it, so they travel as one *piece*, a run of
windows and the bytes under it. Equal windows have equal smallest grams, so each shard holds all
occurrences of its windows and is judged alone.

1. A scan sends, for each piece, the hash of its gram and a hash of its bytes, packed, each pair once per
   batch. Grams that occur once end here: most of a corpus, in which no window can be repeated, and so do those
   whose pieces are all equal, in which every window is. Where a gram's pieces differ, one copy of each goes on,
   with the word whether there are more.
2. Those pieces' bytes go to their shards. A shard's suffix array comes from induced sorting, the common
   prefixes of neighbours from the permuted form; windows with a neighbour that shares 200 bytes are repeated,
   and so are all windows of a piece that has copies, which the array holds once. The other copies, known by
   128 bits of their bytes, inherit that.
3. A gram with more than ``CROWD`` distinct pieces (a passage in many contexts) is not sorted in one place:
   its windows are dealt by their own hash, 128 bits, and counted. That is exact, too, and keeps any one
   passage from gathering in one task.

The pieces of a document are the same in both scans, so only their places travel in between. All scans of
the texts share one shuffle.

Each row is a document of its own, known by its number, whatever its key. Null text: empty. Texts below 200
bytes keep all. Rows without a key, or that repeat one, are further documents, so of rows that are alike all
go. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstats.llm.common import (
    AT,
    FILE,
    HELD,
    KEYED,
    OCCURRENCES,
    Found,
    Hasher,
    Occurrences,
    arrow,
    at_places,
    blocks,
    buckets,
    bucketwise,
    by_key,
    few_rows,
    keyed,
    mix,
    numbers,
    placed,
    received,
    split_runs,
    to_buckets,
    unpacked,
)
from snapstats.llm.suffixarray import permuted_prefixes, suffix_array

WINDOW = 200
GRAM = 64
#: Distinct pieces of a gram that are sorted in one place.
CROWD = 4096
#: Bytes of one suffix array, but for a single gram with more.
SHARD = 1 << 20
#: Not a byte of UTF-8: ends a piece.
STOP = 0xFF

#: What is known of a piece, beside its place: it has copies (WHOLE), it is to be sorted (SORT), it is one of too many of its gram (DEAL).
WHOLE, SORT, DEAL = 1, 2, 4

_WORK = "bucket int, kind int, h binary, g binary, k binary, p binary, n binary, body binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


class _Pieces:
    """The pieces of the texts in a block: begin byte, windows, row, hash of the gram."""

    def __init__(self, grams: Hasher, data: np.ndarray, at: np.ndarray, window: int, gram: int):
        hashed = grams.windows(grams.bytes[data], gram)
        least = _sliding_min(hashed, window - gram + 1)
        n = np.maximum(0, np.diff(at) - window + 1)
        own = n > 0
        step = np.zeros(len(least) + 1, np.int32)
        step[at[:-1][own]] = 1
        np.add.at(step, at[:-1][own] + n[own], -1)
        valid = np.cumsum(step[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (hashed[: max(0, len(least) - 1)] == least[:-1])  # or the gram itself is left behind
        new[at[:-1][own]] = True
        self.begin = np.flatnonzero(new)
        stop = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True)) if len(valid) else self.begin
        self.n = stop - self.begin + 1
        self.row = np.searchsorted(at, self.begin, "right") - 1
        self.place = (self.begin - at[self.row]).astype(np.int32)
        self.hash = mix(least[self.begin] ^ np.uint64(0x2545F4914F6CDD1D))


def _find(n_buckets: int, window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, whole, found = Hasher(3), Hasher(33), Occurrences(n_buckets, all_known=True)
        for keys, data, at, _, _ in blocks(batches):
            x = _Pieces(grams, data, at, window, gram)
            if len(x.begin):
                g = whole.ranges(whole.sums(whole.bytes[data]), x.begin, x.begin + x.n + window - 1)
                yield from found.add(x.hash, g, keys[x.row], x.place.astype(np.int64))
        yield from found.flush()

    return run


def _judge(n_buckets: int, crowd: int):
    """Places with what is known of them, packed as place * 8 + flags."""

    def judged(found: Found) -> tuple[np.ndarray, np.ndarray]:
        found, first = found.sorted()
        group = np.cumsum(first) - 1
        gram = np.cumsum(split_runs(found.h)) - 1
        kinds = np.bincount(gram[first])[gram]  # distinct pieces of the gram
        copies = np.bincount(group)[group]
        flags = np.where(copies > 1, WHOLE, 0) | np.where(first & (kinds > 1), np.where(kinds > crowd, DEAL, SORT), 0)
        use = (kinds > 1) | (copies > 1)
        return found.k[use], (found.p * 8 + flags)[use]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, known_k, known_p in received(batches):
            keys, codes = [known_k], [known_p * 8 + WHOLE]
            if len(found.h):
                k, c = judged(found)
                keys.append(k)
                codes.append(c)
            yield from keyed(n_buckets, np.concatenate(keys), np.concatenate(codes))

    return run


def _rows(n_buckets: int, kind: int, h: np.ndarray, columns: dict[str, np.ndarray], body: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One row of _WORK for each bucket."""
    if not len(h):
        return
    bucket = (h >> np.uint64(64 - (n_buckets.bit_length() - 1))).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(split_runs(bucket[order]))
    spans = list(zip(at, np.append(at[1:], len(order))))
    out: list[pa.Array] = [pa.array(bucket[order][at]), pa.array([kind] * len(at), pa.int32())]
    for name in "hgkpn":
        values = columns.get(name)
        out.append(pa.array([values[order[i:j]].tobytes() if values is not None else b"" for i, j in spans], pa.binary()))
    out.append(pa.array([b"".join(body[x] for x in order[i:j]) if body else b"" for i, j in spans], pa.binary()))
    yield pa.RecordBatch.from_arrays(out, ["bucket", "kind", "h", "g", "k", "p", "n", "body"])


_DONE, _SORTED, _DEALT = 0, 1, 2


def _ship(n_buckets: int, window: int, gram: int):
    """Spans of whole pieces, pieces to sort with their bytes, and windows to count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, windows = Hasher(3), (Hasher(34), Hasher(35))
        for keys, data, at, row0, batch in blocks(batches):
            x = _Pieces(grams, data, at, window, gram)
            flags = np.zeros(len(x.begin), np.int64)
            for i, packed in enumerate(batch.column("packed").slice(row0, len(keys)).to_pylist()):
                codes = unpacked(packed)
                begin = at[i] + codes // 8
                there = np.searchsorted(x.begin, begin)
                ok = there < len(x.begin)
                ok[ok] = x.begin[there[ok]] == begin[ok]
                np.bitwise_or.at(flags, there[ok], codes[ok] & 7)
            key, place, n = keys[x.row], x.place, x.n.astype(np.int32)
            done = np.flatnonzero((flags & WHOLE > 0) & (flags & SORT == 0))  # those that are sorted come out of the array
            yield from _rows(n_buckets, _DONE, mix(key[done].view(np.uint64)), {"k": key[done], "p": place[done], "n": n[done] + (window - 1)})
            sort = np.flatnonzero(flags & SORT)
            body = [data[b : b + m + window - 1].tobytes() for b, m in zip(x.begin[sort].tolist(), x.n[sort].tolist())]
            yield from _rows(n_buckets, _SORTED, x.hash[sort], {"h": x.hash[sort], "k": key[sort], "p": place[sort], "n": np.where(flags[sort] & WHOLE, -n[sort], n[sort])}, body)
            deal = np.flatnonzero(flags & DEAL)
            if len(deal):
                start = np.repeat(x.begin[deal] - np.cumsum(x.n[deal]) + x.n[deal], x.n[deal]) + np.arange(x.n[deal].sum())
                h, g = (w.ranges(w.sums(w.bytes[data]), start, start + window) for w in windows)
                row = np.repeat(x.row[deal], x.n[deal])
                # one occurrence of a window here is enough for the others to know; more of them are repeated already
                here, first = Found(h, g, keys[row], start - at[row]).sorted()
                for kind, use in ((_DEALT, here.take(first)), (_DONE, here.take(~(first & np.append(first[1:], True))))):
                    by = use.h if kind == _DEALT else mix(use.k.view(np.uint64))
                    yield from _rows(n_buckets, kind, by, {"h": use.h, "g": use.g, "k": use.k, "p": use.p.astype(np.int32), "n": np.full(len(use.h), window, np.int32)})

    return run


def repeated_windows(bodies: list[bytes], copied: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each window of the pieces that stands elsewhere in them, too, or whose piece has copies. What runs into the next piece is no window."""
    data = np.frombuffer(b"".join(b + b"\xff" for b in bodies), np.uint8)
    before, prefix = permuted_prefixes(data, suffix_array(data, 256))
    begin = np.cumsum([0] + [len(b) + 1 for b in bodies])
    long = prefix >= window
    hit = long | np.repeat(copied, np.diff(begin))
    hit[before[long]] = True
    at = np.flatnonzero(hit)
    piece = np.searchsorted(begin, at, "right") - 1
    inside = at + window < begin[piece + 1]
    return piece[inside], (at - begin[piece])[inside]


def _sorted_spans(h: np.ndarray, k: np.ndarray, p: np.ndarray, copied: np.ndarray, bodies: list[bytes], window: int, shard: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, begin, end) of what is repeated, from one suffix array for several whole grams."""
    order = np.argsort(h, kind="stable")
    begins = np.flatnonzero(split_runs(h[order])).tolist() + [len(order)]
    size = np.cumsum([0] + [len(bodies[i]) + 1 for i in order])
    first = 0
    for j, following in zip(begins[1:], [*begins[2:], None]):
        if following is None or size[following] - size[first] > shard:
            use = order[first:j]
            piece, offset = repeated_windows([bodies[x] for x in use], copied[use], window)
            piece = use[piece]
            if len(piece):
                new = np.ones(len(piece), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(piece)) - 1
                yield k[piece[start]], p[piece[start]] + offset[start], p[piece[stop]] + offset[stop] + window
            first = j


def _match(n_buckets: int, window: int, shard: int):
    """Spans by key, packed as begin * 2^32 + end."""

    types = {"h": np.uint64, "g": np.uint64, "k": np.int64, "p": np.int32, "n": np.int32}

    def spans_of(some: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        parts: dict[int, dict[str, list[bytes]]] = {kind: {c: [] for c in types} for kind in (_DONE, _SORTED, _DEALT)}
        bodies: list[bytes] = []
        for batch in some:
            kinds = batch.column("kind").to_pylist()
            for c in types:
                for kind, value in zip(kinds, batch.column(c).to_pylist()):
                    parts[kind][c].append(value)
            for kind, n, body in zip(kinds, batch.column("n").to_pylist(), batch.column("body").to_pylist()):
                if kind == _SORTED:
                    at = 0
                    for size in (np.abs(np.frombuffer(n, np.int32)) + (window - 1)).tolist():
                        bodies.append(body[at : at + size])
                        at += size
        got = {kind: {c: np.frombuffer(b"".join(v), types[c]) for c, v in own.items()} for kind, own in parts.items()}
        done = got[_DONE]
        yield done["k"], done["p"].astype(np.int64), done["p"].astype(np.int64) + done["n"]
        if bodies:
            own = got[_SORTED]
            yield from _sorted_spans(own["h"], own["k"], own["p"].astype(np.int64), own["n"] < 0, bodies, window, shard)
        own = got[_DEALT]
        if len(own["h"]):
            found, first = Found(own["h"], own["g"], own["k"], own["p"].astype(np.int64)).sorted()
            found = found.take(~(first & np.append(first[1:], True)))
            yield found.k, found.p, found.p + window

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for some in bucketwise(batches):
            held += spans_of(some)
            if sum(len(k) for k, _, _ in held) >= HELD:
                yield from _spans(held)
                held = []
        yield from _spans(held)

    def _spans(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if held:
            key, begin, end = (np.concatenate(x) for x in zip(*held))
            yield from keyed(n_buckets, key, begin << 32 | end)

    return run


def merged(packed: bytes | None, n: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under the spans of one document of n bytes."""
    codes = unpacked(packed)
    if not len(codes):
        return []
    begin, end = codes >> 32, np.minimum(np.maximum.accumulate(codes & 0xFFFFFFFF), n)
    new = np.ones(len(codes), bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(codes) - 1)
    return [(a, b) for a, b in zip(begin[new].tolist(), end[last].tolist()) if a < b]


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        rows = []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("packed").to_pylist()):
            raw = text.encode()
            runs, digest, at = merged(packed, len(raw)), hashlib.sha256(), 0
            for a, b in runs:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
        n, gone, spans, digests = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(texts: DataFrame, ids: DataFrame, *, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """(place, packed): packed spans under repeated strings; they may overlap. ``texts`` has places and text, ``ids`` the numbers of the places."""
    if not 0 < gram <= window:
        raise ValueError("a gram must fit into a window")
    n_buckets = buckets(texts)
    found = arrow(at_places(texts, ids), _find(n_buckets, window, gram), OCCURRENCES)
    places = by_key(arrow(to_buckets(found), _judge(n_buckets, crowd), KEYED)).join(ids, "key")
    work = arrow(texts.join(places, [FILE, AT]), _ship(n_buckets, window, gram), _WORK)
    return by_key(arrow(to_buckets(work), _match(n_buckets, window, shard), KEYED)).join(ids, "key").select(FILE, AT, "packed")


def string_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row per document: bytes, bytes removed, maximal removed runs, a digest of the bytes kept."""
    rows = placed(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))).select(FILE, AT, "id", "text")
    spans = repeated_spans(rows, numbers(rows.select(FILE, AT)), **how)
    joined = rows.join(spans, [FILE, AT], "left").select("id", "text", "packed")
    out = arrow(joined, _kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return string_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
