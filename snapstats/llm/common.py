"""What the operators of this subpackage share.

Four things recur:

* ``placed`` knows each row by its place, whatever its key: keys may be null or repeat;
* ``frame`` narrows a documents table to a key and a text, so that extra or clashing columns of the
  caller never meet a join, and so that only two columns leave the scan;
* ``word_ids`` and ``windows_of`` hash the words of whole Arrow buffers and runs of words with numpy, without a
  Python step per word;
* the *packed exchange*: a task sends one row per bucket that holds many hashes as binary arrays. It
  shuffles 8 bytes a hash instead of a row a hash, and each task sends a hash once however often it saw
  it, so a hash that fills a third of the corpus arrives once per batch, not once per row. Spark sorts a
  partition by bucket, and Python works on one bucket at a time; there are as many buckets as the input's
  bytes ask for, so a bucket stays small.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstats.session import checkpoint, shared_dir

#: Stands for a null key inside an operator; results carry the null again.
#: The place of a row: the file and its number there.
FILE, AT = "__file", "__at"
#: Bytes of text that are hashed at once. A longer document is a block of its own.
BLOCK = 1 << 19
#: Hashes that a task holds before it sends them.
HELD = 500_000
#: Bytes of input for each bucket of a packed exchange, and the most buckets; with more, a task would send a row for a few hashes.
BUCKET, MOST_BUCKETS = 4 << 20, 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: The tables stored since each ``scratch`` that is open began.
_open: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, as a compressed Parquet table: for frames that grow with the corpus."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored inside are deleted at its end, but for a result that is passed to what it yields.

    Nothing lazy that reads such a table may be used after that.
    """
    paths: list[str] = []
    _open.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        paths.pop()
        return out

    try:
        yield keep
    finally:
        _open.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def frame(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, text string, *more) of a documents table; a null key stays null, a null text is empty."""
    return docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *more,
    )


def _reads_parquet(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a Parquet file, so that the reader can tell its place."""
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" in docs.columns or not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    files = plan.relation()
    return files.fileFormat().toString() == "Parquet" and files.location().rootPaths().size() == 1  # of several, one may be read twice


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in ``FILE`` and ``AT``: what tells rows apart when keys are null or repeat.

    A table that is read from Parquet has it in the reader. Other rows are written first, so whatever is
    computed from a place, again or by a second attempt of a task, finds the same row there.
    """
    if _reads_parquet(docs):
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.coalesce("_metadata.row_index", F.lit(0).cast("long")).alias(AT))
    return stored(docs.select("*", F.lit(0).cast("long").alias(FILE), F.monotonically_increasing_id().alias(AT)))


def numbers(places: DataFrame, *by) -> DataFrame:
    """(FILE, AT, key): the rows numbered from 0 without gaps, in the order of ``by`` and then of their places.

    Only ``by`` and the places are sorted. What is broadcast is the first number of each partition.
    """
    order = [*by, FILE, AT]
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")
    rows = places.repartitionByRange(*order).sortWithinPartitions(*order).select(FILE, AT, F.spark_partition_id().alias("part"), nth)
    rows, first, at = stored(rows), [], 0
    for part, n in sorted(tuple(x) for x in rows.groupBy("part").count().collect()):
        first.append((part, at))
        at += n
    return rows.join(F.broadcast(places.sparkSession.createDataFrame(first, "part int, first long")), "part").select(FILE, AT, (F.col("first") + F.col("nth")).alias("key"))


def sorted_join(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a sort and never broadcast: for one side of a join whose sides both grow with the corpus.

    Spark sizes what an explode or a step in Arrow makes by its input, and a stored table by its compressed files. So a table a
    hundred times the limit of a broadcast may seem to lie below it, and would go through the driver whole.
    """
    return df.hint("merge")


def at_places(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with the numbers of ``numbers``. The texts are shuffled by place; every other join by place can use that shuffle, too."""
    return rows.join(ids.hint("shuffle_hash"), [FILE, AT])


def buckets(docs: DataFrame) -> int:
    """A power of two: by the bytes that ``docs`` reads, and at least twice the shuffle partitions, so that each has work."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(256, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    return min(MOST_BUCKETS, 1 << (n - 1).bit_length())


@cache
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # only GNU's C library has it
        return None


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``; at its end a task hands freed memory back, so that waiting workers hold little."""

    def lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)

    return df.mapInArrow(lean, schema)


def long_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, pa.RecordBatch]]:
    """(keys, bytes, row offsets into bytes, first row, batch), at most ``limit`` bytes of whole texts at once; a null key is 0 here, see ``keys_of``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = long_array(batch.column("key").fill_null(0))
        data, at = text_buffer(batch.column("text"))
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield keys[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i], i, batch
            i = j


def keys_of(batch: pa.RecordBatch, first: int, keys: np.ndarray) -> pa.Array:
    """The keys of a block as they are, null or not."""
    return batch.column("key").slice(first, len(keys))


def few_rows(batches: Iterable[pa.RecordBatch], limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of whole texts, so that a step in Python holds few of them."""
    for batch in batches:
        _, at = text_buffer(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of each 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for each byte range: eight bytes at a time are mixed in, from a key that the length selects.

    Ranges of eight bytes or fewer that differ, but are equally long, differ in their ids. Nothing is linear in
    the letters, so no arrangement of them makes two words equal for every seed.
    """
    keys = np.random.default_rng(seed).integers(0, 2**64, LONG_WORD + 1, np.uint64)
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    out = keys[np.minimum(n, LONG_WORD)]
    for k in range(0, LONG_WORD, 8):
        at = np.flatnonzero(n > k) if k else slice(None)
        if not len(n[at]):
            break
        out[at] = mix(out[at] ^ (eight[start[at] + k] & _FIRST_BYTES[np.minimum(n[at] - k, 8)]))
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def paired(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """The hash of a sequence from those of its two parts; the order counts."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ np.uint64(key)))


def windows_of(ids: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` ids, from those of runs half as long, and so on: about log2(width) steps."""
    keys = [int(x) for x in np.random.default_rng(seed + 7).integers(0, 2**64, 128, np.uint64)]
    out, done, size, now = None, 0, 1, ids
    while len(ids) >= width:
        if width & size:
            if out is None:
                out = now
            else:  # the part so far stands before that of this size
                n = len(ids) - done - size + 1
                out = paired(out[:n], now[done : done + n], keys[64 + size.bit_length()])
            done += size
        if done == width:
            return out
        now = paired(now[: len(now) - size], now[size:], keys[size.bit_length()])
        size *= 2
    return np.zeros(0, np.uint64)


class Hasher:
    """Polynomial hashes modulo 2^64 of ranges of a sequence of 64-bit values, for ranges of a few hundred values.

    There are sequences of 1,024 values and more that collide whatever the base; nothing that long may be hashed
    with it. Equal ranges have equal hashes wherever they stand. With prefix sums ``s`` of ``v[i] * base**i``, the
    hash of [i, j) is ``(s[j] - s[i]) * base**-i``.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.bytes = draw.integers(0, 2**64, 256, np.uint64)
        self.base = int(draw.integers(0, 2**62)) * 4 + 3
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = 1 << (n + 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(n, base % 2**64, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of ``width`` values."""
        if len(values) < width:
            return np.zeros(0, np.uint64)
        sums = self.sums(values)
        n = len(values) - width + 1
        return mix((sums[width:] - sums[:n]) * self.down[:n])


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (runs of anything but ASCII white space), and the words before each row."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else np.zeros(0, bool)
    after = np.concatenate([inside[1:], [False]]) if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def split_runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return first


def pack_ints(values: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; with ``steps`` their differences, which are small for keys in order."""
    values = values.astype(np.int64, copy=False)
    kept = np.diff(values) if steps else values
    width = next((w for w in (1, 2, 4) if not len(kept) or (kept.min() >= -(1 << 8 * w - 1) and kept.max() < 1 << 8 * w - 1)), 8)
    return bytes([width]) + (values[:1].tobytes() if steps else b"") + kept.astype(f"<i{width}").tobytes()


def pack_sorted(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values in order: the first, then their steps in as many bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out = out.reshape(-1).view(np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def unpack_ints(data: bytes, steps: bool = False) -> np.ndarray:
    if len(data) < 2:
        return np.zeros(0, np.int64)
    if not steps:
        return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
    first = np.frombuffer(data, np.int64, 1, 1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, f"<i{data[0]}", offset=9).astype(np.int64)]))


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _spans(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order by bucket (stable), the buckets that occur, and each one's span of that order."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(split_runs(bucket[order]))
    return order, bucket[order][at], list(zip(at.tolist(), [*at[1:].tolist(), len(order)]))


# --- values by key: a task's findings go to the key's bucket, where each key becomes one row ---

KEYED = "bucket int, k binary, v binary"
PER_KEY = "key long, packed binary"


def keyed(n_buckets: int, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of KEYED: one for each bucket, however many keys there are."""
    if not len(keys):
        return
    by = np.lexsort((values, keys))
    keys, values = keys[by], values[by]
    order, buckets_, spans = _spans((mix(keys.view(np.uint64)) >> np.uint64(64 - (n_buckets.bit_length() - 1))).astype(np.int32))
    keys, values = keys[order], values[order]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(buckets_),
            pa.array([pack_ints(keys[i:j], True) for i, j in spans], pa.binary()),
            pa.array([pack_ints(values[i:j]) for i, j in spans], pa.binary()),
        ],
        ["bucket", "k", "v"],
    )


def to_buckets(found: DataFrame) -> DataFrame:
    """Each bucket in one partition, its rows in a run; the sort is Spark's, which can spill."""
    return found.repartition("bucket").sortWithinPartitions("bucket")


def bucketwise(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one bucket after those of another."""
    held, now = [], None
    for batch in batches:
        of = batch.column("bucket").to_numpy()
        cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for i, j in zip(cut, cut[1:]):
            if i < j:
                if held and of[i] != now:
                    yield held
                    held = []
                now = of[i]
                held.append(batch.slice(i, j - i))
    if held:
        yield held


def _rows_of_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in bucketwise(batches):
        k = joined([unpack_ints(x, True) for b in some for x in b.column("k").to_pylist()])
        v = joined([unpack_ints(x) for b in some for x in b.column("v").to_pylist()])
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        at = np.flatnonzero(split_runs(k))
        spans = zip(at.tolist(), [*at[1:].tolist(), len(k)])
        yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array([pack_ints(np.unique(v[i:j])) for i, j in spans], pa.binary())], ["key", "packed"])


def by_key(found: DataFrame) -> DataFrame:
    """(key, packed): one row for each key of KEYED rows, with all its values, each once. A key is a document, so they are bounded by its length."""
    return arrow(to_buckets(found), _rows_of_keys, PER_KEY)


def unpacked(packed: bytes | None) -> np.ndarray:
    return unpack_ints(packed) if packed else np.zeros(0, np.int64)


# --- the packed exchange of occurrences: (hash, second hash, row number, position) ---

OCCURRENCES = "bucket int, known boolean, h binary, g binary, k binary, p binary"


@dataclass
class Found:
    """Occurrences: hashes ``h`` and, if one is not enough, ``g``; row numbers ``k``; positions ``p``."""

    h: np.ndarray
    g: np.ndarray | None
    k: np.ndarray
    p: np.ndarray

    def take(self, which: np.ndarray) -> Found:
        return Found(*(None if x is None else x[which] for x in (self.h, self.g, self.k, self.p)))

    @staticmethod
    def concat(parts: list[Found]) -> Found:
        columns = ([getattr(x, name) for x in parts] for name in "hgkp")
        return Found(*(None if c[0] is None else np.concatenate(c) for c in columns))

    def sorted(self) -> tuple[Found, np.ndarray]:
        """By (h, g, k, p), and where in that order another pair of hashes begins."""
        own = self.take(np.lexsort([x for x in (self.p, self.k, self.g, self.h) if x is not None]))
        first = split_runs(own.h)
        return own, first if own.g is None else first | split_runs(own.g)


def send(n_buckets: int, known: bool, found: Found) -> Iterator[pa.RecordBatch]:
    """Occurrences as rows of OCCURRENCES. What is ``known`` only passes through, so it goes by key, not by hash."""
    if not len(found.k):
        return
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    found = found.take(np.lexsort((found.p, found.k)))  # rows in order have small steps
    order, buckets_, spans = _spans(((mix(found.k.view(np.uint64)) if known else found.h) >> shift).astype(np.int32))
    found = found.take(order)
    columns: list[pa.Array] = [pa.array(buckets_), pa.array(np.full(len(buckets_), known))]
    for values in (found.h, found.g):
        columns.append(pa.array([b"" if known or values is None else values[i:j].tobytes() for i, j in spans], pa.binary()))
    for values, steps in ((found.k, True), (found.p, False)):
        columns.append(pa.array([pack_ints(values[i:j], steps) for i, j in spans], pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "known", "h", "g", "k", "p"])


def received(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Found, np.ndarray, np.ndarray]]:
    """For each bucket the occurrences to compare, and (k, p) of those already known."""
    for some in bucketwise(batches):
        known = [x for b in some for x in b.column("known").to_pylist()]
        column = {c: [x for b in some for x in b.column(c).to_pylist()] for c in "hgkp"}
        h, g = (np.frombuffer(b"".join(column[c]), np.uint64) for c in "hg")
        k, p, known_k, known_p = (
            joined([unpack_ints(x, c == "k") for x, flag in zip(column[c], known) if flag == which]) for which in (False, True) for c in "kp"
        )
        yield Found(h, g if len(g) else None, k, p), known_k, known_p


class Occurrences:
    """What a task has found and not sent yet.

    Of each hash the first occurrence goes to the hash's bucket; the others are known to repeat it. With
    ``all_known`` the first of several is known to be repeated as well, and goes both ways.
    """

    def __init__(self, n_buckets: int, all_known: bool = False):
        self.n_buckets, self.all_known, self.parts, self.n = n_buckets, all_known, [], 0

    def add(self, h, g, k, p) -> Iterator[pa.RecordBatch]:
        if len(h):
            self.parts.append(Found(h, g, k, p))
            self.n += len(h)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        found, first = Found.concat(self.parts).sorted()
        self.parts, self.n = [], 0
        rest = ~(first & np.append(first[1:], True)) if self.all_known else ~first
        reps, rest = found.take(first), found.take(rest)
        del found, first
        yield from send(self.n_buckets, False, reps)
        yield from send(self.n_buckets, True, rest)


def repeated(n_buckets: int):
    """Positions by key of all occurrences whose hash occurs twice or more."""
    return _matched(n_buckets, later_only=False)


def later(n_buckets: int):
    """Positions by key of all occurrences that another in an earlier row, or earlier in their own, precedes."""
    return _matched(n_buckets, later_only=True)


def _matched(n_buckets: int, later_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, n = [], [], 0
        for found, k, p in received(batches):
            if len(found.h):
                found, first = found.sorted()
                found = found.take(~first if later_only else ~(first & np.append(first[1:], True)))
                k, p = np.concatenate([k, found.k]), np.concatenate([p, found.p])
            keys.append(k)
            places.append(p)
            n += len(k)
            if n >= HELD:
                yield from keyed(n_buckets, joined(keys), joined(places))
                keys, places, n = [], [], 0
        yield from keyed(n_buckets, joined(keys), joined(places))

    return run
