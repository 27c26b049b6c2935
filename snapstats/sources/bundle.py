"""Bundles: one large JSON object of sections, each an object (or array) of entries, read by many tasks.

A bundle may be one line of any length, so a task that begins at a byte can't tell from the text there whether it is
inside a string, how deep it is, or in which section. ``outline`` finds that out in one distributed pass: each block of
bytes tells, for either answer to "does it begin inside a string", what it closes and opens; a few numbers a block, like the
list of splits that Spark keeps of any file, give the state at which each block begins. With it the data source
``json_bundle`` reads blocks apart from each other, in one pass for all sections.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Bytes that a task holds at a time beside the entry it is in.
CHUNK = 1 << 20


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system, at


def bundle_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder but those that begin with _ or a dot."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    hidden = lambda p: any(x[:1] in "_." for x in p[len(at) :].split("/") if x)
    return sorted((head + x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not hidden(x.path))


def _structure(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(where, what, inside, escaped): the braces, brackets and commas of ``data`` that are outside strings, and the state behind it."""
    slash = data == 92
    other = np.where(slash, -1, np.arange(len(data)))
    last = np.concatenate(([-1], np.maximum.accumulate(other)[:-1]))
    run = np.arange(len(data)) - 1 - last + (escaped & (last < 0))
    odd = (run & 1).astype(bool)
    quotes = (data == 34) & ~odd
    within = ((np.cumsum(quotes) + inside) & 1).astype(bool)
    marks = np.isin(data, np.frombuffer(b"{}[],", np.uint8)) & ~within
    where = np.flatnonzero(marks)
    behind = bool(odd[-1] ^ True) if slash[-1] else False
    return where, data[where], bool(within[-1]), behind


class Block(NamedTuple):
    """A range of a file and what is known where it begins; ``section`` is the offset of the bracket that opens the section, -1 outside of one."""

    path: str
    start: int
    end: int
    inside: bool
    escaped: bool
    depth: int
    section: int
    name: str | None
    whole: bool  # whether nothing but this section is in it


def _summary(path: str, start: int, end: int) -> list[dict]:
    """For a block that begins outside (0) and inside (1) of a string: what it closes, opens, and whether it ends inside one."""
    system, at = _open(path)
    out = []
    with system.open_input_file(at) as f:
        back, n = start, 0  # an odd run of backslashes in front escapes the first byte
        while back:
            f.seek(max(0, back - CHUNK))
            before = f.read(back - max(0, back - CHUNK))
            here = len(before) - len(before.rstrip(b"\\"))
            n, back = n + here, max(0, back - CHUNK) if here == len(before) else 0
        for begins in (0, 1):
            inside, escaped, pos = bool(begins), bool(n & 1), start
            depth = low = 0  # relative to the block's begin
            opens: dict[int, int] = {}  # where the two lowest levels above ``low`` that are open were opened
            f.seek(start)
            while pos < end:
                data = np.frombuffer(f.read(min(CHUNK, end - pos)), np.uint8)
                where, what, inside, escaped = _structure(data, inside, escaped)
                where, what = where[what != 44], what[what != 44]
                level = np.concatenate(([depth], depth + np.cumsum(np.where((what == 123) | (what == 91), 1, -1))))
                low, held = min(low, int(level.min())), opens
                depth, opens = int(level[-1]), {}
                for goal in (low + 1, low + 2):
                    if depth >= goal:
                        under = np.flatnonzero(level < goal)
                        opens[goal] = pos + int(where[under[-1]]) if len(under) else held[goal]
                pos += len(data)
            out.append({"closes": -low, "opened": depth - low, "first": opens.get(low + 1, -1), "second": opens.get(low + 2, -1), "inside": inside})
    return [{**x, "begins": i, "escaped": bool(n & 1)} for i, x in enumerate(out)]


_KEYS = ("closes", "opened", "first", "second", "inside", "begins", "escaped")
_SUMMARY = "path string, start long, finish long, closes long, opened long, first long, second long, inside boolean, begins long, escaped boolean"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, start, finish in batch.itertuples(index=False, name=None):
            yield pd.DataFrame([{"path": path, "start": start, "finish": finish, **s} for s in _summary(path, start, finish)])[["path", "start", "finish", *_KEYS]]


def _key_before(path: str, at: int) -> str | None:
    """The member's name in front of the bracket at ``at``."""
    system, where = _open(path)
    size = 4096
    with system.open_input_file(where) as f:
        while True:
            begin = max(0, at - size)
            f.seek(begin)
            text = f.read(at - begin).rstrip()
            if not text.endswith(b":"):
                return None
            text = text[:-1].rstrip()
            i = text.rfind(b'"', 0, len(text) - 1)
            while i > 0 and (len(text[:i]) - len(text[:i].rstrip(b"\\"))) & 1:
                i = text.rfind(b'"', 0, i)
            if i >= 0 and (i > 0 or begin == 0):
                return json.loads(text[i:])
            if begin == 0:
                raise ValueError(f"{path}: no name in front of byte {at}")
            size *= 2


def outline(spark: SparkSession, path: str, block: int = 64 << 20) -> list[Block]:
    """The blocks of all files below ``path`` and the state at which each begins; the texts are read by tasks, a row of numbers comes back for each block."""
    ranges = [(p, a, min(n, a + block)) for p, n in bundle_files(path) for a in range(0, n, block)]
    if not ranges:
        return []
    df = spark.createDataFrame(ranges, "path string, start long, finish long").repartition(len(ranges), "path", "start")
    told = {(r.path, r.start, r.begins): r for r in df.mapInPandas(_summaries, _SUMMARY).collect()}  # two rows a block
    out, names = [], {}
    for i, (p, start, end) in enumerate(ranges):
        if start == 0:
            inside, depth, section = False, 0, -1
        r = told[p, start, int(inside)]
        left = depth - r.closes
        if left < 0:
            raise ValueError(f"{p}: more is closed than opened between bytes {start} and {end}")
        if section >= 0 and (p, section) not in names:
            names[p, section] = _key_before(p, section)
        out.append(Block(p, start, end, inside, r.escaped, depth, section, names.get((p, section)), left >= 2))
        if left < 2:
            section = (r.second, r.first)[left] if left + r.opened >= 2 else -1
        inside, depth = r.inside, left + r.opened
        if (i + 1 == len(ranges) or ranges[i + 1][0] != p) and (inside or depth):
            raise ValueError(f"{p} ends inside a value")
    return out


def _entries(block: Block, wanted: Sequence[str] | None) -> Iterator[tuple[str | None, str | None, str]]:
    """(section, key, body) of the entries whose begin is in the block; the last is read to its end, wherever that is.

    An entry begins behind the bracket that opens its section or behind a comma directly inside it.
    """
    system, at = _open(block.path)
    inside, escaped, depth, section = block.inside, block.escaped, block.depth, block.name
    pos, parts, last = block.start, None, b""  # parts: the text so far of the entry that is open
    with system.open_input_file(at) as f:
        f.seek(block.start)
        while pos < block.end or parts is not None:
            text = f.read(CHUNK)
            if not text:
                return
            data = np.frombuffer(text, np.uint8)
            where, what, inside, escaped = _structure(data, inside, escaped)
            step = np.where(what == 44, 0, np.where((what == 123) | (what == 91), 1, -1))
            level = depth + np.cumsum(step)
            edge = ((step == 0) & (level == 2)) | ((step == 1) & (level == 2)) | ((step == -1) & (level == 1))
            done = 0
            for i in np.flatnonzero(edge):
                here = int(where[i])
                if parts is not None:
                    parts.append(text[done:here])
                    if wanted is None or section in wanted:
                        yield from _entry(section, b"".join(parts))
                    parts = None
                if pos + here >= block.end:
                    return
                if step[i] == 1:
                    section = _key_before(block.path, pos + here)
                if step[i] >= 0:
                    parts, done = [], here + 1
            if parts is not None and (wanted is None or section in wanted):
                parts.append(text[done:])
            depth = int(level[-1]) if len(level) else depth
            pos += len(text)


def _entry(section: str | None, text: bytes) -> Iterator[tuple[str | None, str | None, str]]:
    text = text.decode("utf-8").strip(" \t\r\n")
    if not text:
        return  # a section without entries
    key, body = None, text
    if text[0] == '"':
        name, end = json.JSONDecoder().raw_decode(text)
        rest = text[end:].lstrip(" \t\r\n")
        if rest[:1] == ":":
            key, body = name, rest[1:].strip(" \t\r\n")
    yield section, key, body


class _Part(InputPartition):
    def __init__(self, block: Block, wanted: Sequence[str] | None):
        self.block, self.wanted = block, wanted


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks, self.wanted = options.get("path"), options.get("blocks"), None

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("section",):
                named = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.wanted = sorted(named if self.wanted is None else named & set(self.wanted))
            else:
                yield x

    def partitions(self):
        if self.blocks is not None:
            blocks = [Block(*x) for x in json.loads(self.blocks)]
        else:
            blocks = [Block(p, 0, n, False, False, 0, -1, None, False) for p, n in bundle_files(self.path)]
        # a block that holds nothing but another section is not read
        return [_Part(b, self.wanted) for b in blocks if self.wanted is None or not b.whole or b.name in self.wanted] or [_Part(None, None)]

    def read(self, partition):
        return _entries(partition.block, partition.wanted) if partition.block else iter(())


class JsonBundle(DataSource):
    """Format ``json_bundle``: (section, key, body) of every entry of the bundles below ``path``; ``body`` is JSON text.

    A filter by section reaches the reader. With the option ``blocks``, what ``outline`` says, each block is a partition;
    without it each file is one.
    """

    @classmethod
    def name(cls) -> str:
        return "json_bundle"

    def schema(self) -> str:
        return "section string, key string, body string"

    def reader(self, schema):
        return _Reader(self.options)


def scan_bundle(spark: SparkSession, path: str, *, block: int = 64 << 20) -> DataFrame:
    """L1: (section, key, body) of all sections of the bundles below ``path``, a task for each ``block`` bytes.

    The key of an array's element is null. Two entries of one key are two rows. An entry has to fit into a task, a bundle
    need not. Sections that are neither object nor array, such as a version number, have no rows. A file that ends inside
    a value is an error, an empty file has no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonBundle)
    return spark.read.format("json_bundle").option("path", path).option("blocks", json.dumps(outline(spark, path, block))).load()


def bundle_section(entries: DataFrame, section: str, fields: str) -> DataFrame:
    """(key, *fields) of one section of ``scan_bundle``; only the fields that are used are parsed."""
    body = F.from_json("body", f"struct<{fields}>").alias("__v")
    return entries.where(F.col("section") == section).select("key", body).select("key", "__v.*")
