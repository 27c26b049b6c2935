"""Sources, loads and sinks. Every writer takes a path; nothing is collected."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from snapstats.operators.documents import walk
from snapstats.operators.models import leaf_paths
from snapstats.sources.bundle import bundle_section, scan_bundle


def read_bundle(spark: SparkSession, path: str, section: str, fields: str) -> DataFrame:
    """L1: one section of the JSON bundles below ``path``: one row per entry, its name in ``key``. For several sections see ``sources.bundle``."""
    return bundle_section(scan_bundle(spark, path), section, fields)


def read_keyed_files(spark: SparkSession, folder: str, schema: str, pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """CSV files below a folder; ``pattern`` takes the key out of each file's path, by default its name."""
    read = spark.read.csv(folder, schema=schema, header=True, recursiveFileLookup=True)
    return read.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("key"))


def read_commented(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV seed with # comments and blank lines."""
    read = spark.read.csv(path, schema=schema, header=header, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return read.where(F.coalesce(*[F.col(c).cast("string") for c in read.columns]).isNotNull())


def labels(spark: SparkSession, root: str, marker: str = "summary.json", pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Every folder under root with a file in it that is called as ``marker`` says."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", pattern, 1).alias("label")).distinct()


def replace_slices(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite the slices that ``df`` has, whole, and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own file layer, which knows the stores that only Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the manifests of a store, in order."""
    fs, at = _files(spark, f"{root}/_manifest")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []


_MANIFEST = "table string, slice string, version string"


def manifest(spark: SparkSession, root: str, commit: int | None = None) -> DataFrame:
    """(table, slice, version): what a commit of a store says, by default its last one: where the rows of each slice are."""
    known = _commits(spark, root)
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest/{known[-1] if commit is None else commit}")


def _slice(by: Sequence[str]):
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by]), {"ignoreNullFields": "false"}).alias("slice")


def load_label(tables: dict[str, DataFrame], root: str, by: dict[str, Sequence[str]], groups: Sequence[str] | None = None) -> list[str]:
    """L8 for one label: its tables, or the named ``groups`` of them, each replacing its own slices (season and phase, and the source where it has one).

    All or nothing. Each load writes a version of its own below each table; no file of another is touched. What a
    reader sees is the manifest of the last commit, which names the version of each slice. The new manifest is written
    aside and renamed to the next number as the last step, and a rename happens or does not. So a failure anywhere
    before leaves the old state, a repeat gives the state of one load, and of two loads that commit at once the later
    one fails instead of losing the other's slices. Returns what was loaded.
    """
    wanted = [n for n in tables if groups is None or n in groups]
    if groups is not None and (unknown := set(groups) - set(tables)):
        raise ValueError(f"no such tables: {sorted(unknown)}")
    if not wanted:
        return []
    spark, version = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    known = _commits(spark, root)
    new = None
    for name in wanted:
        rows = tables[name].withColumn("version", F.lit(version))
        rows.write.mode("append").partitionBy("version", *by[name]).parquet(f"{root}/{name}")
        kinds = ", ".join(f"`{c}` {tables[name].schema[c].dataType.simpleString()}" for c in by[name])
        written = spark.read.schema(f"{kinds}, version string").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/version={version}") if _files(spark, f"{root}/{name}/version={version}")[0].exists(_files(spark, f"{root}/{name}/version={version}")[1]) else None
        if written is not None:
            own = written.select(F.lit(name).alias("table"), _slice(by[name]), "version").distinct()
            new = own if new is None else new.unionByName(own)
    old = manifest(spark, root)
    new = old if new is None else new.unionByName(old.join(new, ["table", "slice"], "left_anti"))
    aside, last = f"{root}/_manifest/_{version}", (known[-1] if known else -1) + 1
    new.write.parquet(aside)
    fs, at = _files(spark, aside)
    target = _files(spark, f"{root}/_manifest/{last}")[1]
    if fs.exists(target) or not fs.rename(at, target):
        raise RuntimeError(f"another load has committed {last} meanwhile")
    return wanted


def read_store(spark: SparkSession, root: str, name: str, by: Sequence[str], schema: str, commit: int | None = None) -> DataFrame:
    """The rows of a table as of a commit; ``schema`` names its columns. Slices and versions are folders, so the join prunes what is read."""
    rows = spark.read.schema(f"{schema}, version string").parquet(f"{root}/{name}")
    here = manifest(spark, root, commit).where(F.col("table") == name).select("slice", "version")
    return rows.withColumn("slice", _slice(by)).join(here, ["version", "slice"], "left_semi").drop("version", "slice")


def forget_versions(spark: SparkSession, root: str, names: Sequence[str], keep: int = 1) -> list[str]:
    """Delete manifests but the last ``keep``, and the versions that none of these names; returns the folders that went."""
    known, gone = _commits(spark, root), []
    used = None
    for n in known[-keep:]:
        one = manifest(spark, root, n).select("table", "version")
        used = one if used is None else used.unionByName(one)
    living = {tuple(x) for x in used.distinct().collect()} if used is not None else set()  # loads, not rows
    for name in names:
        fs, at = _files(spark, f"{root}/{name}")
        for x in fs.listStatus(at):
            folder = x.getPath().getName()
            if folder.startswith("version=") and (name, folder[8:]) not in living:
                fs.delete(x.getPath(), True)
                gone.append(f"{name}/{folder}")
    for n in known[:-keep]:
        fs, at = _files(spark, f"{root}/_manifest/{n}")
        fs.delete(at, True)
    return gone


def archive(current: DataFrame, details: DataFrame, keys: Sequence[str], label: str | Column, path: str) -> None:
    """Rows with their details, kept once under their label: a label is a partition that a repeat overwrites, and a column of labels writes all of them at once."""
    kept = current.join(details, list(keys), "left").withColumn("label", label if isinstance(label, Column) else F.lit(label))
    replace_slices(kept, path, ["label"])


def slice_key(dates: DataFrame, date: str, keys: Sequence[str] = (), season=None, phase=None) -> DataFrame:
    """For each snapshot (``keys``; all rows are one without) its season, the year the campaign ends in, and phase, from its newest match.

    Given values win; without matches the phase is the first of July.
    """
    newest = dates.groupBy(*keys).agg(F.max(date).alias("at"))
    by_date = F.when(F.month("at") >= 8, F.year("at") + 1).otherwise(F.year("at")).cast("long")
    season = F.coalesce(F.lit(season).cast("long"), by_date)
    return newest.select(*keys, season.alias("season"), F.coalesce(F.lit(phase).cast("string"), F.col("at").cast("string"), F.concat(F.lit(season).cast("string"), F.lit("-07-01"))).alias("phase"))


def reconcile(loaded: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose loaded count is not the expected one; either may be absent."""
    n = loaded.groupBy(*keys).agg(F.count("*").alias("loaded"))
    both = n.join(expected, list(keys), "full")
    both = both.fillna(0, ["loaded", "expected"])
    return both.where(F.col("loaded") != F.col("expected"))


def evolve(old: DataFrame, new: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Old and new slices under one schema: what is absent is null, what is not listed is left out."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select(*[(F.col(c) if c in both.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def positional_json(df: DataFrame, group: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per group one JSON document: the field list once, and the rows as arrays of values in order."""
    row = F.struct(*order, F.array(*[F.col(c).cast("string") for c in columns]).alias("__row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__row"])
    body = F.to_json(F.struct(F.array(*[F.lit(c) for c in columns]).alias("fields"), rows.alias("rows")))
    return df.groupBy(*group).agg(body.alias("json"), F.count("*").alias("n"))


def dropped_groups(groups: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(known, published, dropped): how many groups there are, have rows, and are left out of the export for having none."""
    held = groups.select(*keys).distinct().join(rows.select(*keys).distinct().withColumn("__held", F.lit(True)), list(keys), "left")
    return held.agg(F.count("*").alias("known"), F.count("__held").alias("published"), F.count_if(F.col("__held").isNull()).alias("dropped"))


def _inside(value, kind, path: str) -> list[tuple[str, bool, Column]]:
    """(path, whether these are keys, array of strings) for the keys of each map and for each text inside a column, through structs, arrays and maps."""
    name = kind.typeName()
    if name == "struct":
        return [x for f in kind.fields for x in _inside(value[f.name], f.dataType, f"{path}.{f.name}")]
    if name == "array":
        # of each element an array of what is inside it; types are those of the element, so paths need no data
        held = _inside(F.lit(None).cast(kind.elementType), kind.elementType, f"{path}.[]")
        at = lambda i: lambda x: _inside(x, kind.elementType, f"{path}.[]")[i][2]
        return [(p, keys, F.flatten(F.transform(value, at(i)))) for i, (p, keys, _) in enumerate(held)]
    if name == "map":
        values = _inside(F.map_values(value), ArrayType(kind.valueType), path)
        return [(f"{path}{{}}", True, F.transform(F.map_keys(value), lambda k: k.cast("string")))] + [(p.replace(f"{path}.[]", f"{path}{{}}", 1), keys, x) for p, keys, x in values]
    return [(path, False, F.array(value))] if name in ("string", "varchar", "char") else []


def leaks(spark: SparkSession, outputs: dict[str, DataFrame], banned: Sequence[str]) -> DataFrame:
    """(output, path): the fields at any depth whose name is banned, in any letter case and with blanks around it.

    Names of columns and of fields inside structs, arrays and maps are known from the schema. Keys of maps, wherever one is,
    and the fields of documents that are JSON text, at any depth of them and of further JSON text inside, are
    looked up in the data: each column that may hold some gives arrays of its keys and texts.
    """
    low, found = {b.strip().lower() for b in banned}, []
    for name, df in outputs.items():
        found += [(name, p) for p in leaf_paths(df.schema) if p.split(".")[-1].strip().lower() in low]
    out = spark.createDataFrame(found, "output string, path string")
    for name, df in outputs.items():
        for f in df.schema.fields:
            for path, keys, held in _inside(F.col(f"`{f.name}`"), f.dataType, f.name):
                each = df.select(F.explode(held).alias("x"))
                if keys:
                    own = each.where(F.lower(F.trim("x")).isin(*low)).select(F.concat(F.lit(f"{path}."), "x").alias("path"))
                else:
                    # a text without any of the words has none as a key
                    text = each.where(F.col("x").rlike(r"^\s*[\[{]") & F.lower("x").rlike("|".join(re.escape(b) for b in sorted(low))))
                    inside = walk(text, [], "x", inner=True).where(F.lower(F.trim("tag")).isin(*low))
                    own = inside.select(F.concat(F.lit(path), F.substring("path", 2, 1 << 30)).alias("path"))
                out = out.unionByName(own.distinct().select(F.lit(name).alias("output"), "path"))
    return out


def entry_log(log: DataFrame, key: Sequence[str], at: str, op: str) -> DataFrame:
    """The newest entry of each key, unless that is a deletion."""
    w = Window.partitionBy(*key).orderBy(F.desc(at))
    return log.withColumn("__k", F.row_number().over(w)).where(f"__k = 1 and {op} <> 'delete'").drop("__k", op)


def config_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """Small configuration tables as one JSON document; rows in the order of their columns."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(F.to_json(F.struct(*tables)).alias("bundle"))


def output_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files, bytes, rows and snapshots (the distinct season and phase, in order) of each written output, a folder below ``folder``.

    Rows are counted by file, from the reader's metadata, with no column read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    pattern = rf"{folder.rstrip('/').split('/')[-1]}/([^/]+)/"
    name = F.regexp_extract("path", pattern, 1)
    sizes = files.groupBy(name.alias("output")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.schema("season long, phase string").option("recursiveFileLookup", "true").parquet(folder)
    of = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("output")
    counts = rows.groupBy(of, "season", "phase").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("season", "phase"))), lambda x: F.concat_ws("/", x["season"].cast("string"), x["phase"])), ",")
    return sizes.join(counts.groupBy("output").agg(F.sum("n").alias("rows"), listed.alias("snapshots")), "output")

