"""Files of several schemas under one: columns that came, went, or were widened between loads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, MapType, NullType, StringType, StructField, StructType

#: Whole numbers from the shortest; below, what the Parquet reader widens by itself.
WHOLE = ["tinyint", "smallint", "int", "bigint"]
READS = {"tinyint": {"smallint", "int", "bigint", "double"}, "smallint": {"int", "bigint", "double"}, "int": {"bigint", "double"}, "float": {"double"}}


def wider(a: DataType, b: DataType) -> DataType:
    """The kind that holds the values of both.

    Whole numbers: the longer. A whole number and a fraction: double, except decimals, which grow as far as 38 digits.
    Date and timestamp: timestamp. Structs: the fields of both. Anything beside a string is a string. Other pairs are an error.
    """
    x, y = a.simpleString(), b.simpleString()
    if x == y or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType))
    nested = (StructType, ArrayType, MapType)
    if not isinstance(a, nested) and not isinstance(b, nested):
        if x in WHOLE and y in WHOLE:
            return max(a, b, key=lambda k: WHOLE.index(k.simpleString()))
        tens = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
        size = lambda k: (k.precision - k.scale, k.scale) if isinstance(k, DecimalType) else (tens[k.simpleString()], 0)
        if any(isinstance(k, DecimalType) for k in (a, b)) and all(isinstance(k, DecimalType) or k.simpleString() in tens for k in (a, b)):
            whole, part = (max(p) for p in zip(size(a), size(b)))
            if whole + part <= 38:
                return DecimalType(whole + part, part)
        elif {x, y} <= {*WHOLE, "float", "double"}:
            return DoubleType()
        elif {x, y} <= {"date", "timestamp", "timestamp_ntz"} and "date" in (x, y):
            return b if x == "date" else a
        elif isinstance(a, StringType) or isinstance(b, StringType):
            return StringType()
    raise ValueError(f"nothing holds both {x} and {y}")


def merged(old: StructType, new: StructType) -> StructType:
    """The columns of both in order of appearance, each as wide as both need; names that differ by letter case only are one column."""
    out = {f.name.lower(): f for f in old.fields}
    for f in new.fields:
        was = out.get(f.name.lower())
        try:
            out[f.name.lower()] = StructField(was.name if was else f.name, wider(was.dataType, f.dataType) if was else f.dataType)
        except ValueError as e:
            raise ValueError(f"{f.name}: {e}") from None
    return StructType([StructField(f.name, f.dataType) for f in out.values()])


def _as(value: Column, kind: DataType, goal: DataType) -> Column:
    """``value`` as ``goal``: fields of structs by name, at any depth; absent ones are null."""
    if kind.simpleString() == goal.simpleString():
        return value
    if isinstance(goal, StructType):
        own = {f.name.lower(): f for f in kind.fields}
        fields = [_as(value[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType).alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in goal.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(goal, ArrayType):
        return F.transform(value, lambda x: _as(x, kind.elementType, goal.elementType))
    if isinstance(goal, MapType):
        keys = F.transform_keys(value, lambda k, v: _as(k, kind.keyType, goal.keyType))
        return F.transform_values(keys, lambda k, v: _as(v, kind.valueType, goal.valueType))
    return value.cast(goal)


def _read_as_is(schema: StructType, goal: StructType) -> bool:
    """Whether the Parquet reader itself gives ``goal``: names are written alike, and whole or floating numbers are all that is widened."""
    kinds = {f.name: f.dataType.simpleString() for f in goal.fields}
    return all(f.name in kinds and (f.dataType.simpleString() == kinds[f.name] or kinds[f.name] in READS.get(f.dataType.simpleString(), ())) for f in schema.fields)


def read_generations(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet folders ``paths``, oldest first, under the schema that holds all of them; a column that a folder lacks is null there.

    Schemas come from footers. Folders whose columns are those of the result, some of them missing or stored as shorter
    numbers, are one scan, which widens as it reads, so filters and column pruning reach the files. Folders that need a
    conversion (text for numbers, nested fields) are scans of their own, cast by name. A folder has one schema. A whole number that becomes
    a double is rounded from 2^53 on. ``columns`` selects and orders.
    """
    if not paths:
        raise ValueError("no folders")
    schemas = [spark.read.parquet(p).schema for p in paths]
    goal = reduce(merged, schemas, StructType([]))
    plain = [p for p, s in zip(paths, schemas) if _read_as_is(s, goal)]
    parts = [spark.read.schema(goal).parquet(*plain)] if plain else []
    for p, s in zip(paths, schemas):
        if p not in plain:
            own = {f.name.lower(): f for f in s.fields}
            value = lambda f: _as(F.col(f"`{own[f.name.lower()].name}`"), own[f.name.lower()].dataType, f.dataType) if f.name.lower() in own else F.lit(None).cast(f.dataType)  # noqa: E731, B023
            parts.append(spark.read.schema(s).parquet(p).select(*[value(f).alias(f.name) for f in goal.fields]))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*columns) if columns else out
