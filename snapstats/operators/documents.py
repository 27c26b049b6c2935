"""Documents without a fixed schema: JSON values walked level by level as VARIANT."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What ``schema_of_variant`` begins with, and the kind of value that is.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BIGINT": "integer"}


def kind_of(value):
    """object, array, string, boolean, null, number or integer; null for what is no JSON."""
    name, out = F.schema_of_variant(value), F.lit("other")
    for begin, kind in reversed(KINDS.items()):
        out = F.when(name.startswith(begin), kind).otherwise(out)
    return F.when(value.isNotNull(), out)


def walk(df: DataFrame, keys: Sequence[str], document: str, *, inner: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(*keys, depth, parent, tag, path, kind, whole, text): a row for each value inside a JSON document, whatever its depth.

    ``tag`` is the field's name, ``[]`` for an element of an array; ``parent`` is the tag of what holds it, ``$`` for the
    document. ``whole`` is the value of a whole number, ``text`` that of a string. With ``inner`` a string that is an
    object or array as JSON text is walked, too. One level is exploded from the one above until a level is empty, so
    the work follows the number of values and no document is held by Python; ``keep`` writes a level before it is
    read twice. What is no JSON has no rows.
    """
    spark = df.sparkSession
    root = F.try_parse_json(F.col(document)).alias("v")
    level, depth, out = df.select(*keys, F.lit("$").alias("parent"), F.lit("$").alias("path"), root).where("v IS NOT NULL"), 1, None
    while True:
        # a variant of another kind than object and array explodes to nothing
        grown = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            *keys, F.lit(depth).alias("depth"), "parent", F.coalesce("key", F.lit("[]")).alias("tag"), F.concat_ws(".", "path", F.coalesce("key", F.lit("[]"))).alias("path"), "value"
        )
        grown = grown.withColumn("kind", kind_of(F.col("value")))
        grown = grown.withColumn("whole", F.when(F.col("kind") == "integer", F.try_variant_get("value", "$", "long"))).withColumn("text", F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string")))
        grown = keep(grown) if keep else grown
        out = grown.drop("value") if out is None else out.unionByName(grown.drop("value"))
        below = F.when(F.col("kind").isin("object", "array"), F.col("value"))
        if inner:
            below = F.coalesce(below, F.when(F.col("text").rlike(r"^\s*[\[{]"), F.try_parse_json("text")))
        level = grown.select(*keys, F.col("tag").alias("parent"), "path", below.alias("v")).where("v IS NOT NULL")
        if not level.head(1):
            return out
        depth += 1


def _listed(df: DataFrame, by: str, what: str, most: int) -> DataFrame:
    """``what:count`` of each ``by``, most frequent first, ``most`` of them, joined by commas."""
    counts = df.groupBy(by, what).agg(F.count("*").alias("k"))
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("k"), what))).where(F.col("i") <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", what, "k"))), lambda x: F.concat_ws(":", x[what], x["k"].cast("string")))
    return top.groupBy(by).agg(F.array_join(parts, ",").alias(f"{what}s"))


def nested_profile(values: DataFrame, entity: str, *, parents: int = 8) -> DataFrame:
    """M5 over the rows of ``walk``: for each tag its count, entities, type mix, containers, whole values and parents.

    Values are counted before they are gathered, so no task holds a tag's rows.
    """
    counts = values.groupBy("tag", "kind", "whole", "depth").agg(F.count("*").alias("k"))
    held = F.col("kind").isin("object", "array")
    stats = counts.groupBy("tag").agg(
        F.sum("k").alias("n"),
        F.coalesce(F.sum(F.when(held, F.col("k"))), F.lit(0)).alias("as_container"),
        F.count_distinct("whole").alias("distinct_values"),
        F.min("whole").alias("least"),
        F.max("whole").alias("most"),
        F.min("depth").cast("long").alias("least_depth"),
        F.max("depth").cast("long").alias("most_depth"),
    )
    entities = values.select("tag", entity).distinct().groupBy("tag").agg(F.count("*").alias("entities"))
    return stats.join(entities, "tag").join(_listed(values, "tag", "kind", 99), "tag").join(_listed(values, "tag", "parent", parents), "tag")


def nesting(values: DataFrame) -> DataFrame:
    """M5: how often a tag stands directly inside another."""
    return values.groupBy("parent", "tag").agg(F.count("*").alias("n"))
