"""A training corpus in five stages; each reads the table that the one before wrote.

In all stages: a row is a document, whatever its doc_id. Null text counts as empty, and stays null where a
stage changes nothing in it. Of documents that tie (share a doc_id, or have none) the one that stands first in
the table counts as first. Repeated rows are documents like any others. Very long texts are processed whole.
Empty tables give empty results. Columns other than those that a stage reads pass through, whatever their
names; ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstats.llm import decontaminate, packing, quality, repeats, simhash
from snapstats.llm.common import scratch


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; boilerplate lines go from the others.

    Null or empty text is rejected. Lines are counted per source, a null source is one of its own, and exact
    copies count once; each row has its own verdict.
    """
    return _sized(quality.keep_quality(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines under a three-line window that has occurred before go, and so does a document without a word left.

    The order is that of doc_id, null first, then that of the table; so of copies the first stays as it is.
    Null and empty texts go, as they have no word.
    """
    return _sized(repeats.without_later_lines(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, null last, then the first in the table.

    Candidates are all pairs that the anchors find (fingerprints two bits apart or fewer) and those of shared samples; they are compared by
    their sketches, unless they are in one group already. Texts without a word are near-duplicates of each other.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of the benchmark go; all rows stay. An empty benchmark leaves everything as it is."""
    return _sized(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. A null or empty text is its end mark alone; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: No SQL for the tokenizer, nor for the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage stored on its way goes as soon as its result is written; only the last one's tables stay, as its result is lazy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
