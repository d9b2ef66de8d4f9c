"""Corpus pipeline: quality, near-dedup, decontamination, redaction, mixing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next
one reads it. A stage works on all that the one before it kept; extra columns of
``documents`` go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qoslattice.llm import decontaminate, mixing, pii, quality, simhash
from qoslattice.llm.common import discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash.near_dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words it takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mix", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained classifiers and similarity joins are not expressible in SQL.
ORACLE_SQL = None
