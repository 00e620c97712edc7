"""The corpus pipeline: quality classifier, near-duplicate removal, PII redaction, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workboard.llm import minhash_dedup, mixing, packing, pii, quality
from workboard.llm.queries import TARGETS, domain
from workboard.llm.store import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash_dedup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned by rates in [0, 1] that bring the shares kept to the targets; main documents stay."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), domain(), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in training sequences."""
    return packing.best_fit(docs)


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", near_dedup), ("pii", redact),
          ("mixing", mix), ("best_fit_packing", pack)]

#: SQL cannot express the classifier, the search tree or the packing; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
