"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, packing, each over all that the stage before kept.

Every stage but the last returns the columns of documents. Each stage's rows are written as Parquet in the
shared folder and read again, so a lost executor costs one stage's tasks and no more.

Defined cases: null texts fail the quality rules and go; null ids, languages and sources are values like others (rows without an id have no
near copies and stay); repeated rows are near copies of each other, of which one stays; texts are whole, however long; extra columns stay up to the
last stage, whatever their names; without a column n_chars none is made; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, neardup, packing, quality, secrets
from tidemark.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive thresholds keep."""
    return quality.filter_docs(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_duplicates(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by signs; none is dropped."""
    return secrets.redact(spark, docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(spark, docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality_rules), ("neardup", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("packing", pack_batches)]

#: The secrets stage's dynamic programme can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
