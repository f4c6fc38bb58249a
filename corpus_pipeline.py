"""Corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written and read again as the next stage's docs.
All but the last return the columns of documents. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifdrift.llm import decontaminate, lang_id, line_dedup, near_dedup, packing
from motifdrift.llm.shared import table, written

#: SQL can't express the trained language model, nor packing: tests compare each stage with a brute-force version.
ORACLE_SQL = None
#: Documents that share this much of their word shingles are near-duplicates (op10_near_dedup's contract has 85).
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: without a letter, or without a main language. The model learns from docs."""
    return lang_id.identified(docs, lang_id.fitted(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that three documents or more share, but for the last holder; no document goes."""
    return line_dedup.with_kept_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (a Jaccard of 0.8 or more): the one with the smallest id."""
    return near_dedup.first_of_groups(docs, least_percent=NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bin, its place there, and the bin's capacity."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing_plan)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
