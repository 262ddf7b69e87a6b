"""A corpus pipeline: five operators in a row, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.decontaminate import decontaminate
from rankmill.llm.line_dedup import line_dedup
from rankmill.llm.mixing import mix_sources
from rankmill.llm.ngram_join import drop_near_duplicates
from rankmill.llm.quality_model import keep_quality
from rankmill.llm.shared import discard, documents, fresh, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    return keep_quality(docs, documents(spark, sf_dir, "labels"), threshold=0.3)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; one that had nothing else goes. n_chars follows."""
    lines, dropped = (F.col(c) for c in fresh(docs, "n_lines", "n_dropped"))
    d = line_dedup(docs).where((dropped == 0) | (dropped < lines))
    return d.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    return drop_near_duplicates(docs, n=5, percent=80).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, shuffled; with copy and copies."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", boilerplate_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The trained classifier and the joins have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # a table of the stage before; nothing for the input
    return STAGES[-1][1](spark, docs, sf_dir)
