"""The corpus pipeline: five stages over `documents`. Each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.deploy import ship_package
from fieldlab.functions.reuse import materialize
from fieldlab.llm import decontaminate, linededup, mixing, neardup, quality
from fieldlab.llm.common import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score(docs, read(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated chunks and passages; a document of which nothing is left goes. n_chars follows the text."""
    cut = linededup.dedup_lines(docs, carry=COLUMNS[2:]).where("n_words_removed = 0 or trim(text) != ''")
    return cut.withColumn("n_chars", F.when(F.col("n_words_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.first_of_each(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate per document, so that languages have equal expected tokens."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_weights", mixing_weights),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored before the next stage reads it."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
