"""The dealt queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.deploy import ship_package
from fieldlab.llm import conversations, decontaminate, divergence, html, language, licenses, linededup, mixing, neardup, quality, secrets, simhash, spelling
from fieldlab.llm.common import read


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(read(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("items", "hits")


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(read(spark, folder, "pages"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, folder, "documents"))


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, folder, "documents"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = divergence.judge(read(spark, folder, "documents"))
    return measured.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op10_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, folder, "documents")).drop("text_id")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read(spark, folder, "documents"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, folder, "conversations")))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_classes(read(spark, folder, "documents"))


_ALL = (
    op1_secrets, op2_mixing, op3_language, op4_quality, op5_decontaminate, op6_html, op7_licenses, op8_lines, op9_rules, op10_neardup,
    op11_spelling, op12_conversations, op13_simhash,
)


def _shipped(query):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {}
