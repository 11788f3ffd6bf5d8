"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clozemill.llm import (
    alignment, decontaminate, html_text, language, licences, minhash, mixing, periodic, pii, quality, ranking,
    suffix_dedup, toxicity,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.query(documents(spark, d), labels(spark, d)),
    "op2_pii": lambda spark, d: pii.query(documents(spark, d)),
    "op3_licence_scan": lambda spark, d: licences.query(documents(spark, d)),
    "op4_suffix_dedup": lambda spark, d: suffix_dedup.query(documents(spark, d)),
    "op5_source_mixing": lambda spark, d: mixing.query(documents(spark, d)),
    "op6_quality_rules": lambda spark, d: quality.query(documents(spark, d)),
    "op7_language_id": lambda spark, d: language.query(documents(spark, d)),
    "op8_decontamination": lambda spark, d: decontaminate.query(
        documents(spark, d), benchmark(spark, d)),
    "op9_html_text": lambda spark, d: html_text.query(spark.read.parquet(f"{d}/pages.parquet")),
    "op10_minhash_dedup": lambda spark, d: minhash.query(documents(spark, d)),
    "op11_token_alignment": lambda spark, d: alignment.query(documents(spark, d)),
    "op12_periodic_runs": lambda spark, d: periodic.query(documents(spark, d)),
    "op13_quality_ranking": lambda spark, d: ranking.query(documents(spark, d), labels(spark, d)),
}
