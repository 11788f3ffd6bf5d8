"""A training corpus from raw documents: each stage works on what the one before it kept.

Quality rules drop documents that fail; near-duplicates (five-word shingles, similarity 0.8) leave the
one of least id of each group; documents holding a benchmark passage go; personal data is replaced in
the texts; the rest is interleaved to the target weights, every row with its place in the mix.

Null, empty and blank texts fail the quality rules and go there. Rows with a null id pass near-duplicates and decontamination
as rows of their own. Repeated rows are near-duplicates of each other: one stays. Ties go to the least id. Very
long texts are read whole by every stage. An empty table stays empty, with its columns; further columns are handed on, and
of the columns the mix adds those are left out whose names are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clozemill.llm import decontaminate, minhash, mixing, pii, quality
from clozemill.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]

#: The personal-data stage is a trained model, which SQL cannot express; tests hold the run
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
