"""Tables the stages hand to each other, built once per application.

The offline order is quiz table, vocabulary, models; each stage stores its result in
the shared folder and later stages read it, so a lost executor costs a file read and
not a recomputation of the whole chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clozemill.operators import relational, sampling, tfidf
from clozemill.plans.quizview import quiz_view
from clozemill.session import shared_dir
from clozemill.sources.tables import artefact_record, fingerprint, materialise, write_parquet


def stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Per application, so that no table of an earlier input is picked up."""
    source = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    return shared_dir(spark, f"{spark.sparkContext.applicationId}/{source}/{name}")


def input_stamp(spark: SparkSession, sf_dir: str, **settings) -> str:
    """Stamp of the tables of a folder and the settings of a stage; a changed table makes its stages stale."""
    return fingerprint(spark, [sf_dir], settings)


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], force: bool = False,
           **settings) -> DataFrame:
    """Stage table of these inputs and settings, built if there is none; ``force`` builds it anyway."""
    return materialise(spark, stage_path(spark, sf_dir, name), build, force,
                       stamp=input_stamp(spark, sf_dir, **settings))


def stage_runs(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Run table ``stage, rows, ms`` of the named stages that have been built."""
    records = [(n, artefact_record(spark, stage_path(spark, sf_dir, n))) for n in names]
    return spark.createDataFrame(
        [(n, r.get("rows"), r.get("ms")) for n, r in records if r], "stage string, rows long, ms long")


def stored(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder, written now and read back."""
    path = shared_dir(df.sparkSession)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quiz_table(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    """Quiz rows with their exact train / val / test split."""

    def build() -> DataFrame:
        rows = staged(spark, sf_dir, "quiz_raw", lambda: quiz_view(spark, sf_dir), force)
        return sampling.split_exact(rows)

    return staged(spark, sf_dir, "quiz", build, force)


def corpus(quiz: DataFrame) -> DataFrame:
    return quiz.select("id", relational.corpus_text().alias("text"))


def vocabulary(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    """Fitted on the train rows only, so that held-out figures see none of their own texts."""

    def build() -> DataFrame:
        return tfidf.fit_tfidf(corpus(quiz_table(spark, sf_dir).filter("split = 'train'")), stage=stored)

    return staged(spark, sf_dir, "terms", build, force)
