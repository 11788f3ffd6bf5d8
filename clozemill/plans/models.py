"""Model stages: each model is trained once per application and loaded afterwards."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from clozemill.operators import clusters, distractors, embeddings, relational, tfidf, verifier
from clozemill.plans.stages import input_stamp, quiz_table, stage_path, staged, stored, vocabulary
from clozemill.sources.tables import (
    artefact_params, artefact_record, drop_artefact, materialise_model, save_params,
)

DIM = 100


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz_table(spark, sf_dir).filter("split = 'train'")


def val_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz_table(spark, sf_dir).filter("split = 'val'")


def word_vectors(spark: SparkSession, sf_dir: str, force: bool = False) -> tuple[DataFrame, int]:
    """The vectors as a stage table, and their number."""

    def build() -> DataFrame:
        return embeddings.word_vectors(embeddings.train_word2vec(train_rows(spark, sf_dir), DIM, stage=stored))

    table = staged(spark, sf_dir, "vectors", build, force, dim=DIM)
    return table, table.count()


def ranker(spark: SparkSession, sf_dir: str, force: bool = False) -> LogisticRegressionModel:
    def build():
        vectors, n = word_vectors(spark, sf_dir)
        return distractors.train_ranker(train_rows(spark, sf_dir), vectors, n, DIM, stage=stored), {}

    path = stage_path(spark, sf_dir, "ranker")
    return materialise_model(
        spark, path, build, LogisticRegressionModel.load, force, input_stamp(spark, sf_dir, dim=DIM))[0]


def cluster_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    texts = rows.select("id", relational.cluster_text().alias("text"))
    return tfidf.tfidf_vectors(texts, vocabulary(spark, sf_dir))


def kmeans(
    spark: SparkSession, sf_dir: str, starts: int = 10, force: bool = False, sampled: bool = True
) -> tuple[KMeansModel, dict]:
    """Model with its inertia and, with ``sampled``, the silhouette of a seeded sample stored beside it."""

    def build():
        vectors = cluster_vectors(spark, sf_dir, train_rows(spark, sf_dir)).persist()
        try:
            model, inertia = clusters.train_kmeans(vectors, starts=starts)
            if not sampled:
                return model, {"inertia": inertia}
            found = clusters.silhouette(
                clusters.assign(model, vectors), vector="features", rows=clusters.SAMPLE_ROWS).first()
            return model, {"inertia": inertia, "silhouette": found["silhouette"]}
        finally:
            vectors.unpersist()

    return materialise_model(spark, stage_path(spark, sf_dir, "kmeans"), build, KMeansModel.load, force,
                             input_stamp(spark, sf_dir, starts=starts))


def answer_verifier(spark: SparkSession, sf_dir: str, force: bool = False) -> verifier.Verifier:
    path = stage_path(spark, sf_dir, "verifier")
    stamp = input_stamp(spark, sf_dir)
    if force or artefact_record(spark, path).get("stamp") != stamp:
        drop_artefact(spark, path)
        model = verifier.train_verifier(train_rows(spark, sf_dir), vocabulary(spark, sf_dir))
        verifier.save(model, path)
        save_params(spark, path, model.params, stamp)
        return model
    model = verifier.load(path)
    model.params = artefact_params(spark, path)
    return model
