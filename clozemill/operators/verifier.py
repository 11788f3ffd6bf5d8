"""Answer verifier: two logistic models that vote by mean probability."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.operators.relational import unpivot_options, verifier_text
from clozemill.operators.sampling import two_level_rank
from clozemill.operators.tfidf import MAX_TERMS, tfidf_vectors
from clozemill.sources.tables import outputs_exist

GRID = (0.1, 1.0, 10.0)
FOLDS = 3
SECOND_PENALTY = 1e-4
TOLERANCE = 1e-4
#: Rows of one task of a fit. Every step of a fit is a job over all rows, in which a task of few
#: short rows costs more than its work.
TASK_ROWS = 250_000


@dataclass
class Verifier:
    """The voters; every one is a fitted probabilistic classifier."""

    voters: list
    params: dict = field(default_factory=dict)


def training_rows(quiz: DataFrame, terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """``uid, id, opt, label, features``: four rows per question."""
    rows = unpivot_options(quiz).withColumn("uid", F.concat_ws(":", "id", "opt"))
    return tfidf_vectors(rows, terms, "uid", max_terms=max_terms)


def with_folds(rows: DataFrame, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Seeded folds with the same label mix in each."""
    return two_level_rank(rows, "label", "uid", seed).withColumn(
        "fold", F.pmod("rank", F.lit(folds)).cast("int")
    ).drop("rank")


def _logistic(penalty: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=TOLERANCE
    )


def train_verifier(
    quiz: DataFrame, terms: DataFrame, grid: tuple[float, ...] = GRID, folds: int = FOLDS,
    max_iter: int = 1000, parallelism: int = 3, naive_bayes: bool = False,
) -> Verifier:
    """First voter: inverse penalty C by cross-validated accuracy, refitted on all rows.
    Second voter: a fixed penalty on the mean loss. Optional third: naive Bayes."""
    tasks = max(1, -(-4 * quiz.count() // TASK_ROWS))
    rows = with_folds(training_rows(quiz, terms), folds).select("label", "features", "fold").repartition(tasks).persist()
    try:
        n = rows.count()
        fitted = max(1, n * (folds - 1) // folds)
        base = _logistic(0.0, max_iter)
        search = CrossValidator(
            estimator=base,
            estimatorParamMaps=ParamGridBuilder()
            .addGrid(base.regParam, [1.0 / (c * fitted) for c in grid]).build(),
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            numFolds=folds, foldCol="fold", parallelism=parallelism,
        ).fit(rows)
        accuracy = dict(zip(grid, search.avgMetrics))
        best = max(grid, key=lambda c: (accuracy[c], -grid.index(c)))
        voters = [
            _logistic(1.0 / (best * n), max_iter).fit(rows),
            _logistic(SECOND_PENALTY, max_iter).fit(rows),
        ]
        if naive_bayes:
            from pyspark.ml.classification import NaiveBayes

            voters.append(NaiveBayes().fit(rows))
        params = {"C": best, "accuracy": {str(c): a for c, a in accuracy.items()}, "rows": n}
        return Verifier(voters, params)
    finally:
        rows.unpersist()


def vote(probabilities: list[Column]) -> tuple[Column, Column]:
    """Predicted label and probability of class 1 from each voter's class-1 probability;
    a tie is 0."""
    mean = sum(probabilities[1:], probabilities[0]) / len(probabilities)
    return (mean > 1 - mean).cast("int"), mean


def score(verifier: Verifier, rows: DataFrame) -> DataFrame:
    """Add ``predicted`` and ``probability`` to rows with ``features``; map-only, also
    on a stream."""
    out = rows
    for i, model in enumerate(verifier.voters):
        keep = out.columns
        out = model.transform(out).select(
            *keep, F.get(vector_to_array("probability"), F.lit(1)).alias(f"_p{i}")
        )
    names = [f"_p{i}" for i in range(len(verifier.voters))]
    label, mean = vote([F.col(c) for c in names])
    return out.select(
        *[c for c in rows.columns if c != "features"], label.alias("predicted"),
        mean.alias("probability"),
    )


def verify(
    verifier: Verifier, df: DataFrame, terms: DataFrame, key: str, stem: str = "question_stem",
    option: str = "option", max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Label and probability for any stem and option pair."""
    rows = df.withColumn("text", verifier_text(F.col(stem), F.col(option)))
    return score(verifier, tfidf_vectors(rows, terms, key, max_terms=max_terms))


def evaluate(verifier: Verifier, quiz: DataFrame, terms: DataFrame) -> DataFrame:
    """``uid, id, opt, label, predicted, probability`` for the options of held-out rows."""
    return score(verifier, training_rows(quiz, terms))


def save(verifier: Verifier, path: str) -> None:
    for i, model in enumerate(verifier.voters):
        model.write().overwrite().save(f"{path}/voter{i}")


def load(path: str) -> Verifier:
    """All stored voters, each as the class it was saved from."""
    spark, voters = SparkSession.active(), []
    while outputs_exist(spark, f"{path}/voter{len(voters)}/metadata"):
        voters.append(DefaultParamsReader.loadParamsInstance(f"{path}/voter{len(voters)}", spark))
    return Verifier(voters)
