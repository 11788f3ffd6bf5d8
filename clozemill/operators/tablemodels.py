"""Linear models and centres as tables: scoring is a join on the term and a sum.

A linear model is a long table ``term_id, voter, weight`` and a row ``voter, intercept`` for each voter; centres are
``cluster_id, term_id, value``; a ranker is ``feature, weight`` with the feature ``intercept`` among them. Models
fitted elsewhere, or stored, score the same way, and what they say can be stated in SQL. Tables are
broadcast only if their counted rows fit the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.operators.common import small
from clozemill.operators.verifier import vote


def linear_tables(spark: SparkSession, voters: list[LogisticRegressionModel]) -> tuple[DataFrame, DataFrame]:
    """``term_id, voter, weight`` (weights that are not 0) and ``voter, intercept`` of fitted logistic models.

    A model's weights are one array the size of the vocabulary cap, as the trainer gives them."""
    ids, names, weights = [], [], []
    for k, model in enumerate(voters):
        own = model.coefficients.toArray()
        at = np.flatnonzero(own)
        ids.append(at)
        names.append(np.full(len(at), k))
        weights.append(own[at])
    long = pa.table({"term_id": pa.array(np.concatenate(ids).astype(np.int32)),
                     "voter": pa.array(np.concatenate(names).astype(np.int32)), "weight": pa.array(np.concatenate(weights))})
    rows = [(k, float(model.intercept)) for k, model in enumerate(voters)]
    return spark.createDataFrame(long), spark.createDataFrame(rows, "voter int, intercept double")


def vote_scores(ids: DataFrame, weights: DataFrame, coefficients: DataFrame, intercepts: DataFrame, key: str = "uid") -> DataFrame:
    """``key, probabilities, predicted, probability``: class-1 probability of each voter, their mean, and the vote.

    ``weights`` is the long matrix ``key, term_id, w``. The voters' weights of a term travel as one array, so a term of
    a text meets its model once; the sums stand on the partitioning of the matrix. Keys without a known term, null
    keys among them, have the intercepts alone."""
    voters = [r.voter for r in intercepts.select("voter").orderBy("voter").collect()]
    n_terms = coefficients.count()
    packed = coefficients.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("voter", "weight"))).alias("_m"))
    sums = weights.join(small(packed, n_terms, 64 + 16 * len(voters)), "term_id").groupBy(key).agg(*[
        F.sum(F.col("w") * F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(0.0))).alias(f"_s{k}")
        for k in voters])
    # One row a voter.
    base = {r.voter: r.intercept for r in intercepts.collect()}
    margins = [F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) + F.lit(base[k]) for k in voters]
    odds = [1 / (1 + F.exp(-m)) for m in margins]
    label, mean = vote(odds)
    return ids.join(sums, key, "left").select(
        *ids.columns, F.array(*odds).alias("probabilities"), label.alias("predicted"), mean.alias("probability"))


def rank_scores(features: DataFrame, coefficients: DataFrame, names: list[str]) -> DataFrame:
    """The rows with ``prob``, the class-1 probability of a ranker whose weights are rows; absent weights are 0."""
    weight = {r.feature: r.weight for r in coefficients.collect()}
    margin = F.lit(weight.get("intercept", 0.0))
    for name in names:
        margin = margin + F.col(name) * F.lit(weight.get(name, 0.0))
    return features.withColumn("prob", F.round(1 / (1 + F.exp(-margin)), 12))


def centre_table(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """``cluster_id, term_id, value`` of a fitted model's centres, values that are not 0."""
    centres = np.array(model.clusterCenters())
    cluster, term = np.nonzero(centres)
    return spark.createDataFrame(pa.table({
        "cluster_id": pa.array(cluster.astype(np.int32)), "term_id": pa.array(term.astype(np.int32)),
        "value": pa.array(centres[cluster, term])}))


def nearest_centre(ids: DataFrame, weights: DataFrame, centres: DataFrame, key: str = "uid") -> DataFrame:
    """``key, cluster_id, distance``: the nearest centre of each unit vector and its squared distance.

    Distances come from shared terms and lengths: |x|² + |c|² - 2 x·c. Ties go to the smaller number. A key
    without a known term is the zero vector, nearest to the shortest centre."""
    lengths = centres.groupBy("cluster_id").agg(F.sum(F.col("value") * F.col("value")).alias("c2"))
    # A row a cluster.
    known = sorted((r.c2, r.cluster_id) for r in lengths.collect())
    by_term = centres.groupBy("term_id").agg(F.collect_list(F.struct("cluster_id", "value")).alias("_c"))
    met = weights.join(small(by_term, centres.count(), 64), "term_id", "left")
    dots = met.select(key, "w", F.explode_outer("_c").alias("_c")).groupBy(key, F.col("_c.cluster_id").alias("cluster_id")).agg(
        F.sum(F.col("w") * F.col("_c.value")).alias("dot"))
    x2 = weights.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("x2"))
    placed = dots.join(small(lengths, len(known), 32), "cluster_id").select(
        key, F.struct((F.col("c2") - 2 * F.col("dot")).alias("d"), "cluster_id").alias("m"))
    best = placed.groupBy(key).agg(F.min("m").alias("m"))
    out = ids.join(x2, key, "left").join(best, key, "left")
    if known:
        # Of centres that share no term only the shortest can be nearest.
        shortest = F.struct(F.lit(known[0][0]).alias("d"), F.lit(known[0][1]).alias("cluster_id"))
        out = out.withColumn("m", F.least(F.col("m"), shortest))
    return out.select(*ids.columns, F.col("m.cluster_id").alias("cluster_id"),
                      (F.coalesce("x2", F.lit(0.0)) + F.col("m.d")).alias("distance"))


def cluster_inertia(placed: DataFrame) -> DataFrame:
    """``cluster_id, n, inertia``."""
    return placed.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0.0), F.col("distance"))).alias("inertia"))
