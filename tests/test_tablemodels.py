"""Table models give what the fitted models give."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clozemill.operators import tablemodels, verifier


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        x = np.where(rng.random(12) < 0.4, rng.random(12), 0)
        rows.append((f"u{i:03d}", int(x[0] + x[3] > x[5] + 0.2), x.tolist()))
    rows.append(("zero", 0, [0.0] * 12))
    dense = spark.createDataFrame(rows, "uid string, label int, x array<double>")
    long = dense.select("uid", F.posexplode("x").alias("term_id", "w")).where("w <> 0")
    return dense, long


def test_votes_equal_the_fitted_models(spark, matrix):
    dense, long = matrix
    data = dense.withColumn("features", array_to_vector("x"))
    voters = [LogisticRegression(regParam=p).fit(data) for p in (0.01, 0.5)]
    want = {r.uid: r for r in verifier.score(verifier.Verifier(voters), data.select("uid", "features")).collect()}
    tables = tablemodels.linear_tables(spark, voters)
    got = tablemodels.vote_scores(dense.select("uid", "label"), long, *tables).collect()
    assert len(got) == 121
    for r in got:
        assert r.probability == pytest.approx(want[r.uid].probability, abs=1e-9) and r.predicted == want[r.uid].predicted
        assert len(r.probabilities) == 2
    none = tablemodels.vote_scores(dense.select("uid").limit(0), long, *tables)
    assert none.count() == 0


def test_ranker_rows_equal_the_fitted_model(spark, matrix):
    dense, _ = matrix
    names = ["a", "b", "c"]
    data = dense.select("uid", F.col("label").cast("double").alias("label"), *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    model = LogisticRegression(regParam=0.1).fit(packed)
    rows = [("intercept", float(model.intercept)), *[(n, float(w)) for n, w in zip(names, model.coefficients)]]
    table = spark.createDataFrame(rows, "feature string, weight double")
    want = {r.uid: float(r.probability[1]) for r in model.transform(packed).collect()}
    for r in tablemodels.rank_scores(data, table, names).collect():
        assert r.prob == pytest.approx(want[r.uid], abs=1e-9)
    assert {r.prob for r in tablemodels.rank_scores(data, table.limit(0), names).collect()} == {0.5}


def test_nearest_centres_equal_all_distances(spark, matrix):
    dense, long = matrix
    rng = np.random.default_rng(8)
    centres = np.where(rng.random((4, 12)) < 0.6, rng.random((4, 12)), 0)
    rows = [(c, t, float(centres[c, t])) for c in range(4) for t in range(12) if centres[c, t]]
    table = spark.createDataFrame(rows, "cluster_id int, term_id int, value double")
    placed = tablemodels.nearest_centre(dense.select("uid"), long, table)
    got = {r.uid: (r.cluster_id, r.distance) for r in placed.collect()}
    total = np.zeros(4)
    for r in dense.collect():
        far = ((centres - np.array(r.x)) ** 2).sum(1)
        assert got[r.uid] == (far.argmin(), pytest.approx(far.min()))
        total[far.argmin()] += far.min()
    for r in tablemodels.cluster_inertia(placed).collect():
        assert r.inertia == pytest.approx(total[r.cluster_id])
