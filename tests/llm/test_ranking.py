"""Pairwise ranking: held-out accuracy, the loss against a plain minimiser, the cut, odd rows."""

import numpy as np
import pytest

from clozemill.llm import ranking

SMALL = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = ranking.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in out if r.quality == 1]
    bad = [r for r in out if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([r.predicted for r in good]) >= 0.97
    assert np.mean([r.predicted == 0 for r in bad]) >= 0.8
    ahead = np.mean([[g.score > b.score for b in bad] for g in good])
    assert ahead >= 0.97


def test_every_row_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = ranking.query(docs, labels).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_loss_is_minimal():
    """No small step from the fitted weights makes the loss smaller."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    better, worse = ranking.preferences(np.arange(40), np.arange(40, 60))

    def loss(w):
        return np.logaddexp(0, -(x @ w)[better] + (x @ w)[worse]).mean() + 0.05 * (w ** 2).sum()

    w = ranking.bradley_terry(x, better, worse, penalty=0.1, rounds=3000)
    steps = rng.normal(size=(200, 5)) * 1e-3
    assert all(loss(w) <= loss(w + s) + 1e-12 for s in steps)


def test_preferences_use_every_row():
    for good, bad in ((np.arange(7), np.arange(7, 10)), (np.arange(2), np.arange(2, 9))):
        better, worse = ranking.preferences(good, bad)
        assert set(better) == set(good) and set(worse) == set(bad)


def test_cut_is_a_quantile_of_all_scores(spark):
    scores = spark.createDataFrame([(i, i / 10) for i in range(100)], "_id long, raw double")
    labels = spark.createDataFrame([(i, int(i >= 63)) for i in range(0, 100, 3)], "doc_id long, quality int")
    level, cut = ranking.cut_at_quantile(scores, labels)
    assert 6.0 < cut <= 6.3 and level == pytest.approx(np.mean([i / 10 < cut for i in range(100)]))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "A plain line of words that runs on.", "r"), (2, "X!! Y!! Z!!", "r"), (2, "X!! Y!! Z!!", "r"),
         (3, None, "r"), (4, "", "r"), (None, "A plain line.", "r"), (5, "word " * 200_000, "r")],
        "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    out = ranking.scored(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] > by[2] and by[3] == by[4]
    assert {r.score for r in ranking.scored(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert ranking.scored(docs.limit(0), labels).count() == 0
    assert ranking.query(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
