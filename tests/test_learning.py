"""Learned operators on data with a known answer, checked against brute force."""

import math
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozemill.operators import cells, clusters, distractors, embeddings, tfidf, verifier
from clozemill.functions.words import LETTERS
from clozemill.plans.stages import stored


def quiz(spark, n=24):
    """The right option is always a 'good' word, the others 'bad' ones."""
    rows = []
    for i in range(n):
        options = [f"bad{(i + j) % 4} rotten" for j in range(4)]
        options[i % 4] = f"good{i % 3} splendid"
        rows.append((i, f"Anna met Otto in Paris. Good{i % 3} things splendid. Rotten bad{i % 4} days.", "Which thing?", *options, LETTERS[i % 4]))
    return spark.createDataFrame(rows, "id long, article string, question string, A string, B string, C string, D string, answer string")


@pytest.fixture(scope="module")
def terms(spark, tmp_path_factory):
    docs = quiz(spark).select("id", F.concat_ws(" ", "article", "A", "B", "C", "D").alias("text"))
    path = str(tmp_path_factory.mktemp("terms") / "t")
    tfidf.fit_tfidf(docs).write.parquet(path)
    return spark.read.parquet(path)


def test_verifier_learns_separable_options(spark, terms, tmp_path):
    model = verifier.train_verifier(quiz(spark), terms, grid=(1.0, 10.0), max_iter=50)
    assert model.params["rows"] == 96 and model.params["C"] in (1.0, 10.0)
    scored = verifier.evaluate(model, quiz(spark), terms)
    assert scored.filter("predicted <> label").count() == 0
    verifier.save(model, str(tmp_path / "v"))
    again = verifier.evaluate(verifier.load(str(tmp_path / "v")), quiz(spark), terms)
    one = {r.uid: r.probability for r in scored.collect()}
    assert {r.uid: r.probability for r in again.collect()} == pytest.approx(one)
    pair = spark.createDataFrame([("x", "Which thing?", "good1 splendid"), ("y", "Which thing?", "bad1 rotten")], "k string, question_stem string, option string")
    got = {r.k: r.predicted for r in verifier.verify(model, pair, terms, "k").collect()}
    assert got == {"x": 1, "y": 0}


def test_folds_keep_the_label_mix(spark, terms):
    rows = verifier.with_folds(verifier.training_rows(quiz(spark), terms))
    counts = {(r.fold, r.label): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    assert counts == {(f, l): 8 if l else 24 for f in range(3) for l in (0, 1)}


def test_votes(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.9, 0.2), (0.2, 0.3)], "a double, b double")
    label, mean = verifier.vote([F.col("a"), F.col("b")])
    assert [tuple(r) for r in df.select(label, F.round(mean, 6)).collect()] == [(0, 0.5), (1, 0.55), (0, 0.25)]


def test_kmeans_finds_blobs(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    rows = [(i, Vectors.dense(rng.normal(5 * (i % 3), 0.1, 2).tolist())) for i in range(60)]
    df = spark.createDataFrame(rows, ["id", "features"])
    model, cost = clusters.train_kmeans(df, k=3, starts=3)
    got = clusters.assign(model, df).select("id", "cluster_id").collect()
    assert len({(r.id % 3, r.cluster_id) for r in got}) == 3 and cost < 5
    score = clusters.silhouette(clusters.assign(model, df), vector="features").first()[0]
    assert score > 0.9


def brute_silhouette(x, c):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        same = (c == c[i]).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = d[c == c[i]].sum() / (same - 1)
        b = min(d[c == k].mean() for k in set(c.tolist()) if k != c[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_is_exact_in_any_blocking(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x = np.where(rng.random((40, 6)) < 0.5, 0, rng.random((40, 6)))
    x[3] = 0
    c = np.array([i % 4 for i in range(39)] + [9])
    df = spark.createDataFrame(
        [(i, Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(row) if v]), int(k)) for i, (row, k) in enumerate(zip(x, c))],
        ["id", "features", "cluster_id"])
    want = brute_silhouette(x, c)
    for block in (512, 7):
        parts = clusters.silhouette_parts(df, 40, vector="features", block=block)
        assert parts.agg(F.avg("s")).first()[0] == pytest.approx(want)


def test_nearest_is_exact_in_any_blocking(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    want = {i: [j for j in np.lexsort((np.arange(50), -sims[i])) if j != i][:4] for i in range(50)}
    for block in (4096, 9):
        got = embeddings.nearest(df, df, 4, 50, 50, "id", "id", block=block).collect()
        assert {i: [r.p for r in sorted((r for r in got if r.q == i), key=lambda r: r["rank"])] for i in range(50)} == want


def test_mean_of_known_tokens_only(spark):
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("fox", [0.0, 1.0])], "word string, vector array<double>")
    phrases = spark.createDataFrame([("red fox",), ("red zzz",), ("zzz",)], "phrase string")
    got = {r.phrase: r["mean"] for r in embeddings.phrase_vectors(phrases, vectors, 2, 2).collect()}
    assert got == {"red fox": [0.5, 0.5], "red zzz": [1.0, 0.0]}


def test_candidate_features(spark):
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("fox", [0.0, 1.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame(
        [(1, "red", "red fox", "red red fox"), (1, "zzz", "red fox", "red red fox"), (2, "red", "zzz", "none")],
        "id long, cand string, answer string, low_article string")
    got = {(r.id, r.cand): r for r in distractors.candidate_features(pairs, vectors, ["id"], 2, 2).collect()}
    assert got[(1, "red")].sim == pytest.approx(math.sqrt(0.5)) and got[(1, "red")].freq == 2
    assert got[(1, "zzz")].sim == 0.0 and got[(2, "red")].sim == 0.0
    assert got[(1, "red")].len_diff == 4


def test_ranker_and_ranked_distractors(spark):
    model = embeddings.train_word2vec(quiz(spark), dim=8, epochs=1)
    vectors = embeddings.word_vectors(model).cache()
    n = vectors.count()
    ranker = distractors.train_ranker(quiz(spark), vectors, n, 8)
    rows = distractors.with_candidates(quiz(spark)).withColumn("answer", F.lit("Otto"))
    got = distractors.generate_distractors(rows, ["id"], "answer", 3, vectors, ranker, n, 8).collect()
    for r in got:
        assert len(r.distractors) == 3 and "otto" not in r.distractors and set(r.distractors) <= set(r.candidates)
    answers = quiz(spark).select("id", "article", F.lit("anna").alias("answer"))
    near = embeddings.nearest_words(answers, vectors, n, cells.build(vectors, stored, "word"), stored).collect()
    # tokens of the passage, not parts of them: `thing` may be named beside `things`
    texts = {r.id: set(re.findall(r"\w+|[^\w\s]", r.article.lower())) for r in quiz(spark).collect()}
    assert near and all(r.word not in texts[r.id] and r["rank"] <= 3 for r in near)


def test_ranker_learns_from_every_row(spark):
    # the rows behind the first 2,000 are of another kind: they decide what a long wrong option means
    rows = [(i, "Anna met Otto in Paris.", "Who met?", "Otto", *(["x" * 9 if i >= 2000 else "y"] * 3), "A") for i in range(4100)]
    df = spark.createDataFrame(rows, "id long, article string, question string, A string, B string, C string, D string, answer string")
    vectors = spark.createDataFrame([("otto", [1.0, 0.0]), ("anna", [0.0, 1.0])], "word string, vector array<double>")
    pairs = distractors.ranker_rows(df)
    assert pairs.select("id").distinct().count() == 4100
    assert pairs.columns == ["id", "answer", "cand", "label", "freq"]
    got = {(r.cand, r.label, r.freq) for r in pairs.where("id = 4000").collect()}
    assert ("x" * 9, 1.0, 0) in got and ("anna", 0.0, 1) in got
    one, first = (distractors.train_ranker(df, vectors, 2, 2, n).coefficients[3] for n in (None, 2000))
    assert distractors.ranker_rows(df, 2000).select("id").distinct().count() == 2000
    assert one > first


def test_silhouette_is_of_every_row(spark):
    from pyspark.ml.linalg import Vectors

    # more rows than the 5,000 that were sampled
    n = 2600
    rng = np.random.default_rng(7)
    x = np.where(rng.random((n, 12)) < 0.7, 0, rng.random((n, 12)))
    c = rng.integers(0, 3, n)
    rows = [(i, Vectors.sparse(12, [(j, float(v)) for j, v in enumerate(row) if v]), int(k)) for i, (row, k) in enumerate(zip(x, c))]
    df = spark.createDataFrame(rows, ["id", "features", "cluster_id"])
    more = df.selectExpr(f"id + {n} id", "features", "cluster_id")
    both = df.union(more)
    want = brute_silhouette(np.concatenate([x, x]), np.concatenate([c, c]))
    assert clusters.silhouette(both, vector="features").first()[0] == pytest.approx(want)
    one = clusters.silhouette(both, vector="features", rows=300).first()[0]
    assert one != pytest.approx(want, abs=1e-9)
    for block in (700, 16384):
        parts = clusters.silhouette_parts(both, 2 * n, vector="features", block=block)
        assert parts.count() == 2 * n and parts.agg(F.avg("s")).first()[0] == pytest.approx(want)


def test_starts_of_kmeans_go_side_by_side(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(Vectors.dense(row.tolist()),) for row in rng.random((200, 3))], ["features"]).coalesce(1).cache()
    alone = [KMeans(k=4, seed=42 + i, initMode="k-means||", maxIter=100, featuresCol="features").fit(df) for i in range(5)]
    want = min(alone, key=lambda m: m.summary.trainingCost)
    at_once, most, lock = [0], [0], threading.Lock()

    class Counted(KMeans):
        def fit(self, rows):
            with lock:
                at_once[0] += 1
                most[0] = max(most[0], at_once[0])
            try:
                return super().fit(rows)
            finally:
                with lock:
                    at_once[0] -= 1

    monkeypatch.setattr(clusters, "KMeans", Counted)
    model, cost = clusters.train_kmeans(df, k=4, starts=5)
    assert cost == pytest.approx(want.summary.trainingCost) and 1 < most[0] <= clusters.AT_ONCE
    assert np.allclose(model.clusterCenters(), want.clusterCenters())
