"""Cases that an earlier version dropped, crashed on or let leak."""

import pytest
from pyspark.sql import functions as F

from clozemill.operators import cells, embeddings, profile, sampling, tfidf, verifier
from clozemill.plans.stages import stored
from clozemill.streaming.articles import MiniBatchKMeans, centre_distances


def test_density_of_very_long_texts(spark):
    df = spark.createDataFrame([("w " * 50_000,), ("w " * 60_000,), ("w",), (None,)], "text string")
    rows = profile.length_density(df, "text", 20).collect()
    assert len(rows) == 20 and all(r.density > 0 for r in rows)


def test_null_strata_are_ranked(spark):
    rows = [(i, [None, "a", "b"][i % 3], "wide") for i in range(30)] + [(30, "", "wide"), (31, "=", "wide")]
    df = spark.createDataFrame(rows, "id long, s string, text string")
    out = sampling.two_level_rank(df, "s").collect()
    assert len(out) == 32 and set(out[0].asDict()) == {"id", "s", "text", "rank"}
    assert sorted(r.rank for r in out if r.s is None) == list(range(1, 11))
    assert [r.rank for r in out if r.s in ("", "=")] == [1, 1]


def test_stratified_folds_of_a_nullable_column(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left")
    ranked = sampling.two_level_rank(rows, "quality", "doc_id")
    assert ranked.count() == rows.count()
    assert ranked.where("quality is null").agg(F.max("rank")).first()[0] == rows.where("quality is null").count()


def test_neighbours_of_phrases_and_whole_tokens(spark):
    vectors = spark.createDataFrame(
        [("art", [1.0, 0.0]), ("big", [0.9, 0.1]), ("red", [0.8, 0.2]), ("dog", [0.0, 1.0]), ("cat", [0.1, 0.9])],
        "word string, vector array<double>")
    answers = spark.createDataFrame(
        [(1, "Big red", "They start here"), (2, "big", "ART and more"), (3, "unknown", "x"), (4, "red", "big art dog cat")],
        "id long, answer string, article string")
    out = {}
    for r in embeddings.nearest_words(
            answers, vectors, 5, cells.build(vectors, stored, "word"), stored, top=2, keep=2, dim=2).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.word)
    # `start` does not hold the token `art`; own tokens are no neighbours
    assert out == {1: ["art", "cat"], 2: ["red"]}


def test_nearest_keeps_the_least_ids_among_ties(spark):
    points = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0])], "p long, vector array<double>")
    near = embeddings.nearest(points.withColumnRenamed("p", "q"), points, 3, 31, 31, block=8)
    got = {}
    for r in near.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.p)
    assert all(got[q] == [p for p in range(5) if p != q][:3] for q in range(30)) and got[99] == [0, 1, 2]


def test_texts_without_known_terms_get_the_shortest_centre(spark, tmp_path):
    weights = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "uid long, term_id int, w double")
    centres = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.2)], "cluster_id int, term_id int, value double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "uid long")
    got = {r.uid: r.cluster_id for r in centre_distances(ids, weights, centres, 2, 10).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_streamed_clusters_grow_to_k(spark, tmp_path):
    terms = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(["alpha", "beta", "gamma", "delta"])],
                                  "term_id int, term string, idf double")
    km = MiniBatchKMeans(spark, str(tmp_path / "km"), k=3, max_terms=10)
    first = km.step(spark.createDataFrame([(1, "alpha"), (2, "zzz")], "uid long, text string"), terms, 0)
    assert {r.uid for r in first.where("cluster_id is not null").collect()} == {1, 2}
    km.step(spark.createDataFrame([(i, t) for i, t in enumerate(["beta", "gamma", "delta", "alpha"], 10)],
                                  "uid long, text string"), terms, 1)
    assert km.centres(1).select("cluster_id").distinct().count() == 3
    assert km.centres(1).agg(F.count("cluster_id")).first()[0] > 0


def test_all_voters_are_loaded(spark, tmp_path):
    from test_learning import quiz

    path = str(tmp_path / "terms")
    docs = quiz(spark).select("id", F.concat_ws(" ", "article", "A", "B", "C", "D").alias("text"))
    tfidf.fit_tfidf(docs).write.parquet(path)
    terms = spark.read.parquet(path)
    model = verifier.train_verifier(quiz(spark), terms, grid=(1.0,), max_iter=20, naive_bayes=True)
    verifier.save(model, str(tmp_path / "v"))
    again = verifier.load(str(tmp_path / "v"))
    assert [type(v) for v in again.voters] == [type(v) for v in model.voters] and len(again.voters) == 3
    one, two = ({r.uid: r.probability for r in verifier.evaluate(m, quiz(spark), terms).collect()}
                for m in (model, again))
    assert two == pytest.approx(one)


def test_vocabulary_sees_train_rows_only(spark, sf):
    from clozemill.plans import stages

    quiz = stages.quiz_table(spark, sf)
    terms = {r.term for r in stages.vocabulary(spark, sf).select("term").collect()}
    held = stages.corpus(quiz.where("split <> 'train'"))
    seen = stages.corpus(quiz.where("split = 'train'"))
    only = {r.term for r in tfidf.term_counts(held).where("df >= 2").select("term").collect()} - {
        r.term for r in tfidf.term_counts(seen).select("term").collect()}
    assert only and not only & terms


def test_quiz_rows_of_every_language(spark, sf):
    from clozemill.plans import stages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = stages.quiz_table(spark, sf).select(F.col("id").alias("doc_id")).join(docs, "doc_id")
    assert got.select("lang").distinct().count() == docs.select("lang").distinct().count()


def test_fits_of_few_rows_are_one_task(spark, tmp_path, monkeypatch):
    from test_learning import quiz

    path = str(tmp_path / "terms")
    docs = quiz(spark).select("id", F.concat_ws(" ", "article", "A", "B", "C", "D").alias("text"))
    tfidf.fit_tfidf(docs).write.parquet(path)
    seen, fit = [], verifier.CrossValidator.fit
    monkeypatch.setattr(verifier.CrossValidator, "fit",
                        lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        verifier.train_verifier(quiz(spark), spark.read.parquet(path), grid=(1.0,), max_iter=5)
        monkeypatch.setattr(verifier, "TASK_ROWS", 40)
        verifier.train_verifier(quiz(spark), spark.read.parquet(path), grid=(1.0,), max_iter=5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen == [1, 3]
