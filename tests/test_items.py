"""Questions, hints and items on small passages."""

import pytest
from pyspark.sql import functions as F

from clozemill.functions.words import BLANK, NO_DISTRACTOR
from clozemill.operators import cloze, distractors, similarity, tfidf
from clozemill.plans import items

STORY = (
    "Anna visited Paris in spring. The river was cold. Boats passed under the old bridge. "
    "Anna met Otto near the Louvre. They walked along the river. Otto sold old boats. "
    "Paris was quiet. The bridge was closed. Spring ended."
)


@pytest.fixture(scope="module")
def terms(spark):
    docs = spark.createDataFrame([(1, STORY), (2, STORY)], "id long, text string")
    return tfidf.fit_tfidf(docs).cache()


def articles(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, article string")


def test_vocabulary(spark, terms):
    rows = {r.term: r for r in terms.collect()}
    assert rows["river"].df == 2 and rows["river"].cf == 4 and rows["river"].idf == pytest.approx(1.0)
    assert "the" not in rows and "otto sold" in rows
    assert sorted(r.term_id for r in rows.values()) == list(range(len(rows)))
    top = tfidf.fit_tfidf(spark.createDataFrame([(1, "b a a c"), (2, "c b a")], "id long, text string"), max_terms=2, max_n=1)
    # 'a' is a stop word; b and c tie and the term decides
    assert [(r.term, r.cf) for r in top.orderBy("term_id").collect()] == []
    top = tfidf.fit_tfidf(spark.createDataFrame([(1, "bb aa aa cc"), (2, "cc bb aa")], "id long, text string"), max_terms=2, max_n=1)
    assert [r.term for r in top.orderBy("term_id").collect()] == ["aa", "bb"]


def test_weights_have_unit_length(spark, terms):
    docs = spark.createDataFrame([(1, STORY), (2, "river"), (3, "unknown words")], "id long, text string")
    norms = tfidf.tfidf_weights(docs, terms).groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    assert {r.id: round(r.n, 9) for r in norms.collect()} == {1: 1.0, 2: 1.0}
    vectors = {r.id: r.features for r in tfidf.tfidf_vectors(docs, terms).collect()}
    assert vectors[3].numNonzeros() == 0 and vectors[2].norm(2) == pytest.approx(1.0)


def best(spark, terms, article, query):
    df = articles(spark, article).withColumn("query", F.lit(query))
    return similarity.best_sentence(df, terms).collect()


def test_best_sentence(spark, terms):
    assert best(spark, terms, STORY, "Otto sold boats")[0].pos == 5
    assert best(spark, terms, STORY, "nothing known")[0].pos == 0
    assert best(spark, terms, "River one. Other. River one.", "river")[0].pos == 0
    row = best(spark, terms, STORY, "The river was cold.")[0]
    assert row.pos == 1 and row.sim == pytest.approx(1.0)
    assert best(spark, terms, "", "river") == []


def test_questions(spark, terms):
    df = articles(spark, STORY, "", "all is lower here. nothing else.").withColumn("query", F.lit("Otto sold boats"))
    got = {r.id: (r.stem, r.chunk) for r in cloze.extract_questions(df, terms).collect()}
    assert got[0] == (f"{BLANK} sold old boats.", "Otto")
    assert got[1] == ("", "")
    assert got[2] == (f"all is lower here. {BLANK}?", "Otto sold boats")


def test_hints(spark, terms):
    df = articles(spark, STORY, "", "One.", "One. Two.").withColumn("query", F.lit("Otto sold old boats near the Louvre"))
    got = {r.id: r.hints for r in cloze.hints(df, terms).collect()}
    assert got[1] == ["", "", ""] and got[2] == ["One.", "", ""] and got[3] == ["One.", "Two.", ""]
    assert got[0][0] == "Otto sold old boats." and got[0][1] == "Anna met Otto near the Louvre."
    assert len(set(got[0])) == 3
    top = {r.id: r.hints for r in cloze.hints(df, terms, n=2).collect()}
    assert top[0] == ["Otto sold old boats.", "Anna met Otto near the Louvre."] and top[2] == ["One."]


@pytest.mark.parametrize("n, want", [
    (1, [0]), (3, [0, 1, 2]), (9, [0, 3, 6]), (10, [0, 3, 6]), (12, [0, 3, 6, 9]),
    (15, [0, 3, 6, 9, 12]), (16, [0, 3, 6, 9, 12]), (40, [0, 8, 16, 24, 32]), (0, []),
])
def test_pivots(spark, n, want):
    assert spark.range(1).select(items.pivot_positions(F.lit(n))).first()[0] == want


def test_distractors(spark):
    df = articles(spark, "Big Cat met Al. The big cat met Otto and Big Cat", "none here").withColumn("answer", F.lit("OTTO"))
    rows = distractors.with_candidates(df)
    got = {r.id: r.distractors for r in distractors.generate_distractors(rows, ["id"]).collect()}
    assert got == {0: ["big cat"], 1: ["option1", "option2", "option3"]}


def test_top_ranked_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "c", 0.5), (1, "b", 0.5), (1, "z", 0.1)], "id long, cand string, prob double")
    rows = distractors.top_ranked(df, ["id"], 2).orderBy("rank").collect()
    assert [r.cand for r in rows] == ["c", "b"]


def made(spark, terms, tmp_path, parts=4, **kw):
    def stage(df):
        path = str(tmp_path / f"stems{parts}{len(kw)}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    df = articles(spark, STORY, "", "lower only. no names.", "Only Anna here. Then Anna left. Anna slept.").repartition(parts)
    return df, items.quiz_items(df, terms, stage, **kw)


def test_items(spark, terms, tmp_path):
    df, got = made(spark, terms, tmp_path)
    rows = got.orderBy("id", "pivot_pos").collect()
    assert {r.id for r in rows} == {0, 3}
    for r in rows:
        assert BLANK in r.question_stem and len(r.options) == len(r.option_words) == 4
        assert r.option_words[r.correct_idx] == r.answer_chunk
        assert r.options[r.correct_idx] == r.question_stem.replace(BLANK, r.answer_chunk)
        assert sum(w == r.answer_chunk for w in r.option_words) == 1
        assert len(r.hints) == 3 and not any(r.answer_chunk.lower() in h.lower() for h in r.hints)
        assert r.cluster_id is None
    lonely = [r for r in rows if r.id == 3]
    assert all(set(r.option_words) == {"Anna", "Option1", "Option2", "Option3"} for r in lonely[:1])
    again = made(spark, terms, tmp_path, parts=1)[1].orderBy("id", "pivot_pos").collect()
    assert again == rows
    status = {r.id: r.status for r in items.passage_status(df, got).collect()}
    assert status == {0: "ok", 1: "blank", 2: "insufficient", 3: "ok"}


def test_items_without_distractors_are_padded(spark, terms, tmp_path):
    _, got = made(spark, terms, tmp_path, with_distractors=False)
    row = got.first()
    assert row.options.count(NO_DISTRACTOR) == 3 and row.option_words.count("") == 3


def test_distinct_pivots(spark, terms):
    twice = "Anna met Otto. Anna met Otto. Anna met Otto."
    df = articles(spark, twice)
    assert len(items.passage_stems(df, terms).first().stems) == 3
    assert len(items.passage_stems(df, terms, distinct_pivots=True).first().stems) == 1


def test_clean_distractors(spark):
    df = spark.createDataFrame([(["rome", "ROME", "paris", "anna", "new-york", "x"], "Anna")], "d array<string>, a string")
    got = df.select(items.clean_distractors(F.col("d"), F.col("a"))).first()[0]
    assert got == ["Rome", "Paris", "New-York"]
