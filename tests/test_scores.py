"""Scores and weights formed in Arrow batches against the same by rows of terms, on odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.operators import similarity, tfidf
from clozemill.operators.common import keyed, once

TEXTS = [
    "Red fox ran home. The red fox slept. Élan vital élan! Red river. 北京 大学 red.", "", None, "and the of", "x y z",
    "River red fox river. Fox red? River. " * 30, "nothing here. NOTHING HERE.", "river",
]


@pytest.fixture(scope="module")
def terms(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "id long, text string")
    return tfidf.fit_tfidf(docs).cache()


def passages(spark):
    rows = [(i % 6 if i % 7 else None, t, f"red fox {t or ''}"[:40], "river") for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "id long, article string, one string, two string")
    return once(keyed(df, "id"), sents=X.sentences(F.col("article")), q=F.array("one", F.lit(None).cast("string"), "two"))


def by_key(df):
    return {r.id: {u.pos: list(u.s) for u in r.scored} for r in df.collect() if r.id is not None}


def test_scores_equal_those_of_joined_terms(spark, terms):
    rows = passages(spark)
    got, want = by_key(similarity.sentence_scores(rows, terms, "q", 3)), by_key(similarity.joined_scores(rows, terms, "q", 3))
    assert got.keys() == want.keys() and any(want.values())
    for key, scored in want.items():
        assert got[key].keys() == scored.keys()
        for pos, s in scored.items():
            assert got[key][pos] == pytest.approx(s, abs=2e-9)


def test_scores_shuffle_no_terms(spark, terms):
    """Before, every term of a sentence was a row of a join and of two aggregates by key and place."""
    plan = similarity.sentence_scores(passages(spark), terms, "q", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_keys_stay_whole_over_batches():
    ids = [1, 1, 2, 3, 3, 3, 3, 4, None]
    rows = pa.record_batch([pa.array(ids), pa.array([[f"t{i}"] for i in range(9)]), pa.array([["q"]] * 9)], ["key", "a", "b"])
    for cuts in ([9], [1, 8], [4, 1, 4], [1] * 9, [3, 0, 3, 3]):
        batches = [rows.slice(sum(cuts[:i]), n) for i, n in enumerate(cuts)]
        for limit in (1, 7, 1 << 20):
            parts = list(similarity.whole_keys(iter(batches), limit))
            assert pa.Table.from_batches(parts).to_pylist() == rows.to_pylist()
            seen = [set(p.column(0).to_pylist()) for p in parts]
            assert sum(map(len, seen)) == len(set().union(*seen))


def test_weights_equal_those_of_joined_terms(spark, terms):
    docs = spark.createDataFrame([(i % 5 if i % 9 else None, t) for i, t in enumerate(TEXTS * 3)], "id long, text string")
    raw = tfidf.raw_weights(docs, terms)
    norms = {r.id: r.n for r in raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()}
    want = sorted((r.id or -1, r.term, r.w / norms[r.id]) for r in raw.collect())
    got = sorted((r.id or -1, r.term, r.w) for r in tfidf.tfidf_weights(docs, terms).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-12)
    plain = docs.where("id is not null").dropDuplicates(["id"])
    sparse = {r.id: r.features for r in tfidf.tfidf_vectors(plain, terms).collect()}
    for r in tfidf.unit_weights(plain, terms).collect():
        assert sparse[r.id][r.term_id] == pytest.approx(r.w)


def test_weights_move_a_row_a_text(spark, terms):
    docs = spark.createDataFrame([(1, "red fox")], "id long, text string")
    plan = tfidf.unit_weights(docs, terms)._jdf.queryExecution().optimizedPlan().toString()
    # the window stands on packed rows; terms are exploded above it
    assert plan.index("Generate") < plan.index("Window") < plan.index("MapInArrow")
    assert "Generate" not in plan[plan.index("Window"):]


def test_candidates_are_counted_in_the_row(spark):
    from clozemill.operators import distractors

    rows = [(1, "aaaa big cat BIG CAT étéété", ["aa", "Big Cat", "été", "", "none", None]), (2, None, ["x"]), (3, "x", None), (4, "x", [])]
    df = spark.createDataFrame(rows, "id long, article string, c array<string>").withColumn("low", F.lower("article"))
    made = df.select("id", distractors.frequencies(F.col("c"), F.col("low")).alias("got"), F.transform(
        "c", lambda c: X.count_substring(F.col("low"), c, lowered=True)).alias("want")).collect()
    assert [r.got for r in made] == [r.want for r in made] and made[0].got == [2, 2, 2, len(rows[0][1]) + 1, 0, None]


def test_ranked_pairs_do_not_repeat_the_article(spark, sf, monkeypatch):
    """Before, the article was copied beside each of its candidates and replaced in once for each."""
    from clozemill.operators import distractors
    from clozemill.plans import registry

    seen, features = [], distractors.candidate_features
    monkeypatch.setattr(distractors, "candidate_features", lambda pairs, *a: seen.append(pairs.columns) or features(pairs, *a))
    assert registry.ranked_table(spark, sf).count() > 0
    assert seen == [["id", "answer", "cand", "freq"]]
