"""Metric values worked out by hand or by a direct computation."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clozemill.operators import metrics, reports


def scores(spark, *pairs, **kw):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, hyp_text string, ref_text string")
    return [r.asDict() for r in sorted(metrics.text_scores(df, **kw).collect(), key=lambda r: r.id)]


def direct_bleu(h, r):
    if not h:
        return 0.0
    logs = []
    for n in range(1, 5):
        a = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
        b = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        o = sum((a & b).values())
        if n == 1 and o == 0:
            return 0.0
        logs.append(math.log((o or 0.1) / max(1, len(h) - n + 1)))
    bp = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))
    return bp * math.exp(sum(logs) / 4)


CASES = [
    ("the cat sat on the mat", "the cat sat on the mat"), ("a b", "c d"), ("word", "word"), ("", "a b"),
    ("the cat", "the cat sat on the mat"), ("the cat sat on the mat today ok", "the cat sat"),
    ("the the the the", "the cat the dog"), ("a b c d e", "a x c d e"), ("", ""),
]


def test_bleu(spark):
    for (hyp, ref), got in zip(CASES, scores(spark, *CASES, stem=False)):
        assert got["bleu"] == pytest.approx(direct_bleu(hyp.split(), ref.split()))


def test_values_by_hand(spark):
    same, none, turned, stemmed, meteor_two, from_right, run = scores(
        spark,
        ("the cats sat on mats", "the cats sat on mats"), ("alpha beta", "gamma delta"),
        ("the cat ran fast", "the fast cat ran"), ("running dogs", "run dog"),
        ("a b x d", "a b c d e"), ("a x a", "a"), ("running", "runs"),
    )
    assert same["rouge1"] == same["rouge2"] == same["rougeL"] == 1.0
    assert same["bleu"] == pytest.approx(1.0)
    # one chunk of five matches
    assert same["meteor"] == pytest.approx(1 - 0.5 * (1 / 5) ** 3)
    assert none["rouge1"] == none["rouge2"] == none["rougeL"] == none["meteor"] == none["bleu"] == 0.0
    assert turned["rouge1"] == 1.0 and turned["rouge2"] == pytest.approx(1 / 3)
    assert turned["rougeL"] == pytest.approx(0.75)
    assert stemmed["rouge1"] == 1.0 and run["meteor"] == pytest.approx(0.5)
    # matches 3 of 4 and 3 of 5 in two chunks: (a b) and (d)
    p, r = 3 / 4, 3 / 5
    assert meteor_two["meteor"] == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (2 / 3) ** 3))
    # aligned from the right: the second 'a' of the hypothesis takes the only 'a'
    p, r = 1 / 3, 1.0
    assert from_right["meteor"] == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5))


def test_synonyms_and_no_stems(spark):
    plain = scores(spark, ("running dogs", "run dog"), ("car", "auto"), stem=False)
    assert [x["rouge1"] for x in plain] == [0.0, 0.0] and plain[1]["meteor"] == 0.0
    table = spark.createDataFrame([("car", "auto"), ("car", "wagon")], "word string, synonym string")
    one, two = scores(spark, ("car", "auto"), ("car car", "auto wagon"), synonyms=table)
    assert one["meteor"] == pytest.approx(0.5)
    assert two["meteor"] == pytest.approx(1 - 0.5 * (1 / 2) ** 3)


def test_means_and_report(spark):
    empty = spark.createDataFrame([], "id long, bleu double, meteor double")
    assert {r.metric: r.value for r in metrics.mean_scores(empty, "options").collect()} == {"BLEU": 0.0, "METEOR": 0.0}
    table = spark.createDataFrame(
        [("extraction", "BLEU", 0.1234), ("options", "METEOR", 0.5), ("extraction", "Silhouette Score", 0.3)],
        "pipeline string, metric string, value double")
    rows = [tuple(r) for r in metrics.metric_report(table).collect()]
    assert rows == [("BLEU", "12.34%", "0.00%"), ("METEOR", "0.00%", "50.00%")]


def test_report_without_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "actual int, predicted int")
    rows = {r["name"]: r for r in reports.classification_report(df).collect()}
    assert rows["Correct"]["precision"] == 0.0 and rows["Correct"]["f1"] == 0.0 and rows["Correct"]["support"] == 1
    assert rows["Incorrect"]["precision"] == pytest.approx(2 / 3) and rows["Incorrect"]["recall"] == 1.0
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(2 / 3)
    assert [tuple(r) for r in reports.confusion_matrix(df).collect()] == [(0, 2, 0), (1, 1, 0)]
    only = reports.classification_report(df.filter("actual = 0")).collect()
    assert {r["name"]: r["support"] for r in only}["Correct"] == 0


def test_sessions(spark):
    items = spark.createDataFrame(
        [(1, 0, "q0", "w0", ["a", "b", "c", "d"], 1), (1, 1, "q1", "w1", ["a", "b", "c", "d"], 2), (2, 0, "q", "w", ["a", "b", "c", "d"], 0)],
        "session_id long, q_idx long, question_stem string, answer_chunk string, options array<string>, correct_idx int")
    log = spark.createDataFrame(
        [(1, 0, 1, 10, 5), (1, 0, 3, 9, 6), (1, 1, 2, 9, 7)], "session_id long, q_idx long, chosen int, ts long, event_id long")
    first = reports.first_answers(log)
    got = {(r.session_id, r.q_idx): r.chosen for r in first.collect()}
    assert got == {(1, 0): 3, (1, 1): 2}
    s = {r.session_id: r for r in reports.session_scores(items, first).collect()}
    assert (s[1].total, s[1].answered, s[1].correct, s[1].pct, s[1].complete) == (2, 2, 1, 50, True)
    assert (s[2].answered, s[2].pct, s[2].complete) == (0, 0, False)
    rows = {(r["session_id"], r["q_idx"]): r for r in reports.session_log(items, first).collect()}
    assert rows[(1, 0)]["User Choice"] == "d" and rows[(1, 0)]["Is Correct"] is False
    assert rows[(2, 0)]["User Choice"] == "N/A" and rows[(2, 0)]["Is Correct"] is False
    zero = spark.range(1).select(reports.percentage(F.lit(0), F.lit(0))).first()[0]
    assert zero == 0
