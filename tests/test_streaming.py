"""Streams give the batch result for any cut of the input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozemill.operators import reports, tfidf
from clozemill.streaming import articles, sessions

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "session_id long, q_idx long, chosen int, ts timestamp, event_id long, kind string, correct_idx int"


def rows(*events):
    return [(s, q, c, T0 + dt.timedelta(minutes=m), i, kind, 1) for i, (s, q, c, m, kind) in enumerate(events)]


def write_files(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def first(spark, tmp_path, name, *batches):
    path = str(tmp_path / name)
    write_files(spark, path, *batches)
    stream = sessions.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    sessions.run_to_table(sessions.first_answers(stream), path + "_out", path + "_cp")
    return {(r.session_id, r.q_idx, r.epoch): r.chosen for r in spark.read.parquet(path + "_out").collect()}


def test_first_answers_and_reset(spark, tmp_path):
    events = rows(
        (1, 0, 3, 0, "answer"), (1, 0, 2, 1, "answer"), (1, 1, 1, 2, "answer"), (2, 0, 0, 3, "answer"),
        (1, None, None, 4, "reset"), (1, 0, 1, 5, "answer"), (1, 0, 2, 6, "answer"),
    )
    want = {(1, 0, 0): 3, (1, 1, 0): 1, (2, 0, 0): 0, (1, 0, 1): 1}
    assert first(spark, tmp_path, "one", events) == want
    assert first(spark, tmp_path, "three", events[:2], events[2:5], events[5:]) == want


def test_restart_continues(spark, tmp_path):
    path = str(tmp_path / "restart")
    events = rows((1, 0, 3, 0, "answer"), (1, 0, 2, 1, "answer"), (1, 1, 0, 2, "answer"))
    for part in (events[:1], events[1:]):
        write_files(spark, path, part)
        stream = sessions.read_stream(spark, path, spark.read.parquet(path).schema)
        sessions.run_to_table(sessions.first_answers(stream), path + "_out", path + "_cp")
    got = spark.read.parquet(path + "_out")
    assert {(r.q_idx, r.chosen) for r in got.collect()} == {(0, 3), (1, 0)} and got.count() == 2


def windows(spark, tmp_path, name, batches, **kw):
    path = str(tmp_path / name)
    for b in batches:
        write_files(spark, path, b)
    stream = sessions.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    sessions.run_to_table(sessions.windowed_accuracy(stream, **kw), path + "_out", path + "_cp")
    return spark.read.parquet(path + "_out")


def test_windows_late_and_repeated(spark, tmp_path):
    early = rows((1, 0, 1, 0, "answer"), (1, 0, 1, 1, "answer"), (2, 0, 0, 5, "answer"))
    mark = rows((9, 9, 0, 180, "answer"))
    late = rows((3, 0, 1, 2, "answer"))
    # chained stateful steps test lateness against the mark of the batch before
    again = rows((9, 7, 0, 181, "answer"))
    end = rows((9, 8, 0, 600, "answer"))
    got = windows(spark, tmp_path, "w", (early, mark, again, late, end), window="1 hour", late="10 minutes", distinct=True)
    first_hour = got.filter(F.col("start") == F.lit(T0)).collect()
    assert [(r.answers, r.correct) for r in first_hour] == [(2, 1)]


def test_sliding_and_session_windows(spark, tmp_path):
    early = rows((1, 0, 1, 0, "answer"), (1, 1, 1, 10, "answer"), (1, 2, 0, 100, "answer"))
    end = rows((9, 8, 0, 900, "answer"))
    slide = windows(spark, tmp_path, "s", (early, end), window="1 hour", slide="30 minutes", late="1 minute")
    assert slide.filter("session_id IS NULL" if "session_id" in slide.columns else "answers = 2").count() == 2
    gaps = windows(spark, tmp_path, "g", (early, end), gap="30 minutes", late="1 minute")
    assert sorted((r.session_id, r.answers, r.correct) for r in gaps.collect()) == [(1, 1, 0), (1, 2, 2)]


def test_minibatch_centres_match_a_direct_computation(spark, tmp_path):
    texts = [f"red fox {'jumps' if i % 2 else 'sleeps'}" for i in range(6)] + [f"blue sea {'calm' if i % 2 else 'wild'}" for i in range(6)]
    df = spark.createDataFrame([(f"u{i:02d}", t) for i, t in enumerate(texts)], "uid string, text string")
    path = str(tmp_path / "terms")
    tfidf.fit_tfidf(df).write.parquet(path)
    terms = spark.read.parquet(path)
    model = articles.MiniBatchKMeans(spark, str(tmp_path / "km"), k=3)
    size = terms.count()
    dense = {}
    for r in tfidf.tfidf_weights(df, terms, "uid").collect():
        dense.setdefault(r.uid, np.zeros(size))[r.term_id] = r.w
    centres, seen = None, np.zeros(3)
    for batch, part in enumerate((df.limit(7), df.exceptAll(df.limit(7)))):
        got = {r.uid: r.cluster_id for r in model.step(part, terms, batch).collect()}
        if centres is None:
            centres = np.zeros((3, size))
            for r in spark.read.parquet(str(tmp_path / "km" / "start")).collect():
                centres[r.cluster_id, r.term_id] = r.value
        x = {u: dense[u] for u in got}
        for u, v in x.items():
            d = ((centres - v) ** 2).sum(1)
            assert d[got[u]] == pytest.approx(d.min())
        for k in range(3):
            mine = [x[u] for u in x if got[u] == k]
            if mine:
                centres[k] = (centres[k] * seen[k] + sum(mine)) / (seen[k] + len(mine))
                seen[k] += len(mine)
        stored = np.zeros((3, size))
        for r in model.centres(batch).collect():
            stored[r.cluster_id, r.term_id] = r.value
        assert stored == pytest.approx(centres)


def test_state_ends_after_a_while(spark, tmp_path):
    path = str(tmp_path / "forget")
    batches = [rows((1, 0, 3, 0, "answer"), (1, 0, 2, 1, "answer")), rows((9, 9, 0, 500, "answer")),
               rows((9, 8, 0, 501, "answer")), rows((1, 0, 1, 502, "answer"))]
    for b in batches:
        write_files(spark, path, b)
    stream = sessions.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    made = sessions.first_answers(stream.withWatermark("ts", "10 minutes"), forget="1 hour")
    sessions.run_to_table(made, path + "_out", path + "_cp")
    got = sorted((r.session_id, r.q_idx, r.chosen) for r in spark.read.parquet(path + "_out").collect())
    assert got == [(1, 0, 1), (1, 0, 3), (9, 8, 0), (9, 9, 0)]


def test_an_answer_without_choice_stays_null(spark, tmp_path):
    got = first(spark, tmp_path, "null", rows((1, 0, None, 0, "answer"), (1, 1, 2, 1, "answer")))
    assert got == {(1, 0, 0): None, (1, 1, 0): 2}
