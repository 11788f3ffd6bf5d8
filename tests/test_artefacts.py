"""Stale artefacts, publishing, batch times, CSV records by splits."""

import os
import time

import pytest
from pyspark.sql import functions as F

from clozemill.plans import models, stages
from clozemill.sources import tables
from clozemill.streaming import articles, latency, sessions

ODD = [
    ("One line.", "Q?", "a", "b", "c", "d", "A"),
    ('He said "no", twice.\nThen\r\nleft, "quietly".', 'Why "no"?', "x,y", "b\nb", '"c"', "", "B"),
    ("\n\nblank lines inside\n\n", "Q", "1", "2", "3", "4", None),
    ("long " * 400 + "\n" + "text " * 300, "Q2", "é", "ü", "漢", "🙂", "C"),
    ('"', '""', '"""', "\n", '"\n"', "e", "D"),
    (None, None, "b", "c", "d", "e", "A"),
]


@pytest.mark.parametrize("part", ["64", "300", "5000", "128m"])
def test_csv_by_splits_equals_the_reader(spark, tmp_path, part):
    path = str(tmp_path / "quiz")
    df = spark.createDataFrame(ODD * 7, tables.CSV_SCHEMA.simpleString()[7:-1].replace(":", " "))
    df.select("article", "question", *"ABCD", "answer").repartition(2).write.option("header", True).option(
        "quote", '"').option("escape", '"').csv(path)
    want = sorted(map(repr, tables.read_quiz_csv(spark, path).collect()))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = tables.read_quiz_csv_split(spark, path)
        if part == "300":
            assert tables.csv_records(spark, path).select("file").distinct().count() == 2
            assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert sorted(map(repr, got.collect())) == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_csv_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('question,article,A,B,C,D,answer,extra\nq1,"a ""1""\nx",1,2,3,4,B,z\n')
    (tmp_path / "b.csv").write_text("article,question\na2,q2\n\n")
    (tmp_path / "c.csv").write_text("")
    rows = {(r.article, r.question, r.A, r.answer) for r in tables.read_quiz_csv_split(spark, str(tmp_path)).collect()}
    assert rows == {('a "1"\nx', "q1", "1", "B"), ("a2", "q2", "", "")}
    with pytest.raises(tables.MissingInput):
        tables.read_quiz_csv_split(spark, str(tmp_path / "none"))


def test_changed_input_or_settings_build_again(spark, tmp_path):
    source, store, calls = str(tmp_path / "in"), str(tmp_path / "out"), []

    def table(force=False, **settings):
        def build():
            calls.append(1)
            return spark.read.parquet(source)
        return tables.materialise(spark, store, build, force, {"s": 1}, tables.fingerprint(spark, [source], settings)).count()

    spark.range(3).write.parquet(source)
    assert [table(), table(), table(k=2), table(k=2), table(force=True, k=2)] == [3] * 5 and len(calls) == 3
    record = tables.artefact_record(spark, store)
    assert record["rows"] == 3 and record["ms"] >= 0 and tables.artefact_params(spark, store) == {"s": 1}
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert table(k=2) == 5 and len(calls) == 4
    tables.drop_artefact(spark, store)
    assert tables.artefact_record(spark, store) == {} and table(k=2) == 5
    # A build that was broken off leaves no record, or one whose table is not whole.
    os.remove(f"{store}.params/_SUCCESS")
    assert table(k=2) == 5 and len(calls) == 6


def test_a_failed_build_leaves_the_old_table(spark, tmp_path):
    store = str(tmp_path / "kept")
    tables.materialise(spark, store, lambda: spark.range(4), stamp="a")

    def broken():
        return spark.range(4).select(F.raise_error(F.lit("no")).alias("id"))

    with pytest.raises(Exception, match="no"):
        tables.materialise(spark, store, broken, stamp="b")
    assert spark.read.parquet(store).count() == 4 and tables.artefact_record(spark, store)["stamp"] == "a"


def test_force_reaches_the_plans(spark, sf):
    for build in (stages.quiz_table, stages.vocabulary, models.kmeans):
        build(spark, sf)
        name = {"quiz_table": "quiz", "vocabulary": "terms", "kmeans": "kmeans"}[build.__name__]
        path = f"{stages.stage_path(spark, sf, name)}.params/record.json"
        before = os.stat(path).st_mtime_ns
        build(spark, sf)
        assert os.stat(path).st_mtime_ns == before
        build(spark, sf, force=True)
        assert os.stat(path).st_mtime_ns > before
    runs = {r.stage: r.rows for r in stages.stage_runs(spark, sf, ["quiz", "terms", "none"]).collect()}
    assert set(runs) == {"quiz", "terms"} and runs["quiz"] == stages.quiz_table(spark, sf).count()


def test_a_row_for_each_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    for n in (3, 5, 2):
        spark.range(n).coalesce(1).write.mode("append").parquet(path)
    stream = sessions.read_stream(spark, path, "id long", files_per_batch=1)
    with latency.timed_batches(spark, str(tmp_path / "runs")):
        articles.run_batches(stream, lambda batch, _: batch, str(tmp_path / "t"), str(tmp_path / "c"))
    runs = latency.read_runs(spark, str(tmp_path / "runs")).orderBy("batch").collect()
    assert [r.batch for r in runs] == [0, 1, 2] and sorted(r.rows for r in runs) == [2, 3, 5]
    assert all(r.ms > 0 and r.add_ms <= r.ms for r in runs) and len({r.run for r in runs}) == 1


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def data():
        return {n for n in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n and n.endswith(".data")}

    setting = spark.conf.get(tables.DROP_SHUFFLES)
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "plain"))
    before = data()
    tables.write_parquet(spark.range(1000).repartition(3, "id"), str(tmp_path / "t"))
    # files are taken away behind the write
    end = time.monotonic() + 20
    while data() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert before and not data() - before and spark.conf.get(tables.DROP_SHUFFLES) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_overlapping_writes_leave_the_setting_as_it_was(spark):
    setting = spark.conf.get(tables.DROP_SHUFFLES)
    one, other = tables.shuffles_dropped(spark), tables.shuffles_dropped(spark)
    one.__enter__()
    other.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(tables.DROP_SHUFFLES) == "true"
    other.__exit__(None, None, None)
    assert spark.conf.get(tables.DROP_SHUFFLES) == setting and not tables._dropping
