"""Quiz rows, splits, samples, readers and writers."""

import math

import pytest
from pyspark.sql import functions as F

from clozemill.operators import profile, relational, sampling
from clozemill.sources import tables


def quiz(spark, rows):
    return spark.createDataFrame(rows, "id long, article string, question string, A string, B string, C string, D string, answer string")


@pytest.mark.parametrize("answer, want", [("a", "A"), ("B", "B"), (" b", "A"), ("X", "A"), ("", "A"), (None, "A"), ("d", "D")])
def test_answer_letter(spark, answer, want):
    df = quiz(spark, [(1, "t", "q", "oa", "ob", "oc", "od", answer)])
    row = df.select(
        relational.answer_letter(F.col("answer")), relational.correct_option(), relational.wrong_options()
    ).first()
    assert row[0] == want and row[1] == "o" + want.lower()
    assert row[2] == [f"o{c}" for c in "abcd" if c != want.lower()]


def test_blank_filters_and_unpivots(spark):
    df = quiz(spark, [
        (1, "Text one.", "Q?", "a", "b", "c", "d", "C"), (2, None, "Q?", "a", "b", "c", "d", "A"),
        (3, " \n", "Q?", "a", "b", "c", "d", "A"), (4, "T", "", "a", None, "c", "d", "B"),
    ])
    assert [r.id for r in relational.with_question_text(df).collect()] == [1]
    assert [r.id for r in relational.with_answer_text(df).collect()] == [1]
    options = relational.unpivot_options(df.filter("id = 1")).collect()
    assert [(r.opt, r.text, r.label) for r in options] == [
        ("A", "Q? a", 0), ("B", "Q? b", 0), ("C", "Q? c", 1), ("D", "Q? d", 0)]
    cells = relational.unpivot_texts(df.filter("id = 4")).collect()
    assert sorted(r.field for r in cells) == ["A", "C", "D", "article"]
    assert df.filter("id = 4").select(relational.corpus_text()).first()[0] == "T a  c d"


@pytest.mark.parametrize("n", [1, 2, 5, 7, 10, 11, 100])
def test_split_sizes(spark, n):
    rows = sampling.split_exact(spark.range(n)).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in rows}
    held = math.ceil(n / 5)
    want = {"train": n - held, "test": math.ceil(held / 2), "val": held - math.ceil(held / 2)}
    assert got == {k: v for k, v in want.items() if v}


def test_split_does_not_depend_on_layout(spark):
    one = sampling.split_exact(spark.range(500).repartition(1)).orderBy("id").collect()
    many = sampling.split_exact(spark.range(500).repartition(16)).orderBy("id").collect()
    assert one == many


def test_group_split_keeps_groups_whole_even_a_hot_one(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 100, F.lit(0)).otherwise(F.col("id")))
    rows = sampling.split_exact(df, group_col="g").groupBy("g").agg(F.countDistinct("split").alias("n"))
    assert rows.filter("n > 1").count() == 0


def test_samples(spark):
    df = spark.range(100)
    assert sampling.sample_exact(df, 7).count() == 7
    assert sampling.sample_exact(df, 1000).count() == 100
    a = {r.id for r in sampling.sample_exact(df, 7).collect()}
    assert a == {r.id for r in sampling.sample_exact(df.repartition(9), 7).collect()}
    assert a <= {r.id for r in sampling.sample_exact(df, 20).collect()}
    assert [r.id for r in sampling.first_rows(df.repartition(5), 3).orderBy("id").collect()] == [0, 1, 2]


def test_ranks_are_complete_in_each_value(spark):
    df = spark.range(200).withColumn("by", (F.col("id") % 10 == 0).cast("int"))
    for by, n in ((0, 180), (1, 20)):
        ranks = [r["rank"] for r in sampling.two_level_rank(df, "by").filter(F.col("by") == by).collect()]
        assert sorted(ranks) == list(range(1, n + 1))


def test_csv_round_trip_and_tolerant_columns(spark, tmp_path):
    path = str(tmp_path / "quiz.csv")
    with open(path, "w") as f:
        f.write('question,article,A,B,C,D,answer,extra\n"Who, ""x""?","Line one.\nLine two.",a,b,c,d,B,1\n,"T",a,,c,d,,2\n')
    df = tables.read_quiz_csv(spark, path)
    rows = df.orderBy("extra") if "extra" in df.columns else df
    first, second = sorted(rows.collect(), key=lambda r: r["answer"], reverse=True)
    assert first["article"] == "Line one.\nLine two." and first["question"] == 'Who, "x"?'
    assert second["B"] == "" and second["question"] == "" and second["answer"] == ""
    lacking = tables.complete_columns(spark.createDataFrame([("t",)], "article string"))
    assert lacking.first().asDict() == {"article": "t", "question": "", "A": "", "B": "", "C": "", "D": "", "answer": ""}
    with pytest.raises(tables.MissingInput):
        tables.read_quiz_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(tables.MissingInput, match="split"):
        tables.read_table(spark, str(tmp_path / "none"), "split")


def test_row_ids_for_equal_rows(spark):
    rows = [("t", "q", "a", "b", "c", "d", "A")] * 25 + [("u", "q", "a", "b", "c", "d", "A")]
    df = spark.createDataFrame(rows, "article string, question string, A string, B string, C string, D string, answer string")
    one = sorted(r.id for r in tables.with_row_ids(df.repartition(1), chunk=10).collect())
    many = sorted(r.id for r in tables.with_row_ids(df.repartition(7), chunk=4).collect())
    assert one == many and len(set(one)) == 26


def test_splits_guard_and_artefacts(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = sampling.split_exact(spark.range(10))
    assert not tables.outputs_exist(spark, path)
    tables.write_splits(df, path)
    assert tables.outputs_exist(spark, path) and not tables.outputs_exist(spark, path, path + "x")
    assert spark.read.parquet(path).filter("split = 'train'").count() == 8
    tables.write_splits(df, path + "_csv", "csv")
    assert spark.read.option("header", True).csv(path + "_csv").count() == 10

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    store = str(tmp_path / "artefact")
    for force in (False, False, True):
        assert tables.materialise(spark, store, build, force, {"score": 0.5}).count() == 3
    assert len(calls) == 2 and tables.artefact_params(spark, store) == {"score": 0.5}


def test_scores(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert tables.read_scores(spark, path).count() == 0
    row = spark.createDataFrame([("extraction", "BLEU", 0.5)], "pipeline string, metric string, value double")
    tables.append_scores(row, path, "r1")
    tables.append_scores(row, path, "r2")
    assert sorted(r.run_id for r in tables.read_scores(spark, path).collect()) == ["r1", "r2"]


def test_histogram_of_equal_lengths(spark):
    df = spark.createDataFrame([("a b",), ("c d",)], "article string")
    hist = {r.bin: r.n for r in profile.length_histogram(df).collect()}
    assert hist[0] == 2 and sum(hist.values()) == 2 and len(hist) == 50
