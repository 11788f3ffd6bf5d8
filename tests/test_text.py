"""Text rules on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.stemmer import porter_stem
from clozemill.functions.arrow import lcs_of, stem_tokens


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("", []), (None, []), ("  ", []), ("No end", ["No end"]),
    ("A b. C d!  E?\nF", ["A b.", "C d!", "E?", "F"]), ("3.14 is pi. Yes.", ["3.14 is pi.", "Yes."]),
])
def test_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.sentences(F.col("t"))).first()[0] == want


def test_tokens_and_terms(spark):
    assert one(spark, X.word_tokens(F.col("t")), t="Don't stop, Zoë_1!") == [
        "don", "'", "t", "stop", ",", "zoë_1", "!"]
    assert one(spark, X.terms(F.col("t")), t="The red fox and a red hen") == [
        "red", "fox", "red", "hen", "red fox", "fox red", "red hen"]
    assert one(spark, X.terms(F.col("t")), t="a the") == []


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],)], "t array<string>")
    rows = [r[0] for r in df.select(X.run_lengths(F.col("t"))).collect()]
    assert [(x["item"], x["n"]) for x in rows[0]] == [("a", 1), ("b", 3)] and rows[1] == []


@pytest.mark.parametrize("sentence, chunk, want", [
    ("Rome and Rome", "Rome", "__________ and Rome"),
    ("in rome now", "ROME", "in __________ now"),
    ("Romeo ran", "Rome", "__________o ran"),
    ("cost (a+b)* more", "(A+B)*", "cost __________ more"),
    ("İstanbul and Rome", "Rome", "İstanbul and __________"),
    ("nothing here", "Rome", "nothing here"),
    ("keep", "", "keep"),
])
def test_blank_first(spark, sentence, chunk, want):
    assert one(spark, X.blank_first(F.col("s"), F.col("c")), s=sentence, c=chunk) == want


@pytest.mark.parametrize("hint, chunk, want", [
    ("Rome, rome", "Rome", "[answer], [answer]"), ("a.b acb", "a.b", "[answer] acb"),
    ("Élan élan", "ÉLAN", "[answer] [answer]"), ("x", "", "x"), (r"a\Eb here", r"a\Eb", "[answer] here"),
])
def test_mask(spark, hint, chunk, want):
    assert one(spark, X.mask_answer(F.col("h"), F.col("c")), h=hint, c=chunk) == want


@pytest.mark.parametrize("text, answer, want", [
    ("new-york o'neil", "Rome", "New-York O'Neil"), ("OPTION1 a2b", "Rome", "Option1 A2B"),
    ("Big CAT", "rome", "big cat"),
])
def test_format(spark, text, answer, want):
    assert one(spark, X.format_like(F.col("t"), F.col("a")), t=text, a=answer) == want


@pytest.mark.parametrize("text, want", [
    ("the Big Cat sat. A Dog ran with Big cat", ["big cat", "dog", "big"]),
    ("Big, Cat Big", ["big", "cat big"]), ("Al ran", []), ("The cat", []),
])
def test_candidates(spark, text, want):
    got = one(spark, X.candidate_phrases(X.tag_tokens(X.cased_tokens(F.col("t")))), t=text)
    assert got == want


def test_candidates_of_two_tags(spark):
    tagged = X.tag_tokens(X.cased_tokens(F.col("t")), nouns=["river", "bank"])
    assert one(spark, X.candidate_phrases(tagged), t="Old Thames river bank") == [
        "old thames", "river bank"]


@pytest.mark.parametrize("text, want", [
    ("the Cat met Alexander", "Alexander"), ("Anna saw Otto", "Anna"), ("Someone left", ""),
    ("all lower case", ""), ("The Cat", ""), ("Something Else", "Else"),
])
def test_key_chunk(spark, text, want):
    assert one(spark, X.key_chunk(X.tag_tokens(X.cased_tokens(F.col("t")))), t=text) == want


def test_key_chunk_prefers_proper(spark):
    tagged = F.from_json(F.col("t"), "array<struct<token:string,tag:string>>")
    data = '[{"token":"Longestword","tag":"NN"},{"token":"Rome","tag":"NNP"}]'
    assert one(spark, X.key_chunk(tagged), t=data) == "Rome"


def test_features(spark):
    assert one(spark, X.count_substring(F.col("a"), F.col("c")), a="aaa Aaa", c="aa") == 2
    assert one(spark, X.count_substring(F.col("a"), F.col("c")), a="abc", c="") == 4
    assert one(spark, X.shared_characters(F.col("a"), F.col("b")), a="hello", b="Hole") == pytest.approx(3 / 5)
    assert one(spark, X.shared_characters(F.col("a"), F.col("b")), a="", b="x") == 0
    assert one(spark, X.length_difference(F.col("a"), F.col("b")), a="abc", b="z") == 2


# Expected values from the published algorithm's own examples.
@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"),
    ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("rational", "ration"), ("generalization", "gener"),
    ("hopefulness", "hope"), ("electrical", "electr"), ("adjustment", "adjust"),
    ("probate", "probat"), ("rate", "rate"), ("controller", "control"), ("roll", "roll"),
    ("dying", "die"), ("enjoy", "enjoy"), ("at", "at"),
])
def test_stems(word, want):
    assert porter_stem(word) == want


def test_stem_udf(spark):
    df = spark.createDataFrame([(["cats", "running", "is"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(stem_tokens(F.col("t"), 3)).collect()]
    assert got == [["cat", "run", "is"], []]


def test_lcs():
    assert lcs_of("abcbdab", "bdcaba") == 4
    assert lcs_of("", "abc") == 0 and lcs_of("abc", "abc") == 3 and lcs_of("abc", "xyz") == 0
    import random

    rnd = random.Random(7)
    for _ in range(50):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert lcs_of(a, b) == row[-1]


def test_tags_are_counted_by_row_and_by_id(spark):
    from clozemill.operators import profile

    df = spark.createDataFrame(
        [(1, "Anna saw Anna. a b a"), (1, "Otto saw Anna"), (None, "Bo"), (None, "Bo x"), (2, None), (3, "")],
        "doc_id long, text string")
    flat = df.select("doc_id", F.inline(X.tag_tokens(X.cased_tokens(F.col("text")))))
    want = flat.groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct"))
    got = profile.tag_counts(df)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
