"""Words of many texts in Arrow batches: equal to the column expressions, and few enough to be shuffled."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from clozemill.functions import arrow
from clozemill.functions import text as X
from clozemill.operators import cooccurrence, tfidf
from clozemill.plans import quizview

ODD = [
    "", None, " ", "a", "é", "A1_b", "\x01\x01 a. b", " . foo", "foo. bar! baz", "no end", "x.\n\ty", "a\x01b. c", "Straße İstanbul ΣΑΣ",
    "日本語 テキスト。 次", "éa ab́c", "tail \n", "tail  ", "\n\n lead. x", "𝔘𝔫𝔦 code 😀 word", "१२३ ٣٤٥ ⅷ", "a.b.c. D",
    "?! ?! x", ".", ". ", "\u0085 x. y", "end.",
]


def made_texts(n=60):
    rng = random.Random(5)
    words = ["the", "Éa", "thin", "ou", "x", "word_1", "longer", "日本", "𝔘𝔫", "of", "zweite", "é"]
    marks = [" ", ". ", "\n", "! ", ", ", "-", "\x01", "  "]
    return ODD + ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_runs_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame(list(enumerate(made_texts())), "id int, text string")
    low = F.lower(X.text_or_empty(F.col("text")))
    for shortest in (1, 2, 4):
        pattern = F.lit(rf"[\p{{L}}\p{{N}}_]{{{shortest},}}")
        want = [(r.low, r.w) for r in rows.orderBy("id").select(low.alias("low"), F.regexp_extract_all(low, pattern, F.lit(0)).alias("w")).collect()]
        got = []
        for piece in arrow.pieces(pa.array([t for t, _ in want]), 200):
            words, row = arrow.word_runs(piece, arrow.unpacked(arrow.word_letters()), shortest)
            found = [[] for _ in range(len(piece))]
            for at, w in zip(row.tolist(), words.to_pylist()):
                found[at].append(w)
            got += found
        assert got == [w for _, w in want]


def test_first_sentence_is_that_of_all(spark):
    rows = spark.createDataFrame([(t,) for t in made_texts()], "text string")
    for r in rows.select("text", quizview.first_sentence(F.col("text")).alias("got"),
                         F.get(X.sentences(F.col("text")), F.lit(0)).alias("want")).collect():
        assert r.got == r.want, r.text


def test_options_follow_the_md5(spark):
    def long_words(text):
        words = F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0))
        return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))

    def hashed(words):
        return F.transform(words, lambda w: F.struct(F.md5(F.concat_ws(":", F.col("id").cast("string"), w)).alias("h"), w.alias("w")))

    rows = spark.createDataFrame(
        [(None if i % 9 == 0 else i % 50, t) for i, t in enumerate(made_texts())], "id long, text string").where("text is not null")
    question = F.split("text", "[.]")[0]
    picked = rows.select("id", "text", quizview.word_options(F.col("id").cast("string"), F.lower(question), F.lower("text")).alias("o"),
                         F.array_min(hashed(long_words(question)))["w"].alias("right"),
                         F.slice(F.sort_array(hashed(F.array_except(long_words(F.col("text")), long_words(question)))), 1, 3)["w"].alias("wrong"))
    found = picked.collect()
    assert any(len(r.wrong) == 3 and r.right for r in found)
    for r in found:
        assert (r.o.right, r.o.wrong) == (r.right, r.wrong), r.text


def test_vocabulary_is_that_of_all_terms(spark):
    docs = spark.createDataFrame([(1, t) for t in made_texts()], "id int, text string")
    for cap in (1, 3, 7, 12, 1000):
        all_terms = tfidf.term_counts(docs).where("df >= 2").orderBy(F.desc("cf"), "term").limit(cap)
        want = [(r.term, r.df, r.cf) for r in all_terms.collect()]
        assert [(r.term, r.df, r.cf) for r in tfidf.fit_tfidf(docs, max_terms=cap).orderBy("term_id").collect()] == want


def test_too_many_words_are_counted_as_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, t) for t in made_texts()], "id int, text string")
    want = tfidf.fit_tfidf(docs, max_terms=9).collect()
    monkeypatch.setattr(tfidf, "WORDS_HELD", 3)
    assert tfidf.fit_tfidf(docs, max_terms=9).collect() == want


def test_pairs_of_rare_words_are_not_shuffled(spark):
    """Before, every pair of neighbours was a row of the shuffle."""
    rare = [(i, "common words " * 5 + " ".join(f"rare{i}x{k}" for k in range(200))) for i in range(10)]
    docs = spark.createDataFrame(rare, "id int, text string")
    words = tfidf.frequent_words(docs, "text", 2, 2)
    assert sorted(words["term"].to_pylist()) == ["common", "words"]
    pairs = tfidf.pair_counts(docs, words["term"].combine_chunks()).collect()
    assert sorted((r.df, r.cf) for r in pairs) == [(10, 40), (10, 50)]
    top = tfidf.fit_tfidf(docs, max_terms=3).orderBy("term_id").collect()
    assert [(r.term, r.df, r.cf) for r in top] == [("common", 10, 50), ("common words", 10, 50), ("words", 10, 50)]


def test_windows_of_whole_texts(spark):
    texts = spark.createDataFrame([(t,) for t in made_texts()], "text string")
    tokens = texts.select(X.word_tokens(F.col("text")).alias("tokens"))
    for least in (1, 2, 9):
        known = cooccurrence.word_counts(tokens, min_count=least)
        assert sorted(cooccurrence.text_word_counts(texts, min_count=least).collect()) == sorted(known.collect())
        want = sorted(cooccurrence.known_pairs(cooccurrence.window_counts(tokens), known, known.count()).collect())
        assert sorted(cooccurrence.text_window_counts(texts, known).collect()) == want
        assert sorted(cooccurrence.text_window_counts(texts, known, limit=1).collect()) == want
    assert cooccurrence.text_window_counts(texts, known.limit(0)).count() == 0


def test_pieces_of_tokens_lose_no_pair(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in made_texts()], "text string")
    known = cooccurrence.text_word_counts(texts)
    want = sorted(cooccurrence.text_window_counts(texts, known).collect())
    monkeypatch.setattr(cooccurrence, "TOKENS", 3)
    assert sorted(cooccurrence.text_window_counts(texts, known).collect()) == want


def test_pairs_are_shuffled_as_numbers(spark):
    """Before, both words of a pair were shuffled as text, those of rare words too."""
    texts = spark.createDataFrame([(t,) for t in made_texts()], "text string")
    plan = cooccurrence.text_window_counts(texts, cooccurrence.text_word_counts(texts))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("pair" in line for line in exchanges)
