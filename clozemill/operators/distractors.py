"""Wrong options from the passage: candidates, features, ranker, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.arrow import counts_in_text
from clozemill.functions.words import FALLBACK_DISTRACTORS
from clozemill.operators.cloze import Tagger, rule_tagger
from clozemill.operators.common import once
from clozemill.operators.embeddings import phrase_vectors
from clozemill.operators.relational import correct_option, wrong_options
from clozemill.operators.sampling import first_rows

FEATURES = ["sim", "char_match", "freq", "len_diff"]


def with_candidates(df: DataFrame, article: str = "article", tagger: Tagger | None = None) -> DataFrame:
    """Add ``candidates``: distinct lower-case noun phrases in text order. Map-only."""
    tagger = tagger or rule_tagger()
    return once(df, candidates=X.candidate_phrases(tagger(X.cased_tokens(F.col(article)))))


def not_answer(candidates: Column, answer: Column) -> Column:
    return F.filter(candidates, lambda c: c != F.lower(answer))


def first_n(candidates: Column, answer: Column, n: int = 3) -> Column:
    """First ``n`` candidates that are not the answer; fixed names when there is none."""
    usable = not_answer(candidates, answer)
    return F.when(F.size(usable) == 0, F.array(*[F.lit(x) for x in FALLBACK_DISTRACTORS])).otherwise(
        F.slice(usable, 1, n)
    )


def lexical_features(cand: Column, answer: Column, low_article: Column) -> list[Column]:
    """Features that need no vectors; the article comes in lower case, so that it is
    folded once and not once per candidate."""
    return [
        X.shared_characters(cand, answer).alias("char_match"),
        X.count_substring(low_article, cand, lowered=True).alias("freq"),
        X.length_difference(cand, answer).alias("len_diff"),
    ]


def frequencies(candidates: Column, low_article: Column) -> Column:
    """Occurrences of each candidate in its passage; the passage stays in its row."""
    return counts_in_text(low_article, F.transform(candidates, lambda c: F.lower(c)))


def candidate_features(
    pairs: DataFrame, vectors: DataFrame, keys: list[str], n_words: int, dim: int,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Features of ``pairs(keys, cand, answer, freq)``, or with ``low_article`` in place of
    ``freq``; an article ends here.

    Mean vectors are formed once per distinct phrase and joined back; a phrase without
    a known word gives similarity 0. ``stage`` stores the pairs, which are read for the
    phrases and for the joins.
    """
    char_match, freq, len_diff = lexical_features(
        F.col("cand"), F.col("answer"), F.col("low_article" if "low_article" in pairs.columns else "cand")
    )
    lexical = stage(pairs.select(
        *keys, "cand", "answer", char_match, "freq" if "freq" in pairs.columns else freq, len_diff
    ))
    phrases = lexical.select(F.col("cand").alias("phrase")).union(lexical.select("answer")).distinct()
    means = phrase_vectors(phrases, vectors, n_words, dim)
    c = means.select(F.col("phrase").alias("cand"), F.col("unit").alias("_c"))
    a = means.select(F.col("phrase").alias("answer"), F.col("unit").alias("_a"))
    joined = lexical.join(c, "cand", "left").join(a, "answer", "left")
    dot = F.aggregate(
        F.zip_with("_c", "_a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    return joined.withColumn("sim", F.coalesce(dot, F.lit(0.0))).drop("_c", "_a")


def assemble(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)


def ranker_rows(quiz: DataFrame, n_rows: int | None = None, tagger: Tagger | None = None) -> DataFrame:
    """Training pairs ``id, answer, cand, label, freq`` of every row, or of the first ``n_rows``:
    the given wrong options as positives, the first three candidates that are not the
    answer as negatives, both counted in the passage before they leave its row."""
    rows = once(
        with_candidates(quiz if n_rows is None else first_rows(quiz, n_rows), tagger=tagger),
        _correct=correct_option(), _wrong=wrong_options(), _low=F.lower("article"),
    )
    gold = F.transform("_wrong", lambda w: F.struct(w.alias("cand"), F.lit(1.0).alias("label")))
    negatives = F.transform(
        F.slice(not_answer(F.col("candidates"), F.col("_correct")), 1, 3),
        lambda c: F.struct(c.alias("cand"), F.lit(0.0).alias("label")),
    )
    paired = once(rows.select("id", "_correct", "_low", "candidates", "_wrong"), _pairs=F.concat(gold, negatives))
    counted = once(paired, _freq=frequencies(F.col("_pairs.cand"), F.col("_low")))
    return counted.select(
        "id", F.col("_correct").alias("answer"), F.inline(F.arrays_zip("_pairs", "_freq"))
    ).select("id", "answer", "_pairs.*", F.col("_freq").alias("freq"))


def train_ranker(
    quiz: DataFrame, vectors: DataFrame, n_words: int, dim: int, n_rows: int | None = None,
    tagger: Tagger | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> LogisticRegressionModel:
    """Logistic regression with unit penalty (C = 1) on the four features of all rows, or of
    the first ``n_rows``; ``stage`` stores the pairs."""
    rows = ranker_rows(quiz, n_rows, tagger)
    data = assemble(
        candidate_features(rows, vectors, ["id", "label"], n_words, dim, stage)
    ).select("features", "label").persist()
    try:
        n = data.count()
        return LogisticRegression(
            regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100
        ).fit(data)
    finally:
        data.unpersist()


def top_ranked(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Best ``n`` of ``scored(keys, cand, prob)`` per key; equal ones by text descending."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("prob"), F.desc("cand")))
    return scored.withColumn("rank", place).filter(F.col("rank") <= n)


def ranked_distractors(
    df: DataFrame, vectors: DataFrame, ranker: LogisticRegressionModel, n_words: int, dim: int,
    keys: list[str], n: int = 3, answer: str = "answer", article: str = "article",
    candidates: str = "candidates", stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """``keys, distractors``: the ``n`` most probable wrong options per row.

    The frequencies come in a column ``freqs`` beside the candidates, or are counted in
    the passage before the candidates leave its row.
    """
    if "freqs" in df.columns:
        named = df.select(*keys, F.col(answer).alias("_answer"), F.col(candidates).alias("cand"), "freqs")
    else:
        low = once(df.select(
            *keys, F.col(answer).alias("_answer"), F.col(candidates).alias("cand"),
            F.lower(article).alias("_low"),
        ), freqs=frequencies(F.col("cand"), F.col("_low")))
        named = low.drop("_low")
    pairs = named.select(
        *keys, F.col("_answer").alias("answer"), F.inline(F.arrays_zip("cand", F.col("freqs").alias("freq")))
    ).filter(F.col("cand") != F.lower("answer"))
    features = assemble(candidate_features(pairs, vectors, keys, n_words, dim, stage))
    scored = ranker.transform(features).select(
        *keys, "cand", F.round(F.get(vector_to_array("probability"), F.lit(1)), 12).alias("prob")
    )
    best = top_ranked(scored, keys, n)
    packed = best.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "cand"))).alias("_d")
    )
    return packed.select(*keys, F.col("_d.cand").alias("distractors"))


def generate_distractors(
    df: DataFrame, keys: list[str], answer: str = "answer", n: int = 3, vectors: DataFrame | None = None,
    ranker: LogisticRegressionModel | None = None, n_words: int = 0, dim: int = 100,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Add ``distractors`` to rows with ``candidates`` and ``freqs`` or ``article``: the first
    ``n`` candidates, or with a ranker the best ``n``."""
    plain = first_n(F.col("candidates"), F.col(answer), n)
    if ranker is None:
        return df.withColumn("distractors", plain)
    ranked = ranked_distractors(df, vectors, ranker, n_words, dim, keys, n, answer, stage=stage)
    fallback = F.array(*[F.lit(x) for x in FALLBACK_DISTRACTORS])
    return df.join(ranked, keys, "left").withColumn(
        "distractors", F.coalesce("distractors", fallback)
    )
