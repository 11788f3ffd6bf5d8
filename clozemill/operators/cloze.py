"""Fill-in-the-blank questions and graduated hints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.words import BLANK
from clozemill.operators.common import keyed, once
from clozemill.operators.similarity import (
    NO_SCORES, best_position, sentence_scores, top_positions,
)

Tagger = Callable[[Column], Column]


def rule_tagger(nouns: Sequence[str] = ()) -> Tagger:
    """Tag by capital letter and an optional noun list; replaceable by any function
    from a token array to ``array<struct<token, tag>>``."""
    return lambda tokens: X.tag_tokens(tokens, nouns)


def blank_key_chunk(sentence: Column, fallback: Column, tagger: Tagger) -> Column:
    """``struct<stem, chunk>`` for one sentence; without a usable chunk the sentence
    gets a trailing blank and the answer stays ``fallback``."""

    def build(chunk: Column) -> Column:
        none = chunk == ""
        return F.struct(
            F.when(none, F.concat(sentence, F.lit(f" {BLANK}?")))
            .otherwise(X.blank_first(sentence, chunk)).alias("stem"),
            F.when(none, fallback).otherwise(chunk).alias("chunk"),
        )

    return X.let(X.key_chunk(tagger(X.cased_tokens(sentence))), build)


def _asked(df: DataFrame, key: str, article: str, query: str) -> DataFrame:
    # stating that every row has its key lets both sides of the later join share one exchange
    return once(
        keyed(df.filter(F.col(key).isNotNull()), key), sents=X.sentences(F.col(article)),
        _queries=F.array(X.text_or_empty(F.col(query))),
    )


def extract_questions(
    df: DataFrame, terms: DataFrame, article: str = "article", query: str = "query",
    key: str = "id", tagger: Tagger | None = None,
) -> DataFrame:
    """Add ``pos, sentence, stem, chunk``: the sentence closest to the query text with
    its key chunk blanked; both empty for a passage without sentences."""
    tagger = tagger or rule_tagger()
    rows = _asked(df, key, article, query)
    scores = sentence_scores(rows, terms, "_queries", 1, key)
    found = once(
        rows.join(scores, key, "left"), pos=best_position(F.col("scored"))
    ).drop("scored", "_queries")
    placed = once(found, sentence=X.text_or_empty(F.get("sents", F.col("pos"))))
    cut = once(placed, _c=blank_key_chunk(F.col("sentence"), F.col(query), tagger))
    nothing = F.size("sents") == 0
    return cut.select(
        *[c for c in df.columns], "pos", "sentence",
        F.when(nothing, F.lit("")).otherwise(F.col("_c.stem")).alias("stem"),
        F.when(nothing, F.lit("")).otherwise(F.col("_c.chunk")).alias("chunk"),
    )


def sentence_words(sents: Column) -> Column:
    """Distinct tokens of each sentence."""
    return F.transform(sents, lambda s: F.array_distinct(X.word_tokens(s)))


def overlap_position(words: Column, query: Column) -> Column:
    """First of the sentences (``words``: their distinct tokens) that share most distinct
    tokens with the query."""
    scored = X.let(
        X.word_tokens(query),
        lambda q: F.transform(
            words,
            lambda w, i: F.struct(F.size(F.array_intersect(w, q)).alias("n"), (-i).alias("neg")),
        ),
    )
    return F.coalesce(-F.array_max(scored)["neg"], F.lit(0))


def hint_texts(
    sents: Column, words: Column, scored: Column, query: Column, index: Column | int = 0
) -> Column:
    """Three hints: most similar sentence, most overlapping sentence, and of the three
    most similar the weakest that is neither. Short passages are padded with ''."""

    def pick(p: Column) -> Column:
        first, second = F.get(p["top"], F.lit(0)), p["second"]
        left = F.filter(F.reverse(p["top"]), lambda i: (i != first) & (i != second))
        third = F.coalesce(F.get(left, F.lit(0)), F.element_at(p["top"], -1))
        return F.array(F.get(sents, first), F.get(sents, second), F.get(sents, third))

    places = F.struct(
        overlap_position(words, query).alias("second"),
        top_positions(scored, F.size(sents), 3, index).alias("top"),
    )
    padded = F.concat(sents, F.array_repeat(F.lit(""), 3 - F.size(sents)))
    return F.when(F.size(sents) < 3, padded).otherwise(X.let(places, pick))


def hints(
    df: DataFrame, terms: DataFrame, article: str = "article", query: str = "query",
    key: str = "id", n: int | None = None,
) -> DataFrame:
    """Add ``hints``. With ``n`` they are simply the ``n`` most similar sentences."""
    rows = _asked(df, key, article, query)
    joined = rows.join(sentence_scores(rows, terms, "_queries", 1, key), key, "left").withColumn(
        "scored", F.coalesce("scored", F.array().cast(NO_SCORES))
    )
    if n is None:
        joined = once(joined, _words=sentence_words(F.col("sents")))
        value = hint_texts(F.col("sents"), F.col("_words"), F.col("scored"), F.col(query))
    else:
        top = top_positions(F.col("scored"), F.size("sents"), n)
        value = F.filter(
            F.transform(top, lambda i: F.get(F.col("sents"), i)), lambda s: s.isNotNull()
        )
    return once(joined, hints=value).select(*df.columns, "hints")
