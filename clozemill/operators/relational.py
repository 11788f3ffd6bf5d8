"""Row shaping for quiz tables: options, labels, unpivots, blank filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.words import FALLBACK_ANCHOR, LETTERS


def answer_letter(answer: Column) -> Column:
    """Upper case; anything but A-D (also with blanks around it, or null) is A."""
    up = F.upper(answer)
    return F.when(up.isin(LETTERS), up).otherwise(F.lit("A"))


def correct_option(answer: Column = None) -> Column:
    letter = answer_letter(F.col("answer") if answer is None else answer)
    out = F.when(letter == "A", F.col("A"))
    for name in LETTERS[1:]:
        out = out.when(letter == name, F.col(name))
    return X.text_or_empty(out)


def wrong_options() -> Column:
    """The three other options in A-D order."""
    letter = answer_letter(F.col("answer"))
    pairs = F.array(*[
        F.struct(F.lit(x).alias("letter"), X.text_or_empty(F.col(x)).alias("text")) for x in LETTERS
    ])
    return F.filter(pairs, lambda p: p["letter"] != letter)["text"]


def corpus_text() -> Column:
    """Article and the four options, the text the vectorizer is fitted on."""
    return F.concat_ws(" ", *[X.text_or_empty(F.col(c)) for c in ["article", *LETTERS]])


def cluster_text(question: Column | None = None, answer: Column | None = None) -> Column:
    q = F.col("question") if question is None else question
    a = correct_option() if answer is None else answer
    return F.concat_ws(" ", X.text_or_empty(q), X.text_or_empty(a))


def verifier_text(stem: Column, option: Column) -> Column:
    return F.concat_ws(" ", X.text_or_empty(stem), X.text_or_empty(option))


def option_sentence(stem: Column, word: Column) -> Column:
    """Every blank filled with the word."""
    return F.replace(stem, F.lit(X.BLANK), word)


def with_anchor(article: Column, options: Column) -> Column:
    """First sentence (or a fixed lead) followed by the options."""
    anchor = F.coalesce(F.get(X.sentences(article), F.lit(0)), F.lit(FALLBACK_ANCHOR))
    return F.concat_ws(" ", anchor, F.array_join(options, " "))


def unpivot_options(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Four rows per question: ``id, opt, text, label`` with label 1 for the right one."""
    options = F.array(*[
        F.struct(F.lit(x).alias("opt"), X.text_or_empty(F.col(x)).alias("option")) for x in LETTERS
    ])
    exploded = df.select(
        "id", *keep, "question", answer_letter(F.col("answer")).alias("_letter"),
        F.inline(options),
    )
    return exploded.select(
        "id", *keep, "opt",
        verifier_text(F.col("question"), F.col("option")).alias("text"),
        (F.col("opt") == F.col("_letter")).cast("int").alias("label"),
    )


def unpivot_texts(df: DataFrame) -> DataFrame:
    """One row per non-blank text cell with its word tokens: ``id, field, tokens``."""
    fields = ["article", *LETTERS, "question"]
    cells = F.array(*[
        F.struct(F.lit(x).alias("field"), X.text_or_empty(F.col(x)).alias("raw")) for x in fields
    ])
    return (
        df.select("id", F.inline(cells))
        .filter(~X.is_blank(F.col("raw")))
        .select("id", "field", X.word_tokens(F.col("raw")).alias("tokens"))
    )


def with_question_text(df: DataFrame) -> DataFrame:
    """Rows whose article and gold question are not blank."""
    return df.filter(~X.is_blank(F.col("article")) & ~X.is_blank(F.col("question")))


def with_answer_text(df: DataFrame) -> DataFrame:
    """Rows whose article and right option are not blank."""
    return df.filter(~X.is_blank(F.col("article")) & ~X.is_blank(correct_option()))
