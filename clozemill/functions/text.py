"""Text functions as column expressions; all of them stay in the JVM and none shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozemill.functions.words import (
    ANSWER_MASK, BLANK, GENERIC_WORDS, STOP_WORDS,
)

SPLIT_MARK = "\x01"
SENTENCE_END = r"([.!?])[ \n\t\r]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \n\t\r]"
WORD = r"[\p{L}\p{N}_]+"
TERM_TOKEN = r"[\p{L}\p{N}_]{2,}"
ASCII_TOKEN = r"[a-z0-9]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a plain expression would be
    inlined into every lambda that mentions it and run once per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null and for white space of any kind."""
    return ~text_or_empty(c).rlike(r"[^ \n\t\r]")


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` that white space follows; trimmed, none empty."""
    marked = F.regexp_replace(text_or_empty(text), SENTENCE_END, "$1" + SPLIT_MARK)
    trimmed = F.transform(
        F.split(marked, SPLIT_MARK),
        lambda s: F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", ""),
    )
    return F.filter(trimmed, lambda s: s != "")


def cased_tokens(text: Column) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(WORD_OR_MARK), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words and single punctuation marks, lower case."""
    return cased_tokens(F.lower(text_or_empty(text)))


def term_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Vectorizer tokens: lower-case words of two characters or more, stop words gone."""
    raw = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TERM_TOKEN), F.lit(0))
    if not stop_words:
        return raw
    # the lambda as SQL text: one call to the JVM instead of one per word
    listed = ", ".join(sql_text(w) for w in stop_words)
    return F.call_function("filter", raw, F.expr(f"t -> t NOT IN ({listed})"))


def sql_text(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ngrams(tokens: Column, n: int) -> Column:
    """``n`` neighbouring tokens joined by a blank."""
    if n == 1:
        return tokens

    def joined(t: Column) -> Column:
        count = F.size(t) - F.lit(n - 1)
        pairs = F.zip_with(
            F.slice(ngrams(t, n - 1), F.lit(1), count), F.slice(t, F.lit(n), count),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.when(count >= 1, pairs).otherwise(F.array().cast("array<string>"))

    return let(tokens, joined)


def terms(text: Column, max_n: int = 2, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All 1- to ``max_n``-grams of the vectorizer tokens."""
    return let(
        term_tokens(text, stop_words),
        lambda t: F.concat(*[ngrams(t, n) for n in range(1, max_n + 1)]),
    )


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(ASCII_TOKEN), F.lit(0))


def run_lengths(items: Column) -> Column:
    """Array to sorted ``array<struct<item, n>>``: counts inside one row, no shuffle."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, k: F.struct(
                    F.get(s, at).alias("item"),
                    (F.coalesce(F.get(b, k + 1), n) - at).alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<item:string,n:int>>")
    return F.when(F.size(items) > 0, let(F.sort_array(items), runs)).otherwise(empty)


def count_map(items: Column) -> Column:
    """Array to ``map<item, n>``."""
    return F.map_from_entries(run_lengths(items))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text_or_empty(text), r"[ \n\t\r]+"), lambda w: w != ""))


def quote_regex(literal: Column) -> Column:
    r"""Quote a column for use inside a pattern, also when it holds ``\E`` itself."""
    inner = F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def blank_first(sentence: Column, chunk: Column) -> Column:
    """Blank the first occurrence of ``chunk``, in any case, also inside a longer word."""
    low_s, low_c = F.lower(sentence), F.lower(chunk)
    at = F.position(low_c, low_s)
    by_position = F.when(at == 0, sentence).otherwise(
        F.concat(
            F.substring(sentence, F.lit(1), at - 1),
            F.lit(BLANK),
            F.substring(sentence, at + F.length(chunk), F.length(sentence)),
        )
    )
    # a few letters change length in lower case; positions would be off there
    same_length = (F.length(low_s) == F.length(sentence)) & (F.length(low_c) == F.length(chunk))
    by_pattern = F.regexp_replace(
        sentence, F.concat(F.lit("(?ius)^(.*?)"), quote_regex(chunk)), F.lit("$1" + BLANK)
    )
    return F.when(chunk == "", sentence).when(same_length, by_position).otherwise(by_pattern)


def mask_answer(hint: Column, chunk: Column) -> Column:
    """Hide every occurrence of the answer in a hint, in any case."""
    pattern = F.concat(F.lit("(?iu)"), quote_regex(chunk))
    return F.when(text_or_empty(chunk) == "", hint).otherwise(
        F.regexp_replace(hint, pattern, F.lit(ANSWER_MASK))
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    cut = F.split(
        F.regexp_replace(F.lower(text), r"([^\p{L}])", "$1" + SPLIT_MARK), SPLIT_MARK
    )
    capital = F.transform(
        cut, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))
    )
    return F.array_join(capital, "")


def format_like(text: Column, answer: Column) -> Column:
    """Title case when the answer starts with a capital, else lower case."""
    return F.when(answer.rlike(r"^\p{Lu}"), title_case(text)).otherwise(F.lower(text))


def count_substring(text: Column, piece: Column, lowered: bool = False) -> Column:
    """Occurrences of ``piece`` that do not overlap, in lower case; ``lowered`` says that
    the text already is."""
    low_t, low_p = text if lowered else F.lower(text), F.lower(piece)
    found = (F.length(low_t) - F.length(F.replace(low_t, low_p, F.lit("")))) / F.nullif(
        F.length(low_p), F.lit(0)
    )
    return F.when(low_p == "", F.length(text) + 1).otherwise(found).cast("int")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def shared_characters(a: Column, b: Column) -> Column:
    """Distinct common characters over the length of ``a``, case-sensitive."""
    return F.size(F.array_intersect(characters(a), characters(b))) / F.greatest(
        F.length(a), F.lit(1)
    )


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b))


PROPER = r"^(?=\p{Lu})(?!(?i:" + "|".join(STOP_WORDS) + r")$)"


def is_proper(token: Column) -> Column:
    """Default tag rule: a capital first letter and no stop word."""
    return token.rlike(PROPER)


def tag_tokens(tokens: Column, nouns: Sequence[str] = ()) -> Column:
    """``array<struct<token, tag>>`` with NNP, NN (words of ``nouns``) or ''."""

    def tag(t: Column) -> Column:
        out = F.when(is_proper(t), F.lit("NNP"))
        if nouns:
            out = out.when(F.lower(t).isin(list(nouns)), F.lit("NN"))
        return F.struct(t.alias("token"), out.otherwise(F.lit("")).alias("tag"))

    return F.transform(tokens, tag)


def phrase_runs(tagged: Column) -> Column:
    """Maximal runs of NNP or of NN tokens in text order, words joined by a blank."""

    def cut(tg: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            same = F.coalesce(F.get(tg, i - 1)["tag"] == t["tag"], F.lit(False))
            return (
                F.when(t["tag"] == "", F.lit(SPLIT_MARK))
                .when(same, t["token"])
                .otherwise(F.concat(F.lit(SPLIT_MARK), t["token"]))
            )

        return F.array_join(F.transform(tg, piece), " ")

    pieces = F.transform(F.split(let(tagged, cut), SPLIT_MARK), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def candidate_phrases(tagged: Column, min_length: int = 3) -> Column:
    """Lower-case phrases of ``min_length`` or more, each once, by first position."""
    low = F.transform(phrase_runs(tagged), lambda p: F.lower(p))
    return F.array_distinct(F.filter(low, lambda p: F.length(p) >= min_length))


ONLY_GENERIC = rf"(?i)^(?:(?:{'|'.join(GENERIC_WORDS)})(?:[ \n\t\r]+|$))+$"


def valid_chunk(chunk: Column) -> Column:
    """Four characters or more, not only generic words, not all lower case."""
    return (
        (F.length(chunk) >= 4)
        & ~chunk.rlike(ONLY_GENERIC)
        & (chunk != F.lower(chunk))
    )


def key_chunk(tagged: Column) -> Column:
    """The token to ask for: proper nouns first, then the longest, then the first; or ''."""

    def best(tg: Column) -> Column:
        usable = F.filter(tg, lambda t: (t["tag"] != "") & valid_chunk(t["token"]))

        def named(t: Column) -> Column:
            return F.exists(
                tg, lambda u: (u["tag"] == "NNP") & (F.lower(u["token"]) == F.lower(t["token"]))
            )

        scored = F.transform(
            usable,
            lambda t, i: F.struct(
                F.when(t["tag"] == "NNP", F.lit(True)).otherwise(named(t)).alias("proper"),
                F.length(t["token"]).alias("len"), (-i).alias("at"), t["token"].alias("token"),
            ),
        )
        return F.array_max(scored)["token"]

    return text_or_empty(let(tagged, best))


def percent_number(x: Column) -> Column:
    """A share as a percentage with one digit."""
    return F.round(x * 100, 1)


def score_text(x: Column) -> Column:
    """A score that is no percentage, with four digits."""
    return F.format_string("%.4f", x)


def percent_text(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)
