r"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are `[^\x20\x09-\x0D]+`. A word counts as a stop word without the marks `.,;:!?` at its end and
in small letters. All stop words listed are of the Latin script, so a text with fewer Latin letters than
others has no stop-word ratio, and the rule does not bind it. A measure that is null passes.

Null and empty texts have no words and fail the base rule. Very long texts are read whole; an empty table
gives no rows. Equal rows get equal results, repeated and null ids too; nothing is shuffled, so hot sources
cost nothing. Measures stand beside a copy of the row, so columns of the documents may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.operators.common import once

# The most frequent function words of languages in the Latin script.
STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this are from or an a not but have "
    "der die das und ist von den mit zu für auf im nicht ein eine sich des dem "
    "le la les des et en de un une que qui dans pour est sur par au avec pas du "
    "el los las y que una por con para su es se lo del no al como "
    "il di che è per della sono non gli nel più "
    "o os da em um uma não com mais dos "
    "het een van op te zijn niet aan voor met "
    "i w na z do się nie to jest że jak"
)
MARKS = ".,;:!?"
#: From this share of stop words on, a text is taken to be in a listed language.
LISTED = 0.25

#: name, metric, lowest and highest value that stays (None: no bound on that side).
RULES = (
    ("words", "n_words", 20, None),
    ("mean_word_length", "mean_word_length", 2.0, 12.0),
    ("symbol_ratio", "symbol_ratio", None, 0.05),
    ("stop_words", "stop_word_ratio", 0.04, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.60),
    ("repeat_word_ratio", "repeat_word_ratio", None, 0.30),
)
SYMBOLS = "#*$%&|<>"
# Letters with a Latin base up to U+024F, and letters of the other scripts.
LATIN = r"[A-Za-z\u00AA\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"
OTHER = r"[\u0370-\u1DFF\u2C00-\uA71F\uA800-\uD7FF\uF900-\uFAFF\uFB13-\uFDFF]"


def let(value: Column, body) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    pieces = F.split(text, r"[\x20\x09-\x0D]", -1)
    # Empty pieces come only from white space at an end or in a row.
    odd = text.rlike(r"(?:^|[\x20\x09-\x0D])(?:[\x20\x09-\x0D]|$)")
    return F.when(odd, F.array_remove(pieces, "")).otherwise(pieces)


def window(words: Column, i: Column, size: int) -> Column:
    # Element by element: slice() would read the whole array for every window.
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(size)])


def repeated_words(words: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that the text has twice or more.

    Every window gets a hash of four of its words, at fixed places. Equal windows have equal
    hashes; where two hashes agree, the whole windows are sorted and compared.
    """
    last = F.size(words) - size
    places = sorted({0, size // 4, size // 2, size - 1})

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(
            F.lit(size), F.coalesce(F.get(starts, j + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def twice(pairs: Column) -> Column:
        """Positions of a sorted array of (key, position) whose neighbour has the same key."""
        flagged = F.transform(pairs, lambda x, j: F.when(
            (F.get(pairs, j + 1)["k"] == x["k"])
            | (F.when(j > 0, F.get(pairs, j - 1)["k"]) == x["k"]), x["p"]))
        return F.array_compact(flagged)

    def exact(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("p"))))
        maybe = let(by_hash, twice)
        by_text = F.sort_array(F.transform(
            maybe, lambda i: F.struct(window(words, i, size).alias("k"), i.alias("p"))))
        return let(F.sort_array(let(by_text, twice)), covered)

    def found(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact(hashes)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[F.get(words, i + j) for j in places]))
    return F.when(last < 1, 0).otherwise(let(hashes, found))


def metrics(docs: DataFrame, text: str = "text", window_words: int = 8,
            stop_words: str = STOP_WORDS) -> DataFrame:
    """The document columns with one struct ``_m`` of measures, in one projection."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = once(docs, _t=body)
    split = once(split, _w=word_array(F.col("_t")))
    words = F.col("_w")
    stops = list(dict.fromkeys(stop_words.split()))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = once(
        split,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.concat_ws("", words)).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.regexp_replace("_t", f"[{SYMBOLS}]", ""))).cast("long"),
        n_lines=F.size(lines).cast("long"),
        n_dup_lines=let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        n_repeat_words=repeated_words(words, window_words).cast("long"),
        n_stop=F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(MARKS))).isin(stops))).cast("long"),
        n_chars_all=F.length("_t").cast("long"),
    )
    whole = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    stop_ratio = F.col("n_stop") / whole
    # Letters are counted only where the ratio is low enough to matter.
    latin = F.length("_t") - F.length(F.regexp_replace("_t", LATIN, ""))
    other = F.length("_t") - F.length(F.regexp_replace("_t", OTHER, ""))
    return measured.withColumns({
        "stop_word_ratio": F.when((stop_ratio < LISTED) & (latin < other), None).otherwise(stop_ratio),
        "mean_word_length": F.col("word_chars") / whole,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("n_chars_all"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / whole,
    }).drop("_t", "_w")


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true where every rule holds."""
    out = F.lit(True)
    for _, metric, low, high in rules:
        if low is not None:
            out = out & F.coalesce(F.col(metric) >= low, F.lit(True))
        if high is not None:
            out = out & F.coalesce(F.col(metric) <= high, F.lit(True))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` beside the key columns."""
    return metrics(docs, text).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & compiled(rules))


def query(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def kept_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """Only documents that pass, with their own columns."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return judged(packed, "_text", rules).filter("kept").select("_row.*")
