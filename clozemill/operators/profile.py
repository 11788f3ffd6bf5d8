"""Column profile, answer distribution, length histogram and density, keywords."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.words import LETTERS, STOP_WORDS
from clozemill.operators.common import once


def column_profile(df: DataFrame) -> DataFrame:
    """``column, type, filled, missing`` for every column, in one pass."""
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("filled"),
            (F.col("_n") - F.col(c)).alias("missing"),
        )
        for c, t in df.dtypes
    ])
    return stats.select(F.inline(rows))


def answer_distribution(df: DataFrame) -> DataFrame:
    """Rows per letter A-D, zeros kept; other values are not counted."""
    counts = df.agg(*[F.count_if(F.col("answer") == x).alias(x) for x in LETTERS])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("answer"), F.col(x).alias("n")) for x in LETTERS
    ])))


def _lengths(df: DataFrame, text_col: str) -> DataFrame:
    """``len, c``: rows per word count. Everything below works on this small table."""
    return df.groupBy(X.word_count(F.col(text_col)).alias("len")).agg(
        F.count(F.lit(1)).alias("c")
    )


def length_histogram(df: DataFrame, text_col: str = "article", bins: int = 50) -> DataFrame:
    """``bin, lo, hi, n`` over equal bins from the smallest to the largest word count;
    empty bins kept, the last bin closed."""
    lengths = _lengths(df, text_col)
    span = lengths.agg(F.struct(
        F.min("len").cast("double").alias("lo"), F.max("len").cast("double").alias("hi")
    ).alias("s")).scalar()
    width = (span["hi"] - span["lo"]) / bins
    slot = F.least(
        F.floor((F.col("len") - span["lo"]) / F.when(width > 0, width).otherwise(1.0)),
        F.lit(bins - 1),
    ).cast("int")
    counted = lengths.groupBy(slot.alias("bin")).agg(F.sum("c").alias("n"))
    spark = df.sparkSession
    domain = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return domain.join(counted, "bin", "left").select(
        "bin",
        (span["lo"] + F.col("bin") * width).alias("lo"),
        (span["lo"] + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def length_density(df: DataFrame, text_col: str = "article", points: int = 200) -> DataFrame:
    """``point, x, density``: Gaussian kernel density of the word counts on an even
    grid, Scott bandwidth.

    Works on the distinct lengths only; each adds its kernel to the grid points and the
    sums combine on the map side, so one row per point is shuffled.
    """
    lengths = _lengths(df, text_col)
    n = F.sum("c").cast("double")
    size = F.col("len").cast("double")
    # Squares of centred doubles: no overflow on long texts, no cancellation on large tables.
    mean = lengths.agg((F.sum(size * F.col("c")) / n).alias("mean")).scalar()
    squares = F.sum(F.col("c") * (size - mean) * (size - mean))
    m = lengths.agg(F.struct(
        F.min("len").cast("double").alias("lo"), F.max("len").cast("double").alias("hi"),
        n.alias("n"), (squares / (n - 1)).alias("var"),
    ).alias("m")).scalar()
    bandwidth = F.sqrt(m["var"]) * F.pow(m["n"], F.lit(-0.2))
    x = m["lo"] + (m["hi"] - m["lo"]) * F.col("point") / (points - 1)
    kernels = lengths.select(
        "len", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    ).withColumn("x", x)
    term = F.col("c") * F.exp(-0.5 * F.pow((F.col("len") - F.col("x")) / bandwidth, 2))
    scale = m["n"] * bandwidth * math.sqrt(2 * math.pi)
    return kernels.groupBy("point", "x").agg((F.sum(term) / scale).alias("density"))


def top_keywords(
    df: DataFrame, text_col: str = "article", k: int = 100, stop_words: list[str] = STOP_WORDS
) -> DataFrame:
    """The ``k`` most frequent words without stop words."""
    words = df.select(F.explode(X.term_tokens(F.col(text_col), stop_words)).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(k)


def tag_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, n, n_distinct``: tokens by tag, all and different ones, over the rows of an id.

    A row hands on its different tokens as one array a tag, so that no task holds a table of
    ids and tokens."""

    def own(tagged: Column, tag: str) -> Column:
        tokens = F.filter(tagged, lambda t: t["tag"] == tag)["token"]
        return X.let(tokens, lambda t: F.struct(
            F.lit(tag).alias("tag"), F.size(t).cast("long").alias("n"), F.array_distinct(t).alias("tokens")))

    rows = once(docs.select(id_col, text_col), _t=X.tag_tokens(X.cased_tokens(F.col(text_col))))
    parts = rows.select(id_col, F.inline(F.array(*[own(F.col("_t"), tag) for tag in ("NNP", "")]))).where("n > 0")
    return parts.groupBy(id_col, "tag").agg(
        F.sum("n").alias("n"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).cast("long").alias("n_distinct"))
