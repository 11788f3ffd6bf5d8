"""Quiz table derived from passages: every passage gets a question, a right and three
wrong options. One pass over the rows, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.arrow import pieces, unpacked, word_letters, word_runs
from clozemill.functions.words import LETTERS
from clozemill.operators.common import once, spread
from clozemill.sources.tables import read_table

LONG_WORD, WRONG = 4, 3
#: Up to the first mark that white space follows, or the end; leading blanks and split marks make no sentence.
FIRST_SENTENCE = r"^[ \n\t\r\x01]*([^\x01]*?[.!?](?=[ \n\t\r])|[^\x01]*)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "passage")


def first_sentence(text: Column) -> Column:
    """The first of ``text.sentences`` without making the others; null if there is none."""
    found = F.regexp_extract(X.text_or_empty(text), FIRST_SENTENCE, 1)
    return F.nullif(F.regexp_replace(found, r"^[ \n\t\r]+|[ \n\t\r]+$", ""), F.lit(""))


def word_options(key: Column, question: Column, article: Column) -> Column:
    """``struct<right, wrong>``: the long word of the question with the smallest md5 of key and word, and the three
    such words of the rest of the article. Both texts come in lower case; null where there is no word."""
    letters = word_letters()

    def words(texts: pa.Array, known: np.ndarray) -> Iterator[list[bytes]]:
        for piece in pieces(texts):
            found, row = word_runs(piece, known, LONG_WORD)
            flat = found.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            ends = np.searchsorted(row, np.arange(len(piece)), "right").tolist()
            for at, end in zip([0, *ends], ends):
                yield flat[at:end]

    def smallest(prefix: bytes, of: set[bytes], n: int) -> list[str]:
        best = nsmallest(n, [(md5(prefix + w, usedforsecurity=False).digest(), w) for w in of])
        return [w.decode() for _, w in best]

    @F.arrow_udf("struct<right:string,wrong:array<string>>")
    def picked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = unpacked(letters)
        for keys, questions, articles in batches:
            right, wrong = [], []
            for name, q, a in zip(keys.to_pylist(), words(questions, known), words(articles, known)):
                prefix, own = b"" if name is None else name.encode() + b":", set(q)
                right += smallest(prefix, own, 1) or [None]
                wrong.append(smallest(prefix, set(a) - own, WRONG))
            yield pa.StructArray.from_arrays(
                [pa.array(right, pa.string()), pa.array(wrong, pa.list_(pa.string()))], ["right", "wrong"])

    return picked(key, question, article)


def quiz_from_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, article, question, A-D, answer``.

    The question is the first sentence, the right option the question word with the
    smallest md5 of id and word, the wrong ones the three such words of the rest.
    Passages with too few words give no row.
    """
    base = once(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("article")),
        question=first_sentence(F.col("article")),
    ).filter(F.col("question").isNotNull())
    options = word_options(F.col("id").cast("string"), F.lower("question"), F.lower("article"))
    # the generator keeps the filter above the Python step, which would run twice else
    made = base.withColumn("_o", options)
    picked = once(made, _right=F.col("_o.right"), _wrong=F.col("_o.wrong")).filter(F.col("_right").isNotNull() & (F.size("_wrong") == WRONG))
    slot = F.pmod(F.col("id"), F.lit(4)).cast("int")
    options = [
        F.when(slot == i, F.col("_right"))
        .otherwise(F.get(F.col("_wrong"), F.lit(i) - (slot < i).cast("int")))
        .alias(letter)
        for i, letter in enumerate(LETTERS)
    ]
    return picked.select(
        "id", "article", "question", *options,
        F.get(F.array(*[F.lit(x) for x in LETTERS]), slot).alias("answer"),
    )


def quiz_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiz rows of all passages; the text rules know no language."""
    return quiz_from_passages(spread(documents(spark, sf_dir).select("doc_id", "text")))
