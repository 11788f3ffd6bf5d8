"""TF-IDF over 1- and 2-grams: vocabulary, long weights, sparse vectors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.functions import text as X
from clozemill.functions.arrow import pieces, unpacked, word_letters, word_runs
from clozemill.functions.words import STOP_WORDS
from clozemill.operators.common import keyed, small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TERMS = 50_000
#: Words that are sent to the tasks at most.
WORDS_HELD = 1 << 20


def term_counts(docs: DataFrame, text_col: str = "text", max_n: int = 2) -> DataFrame:
    """``term, df, cf``. Counts are formed inside the row and summed on the map side,
    so what is shuffled is one row per partition and term, not the text."""
    runs = docs.select(
        F.inline(X.run_lengths(X.terms(F.col(text_col), max_n))).alias("term", "n")
    )
    return runs.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")
    )


def _words_of(text: pa.Array, letters: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of ``text.term_tokens`` of lower-case texts, and the place of each one's text."""
    words, row = word_runs(text, letters, 2)
    kept = pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS)))
    return words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]


def _counted(row: np.ndarray, codes: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Texts that hold each of the codes 0 to n - 1, and how often it stands in all of them."""
    df = np.bincount(np.unique(row.astype(np.int64) * n + codes) % n, minlength=n)
    return pa.array(df), pa.array(np.bincount(codes, minlength=n))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`term_counts` of single words, in Arrow batches."""
    letters = word_letters()

    def work(batches):
        known = unpacked(letters)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                words, row = _words_of(piece, known)
                if len(words):
                    found = words.dictionary_encode()
                    df, cf = _counted(row, found.indices.to_numpy(), len(found.dictionary))
                    yield pa.record_batch({"term": found.dictionary, "df": df, "cf": cf})

    low = docs.select(F.lower(X.text_or_empty(F.col(text_col))))
    return low.mapInArrow(work, "term string, df long, cf long").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def pair_counts(docs: DataFrame, words: pa.Array, text_col: str = "text") -> DataFrame:
    """``pair, df, cf`` of neighbouring tokens that both are in ``words``; a pair is place of the one x n + place
    of the other."""
    letters, n = word_letters(), len(words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        known = unpacked(letters)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                found, row = _words_of(piece, known)
                code = pc.fill_null(pc.index_in(found, value_set=shared.value), -1).to_numpy().astype(np.int64)
                both = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
                if both.any():
                    pair, place = np.unique(code[:-1][both] * n + code[1:][both], return_inverse=True)
                    df, cf = _counted(row[:-1][both], place, len(pair))
                    yield pa.record_batch({"pair": pa.array(pair), "df": df, "cf": cf})

    low = docs.select(F.lower(X.text_or_empty(F.col(text_col))))
    return low.mapInArrow(work, "pair long, df long, cf long").groupBy("pair").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _reached(counts: DataFrame, max_terms: int) -> tuple[Column, Column]:
    """Powers of two of ``cf``, and the one where the cap is reached; rarer terms cannot be kept and stay out of
    the top-n (both plans share the exchange of the counts)."""
    level = F.floor(F.log2("cf"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c"))
    reached = sizes.withColumn("above", F.sum("c").over(W.orderBy(F.desc("level"))))
    return level, reached.agg(
        F.coalesce(F.max(F.when(F.col("above") >= max_terms, F.col("level"))), F.lit(0))
    ).scalar()


def frequent_words(docs: DataFrame, text_col: str, max_terms: int, min_df: int) -> pa.Table | None:
    """``term, df, cf`` of the words that can be, or be part of, one of the ``max_terms`` most frequent terms.

    A pair is no more frequent than either of its words, so both are at least as frequent as the word that takes
    the last place among words alone. None if they are more than ``WORDS_HELD``."""
    counts = word_counts(docs, text_col).filter(F.col("df") >= min_df)
    level, lowest = _reached(counts, max_terms)
    found = counts.filter(level >= lowest).limit(WORDS_HELD + 1).toArrow()
    if len(found) > WORDS_HELD:
        return None
    cf = np.sort(found["cf"].to_numpy())[::-1]
    least = int(cf[max_terms - 1]) if len(cf) >= max_terms else 0
    return found.filter(pc.greater_equal(found["cf"], least)).combine_chunks()


def frequent_counts(docs: DataFrame, text_col: str, max_terms: int, min_df: int, max_n: int,
                    stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``term, df, cf`` that hold the ``max_terms`` most frequent terms, and not many more."""
    found = frequent_words(docs, text_col, max_terms, min_df) if max_n == 2 else None
    if found is None:
        counts = term_counts(docs, text_col, max_n).filter(F.col("df") >= min_df)
        level, lowest = _reached(counts, max_terms)
        return counts.filter(level >= lowest)
    terms = found["term"].combine_chunks()
    n = len(terms)
    words = docs.sparkSession.createDataFrame(found.append_column("number", pa.array(np.arange(n, dtype=np.int64))))
    if not n:
        return words.select("term", "df", "cf")
    pairs = stage(pair_counts(docs, terms, text_col).filter(F.col("df") >= min_df))
    level, lowest = _reached(pairs.select("cf").union(words.select("cf")), max_terms)
    kept = pairs.filter(level >= lowest).select(
        F.expr(f"pair div {n}").alias("first"), F.pmod("pair", F.lit(n)).alias("second"), "df", "cf")
    for side in ("first", "second"):
        named = words.select(F.col("number").alias(side), F.col("term").alias(f"{side}_term"))
        kept = kept.join(small(named, n), side)
    return kept.select(F.concat_ws(" ", "first_term", "second_term").alias("term"), "df", "cf").union(
        words.filter(level >= lowest).select("term", "df", "cf"))


def fit_tfidf(
    docs: DataFrame,
    text_col: str = "text",
    max_terms: int = MAX_TERMS,
    min_df: int = 2,
    max_n: int = 2,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """``term_id, term, df, cf, idf``: the ``max_terms`` most frequent terms (ties by
    term) found in ``min_df`` documents or more; smoothed idf plus one. ``stage`` stores the
    counts of word pairs, which are read for the cut and for the terms."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    counts = frequent_counts(docs, text_col, max_terms, min_df, max_n, stage)
    kept = counts.orderBy(F.desc("cf"), "term").limit(max_terms)
    # max_terms rows at most from here on
    return kept.select(
        (F.row_number().over(W.orderBy(F.desc("cf"), "term")) - 1).alias("term_id"),
        "term", "df", "cf",
        (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def weight(tf: Column, idf: Column) -> Column:
    return (1 + F.log(tf.cast("double"))) * idf


@dataclass(frozen=True)
class Known:
    """A vocabulary as arrays: its words and the words of its pairs, and the place of each term among ``ids``."""

    words: pa.Array
    single: np.ndarray  # place of each word's own term; -1 if it is only part of pairs, and at the end
    pairs: np.ndarray  # place of the one word x number of words + place of the other, ascending
    pair_places: np.ndarray
    ids: np.ndarray
    idf: np.ndarray


def known_terms(terms: DataFrame) -> Known | None:
    """The vocabulary for the tasks; None if it holds more than ``WORDS_HELD`` terms, or a term twice."""
    found = terms.filter(F.col("term").isNotNull()).select(
        "term", F.col("term_id").cast("int"), F.col("idf").cast("double")).limit(WORDS_HELD + 1).toArrow()
    found = found.combine_chunks()
    names = found["term"].to_pylist()
    if len(names) > WORDS_HELD or len(set(names)) < len(names) or found["term_id"].null_count or found["idf"].null_count:
        return None
    split = [name.split(" ") for name in names]
    words = sorted({w for parts in split if len(parts) <= 2 for w in parts})
    place = {w: i for i, w in enumerate(words)}
    single, n = np.full(len(words) + 1, -1, np.int64), len(words)
    pairs, pair_places = [], []
    for i, parts in enumerate(split):
        if len(parts) == 1:
            single[place[parts[0]]] = i
        elif len(parts) == 2:
            pairs.append(place[parts[0]] * n + place[parts[1]])
            pair_places.append(i)
    order = np.argsort(np.array(pairs, np.int64))
    return Known(pa.array(words, pa.string()), single, np.array(pairs, np.int64)[order], np.array(pair_places, np.int64)[order],
                 found["term_id"].to_numpy(), found["idf"].to_numpy())


def matches(texts: pa.Array, known: Known, letters: np.ndarray, max_n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of the term in ``known`` and count of every known term of lower-case texts, by text and term."""
    rows, places, at = [], [], 0
    for piece in pieces(texts):
        found, row = _words_of(piece, letters)
        code = pc.fill_null(pc.index_in(found, value_set=known.words), -1).to_numpy().astype(np.int64)
        own = known.single[code]
        rows.append(at + row[own >= 0])
        places.append(own[own >= 0])
        if max_n > 1 and len(known.pairs):
            both = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
            pair = code[:-1][both] * len(known.words) + code[1:][both]
            near = np.minimum(np.searchsorted(known.pairs, pair), len(known.pairs) - 1)
            hit = known.pairs[near] == pair
            rows.append(at + row[:-1][both][hit])
            places.append(known.pair_places[near[hit]])
        at += len(piece)
    n = max(len(known.ids), 1)
    every = np.concatenate(rows).astype(np.int64) * n + np.concatenate(places) if rows else np.empty(0, np.int64)
    every, count = np.unique(every, return_counts=True)
    return every // n, every % n, count


def _packed(docs: DataFrame, known: Known, id_col: str, text_col: str, max_n: int) -> DataFrame:
    """``id_col, _tw, _n2``: the raw weights ``struct<term_id, w>`` of each text by term, and the sum of their squares;
    texts without a known term are left out. A map over the rows, which stay where they are."""
    letters = word_letters()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("_tw", T.ArrayType(T.StructType([T.StructField("term_id", T.IntegerType()), T.StructField("w", T.DoubleType())]))),
        T.StructField("_n2", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = unpacked(letters), shared.value
        by_id = np.argsort(held.ids, kind="stable")
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(1)):
                row, place, count = matches(piece, held, own, max_n)
                order = np.lexsort((rank[place], row))
                row, place, count = row[order], place[order], count[order]
                w = (1 + np.log(count)) * held.idf[place]
                texts, first = np.unique(row, return_index=True)
                tw = pa.StructArray.from_arrays([pa.array(held.ids[place], pa.int32()), pa.array(w)], ["term_id", "w"])
                ends = pa.array(np.append(first, len(row)), pa.int32())
                yield pa.record_batch([
                    batch.column(0).take(pa.array(at + texts)), pa.ListArray.from_arrays(ends, tw),
                    pa.array(np.bincount(row, w * w)[texts])], [id_col, "_tw", "_n2"])
                at += len(piece)

    low = docs.select(id_col, F.lower(X.text_or_empty(F.col(text_col))))
    return low.mapInArrow(work, kind)


def raw_weights(
    docs: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("id",), text_col: str = "text",
    max_n: int = 2, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """``keys, term_id, term, w`` before normalising. The vocabulary should be a stored table:
    its size decides about a broadcast, not an assumed bound."""
    runs = docs.select(
        *keys, F.inline(X.run_lengths(X.terms(F.col(text_col), max_n))).alias("term", "tf")
    )
    vocab = terms.select("term", "term_id", "idf")
    return runs.join(vocab, "term").select(
        *keys, "term_id", "term", weight(F.col("tf"), F.col("idf")).alias("w")
    )


def unit_weights(
    docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text",
    max_n: int = 2, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Long L2-normalised matrix ``id, term_id, w``: one exchange, of a row a text with its weights. What follows by
    ``id`` finds its rows in place. A vocabulary that is not held by the tasks is joined by rows of text."""
    known = known_terms(terms) if max_n <= 2 else None
    own = W.partitionBy(id_col)
    if known is None:
        raw = raw_weights(keyed(docs.select(id_col, text_col), id_col), terms, (id_col,), text_col, max_n, max_terms)
        return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))).drop("term")
    packed = _packed(docs, known, id_col, text_col, max_n).withColumn("_norm", F.sqrt(F.sum("_n2").over(own)))
    return packed.select(id_col, "_norm", F.inline("_tw")).select(
        id_col, "term_id", (F.col("w") / F.col("_norm")).alias("w"))


def tfidf_weights(
    docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text",
    max_n: int = 2, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """:func:`unit_weights` with the terms themselves: ``id, term_id, term, w``."""
    rows = unit_weights(docs, terms, id_col, text_col, max_n, max_terms)
    return rows.join(terms.select("term_id", "term"), "term_id").select(id_col, "term_id", "term", "w")


def _sparse(size: Column, ids: Column, values: Column) -> Column:
    """Sparse vector from its parts without Python: the parts are written and read as JSON,
    which keeps doubles exactly and lets the reader give them the vector type."""
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"), size.alias("size"), ids.alias("indices"), values.alias("values")
    )
    kind = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), kind)["v"]


def tfidf_vectors(
    docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text",
    out: str = "features", max_n: int = 2, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """``docs`` without its text column, with a sparse unit vector per row.

    Rows without a known term get the empty vector. The terms of one text are gathered
    back by the row's own key, so a group is never larger than one text. ``terms`` is
    read once for its size and should be a stored table.
    """
    placed = keyed(docs, id_col)
    weights = raw_weights(placed, terms, (id_col,), text_col, max_n, max_terms)
    packed = weights.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("_tw"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    joined = placed.drop(text_col).join(packed, id_col, "left")
    ids = F.coalesce(F.col("_tw.term_id"), F.array().cast("array<int>"))
    values = F.coalesce(
        F.transform(F.col("_tw.w"), lambda w: w / F.col("_norm")), F.array().cast("array<double>")
    )
    last = terms.agg(F.max("term_id")).first()[0]
    size = F.lit(1 if last is None else last + 1)
    return joined.withColumn(out, _sparse(size, ids, values)).drop("_tw", "_norm")
