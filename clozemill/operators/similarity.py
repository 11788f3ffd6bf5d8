"""Sentence against query similarity inside each passage, for many passages at once.

A row holds a passage (``sents``) and up to ``k`` query texts about it. The rows are
exchanged once by key; weights, dot products and norms are formed in Arrow batches of whole
keys on that partitioning, so that no term leaves its text. A vocabulary too large for the
tasks is joined by rows of terms; queries then ride along as small count maps. No pair is
formed that shares no key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.functions import text as X
from clozemill.functions.arrow import PIECE, unpacked, word_letters
from clozemill.operators.common import keyed, once
from clozemill.operators.tfidf import MAX_TERMS, Known, known_terms, matches, weight

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _runs(keys: pa.Array) -> np.ndarray:
    """The first places of runs of equal keys."""
    code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)


def whole_keys(batches: Iterator[pa.RecordBatch], limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut anew between keys; each holds about ``limit`` bytes of the
    texts in the lists of the other columns, or one key."""
    held: list[pa.RecordBatch] = []
    for batch in _and_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            # the last key may go on in the next batch
            first, last = held[0].column(0)[0], batch.column(0)[-1]
            if len(held) > 1 and first.equals(last):
                continue
        if not held:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = _runs(rows.column(0))
        stop = int(starts[-1]) if batch is not None else rows.num_rows
        size = np.zeros(rows.num_rows, np.int64)
        for column in rows.columns[1:]:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            bytes_ = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy()))
            size += bytes_[ends]
        at = 0
        while at < stop:
            before = int(size[at - 1]) if at else 0
            end = int(np.searchsorted(size, before + limit, "right"))
            cut = starts[np.searchsorted(starts, end, "right") - 1] if end < stop else stop
            if cut <= at:
                after = np.searchsorted(starts, at, "right")
                cut = starts[after] if after < len(starts) else stop
            cut = min(int(cut), stop)
            yield rows.slice(at, cut - at)
            at = cut
        held = [rows.slice(stop)] if stop < rows.num_rows else []


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _found(column: pa.Array, known: Known, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place in the row's list, term and count of every known term of lists of lower-case texts."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    text, term, count = matches(column.flatten(), known, letters)
    row = np.repeat(np.arange(len(size)), size)
    return row[text], (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[text], term, count


def _merged(keys: np.ndarray, count: np.ndarray, *most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sum of ``count`` and the greatest of each of ``most`` by key."""
    own, place = np.unique(keys, return_inverse=True)
    out = []
    for values in most:
        best = np.zeros(len(own), values.dtype)
        np.maximum.at(best, place, values)
        out.append(best)
    return own, np.bincount(place, count, len(own)), *out


def _cosines(rows: pa.RecordBatch, known: Known, letters: np.ndarray, k: int) -> pa.RecordBatch:
    """``key, scored`` of whole keys; rows of one key count as one text in several parts."""
    n = max(len(known.ids), 1)
    starts = _runs(rows.column(0))
    group = np.searchsorted(starts, np.arange(rows.num_rows), "right") - 1
    s_row, s_pos, s_term, s_count = _found(rows.column(1), known, letters)
    q_row, q_pos, q_term, q_count = _found(rows.column(2), known, letters)
    asked = []
    for i in range(k):
        own = q_pos == i
        keys, count = q_row[own] * n + q_term[own], q_count[own]
        at = np.minimum(np.searchsorted(keys, s_row * n + s_term), max(len(keys) - 1, 0))
        asked.append(np.where(keys[at] == s_row * n + s_term, count[at], 0) if len(keys) else np.zeros(len(s_row), np.int64))
    places = int(s_pos.max(initial=0)) + 1
    key, count, *asked = _merged((group[s_row] * places + s_pos) * n + s_term, s_count, *asked)
    idf, unit = known.idf[key % n], key // n
    w = (1 + np.log(count)) * idf
    units, place = np.unique(unit, return_inverse=True)
    length = np.sqrt(np.bincount(place, w * w, len(units)))
    own = q_pos < k
    q_key, q_count = _merged((group[q_row] * k + q_pos)[own] * n + q_term[own], q_count[own])
    q_w = (1 + np.log(q_count)) * known.idf[q_key % n]
    q_unit = q_key // n
    q_length = np.sqrt(np.bincount(q_unit, q_w * q_w, len(starts) * k)).reshape(len(starts), k)
    of, cosine = units // places, np.zeros((len(units), k))
    for i, c in enumerate(asked):
        dot = np.bincount(place, np.where(c > 0, w * (1 + np.log(np.maximum(c, 1))) * idf, 0.0), len(units))
        near = dot > 0
        cosine[near, i] = dot[near] / (length[near] * q_length[of[near], i])
    known_keys = np.union1d(of, q_unit // k)
    known_keys = known_keys[rows.column(0).take(pa.array(starts[known_keys])).is_valid().to_numpy(zero_copy_only=False)]
    kept = np.isin(of, known_keys)
    ends = np.append(0, np.searchsorted(of[kept], known_keys, "right"))
    scores = pa.ListArray.from_arrays(pa.array(np.arange(int(kept.sum()) + 1) * k, pa.int32()), pa.array(cosine[kept].ravel()))
    scored = pa.StructArray.from_arrays([pa.array((units % places)[kept], pa.int32()), scores], ["pos", "s"])
    return pa.record_batch([rows.column(0).take(pa.array(starts[known_keys])),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), scored)], ["key", "scored"])


def sentence_scores(
    rows: DataFrame, terms: DataFrame, queries: str, k: int, key: str = "id",
    sents: str = "sents", max_terms: int = MAX_TERMS,
) -> DataFrame:
    """``key, scored``: per key the array of ``struct<pos, s>`` where ``s`` holds the
    cosine of the sentence with each query; only sentences that have a known term.

    ``queries`` is an array column of at most ``k`` texts. ``rows`` have to be partitioned
    by ``key`` (:func:`common.keyed`). A null key has no scores.
    """
    known = known_terms(terms)
    if known is None:
        return joined_scores(rows, terms, queries, k, key, sents)
    letters = word_letters()
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = unpacked(letters), shared.value
        for part in whole_keys(batches):
            yield _cosines(part, held, own, k)

    def low(texts: str) -> Column:
        return F.transform(texts, lambda s: F.lower(X.text_or_empty(s)))

    units = rows.select(F.col(key).alias("key"), low(sents).alias("sents"), low(queries).alias("queries"))
    kind = T.StructType([
        T.StructField("key", rows.schema[key].dataType),
        T.StructField("scored", SCORES),
    ])
    found = units.sortWithinPartitions("key").mapInArrow(work, kind)
    return found.select(F.col("key").alias(key), F.transform("scored", lambda u: F.struct(
        u["pos"].alias("pos"), F.transform(u["s"], lambda x: F.round(x, 9)).alias("s"))).alias("scored"))


def joined_scores(
    rows: DataFrame, terms: DataFrame, queries: str, k: int, key: str = "id", sents: str = "sents",
) -> DataFrame:
    """:func:`sentence_scores` by rows of terms that are joined with the vocabulary, of any size."""
    with_maps = once(
        rows.select(key, sents, queries),
        _maps=F.transform(queries, lambda q: X.count_map(X.terms(q))),
    )
    units = F.concat(
        F.transform(F.col(sents), lambda s, i: F.struct(i.alias("pos"), s.alias("unit"))),
        F.transform(F.col(queries), lambda q, i: F.struct((-1 - i).alias("pos"), q.alias("unit"))),
    )
    per_unit = with_maps.select(key, "_maps", F.inline(units))
    grams = per_unit.select(key, "pos", "_maps", F.explode(X.terms(F.col("unit"))).alias("term"))
    # Stored vocabularies have a known size; only a small one is broadcast.
    vocab = terms.select("term", "term_id", "idf")
    counts = [f"_q{i}" for i in range(k)]
    hits = grams.join(vocab, "term").select(
        key, "pos", "term_id", "idf",
        *[
            F.try_element_at(F.get("_maps", F.lit(i)), F.col("term")).alias(c)
            for i, c in enumerate(counts)
        ],
    )
    weights = hits.groupBy(key, "pos", "term_id", "idf").agg(
        F.count(F.lit(1)).alias("tf"), *[F.max(c).alias(c) for c in counts]
    )
    w = weight(F.col("tf"), F.col("idf"))
    sums = weights.select(
        key, "pos", w.alias("w"),
        *[F.coalesce(w * weight(F.col(c), F.col("idf")), F.lit(0.0)).alias(c) for c in counts],
    ).groupBy(key, "pos").agg(
        F.sum(F.col("w") * F.col("w")).alias("n2"), *[F.sum(c).alias(c) for c in counts]
    )
    packed = sums.groupBy(key).agg(
        F.collect_list(
            F.when(
                F.col("pos") >= 0,
                F.struct("pos", F.sqrt("n2").alias("n"), F.array(*counts).alias("dots")),
            )
        ).alias("_s"),
        F.collect_list(
            F.when(F.col("pos") < 0, F.struct((-1 - F.col("pos")).alias("q"), F.sqrt("n2").alias("n")))
        ).alias("_n"),
    )

    def cosines(s: Column) -> Column:
        # most queries of most rows share nothing with the sentence
        return F.transform(
            s["dots"],
            lambda d, i: F.when(
                d > 0,
                F.round(d / (s["n"] * F.get(F.filter("_n", lambda n: n["q"] == i), F.lit(0))["n"]), 9),
            ).otherwise(F.lit(0.0)),
        )

    return packed.select(
        key, F.transform("_s", lambda s: F.struct(s["pos"].alias("pos"), cosines(s).alias("s"))).alias("scored")
    )


NO_SCORES = "array<struct<pos:int,s:array<double>>>"
SCORES = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))]))


def ranked_positions(scored: Column, query: Column | int = 0) -> Column:
    """``array<struct<neg, pos>>`` of sentences with a positive similarity, best first,
    equal ones by position."""
    at = F.lit(query) if isinstance(query, int) else query
    hits = F.filter(scored, lambda s: F.get(s["s"], at) > 0)
    return F.sort_array(
        F.transform(hits, lambda s: F.struct((-F.get(s["s"], at)).alias("neg"), s["pos"].alias("pos")))
    )


def best_position(scored: Column, query: Column | int = 0) -> Column:
    """First of the most similar sentences; position 0 when none is similar."""
    return F.coalesce(F.get(ranked_positions(scored, query), F.lit(0))["pos"], F.lit(0))


def top_positions(scored: Column, n_sents: Column, n: int = 3, query: Column | int = 0) -> Column:
    """The ``n`` best positions, best first; sentences without similarity follow in
    text order."""
    ranked = ranked_positions(scored, query)["pos"]
    rest = F.array_except(F.sequence(F.lit(0), F.greatest(n_sents - 1, F.lit(0))), ranked)
    return F.slice(F.concat(ranked, rest), 1, n)


def best_sentence(
    df: DataFrame, terms: DataFrame, article: str = "article", query: str = "query", key: str = "id"
) -> DataFrame:
    """``key, query, pos, sim, sentence``: per row the passage sentence closest to the
    query. Both sides of the join read the same columns and so share one exchange."""
    rows = once(
        keyed(df.select(key, article, query).filter(F.col(key).isNotNull()), key),
        sents=X.sentences(F.col(article)), _queries=F.array(X.text_or_empty(F.col(query))),
    )
    scores = sentence_scores(rows, terms, "_queries", 1, key)
    joined = rows.filter(F.size("sents") > 0).join(scores, key, "left")
    found = once(joined, _best=F.get(ranked_positions(F.col("scored")), F.lit(0)))
    pos = F.coalesce(F.col("_best.pos"), F.lit(0))
    return found.select(
        key, query, pos.alias("pos"), F.coalesce(-F.col("_best.neg"), F.lit(0.0)).alias("sim"),
        F.get("sents", pos).alias("sentence"),
    )
