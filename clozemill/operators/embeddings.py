"""Word embeddings, mean vectors, exact nearest neighbours."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.operators import skipgram
from clozemill.operators.cells import Cells, best_pairs, search
from clozemill.operators.common import once, small
from clozemill.operators.relational import unpivot_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096


def train_word2vec(
    quiz: DataFrame, dim: int = 100, window: int = 5, min_count: int = 2, epochs: int = 5,
    chunk_tokens: int = skipgram.CHUNK_TOKENS, seed: int = 42, stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Skip-gram embeddings over every text cell (article, options, question): ``word, vector``.

    Texts are trained whole, in chunks of about ``chunk_tokens`` tokens (``operators/skipgram.py``);
    ``stage`` stores the chunks, which every epoch reads.
    """
    return skipgram.train(unpivot_texts(quiz), stage, dim, window, min_count, epochs, seed, chunk_tokens)


def word_vectors(model: DataFrame) -> DataFrame:
    """``word, vector`` as an array of doubles."""
    return model.select("word", "vector")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Vector of length 1; null for the zero vector."""
    return X.let(
        F.nullif(norm(v), F.lit(0.0)),
        lambda n: F.when(n.isNotNull(), F.transform(v, lambda x: x / n)),
    )


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, mean`` with map-side sums, so one hot key is one small buffer per task."""
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"))


def phrase_vectors(
    phrases: DataFrame, vectors: DataFrame, n_words: int, dim: int
) -> DataFrame:
    """``phrase, mean, unit`` of distinct phrases: mean over the known tokens only;
    phrases without a known token are absent. The vectors are broadcast when their
    size (``n_words`` x ``dim`` doubles) allows, else joined by word."""
    tokens = phrases.select("phrase", F.explode(X.word_tokens(F.col("phrase"))).alias("word"))
    known = tokens.join(small(vectors, n_words, 8 * dim + 64), "word")
    means = mean_vectors(known, "phrase", "vector")
    return means.withColumn("unit", unit(F.col("mean")))


def _blocks(df: DataFrame, name: str, key: str, n_blocks: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n_blocks)))


def nearest(
    queries: DataFrame, points: DataFrame, k: int, n_queries: int, n_points: int,
    query_id: str = "q", point_id: str = "p", vector: str = "vector", block: int = BLOCK_ROWS,
    skip_same: bool = True,
) -> DataFrame:
    """``q, p, sim, rank``: exact ``k`` nearest points by cosine for each query.

    Both sides are cut into blocks of about ``block`` rows; every pair of blocks is one
    small matrix product in one task, which hands on only ``k`` candidates per query, so
    neither side is ever held whole and no pair list is formed. ``n_queries`` and
    ``n_points`` only set the number of blocks.
    """
    qn, pn = max(1, -(-n_queries // block)), max(1, -(-n_points // block))
    q = _blocks(queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")), "qb", "id", qn)
    p = _blocks(points.select(F.col(point_id).alias("id"), F.col(vector).alias("v")), "pb", "id", pn)
    q = q.withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pn - 1).cast("long"))))
    p = p.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qn - 1).cast("long"))))
    q_type, p_type = dict(q.dtypes)["id"], dict(p.dtypes)["id"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def rows(block: pd.DataFrame) -> np.ndarray:
            out = np.array(block["v"].tolist(), dtype=np.float64)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300) if len(out) else out

        return best_pairs(left["id"], rows(left), right["id"], rows(right), k, skip_same)

    local = (
        q.groupBy("qb", "pb")
        .cogroup(p.groupBy("qb", "pb"))
        .applyInPandas(best, f"q {q_type}, p {p_type}, sim double")
    )
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "p"))
    return local.withColumn("rank", place).filter(F.col("rank") <= k)


def nearest_words(
    answers: DataFrame, vectors: DataFrame, n_words: int, index: Cells | None, stage, top: int = 10, keep: int = 3,
    dim: int = 100, exact: bool = True,
) -> DataFrame:
    """``id, word, sim, rank``: of the ``top`` nearest words of an answer, the best ``keep``
    that are no token of the passage. ``answers`` holds ``id, answer, article``, ``index`` the
    word vectors by cells; without ``exact`` only the nearest cells are asked.

    An answer of several words asks with the mean vector of its known tokens; its own
    tokens are no neighbours of it. Neighbours are packed into one array for each distinct
    answer and meet the ids, not the texts, by it; the texts are met by id.
    """
    asked = answers.select("id", F.lower("answer").alias("phrase"))
    queries = phrase_vectors(asked.select("phrase").distinct(), vectors, n_words, dim)
    own = X.word_tokens(F.col("q"))
    # Own tokens may fill the first places, so as many more are asked for as the longest answer has.
    longest = asked.agg(F.max(F.size(X.word_tokens(F.col("phrase"))))).first()[0] or 0
    near = search(
        queries.select(F.col("phrase").alias("q"), F.col("mean").alias("vector")), index, top + longest, stage,
        exact=exact, skip_same=False,
    ).filter(~F.array_contains(own, F.col("p")))
    packed = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(
        F.struct("rank", F.col("p").alias("word"), "sim"))), 1, top).alias("near"))
    found = asked.join(packed, asked["phrase"] == packed["q"]).select("id", "near")
    free = once(
        answers.select("id", F.lower("article").alias("_text")).join(found, "id"),
        _tokens=X.word_tokens(F.col("_text")),
    ).select("id", F.slice(F.filter(
        "near", lambda x: ~F.array_contains("_tokens", x["word"])), 1, keep).alias("near"))
    return free.select("id", F.posexplode("near").alias("place", "x")).select(
        "id", "x.word", "x.sim", (F.col("place") + 1).alias("rank"))
