"""Topic clusters: k-means with several starts, assignment, exact silhouette of all rows or a sample, moments on the full table."""

from __future__ import annotations

import sys
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.operators.sampling import sample_exact

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
SAMPLE_ROWS = 5000
#: Runs of k-means at a time.
AT_ONCE = 4
BLOCK_ROWS = 512
#: Rows of a block of sparse vectors, which are never made dense; distances and shared places held at a time.
SPARSE_ROWS = 16384
DISTANCES = 1 << 18
PLACES = 1 << 21


def train_kmeans(
    vectors: DataFrame, k: int = K, seed: int = 42, starts: int = 10, max_iter: int = 100,
    features: str = "features",
) -> tuple[KMeansModel, float]:
    """Best of ``starts`` seeded runs by inertia: ``(model, inertia)``; equal ones by the earlier start.

    A run is a chain of short jobs, so several go side by side."""
    rows = vectors.select(features).persist()

    def fit(start: int) -> tuple[KMeansModel, float]:
        model = KMeans(
            k=k, seed=seed + start, initMode="k-means||", maxIter=max_iter, featuresCol=features,
            predictionCol="cluster_id",
        ).fit(rows)
        return model, model.summary.trainingCost

    try:
        rows.count()
        with ThreadPool(min(starts, AT_ONCE)) as pool:
            return min(pool.imap(inheritable_thread_target(vectors.sparkSession)(fit), range(starts)), key=lambda found: found[1])
    finally:
        rows.unpersist()


def assign(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    """Rows with their ``cluster_id``; a map-only pass."""
    return model.transform(vectors)


def _pair(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two dense blocks over only the coordinates that occur in either."""
    used = np.unique(np.concatenate([*a["i"].tolist(), *b["i"].tolist(), np.zeros(1, np.int64)]))

    def dense(block: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(block), len(used)))
        for row, (i, x) in enumerate(zip(block["i"], block["x"])):
            out[row, np.searchsorted(used, i)] = x
        return out

    return dense(a), dense(b)


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of everything that the vectors of ``rows`` hold."""
    lists = rows["i"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(rows)), size), lists.flatten().to_numpy(), rows["x"].combine_chunks().flatten().to_numpy()


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(sorted_values), 1), bool), sorted_values[1:] != sorted_values[:-1]]))


def distance_sums(a: pa.Table, b: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of each row of ``a`` to the clusters of ``b``, and of each row of ``b`` to those of ``a``.

    Both are in order of ``c``. Rows meet at the places that both vectors hold; ``same`` says that ``a`` is ``b``."""
    c_a, c_b = (t["c"].to_numpy() for t in (a, b))
    first_a, first_b = _runs(c_a), _runs(c_b)
    row_a, at_a, x_a = _flat(a)
    row_b, at_b, x_b = _flat(b)
    square_a, square_b = np.bincount(row_a, x_a * x_a, len(a)), np.bincount(row_b, x_b * x_b, len(b))
    order = np.argsort(at_b, kind="stable")
    at_b, row_b, x_b = at_b[order], row_b[order], x_b[order]
    begin, end = np.searchsorted(at_b, at_a), np.searchsorted(at_b, at_a, "right")
    met = np.concatenate([[0], np.cumsum(np.bincount(row_a, end - begin, len(a)).astype(np.int64))])
    ids = None
    if same:
        ids = a["id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out_a, out_b = np.zeros((len(a), len(first_b))), np.zeros((len(first_a), len(b)))
    most, start = max(1, DISTANCES // len(b)), 0
    while start < len(a):
        stop = min(max(start + 1, int(np.searchsorted(met, met[start] + PLACES, "right")) - 1), start + most, len(a))
        own = slice(*np.searchsorted(row_a, (start, stop)))
        n = (end - begin)[own]
        held = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell = np.repeat(row_a[own] - start, n) * len(b) + row_b[held]
        dot = np.bincount(cell, np.repeat(x_a[own], n) * x_b[held], (stop - start) * len(b)).reshape(stop - start, -1)
        far = np.sqrt(np.maximum(square_a[start:stop, None] + square_b[None] - 2 * dot, 0.0))
        if ids is not None:
            far[ids[start:stop, None] == ids[None]] = 0.0
        out_a[start:stop] = np.add.reduceat(far, first_b, axis=1)
        cluster = np.searchsorted(first_a, np.arange(start, stop), "right") - 1
        begun = _runs(cluster)
        out_b[cluster[begun]] += np.add.reduceat(far, begun, axis=0)
        start = stop
    return out_a, out_b.T


def _sum_rows(rows: pa.Table, c_other: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """``id, c, o, d, n``: a row for each row and cluster of the other side."""
    first = _runs(c_other)
    count, k = np.diff(np.append(first, len(c_other))), len(first)
    at = pa.array(np.repeat(np.arange(len(rows)), k))
    return pa.record_batch({
        "id": rows["id"].combine_chunks().take(at), "c": rows["c"].combine_chunks().take(at),
        "o": pa.array(np.tile(c_other[first], len(rows)).astype(np.int32)), "d": pa.array(sums.ravel()),
        "n": pa.array(np.tile(count, len(rows)).astype(np.int64))})


def _sparse_sums(rows: DataFrame, nb: int) -> DataFrame:
    """``id, c, o, d, n`` of ``rows(id, c, i, x, b)``: every pair of blocks meets once, in a task of its own, and
    is summed up for both of its sides."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long")))
    met = rows.withColumn("_o", other).select(
        "id", "c", "i", "x", (F.col("b") <= F.col("_o")).alias("low"), (F.col("b") == F.col("_o")).alias("same"),
        F.greatest("b", "_o").alias("_hi"), F.least("b", "_o").alias("_lo"))
    pair = (F.col("_hi") * (F.col("_hi") + 1) / 2 + F.col("_lo")).cast("int")

    def work(batches):
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        rows = pa.Table.from_batches(held).sort_by("c")
        del held
        same, low = rows["same"][0].as_py(), rows["low"]
        a, b = (rows, rows) if same else (rows.filter(low), rows.filter(pc.invert(low)))
        if len(a) and len(b):
            sums_a, sums_b = distance_sums(a, b, same)
            yield _sum_rows(a, b["c"].to_numpy(), sums_a)
            if not same:
                yield _sum_rows(b, a["c"].to_numpy(), sums_b)

    kind = dict(rows.dtypes)["id"]
    dealt = met.withColumn("_p", pair).drop("_hi", "_lo").repartitionById(nb * (nb + 1) // 2, F.col("_p")).drop("_p")
    return dealt.mapInArrow(work, f"id {kind}, c int, o int, d double, n bigint")


def silhouette_parts(
    points: DataFrame, n_rows: int, id_col: str = "id", vector: str = "vector",
    cluster: str = "cluster_id", block: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, cluster_id, own, other, s`` per point: mean Euclidean distance to its own
    cluster, the smallest mean distance to another, and the silhouette (0 for a cluster
    of one).

    ``points`` has an ML vector or an array column; blocks of it meet pairwise, and each
    task hands on one distance sum per point and cluster. ML vectors stay sparse.
    """
    nb = max(1, -(-n_rows // block))
    v = F.col(vector)
    sparse = isinstance(points.schema[vector].dataType, VectorUDT)
    if sparse:
        raw = F.unwrap_udt(v)
        values = raw["values"]
        places = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(values) - 1))
    else:
        values = v.cast("array<double>")
        places = F.sequence(F.lit(0), F.size(values) - 1)
    rows = points.select(
        F.col(id_col).alias("id"), F.col(cluster).cast("int").alias("c"),
        places.cast("array<int>").alias("i"), values.alias("x"),
        F.pmod(F.xxhash64(id_col), F.lit(nb)).alias("b"),
    )
    parts = _sparse_sums(rows, nb) if sparse else _dense_sums(rows, nb)
    per = parts.groupBy("id", "c", "o").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("c") == F.col("o"), F.struct(
        (F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).alias("a"), "n")))
    other = F.min(F.when(F.col("c") != F.col("o"), F.col("d") / F.col("n")))
    both = per.groupBy("id", F.col("c").alias("cluster_id")).agg(own.alias("_own"), other.alias("other"))
    a, b = F.col("_own.a"), F.col("other")
    s = F.when((F.col("_own.n") == 1) | b.isNull(), F.lit(0.0)).otherwise(
        F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))
    )
    return both.select("id", "cluster_id", a.alias("own"), "other", s.alias("s"))


def _dense_sums(rows: DataFrame, nb: int) -> DataFrame:
    """``id, c, o, d, n`` of ``rows(id, c, i, x, b)`` for blocks made dense."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long")))

    def side(own: str, other: str) -> DataFrame:
        cells = [F.col(c).alias(c) for c in ("id", "c", "i", "x")]
        return rows.select(*cells, F.col("b").alias(own), every.alias(other))

    left, right = side("lb", "rb"), side("rb", "lb")
    id_type = dict(rows.dtypes)["id"]

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, y = _pair(a, b)
            sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            d = np.sqrt(np.maximum(sq, 0.0))
            d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0.0
            labels = b["c"].to_numpy()
            for c in np.unique(labels):
                at = labels == c
                out.append(pd.DataFrame({
                    "id": a["id"], "c": a["c"], "o": np.int32(c),
                    "d": d[:, at].sum(1), "n": np.int64(at.sum()),
                }))
        if not out:
            return pd.DataFrame({"id": [], "c": [], "o": [], "d": [], "n": []})
        return pd.concat(out)

    return (
        left.groupBy("lb", "rb")
        .cogroup(right.groupBy("lb", "rb"))
        .applyInPandas(sums, f"id {id_type}, c int, o int, d double, n bigint")
    )


def silhouette(
    points: DataFrame, id_col: str = "id", vector: str = "vector", cluster: str = "cluster_id",
    rows: int | None = None, seed: int = 42,
) -> DataFrame:
    """``silhouette`` over every point, or over a seeded sample of at most ``rows`` points.

    Every point meets every other, so the work grows with the square of their number, the memory of a task does not."""
    if rows is None:
        rows = points.count()
    else:
        points = sample_exact(points, rows, id_col, seed)
    block = SPARSE_ROWS if isinstance(points.schema[vector].dataType, VectorUDT) else BLOCK_ROWS
    parts = silhouette_parts(points, rows, id_col, vector, cluster, block)
    return parts.agg(F.avg("s").alias("silhouette"))


def moment_silhouette(
    points: DataFrame, id_col: str = "id", vector: str = "vector", cluster: str = "cluster_id",
) -> DataFrame:
    """``id, cluster_id, own, other, s`` of every point by squared distances; a different number by definition.

    The mean squared distance to a cluster follows from its count, mean and mean square, so no two points meet:
    one aggregate for the moments (a row a cluster), one map over the points. A cluster of one, or a single cluster,
    gives 0; points without a vector or a cluster are left out.
    """
    rows = points.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(cluster).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("x"))
    packed = rows.select("c", array_to_vector("x").alias("v"))
    found = packed.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m"), Summarizer.normL2(F.col("v")).alias("l2"))
    moments = [(r.c, r.n, r.m.toArray(), float((r.l2.toArray() ** 2).sum()) / r.n) for r in found.orderBy("c").collect()]
    known = np.array([m[0] for m in moments])
    count = np.array([m[1] for m in moments], np.float64)
    mean = np.array([m[2] for m in moments]) if moments else np.zeros((0, 1))
    square = np.array([m[3] for m in moments])
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = np.maximum((x * x).sum(1)[:, None] + square[None] - 2 * x @ mean.T, 0.0)
            at = np.searchsorted(known, batch.column(1).to_numpy())
            row = np.arange(len(x))
            own = far[row, at] * count[at] / np.maximum(count[at] - 1, 1)
            far[row, at] = np.inf
            other = far.min(1)
            alone = (count[at] == 1) | ~np.isfinite(other)
            top = np.maximum(own, np.where(np.isfinite(other), other, 0))
            s = np.where(alone | (top == 0), 0.0, (np.where(alone, 0, other) - own) / np.where(top == 0, 1, top))
            yield pa.record_batch({
                "id": batch.column(0), "cluster_id": batch.column(1), "own": pa.array(own),
                "other": pa.array(np.where(np.isfinite(other), other, np.nan)), "s": pa.array(s)})

    return rows.mapInArrow(work, f"id {kind}, cluster_id int, own double, other double, s double")
