"""Nearest neighbours by cells: an inverted file of vectors, probed by query and ranked again exactly.

``build`` fits coarse centres on a bounded sample, gives every vector to its nearest centre and stores the
vectors by cell, large cells in blocks of about ``BLOCK_ROWS`` rows. ``search`` asks the ``probes`` cells with the
nearest centres; queries and vectors meet by cell and block, and each meeting hands on ``k`` candidates a query.
``probes_for`` measures on a sample of the stored vectors how many cells a wanted recall takes. With
``exact`` a second round asks every cell that may still hold a nearer vector: by the triangle inequality,
one whose centre is no farther than its radius and the distance of the k-th candidate together.

Distances are those of vectors of length 1, so they order as cosines do. A zero vector has cosine 0 with all; zero
vectors form a cell of their own that every query asks, and a zero query asks all cells if the search is
exact. Null vectors are neither stored nor asked. Ties go to the smaller id. Vectors may repeat, ids of queries may not.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.operators.common import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
#: Queries and vectors of two blocks whose similarities are held at a time.
SLICE_ROWS = 256
PART_ROWS = 4096
#: Bytes of a block where most queries ask most cells: each copy of a vector then meets many others.
BLOCK_BYTES = 32 << 20
#: Centres at most, and sampled vectors for each of them.
MAX_CELLS = 16_384
SAMPLE_EACH = 64
PROBES = 8
#: Stored vectors on which the recall is measured.
MEASURED = 200
ZERO = -1


@dataclass
class Cells:
    """An index: where its vectors stand and what is known of each cell."""

    centres: np.ndarray
    vectors: DataFrame  # id, vector (length 1 or 0), cell, block
    number: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    rows: int
    block: int

    @property
    def id_type(self) -> str:
        return self.vectors.schema["id"].dataType.simpleString()

    def table(self) -> DataFrame:
        """``cell, blocks``: a row a cell, the zero vectors' cell included."""
        spark = self.vectors.sparkSession
        rows = [(int(c), int(b)) for c, b in zip(self.number, self.blocks)]
        return spark.createDataFrame(rows, "cell int, blocks long")


def large_block(dim: int) -> int:
    """Rows of a block of ``BLOCK_BYTES``, and of a cell that nearly all queries ask."""
    return max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1)))


def cell_count(rows: int) -> int:
    return int(min(MAX_CELLS, max(1, round(rows**0.5))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, each of length 1 (or 0)."""
    if not len(column):
        return np.zeros((0, 1))
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def fit_centres(points: DataFrame, rows: int, vector: str, cells: int, seed: int) -> np.ndarray:
    """Centres of a sample of about ``SAMPLE_EACH`` vectors for each of them, as (cells, dimensions)."""
    share = min(1.0, cells * SAMPLE_EACH / max(rows, 1))
    picked = F.pmod(F.xxhash64("id", vector, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = points.where(picked | F.lit(share == 1.0)).select(array_to_vector(unit_array(vector)).alias("features"))
    if cells == 1:
        return np.array([sample.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=1).fit(sample)
    return np.array(model.clusterCenters())


def unit_array(vector: str):
    value = F.col(vector).cast("array<double>")
    size = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(F.struct(value.alias("v"), size.alias("n"))), lambda p: F.transform(
        p["v"], lambda x: x / F.greatest(p["n"], F.lit(1e-300))))[0]


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances (points, centres)."""
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T
    return np.sqrt(np.maximum(square, 0))


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, vector, cell, far`` of every vector: its nearest centre and the distance to it."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    kind = points.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = matrix(part.column(1))
                far = nearest_centres(rows, shared.value)
                cell = far.argmin(1)
                far = far[np.arange(len(rows)), cell]
                zero = ~rows.any(1)
                yield pa.record_batch({
                    "id": part.column(0), "vector": pa.array(list(rows), pa.list_(pa.float64())),
                    "cell": pa.array(np.where(zero, ZERO, cell).astype(np.int32)),
                    "far": pa.array(np.where(zero, 0.0, far))})

    return points.select("id", "vector").mapInArrow(work, f"id {kind}, vector array<double>, cell int, far double")


def build(points: DataFrame, stage: Callable[[DataFrame], DataFrame], id_column: str = "id", vector: str = "vector",
          cells: int | None = None, block: int = BLOCK_ROWS, seed: int = 42) -> Cells | None:
    """Index all vectors; ``stage`` stores a table and reads it back. None without a vector."""
    points = points.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = points.count()
    if not rows:
        return None
    centres = fit_centres(points, rows, "vector", cells or cell_count(rows), seed)
    placed = stage(assign(points, centres))
    # A row a cell: at most MAX_CELLS + 1.
    known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).orderBy("cell").collect()
    number = np.array([r.cell for r in known])
    blocks = np.array([-(-r.n // block) for r in known])
    index = Cells(centres, placed, number, np.array([r.r for r in known]), blocks, rows, block)
    dealt = placed.join(small(index.table(), len(number), 64), "cell").withColumn(
        "block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")))
    index.vectors = stage(dealt.repartition("cell", "block").sortWithinPartitions("cell", "block").select(
        "id", "vector", "cell", "block"))
    return index


def asked_cells(queries: DataFrame, index: Cells, probes: int, again: bool = False) -> DataFrame:
    """``q, vector, cells`` with the cells each query asks, queries without any left out: the ``probes`` nearest ones, or ``again`` all others that may
    hold a vector within ``far``, the distance of the query's k-th candidate so far (null: all others)."""
    live = index.number >= 0
    shared = queries.sparkSession.sparkContext.broadcast(
        (index.centres[index.number[live]], index.number[live], index.radius[live], bool((~live).any())))
    kind = queries.schema["q"].dataType.simpleString()

    def work(batches):
        centres, number, radius, zeros = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = matrix(part.column(1))
                far = nearest_centres(rows, centres) if len(number) else np.zeros((len(rows), 0))
                asked = np.zeros(far.shape, bool)
                first = min(probes, len(number))
                order = np.argsort(far, axis=1, kind="stable")[:, :first]
                np.put_along_axis(asked, order, True, axis=1)
                own_zero = np.full(len(rows), zeros)
                if again:
                    limit = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = far - radius[None] <= limit[:, None] + 1e-6
                    reach[np.isnan(limit) | ~rows.any(1)] = True
                    asked, own_zero = reach & ~asked, np.zeros(len(rows), bool)
                every = np.concatenate([asked, own_zero[:, None]], axis=1)
                every, kept = every[every.any(1)], np.flatnonzero(every.any(1))
                ends = np.concatenate([[0], every.sum(1).cumsum()]).astype(np.int32)
                yield pa.record_batch({
                    "q": part.column(0).take(pa.array(kept)), "vector": pa.array(
                        list(rows[kept]), pa.list_(pa.float64())),
                    "cells": pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.append(number, ZERO)[np.nonzero(every)[1]].astype(np.int32)))})

    return queries.mapInArrow(work, f"q {kind}, vector array<double>, cells array<int>")


def met(asked: DataFrame, index: Cells, k: int, stage, skip_same: bool, block: int) -> DataFrame:
    """``q, p, sim``: the k best of every block for every query that asks its cell."""
    # A query is stored once with the list of its cells; its vector is copied where it meets them.
    asked = stage(asked)
    named = asked.select(F.explode("cells").alias("cell"))
    # A row a cell again: queries of a cell are cut into blocks of bounded size as the vectors are.
    busy = {r.cell: -(-r.n // block) for r in named.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = asked.sparkSession
    sides = spark.createDataFrame(
        [(int(c), int(b), int(busy[c])) for c, b in zip(index.number, index.blocks) if c in busy],
        "cell int, blocks long, q_blocks long")
    sides = small(sides, len(busy), 64)

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = asked.withColumn("cell", F.explode("cells")).join(sides, "cell").withColumn("q_block", F.pmod(F.xxhash64("q", "vector"), F.col("q_blocks")))
    left = left.withColumn("block", every("blocks")).select("cell", "block", "q_block", "q", "vector")
    right = index.vectors.join(sides, "cell").withColumn("q_block", every("q_blocks")).select(
        "cell", "block", "q_block", "id", "vector")
    q_type, p_type = asked.schema["q"].dataType.simpleString(), index.id_type

    def best(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(queries["q"], np.array(queries["vector"].tolist()), points["id"],
                          np.array(points["vector"].tolist()), k, skip_same)

    keys = ("cell", "block", "q_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, f"q {q_type}, p {p_type}, sim double")


def best_pairs(q, a: np.ndarray, p, b: np.ndarray, k: int, skip_same: bool) -> pd.DataFrame:
    """The k nearest points of each query among a block of vectors of length 1."""
    out: list[tuple] = []
    if len(a) and len(b):
        ids, names = p.to_numpy(), q.to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, b = ids[order], b[order]
        # A slice of queries and a part of the points at a time, so that few similarities are at hand beside the two blocks.
        for first in range(0, len(a), SLICE_ROWS):
            own = names[first:first + SLICE_ROWS]
            least = np.full(len(own), -np.inf)
            row, at, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for start in range(0, len(b), PART_ROWS):
                sims = a[first:first + SLICE_ROWS] @ b[start:start + PART_ROWS].T
                if skip_same:
                    sims[own[:, None] == ids[None, start:start + PART_ROWS]] = -np.inf
                # Everything that may reach the k-th similarity so far, ties after rounding included; only that is sorted.
                new_row, new_at = np.nonzero((sims >= least[:, None] - 2e-9) & (sims > -np.inf))
                if len(new_row) > 8 * k * len(own) and k < sims.shape[1]:
                    bound = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                    new_row, new_at = np.nonzero((sims >= bound[:, None] - 2e-9) & (sims > -np.inf))
                if not len(new_row):
                    continue
                row, at = np.concatenate([row, new_row]), np.concatenate([at, new_at + start])
                sim = np.concatenate([sim, np.round(sims[new_row, new_at], 9)])
                order = np.lexsort((at, -sim, row))
                row, at, sim = row[order], at[order], sim[order]
                heads = np.searchsorted(row, row)
                best = np.arange(len(row)) - heads < k
                row, at, sim = row[best], at[best], sim[best]
                last = np.searchsorted(row, np.arange(len(own)), "right")
                full = np.bincount(row, minlength=len(own)) >= k
                least[full] = sim[last[full] - 1]
            out.append((own[row], ids[at], sim))
    q_out, p_out, sim_out = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"q": q_out, "p": p_out, "sim": sim_out})


def search(queries: DataFrame, index: Cells | None, k: int, stage: Callable[[DataFrame], DataFrame],
           query_id: str = "q", vector: str = "vector", probes: int = PROBES, exact: bool = False,
           skip_same: bool = True, block: int | None = None) -> DataFrame:
    """``q, p, sim, rank``: the ``k`` nearest vectors of each query in the cells it asks, or of all; queries are
    cut into blocks as large as those of the index unless ``block`` is given."""
    asked = queries.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("vector"))
    if index is None:
        return asked.select("q", F.col("q").alias("p"), F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    block = block or index.block
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "p"))
    found = met(asked_cells(asked, index, probes), index, k, stage, skip_same, block)
    if exact and probes < int((index.number >= 0).sum()):
        found = stage(found.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"))
        # Distance of the k-th candidate; without k candidates there is no bound.
        bound = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(
            F.lit(0.0), 2 - 2 * (F.min("sim") - 2e-9)))).alias("far"))
        rest = asked.join(bound, "q", "left").select("q", "vector", "far")
        found = found.unionByName(met(
            asked_cells(rest, index, probes, again=True), index, k, stage, skip_same, block))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def probes_for(index: Cells, k: int, recall: float, stage: Callable[[DataFrame], DataFrame], seed: int = 7) -> int:
    """The least number of cells to ask for this recall, measured on about ``MEASURED`` stored vectors.

    Their exact neighbours are looked up, and the place of each neighbour's cell in the query's order counted."""
    chance = int(min(1.0, MEASURED / index.rows) * (1 << 30))
    picked = stage(index.vectors.where(F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(1 << 30)) < chance).select(
        F.col("id").alias("q"), "vector").dropDuplicates(["q"]))
    near = search(picked, index, k, stage, probes=max(PROBES, len(index.number) // 4), exact=True)
    where = index.vectors.groupBy(F.col("id").alias("p")).agg(F.min("cell").alias("cell"))
    asked = picked.join(near.join(where, "p").groupBy("q").agg(F.collect_list("cell").alias("cells")), "q")
    live = index.number >= 0
    shared = picked.sparkSession.sparkContext.broadcast((index.centres[index.number[live]], index.number[live]))

    def work(batches):
        centres, number = shared.value
        for batch in batches:
            order = np.argsort(nearest_centres(matrix(batch.column(0)), centres), axis=1, kind="stable")
            places = [int(np.flatnonzero(number[row] == cell)[0]) + 1 if cell != ZERO else 1
                      for row, own in zip(order, batch.column(1).to_pylist()) for cell in own]
            yield pa.record_batch({"place": pa.array(places, pa.int64())})

    # A row for each number of cells at most.
    found = asked.select("vector", "cells").mapInArrow(work, "place long").groupBy("place").count().orderBy(
        "place").collect()
    total, have = sum(r["count"] for r in found), 0
    for r in found:
        have += r["count"]
        if have >= recall * total:
            return r["place"]
    return PROBES
