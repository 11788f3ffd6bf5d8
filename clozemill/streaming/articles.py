"""Streams that need more than one stateful step per batch: items, verifier, clusters.

Each batch runs the batch job and appends its rows under the batch id, so a batch that
is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.operators import tfidf
from clozemill.operators.common import small
from clozemill.operators.sampling import sample_exact
from clozemill.sources.tables import outputs_exist


def run_batches(
    stream: DataFrame, job: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str
):
    """Apply a batch job to every micro-batch of a stream; ``path`` gets one
    ``batch=<n>`` folder each. A job reads its batch several times, so the batch is kept (on disk
    where memory is short) and read from its source once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            job(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def centre_distances(
    ids: DataFrame, weights: DataFrame, centres: DataFrame, k: int, max_terms: int
) -> DataFrame:
    """``uid, cluster_id`` for every uid of ``ids``: nearest centre of its unit vector, given
    in long form. A text without a known term is the zero vector and goes to the shortest centre.

    Centres are a long table ``cluster_id, term_id, value`` of at most ``k`` x
    ``max_terms`` rows. Only shared terms enter the dot product, which together with the
    centre's own length orders the distances.
    """
    lengths = centres.groupBy("cluster_id").agg(F.sum(F.col("value") * F.col("value")).alias("c2"))
    # weights are never negative, so of the centres that share no term only the shortest counts
    shortest = lengths.agg(F.min(F.struct(F.col("c2").alias("d"), "cluster_id"))).scalar()
    shared = (
        weights.join(small(centres, k * max_terms, 24), "term_id", "left")
        .groupBy("uid", "cluster_id").agg(F.sum(F.col("w") * F.col("value")).alias("dot"))
        .join(small(lengths, k), "cluster_id", "left")
    )
    distance = F.struct((F.col("c2") - 2 * F.col("dot")).alias("d"), "cluster_id")
    nearest = shared.groupBy("uid").agg(
        F.min(F.when(F.col("cluster_id").isNotNull(), distance)).alias("_near")
    )
    return ids.select("uid").join(nearest, "uid", "left").select(
        "uid", F.least(F.col("_near"), shortest)["cluster_id"].alias("cluster_id")
    )


class MiniBatchKMeans:
    """Centres that follow a stream: each batch moves a centre by the mean of its new
    rows, weighted by the rows seen so far. Centres are stored per batch."""

    def __init__(self, spark: SparkSession, path: str, k: int = 10, seed: int = 42,
                 max_terms: int = tfidf.MAX_TERMS):
        self.spark, self.path, self.k, self.seed, self.max_terms = spark, path, k, seed, max_terms

    def centres(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def _start(self, weights: DataFrame, have: int = 0) -> DataFrame:
        """Rows in seeded order as centres, until there are ``k`` with the ``have`` given ones."""
        uids = sample_exact(weights.select("uid").distinct(), self.k - have, "uid", self.seed)
        # k rows at most, so they may be numbered in one place
        order = uids.agg(F.sort_array(F.collect_list("uid")).alias("u")).select(
            F.posexplode("u").alias("n", "uid")
        ).select((F.col("n") + have).alias("cluster_id"), "uid")
        return weights.join(small(order, self.k), "uid").select(
            "cluster_id", "term_id", F.col("w").alias("value"), F.lit(0).cast("long").alias("seen")
        )

    def step(self, texts: DataFrame, terms: DataFrame, batch_id: int) -> DataFrame:
        """Assign the rows ``uid, text`` of a batch and store the moved centres."""
        weights = tfidf.unit_weights(texts, terms, "uid", max_terms=self.max_terms).persist()
        try:
            old = self.centres(batch_id - 1) if batch_id else None
            have = old.select("cluster_id").distinct().count() if batch_id else 0
            if have < self.k:  # the first batches may have too few texts
                start = f"{self.path}/start{batch_id or ''}"
                if not outputs_exist(self.spark, start):
                    self._start(weights, have).write.mode("overwrite").parquet(start)
                more = self.spark.read.parquet(start)
                old = old.unionByName(more) if batch_id else more
            nearest = centre_distances(texts, weights, old, self.k, self.max_terms)
            assigned = nearest
            sums = weights.join(nearest, "uid").groupBy("cluster_id", "term_id").agg(F.sum("w").alias("s"))
            rows = nearest.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
            seen = old.groupBy("cluster_id").agg(F.max("seen").alias("n"))
            totals = seen.join(rows, "cluster_id", "left").select(
                "cluster_id", "n", F.coalesce("m", F.lit(0)).alias("m")
            )
            moved = (
                old.drop("seen").join(sums, ["cluster_id", "term_id"], "full_outer")
                .join(small(totals, self.k), "cluster_id")
                .select(
                    "cluster_id", "term_id",
                    F.when(
                        F.col("n") + F.col("m") > 0,
                        (F.coalesce("value", F.lit(0.0)) * F.col("n") + F.coalesce("s", F.lit(0.0)))
                        / (F.col("n") + F.col("m")),
                    ).otherwise(F.col("value")).alias("value"),
                    (F.col("n") + F.col("m")).alias("seen"),
                )
            )
            moved.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
            out = f"{self.path}/assigned{batch_id}"
            assigned.write.mode("overwrite").parquet(out)
            return self.spark.read.parquet(out)
        finally:
            weights.unpersist()
