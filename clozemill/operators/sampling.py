"""Seeded splits, samples and ranks by md5 order; none sorts or ranks the whole table.

Rows are ordered by ``md5(seed:id)``, then id. A histogram over the leading hex
digits (bounded size, map-side combined) tells which bucket holds a wanted rank; only
that bucket is ranked, and the key found there decides every other row in a map-only
pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.operators.common import small

PREFIX = 4
PREFIX_BUCKETS = 16**PREFIX


def seeded_hash(id_col: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))


def seeded_key(id_col: Column, seed: int = 42) -> Column:
    return F.struct(seeded_hash(id_col, seed).alias("h"), id_col.alias("id"))


def cut_keys(keys: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """One row, one struct column ``cuts``: the key at each wanted rank (null for rank 0).

    ``keys`` has one column ``key``; ``ranks`` are expressions over the row count ``n``.
    """
    bucketed = keys.select("key", F.substring("key.h", 1, PREFIX).alias("bucket"))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    # at most PREFIX_BUCKETS rows pass through these two windows
    running = counts.select(
        "bucket",
        "c",
        F.sum("c").over(W.orderBy("bucket")).alias("cum"),
        F.sum("c").over(W.partitionBy(F.lit(0))).alias("n"),
    )
    wanted = running.select(
        "bucket", "c", "cum",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), rank.cast("long").alias("k"))
            for name, rank in ranks.items()
        ])).alias("w"),
    )
    edges = wanted.filter((F.col("cum") >= F.col("w.k")) & (F.col("cum") - F.col("c") < F.col("w.k")))
    edges = edges.select(
        "bucket", F.col("w.name").alias("name"),
        (F.col("w.k") - F.col("cum") + F.col("c")).alias("r"),
    )
    # at most one bucket per wanted rank is looked into
    place = F.row_number().over(W.partitionBy("bucket", "name").orderBy("key"))
    hits = (
        bucketed.join(small(edges, len(ranks)), "bucket")
        .withColumn("rn", place)
        .filter(F.col("rn") == F.col("r"))
    )
    return hits.agg(
        F.struct(*[
            F.max(F.when(F.col("name") == name, F.col("key"))).alias(name) for name in ranks
        ]).alias("cuts")
    )


def split_exact(
    df: DataFrame, id_col: str = "id", seed: int = 42, group_col: str | None = None
) -> DataFrame:
    """Exact 80/10/10: ``t = ceil(n/5)`` rows held out, half of them (rounded up) test.

    With ``group_col`` the split is by group (all rows of one article stay together)
    and the sizes are exact in groups.
    """
    unit = F.col(group_col or id_col)
    keys = df.select(unit.alias("_u"))
    if group_col:
        keys = keys.distinct()
    keys = keys.select(seeded_key(F.col("_u"), seed).alias("key"))
    n = F.col("n")
    held = F.floor((n + 4) / 5)
    cuts = cut_keys(
        keys, {"train": n - held, "val": n - held + held - F.floor((held + 1) / 2)}
    ).scalar()
    key = seeded_key(unit, seed)
    return df.withColumn(
        "split",
        F.when(F.coalesce(key <= cuts["train"], F.lit(False)), "train")
        .when(F.coalesce(key <= cuts["val"], F.lit(False)), "val")
        .otherwise("test"),
    )


def split_threshold(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """About 80/10/10; a row keeps its split while the table grows, also on a stream."""
    u = F.conv(F.substring(seeded_hash(F.col(id_col), seed), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn(
        "split", F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test")
    )


def sample_exact(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``min(k, n)`` rows without replacement, the same for the same seed."""
    keys = df.select(seeded_key(F.col(id_col), seed).alias("key"))
    cut = cut_keys(keys, {"k": F.least(F.lit(k), F.col("n"))}).scalar()
    return df.filter(seeded_key(F.col(id_col), seed) <= cut["k"])


def first_rows(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest id. Only ids travel through the top-n."""
    ids = df.select(id_col).orderBy(id_col).limit(n)
    return df.join(small(ids, n, 32), id_col, "left_semi")


def two_level_rank(df: DataFrame, by: str, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Add ``rank`` (from 1, md5 order) inside each value of ``by``, a column of few
    values any of which may hold most rows: rank inside (value, bucket) plus the
    number of rows in the buckets before. Null is a value of its own; ids are unique
    and not null. Only ids and strata are ranked, the rank is joined back."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    hashed = df.select(F.col(id_col).alias("_id"), stratum.alias("_s")).withColumn(
        "_h", seeded_hash(F.col("_id"), seed)
    ).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy("_s").orderBy("_b")) - F.col("_c")
    offsets = counts.select("_s", "_b", before.alias("_before"))
    local = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", "_id"))
    ranks = hashed.withColumn("_rn", local).join(offsets, ["_s", "_b"]).select(
        F.col("_id").alias("_ranked"), (F.col("_rn") + F.col("_before")).alias("rank")
    )
    return df.join(ranks, F.col(id_col) == F.col("_ranked")).drop("_ranked")
