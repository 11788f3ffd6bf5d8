"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import stage


def _mins(edges: DataFrame) -> DataFrame:
    """For each node the smallest node among its neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    low = _mins(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) for every node of a link; the label is the component's smallest node.

    Null ends and loops are ignored. Each round is one staged table of at most as many links;
    hub nodes are joined with one row each, so a hub is split like any skewed join.
    """
    edges = stage(links.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).where("u <> v").distinct())
    before = _digest(edges)
    while before[0]:
        edges = stage(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
