"""Small building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 128 << 20


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add costly columns that must be computed one time per row.

    Catalyst copies a plain alias into every later filter and projection that uses
    it; a one-element generator is a boundary it does not look through.
    """
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    return df.select("*", packed.alias("_once")).select(
        *[F.col(f"`{c}`") for c in df.columns], "_once.*"
    )


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by key once; the groupings and windows on the key that
    follow find their rows in place and add no exchange. The session's shuffle
    partitions and adaptive execution set the number of partitions, at every size."""
    return df.repartition(*[F.col(k) for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """Even out rows in front of costly row work, by one exchange at every size: adaptive
    execution joins small partitions and splits large ones, however the files were cut."""
    return df.hint("rebalance")


def small(df: DataFrame, rows: int, row_bytes: int = 64, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast a side whose row count has a known bound, if the bound fits the limit;
    beyond it Spark picks the join by itself."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
