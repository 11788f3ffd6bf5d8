"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

The rows of each source stand in a seeded md5 order and form blocks. With integer weights a and their
sum Q, block k of a source is released at slot floor(k Q / a) and due by slot ceil((k + 1) Q / a); each
slot goes to the released block with the earliest deadline. All deadlines are met, so before any slot
each source has had less than one block more or less than its weight asks for. The schedule repeats
after Q slots, so it is worked out once for Q slots and every row finds its slot from its block number.

Sources of one weight have the same releases and deadlines, so the earliest deadline is looked for among the
distinct weights only, and sources of a weight take their turns in name order: Q steps of as many
comparisons as there are distinct weights, for any number of sources. Ties go to the greater weight. Slots of a
source that has run out stay empty; ``position`` counts rows without those gaps: rows of the blocks are summed over
ranges of slots, then inside each range. Every row is placed exactly once and none is dropped or repeated.

Documents are dealt by source and md5 bucket, at most about ``BUCKET_ROWS`` rows each, so a hot source is spread
like any other, and what a bucket needs of the schedule comes to it as one row. Names, weights and the slots of
one period are a table of a row a source; it is broadcast only if its counted size allows.

A null source is a source of its own. Null ids stand first in their bucket; repeated rows each get a
place. Texts are moved and never read. An empty table gives an empty result. Columns of the documents keep their
names and values; of the added ones those are left out whose names are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clozemill.llm.common import stage
from clozemill.operators.common import small

#: Target weights by source; a source that is not listed has the default weight.
TARGETS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
DEFAULT_WEIGHT = 1
BLOCK = 64
BUCKET_ROWS = 4096
RANGE_SLOTS = 65_536
SEED = 17


def weight_of(source, weights: dict[str, int] = TARGETS, default: int = DEFAULT_WEIGHT):
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(source == name, weight).otherwise(out)
    return out.cast("long")


def supply(docs: DataFrame, source: str, weights=TARGETS, default: int = DEFAULT_WEIGHT) -> DataFrame:
    """(source, n, w) for every source."""
    counted = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("w", weight_of(F.col("source"), weights, default))


def class_schedule(sources: DataFrame) -> DataFrame:
    """(w, q, slot, k, j): in each slot of a period, the weight that is served, the block and the source's turn."""
    classes = sources.groupBy("w").agg(F.count(F.lit(1)).alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("w", "m")), asc=False).alias("c")).selectExpr(
        "transform(c, x -> x.w) AS w", "transform(c, x -> x.m) AS m",
        "aggregate(c, 0L, (a, x) -> a + x.w * x.m) AS q").where("q > 0")
    # The period is walked in stretches, so that no long array is copied at every slot.
    served = classes.selectExpr("*", """
        aggregate(
          sequence(0L, (q - 1) div 1024),
          named_struct('next', transform(w, x -> 0L), 'out', cast(array() AS array<array<int>>)),
          (acc, part) -> transform(
            array(aggregate(
              sequence(part * 1024, least(q, part * 1024 + 1024) - 1),
              named_struct('next', acc.next, 'out', cast(array() AS array<int>)),
              (own, t) -> transform(
                array(array_min(filter(
                  transform(own.next, (x, i) -> if(x < m[i] * w[i] AND ((x div m[i]) * q) div w[i] <= t,
                    named_struct('due', ((x div m[i] + 1) * q + w[i] - 1) div w[i], 'i', i), NULL)),
                  x -> x IS NOT NULL)).i),
                c -> named_struct('next', transform(own.next, (x, i) -> if(i = c, x + 1, x)),
                                  'out', concat(own.out, array(c))))[0])),
            one -> named_struct('next', one.next, 'out', concat(acc.out, array(one.out))))[0]).out AS out""")
    slots = served.select("w", "m", "q", F.posexplode(F.flatten("out")).alias("slot", "c")).selectExpr(
        "w[c] AS w", "m[c] AS m", "q", "CAST(slot AS bigint) AS slot")
    turn = F.row_number().over(W.partitionBy("w").orderBy("slot")) - 1
    return slots.withColumn("_x", turn).selectExpr("w", "q", "slot", "_x div m AS k", "_x % m AS j")


def schedule(sources: DataFrame) -> DataFrame:
    """(source, w, q, slots): for each source the slots of its blocks in one period, in order."""
    turn = F.row_number().over(W.partitionBy("w").orderBy("source")) - 1
    numbered = sources.select("source", "w", turn.cast("long").alias("j"))
    return numbered.join(class_schedule(sources), ["w", "j"]).groupBy(named("source").alias("_key"), "w", "q").agg(
        F.expr("transform(sort_array(collect_list(struct(k, slot))), x -> x.slot)").alias("slots"))


def rows_before(pieces: DataFrame) -> DataFrame:
    """The pieces (slot, rows, ...) with ``before``: the rows of all earlier slots, range by range."""
    ranged = pieces.withColumn("_range", F.expr(f"slot div {RANGE_SLOTS}"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("rows").alias("_sum")).withColumn(
        "_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = W.partitionBy("_range").orderBy("slot").rangeBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(totals, "_range").withColumn(
        "before", F.col("_base") + F.col("_in")).drop("_base", "_in", "_range")


def mixed_rows(docs: DataFrame, source: str = "source", key: str = "doc_id", weights=TARGETS,
               default: int = DEFAULT_WEIGHT, block: int = BLOCK,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``_row`` (the document) with block, slot, release, deadline and position."""
    if min([default, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1 on")
    sources = stage(supply(docs, source, weights, default))
    n, slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    order = F.md5(F.concat(F.coalesce(F.col(f"_row.{key}").cast("string"), F.lit("")), F.lit(f":{SEED}")))
    dealt = sources.select(named("source").alias("_key"), F.ceil(F.col("n") / bucket_rows).alias("_b"))
    rows = rows.select("_row", named(f"_row.{source}").alias("_key"), order.alias("_h")).join(
        small(dealt, n, 128), "_key"
    ).withColumn("_bucket", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_b")).drop("_b")

    # The window and the join stand on one partitioning: a document moves once.
    own = W.partitionBy("_key", "_bucket").orderBy("_h", f"_row.{key}")
    ranked = rows.withColumn("_n", F.row_number().over(own))

    before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    period = small(schedule(sources), n, 128 + 8 * slots // max(n, 1))
    pieces = buckets.join(period, "_key").selectExpr(
        "*", f"explode(sequence(_before div {block}, (_before + _c - 1) div {block})) AS block").selectExpr(
        "_key", "_bucket", "_before", "w", "q", "block", "(block div w) * q + slots[CAST(block % w AS int)] AS slot",
        f"least(_before + _c, (block + 1) * {block}) - greatest(_before, block * {block}) AS rows")
    plan = rows_before(pieces).groupBy("_key", "_bucket").agg(
        F.first("_before").alias("_before"), F.first("w").alias("w"), F.first("q").alias("q"),
        F.sort_array(F.collect_list(F.struct("block", "slot", "before"))).alias("_plan"))
    placed = ranked.join(plan, ["_key", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1).selectExpr(
        "*", f"_plan[CAST(_rank div {block} - _plan[0].block AS int)] AS _p")
    return placed.selectExpr(
        "_row", "_p.block AS block", "_p.slot AS slot",
        "(_p.block div w) * q + ((_p.block % w) * q) div w AS release",
        "(_p.block div w) * q + ((_p.block % w + 1) * q + w - 1) div w AS deadline",
        f"_p.before + _rank % {block} AS position")


def named(source: str):
    """A source's name as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def query(docs: DataFrame) -> DataFrame:
    return mixed_rows(docs.select("doc_id", "source")).select(
        "_row.doc_id", "_row.source", "block", "slot", "release", "deadline", "position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns, with their block, slot and position in the mix."""
    placed = mixed_rows(docs)
    added = [("mix_block", "block"), ("mix_slot", "slot"), ("mix_position", "position")]
    return placed.select("_row.*", *[F.col(b).alias(a) for a, b in added if a not in docs.columns])
