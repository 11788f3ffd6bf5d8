r"""Periodic runs of words, found in tiles and stitched, and texts with the repeats taken out.

Words are `[^\x20\x09-\x0D]+`, numbered from 0. A run is a stretch of words in which words q apart are equal,
q being its smallest period, of at least ``max(LEAST, 3 * q)`` words, that cannot be made longer. A word is
dropped where a run holds it behind the run's first q words.

A document is exploded into overlapping tiles for each octave of periods (1, 2-3, 4-7, ...): tiles of an octave
overlap by six times its lowest period, so each has a whole run or at least three periods of it. A tile
is solved on its own: at boundaries one window apart, the window's hash is looked for one period further on,
and the Z values of the boundary (how far both copies agree to the right and to the left, inside the tile) give
the tile's piece of the run. Pieces go by document and period to where windows join those that
overlap by a period or more. Range hashes only propose: every piece is compared word by word (words stand for
their 64-bit hashes).

A text is held whole by its task; tiles bound what is worked on at once. Only texts in which a piece was found
are written and shuffled, with their pieces; all others are finished in the first pass. A run of one period
over the longest text gives one piece for each tile, so no group outgrows its document.

Null and empty texts have no words, no runs and collapse to the empty string. Rows with the same id, null
ids included, are kept apart and each gets its own result; equal rows get equal results. Ties for the
strongest run go to the smallest start, then the smallest period. Very long texts are read whole. An empty table gives
no rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.llm.common import INVERSE, SPACED, frames, powers, prefix_hashes, stage, type_of, words

LEAST = 24
STEP = 4096

PIECES = "array<struct<period:int,start:int,end:int>>"
FOUND = pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


# --- one tile ------------------------------------------------------------------------------

def octaves(n: int, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Lowest and highest period of each octave that a text of n words can have."""
    low = 1
    while 3 * low <= n and n >= least:
        yield low, min(2 * low - 1, n // 3)
        low *= 2


def tiles(n: int, low: int, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Word ranges that overlap by six times the lowest period (by ``2 * LEAST`` at least)."""
    overlap = max(6 * low, 2 * LEAST)
    stride = max(step, overlap)
    at = 0
    while True:
        end = min(at + stride + overlap, n)
        yield at, end
        if end == n:
            return
        at += stride


class Hashes:
    """Prefix sums of a text's words, to hash any range of them."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.sums = prefix_hashes(values)
        self.scale = powers(INVERSE, self.n + 1)

    def of(self, start, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.scale[start]


def z_values(hashes: Hashes, at: np.ndarray, other: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from two places on (or before them) agree, at most ``room``; halving steps."""
    good, bad = np.zeros(len(at), np.int64), room.astype(np.int64) + 1
    while True:
        open_ = np.flatnonzero(bad - good > 1)
        if not len(open_):
            return good
        middle = (good[open_] + bad[open_]) // 2
        a, b = at[open_], other[open_]
        if back:
            a, b = a - middle, b - middle
        same = hashes.of(a, middle) == hashes.of(b, middle)
        good[open_[same]] = middle[same]
        bad[open_[~same]] = middle[~same]


def smallest_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n ** 0.5) + 1):
        if out[p] == p:
            own = out[p * p::p]
            own[own == np.arange(p * p, n + 1, p)] = p
    return out


def primitive(hashes: Hashes, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False where a proper divisor of the period is a period too."""
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    factor = smallest_factors(int(period.max()))
    rest = period.copy()
    while (rest > 1).any():
        prime = np.maximum(factor[rest], 1)
        part = period // prime
        size = end - start - part
        out &= ~((prime > 1) & (hashes.of(start, size) == hashes.of(start + part, size)))
        rest = rest // prime
    return out


def solve(values: np.ndarray, hashes: Hashes, lo: int, hi: int, low: int, high: int,
          least: int = LEAST) -> list[tuple[int, int, int]]:
    """(period, start, end) of a tile's pieces with a primitive period between low and high."""
    if hi - lo < max(least, 3 * low):
        return []
    # Agreeing stretches have least - q or 2 * q words at least, so they hold a whole aligned window.
    size = max(low, (least + 1) // 3)
    bounds = np.arange(lo, hi - size - low + 1, size)
    if not len(bounds):
        return []
    own = hashes.of(bounds, size)
    every = hashes.of(np.arange(lo, hi - size + 1), size)
    at, period = [], []
    block = max(64, (1 << 18) // len(bounds))
    for first in range(low, high + 1, block):
        q = np.arange(first, min(first + block, high + 1))
        place = bounds[:, None] - lo + q
        hit = (place < len(every)) & (every[np.minimum(place, len(every) - 1)] == own[:, None])
        row, column = np.nonzero(hit)
        at.append(bounds[row])
        period.append(q[column])
    at, period = np.concatenate(at), np.concatenate(period)
    if not len(at):
        return []
    right = z_values(hashes, at, at + period, hi - at - period, False)
    left = z_values(hashes, at, at + period, at - lo, True)
    start, end = at - left, at + period + right
    long = end - start >= np.maximum(least, 3 * period)
    found = np.unique(np.stack([period[long], start[long], end[long]], 1), axis=0)
    found = found[primitive(hashes, found[:, 1], found[:, 2], found[:, 0])]
    return [(int(q), int(s), int(e)) for q, s, e in found
            if np.array_equal(values[s:e - q], values[s + q:e])]


def pieces(values: np.ndarray, least: int = LEAST, step: int = STEP) -> list[tuple[int, int, int]]:
    """All tiles of a text, one after the other: (period, start, end), clipped to their tiles."""
    n = len(values)
    if n < least:
        return []
    hashes = Hashes(values)
    return [piece for low, high in octaves(n, least) for lo, hi in tiles(n, low, step)
            for piece in solve(values, hashes, lo, hi, low, high, least)]


# --- the table -----------------------------------------------------------------------------

def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words at these byte ranges with one space between them."""
    if not len(start):
        return b""
    size = end - start + 1
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
    out = data[np.minimum(place, len(data) - 1)]
    out[ends - 1] = 0x20
    return out[:-1].tobytes()


def solved(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST,
           step: int = STEP) -> DataFrame:
    """One row a document: number of words, pieces of runs, and its words where it has pieces.

    Without pieces it has the hash of its words instead.
    """
    kind = type_of(docs, id_column)

    def work(batches):
        for rows, data, offsets in frames(batches, "text"):
            value, doc, start, end = words(data, offsets, SPACED)
            edge = np.searchsorted(doc, np.arange(len(offsets)))
            found, own, sha = [], [], []
            for a, b in zip(edge[:-1], edge[1:]):
                part = pieces(value[a:b], least, step)
                body = joined(data, start[a:b], end[a:b])
                found.append([{"period": q, "start": s, "end": e} for q, s, e in part])
                own.append(body if part else None)
                sha.append(None if part else hashlib.sha256(body).hexdigest())
            yield pa.record_batch({
                "row": rows.column(rows.schema.get_field_index("row")),
                "id": rows.column(rows.schema.get_field_index("id")),
                "n": pa.array(np.diff(edge)), "pieces": pa.array(found, FOUND),
                "body": pa.array(own, pa.binary()), "sha": pa.array(sha, pa.string())})

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                        F.col(text).alias("text"))
    return named.mapInArrow(
        work, f"row long, id {kind}, n long, pieces {PIECES}, body binary, sha string")


def stitched(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, runs): pieces of one document and period that overlap by a period are one run."""
    each = found.select("row", F.inline("pieces"))
    before = W.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    marked = each.withColumn("new", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(before)).groupBy("row", "period", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    size = F.col("end") - F.col("start")
    whole = runs.where(size >= F.greatest(F.lit(least), 3 * F.col("period")))
    return whole.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "period", "end"))).alias("runs"))


def strongest(runs: list[dict]) -> tuple[int, int, int]:
    """Start, length and period of the run with the greatest length / period, compared exactly."""
    best = None
    for r in runs:
        size, q = r["end"] - r["start"], r["period"]
        if best is None or size * best[2] > best[1] * q:
            best = (r["start"], size, q)
    return best


def collapsed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST,
              step: int = STEP, keep_text: bool = False) -> DataFrame:
    """(id, n_words, runs, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for
    every row, and ``collapsed`` (null where nothing was dropped) with ``keep_text``."""
    kind = type_of(docs, id_column)
    table = stage(solved(docs, id_column, text, least, step))
    within = table.where(F.size("pieces") > 0).join(stitched(table, least), "row", "left").select(
        "id", "n", "body", F.coalesce("runs", F.array().cast(
            "array<struct<start:int,period:int,end:int>>")).alias("runs"))

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("start", "length", "period", "milli", "runs_sha", "sha", "kept")}
            for body, runs in zip(batch.column("body"), batch.column("runs").to_pylist()):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                _, _, start, end = words(data, np.array([0, len(data)]), SPACED)
                edge = np.zeros(len(start) + 1, np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["end"]] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                left = joined(data, start[stays], end[stays])
                lines = "".join(f"{r['start']},{r['end'] - r['start']},{r['period']}\n" for r in runs)
                best = strongest(runs) or (None, None, None)
                for k, v in zip(("start", "length", "period"), best):
                    out[k].append(v)
                out["milli"].append(1000 * best[1] // best[2] if runs else None)
                out["runs_sha"].append(hashlib.sha256(lines.encode()).hexdigest())
                out["sha"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left.decode() if keep_text and runs else None)
            yield pa.record_batch({
                "id": batch.column("id"), "n": batch.column("n"), "runs": batch.column("runs"),
                **{k: pa.array(out[k], pa.int64()) for k in ("start", "length", "period", "milli")},
                **{k: pa.array(out[k], pa.string()) for k in ("runs_sha", "sha", "kept")}})

    shape = ("array<struct<start:int,period:int,end:int>>", "start long, length long, period long, "
             "milli long, runs_sha string, sha string, kept string")
    some = within.mapInArrow(work, f"id {kind}, n long, runs {shape[0]}, {shape[1]}")
    none = table.where(F.size("pieces") == 0).select(
        "id", "n", F.array().cast(shape[0]).alias("runs"),
        *[F.lit(None).cast("long").alias(k) for k in ("start", "length", "period", "milli")],
        F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha"), "sha",
        F.lit(None).cast("string").alias("kept"))
    rows = some.unionByName(none).select(
        F.col("id").alias(id_column), F.col("n").alias("n_words"), "runs",
        F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.col("milli").alias("exponent_milli"), F.col("runs_sha").alias("runs_sha256"),
        F.col("sha").alias("collapsed_sha256"), F.col("kept").alias("collapsed"))
    return rows if keep_text else rows.drop("collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: of every tenth id (by checksum) the words repeat from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n < 1, F.lit("")).otherwise(F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " "))

    found = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return F.when(h % 10 == 0, F.transform(F.array(found), looped)[0]).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return collapsed(texts).drop("n_words", "runs")
