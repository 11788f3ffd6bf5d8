"""Quality scores by Bradley-Terry pairwise ranking, cut at a quantile of the scores.

A pair says that one document is better than another: a labelled good one beside a labelled bad one. The chance
that a beats b is the logistic function of score(a) - score(b), with score(x) = w . features(x); w
minimises the logistic loss over feature differences and an L2 penalty. Features are square roots of the
shares of character-class trigrams (capitals, small letters, digits, single kinds of marks and white space) of
the whole text, and five measures of its words.

Fitted on at most ``SAMPLE`` labelled rows, half of them of each label if there are so many, those with the least
hash of their id, each good one in ``RIVALS`` pairs. All documents are scored; the cut is one of the
``LEVELS`` quantiles of the scores of all documents, the one that parts all learning rows best (good and bad rows
weigh the same; ties go to the lowest, which keeps most). Scores are mapped to 0 to 1 with the cut at
``THRESHOLD``.

Null and empty texts have no features (raw score 0). Without rows of both labels all scores are 0.5. A null id is
scored and not learnt from; its held_out is null. Repeated ids are scored row by row; equal rows get equal
results. Long texts are read whole, one at a time if need be. An empty table gives no rows. Only id and text are
read, so other columns may have any name. Shuffled are ids, labels and scores, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import SPACED, frames, held_out, stage, type_of, words

SAMPLE = 4_000
RIVALS = 4
LEVELS = 1_000
PENALTY = 1e-4
THRESHOLD = 0.7
SLOPE = 2.0
#: Raw scores are counted in steps of 1 / FINE, and beyond -LIMIT and LIMIT together.
FINE, LIMIT = 256, 64


def character_classes() -> np.ndarray:
    """A number for each byte: kinds of letters, digits and white space, and marks by kind."""
    out = np.full(256, 13, np.int64)
    for number, own in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ",
                                  b"\n", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0)), b".", b",", b"!", b"|",
                                  b"#*$%&<>")):
        out[list(own)] = number
    return out


CLASSES = character_classes()
KINDS = 14
MEASURES = 5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, KINDS ** 3 + MEASURES); zero where a text has no characters."""
    n, size = len(offsets) - 1, KINDS ** 3
    grid = np.zeros(n * size)
    kind = CLASSES[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) > 2:
        whole = owner[:-2] == owner[2:]
        cell = owner[:-2] * size + (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
        grid += np.bincount(cell[whole], minlength=n * size)
    grid = grid.reshape(n, size)
    shares = np.sqrt(grid / np.maximum(grid.sum(1, keepdims=True), 1))

    value, doc, start, end = words(data, offsets, SPACED)
    count = np.bincount(doc, minlength=n)
    whole = np.maximum(count, 1)
    twice = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((value, doc))
    again = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    known = count > 0
    measures = np.stack([
        np.log1p(count) / 5,
        np.minimum(count, 20) / 20,
        3 * np.bincount(doc[1:][twice], minlength=n) / whole,
        np.where(known, 1 - np.bincount(doc[order][1:][again], minlength=n) / whole, 0),
        np.bincount(doc, end - start, n) / whole / 10], 1)
    return np.concatenate([shares, measures], 1).astype(np.float32)


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY,
                  rounds: int = 400) -> np.ndarray:
    """Weights that minimise the mean logistic loss of score differences of the pairs."""
    n = len(better)
    gaps = sum(((x[better[at:at + 256]] - x[worse[at:at + 256]]) ** 2).sum() for at in range(0, n, 256)) / n
    rate = 1 / (0.25 * gaps + penalty)
    old = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        score = x @ ahead
        pull = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -40, 40))) / n
        side = (np.bincount(better, pull, len(x)) - np.bincount(worse, pull, len(x))).astype(x.dtype)
        new = ahead + rate * (x.T @ side - penalty * ahead)
        ahead, old = new + k / (k + 3) * (new - old), new
    return old


def preferences(good: np.ndarray, bad: np.ndarray, rivals: int = RIVALS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (better, worse): every row of the larger side in ``rivals`` pairs, rivals evenly in turn."""
    rng = np.random.default_rng(13)
    more, fewer = (good, bad) if len(good) >= len(bad) else (bad, good)
    mine = np.tile(more, rivals)
    other = np.concatenate([rng.permutation(fewer) for _ in range(-(-len(mine) // len(fewer)))])[:len(mine)]
    return (mine, other) if more is good else (other, mine)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from labelled rows; the caller leaves out what is held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    chosen = None
    for y in (0, 1):
        own = known.where(F.col("_y") == y).orderBy(
            F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most ``sample`` labels, so the broadcast is bounded.
    rows = docs.select(F.col(id_column).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_id", "_y", "_text")

    def work(batches):
        for rows_, data, offsets in frames(batches, "_text", rows=256):
            yield pa.record_batch({
                "id": rows_.column(0), "y": rows_.column(1),
                "x": pa.array([v.tobytes() for v in features(data, offsets).astype(np.float16)], pa.binary())})

    found = rows.mapInArrow(work, f"id {type_of(docs, id_column)}, y int, x binary").orderBy(
        "id", "y", "x").limit(sample).toArrow()
    y = found.column("y").to_numpy()
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in found.column("x")]).astype(np.float32)
    return bradley_terry(x, *preferences(good, bad))


def raw_scores(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, raw) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        for rows, data, offsets in frames(batches, "_text", rows=256):
            yield pa.record_batch({"_id": rows.column(0),
                                   "raw": pa.array((features(data, offsets) @ shared.value).astype(np.float64))})

    return docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        work, f"_id {type_of(docs, id_column)}, raw double")


def cut_at_quantile(scores: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality",
                    levels: int = LEVELS) -> tuple[float, float]:
    """(level, raw score): the quantile of all scores that parts the labelled rows best."""
    known = labels.where(F.col(label).isin(0, 1)).select(
        F.col(id_column).alias("_lid"), F.col(label).cast("int").alias("_y")).distinct()
    step = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("raw"))) * FINE).cast("int")
    counted = scores.join(known, F.col("_id") == F.col("_lid"), "left").groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") == 1).alias("good"),
        F.count_if(F.col("_y") == 0).alias("bad"))
    # At most 2 * LIMIT * FINE rows.
    table = np.array([tuple(r) for r in counted.orderBy("step").collect()], np.float64).reshape(-1, 4)
    under = np.concatenate([[0], np.cumsum(table[:, 1])])
    places = np.unique(np.searchsorted(under, np.linspace(0, 1, levels + 1) * under[-1], "right") - 1)
    places = places[places < len(table)]
    good = table[:, 2][::-1].cumsum()[::-1]
    bad = np.concatenate([[0], table[:, 3].cumsum()])[:-1]
    parted = good / max(table[:, 2].sum(), 1) + bad / max(table[:, 3].sum(), 1)
    best = places[np.argmax(parted[places])]
    return float(under[best] / under[-1]), float(table[best, 0] / FINE)


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
           label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(id, score) for every row; ``labels`` are the rows to learn from."""
    weights = fit(docs, labels, id_column, text, label, sample)
    if weights is None:
        return docs.select(id_column, F.lit(0.5).alias("score"))
    raw = stage(raw_scores(docs, weights, id_column, text))
    _, cut = cut_at_quantile(raw, labels, id_column, label)
    up = F.lit(float(np.log(threshold / (1 - threshold))))
    return raw.select(F.col("_id").alias(id_column), (
        1 / (1 + F.exp(-(SLOPE * (F.col("raw") - cut) + up)))).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels.where(~held_out("doc_id", 4, 2))).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
