"""Language identification by error-correcting output codes.

Every language has a codeword; each bit has a logistic classifier over hashed byte n-grams of the whole
text (two and three bytes of letters, square roots of their shares). The chosen language is the one
whose codeword has the least loss, each bit weighted by how well it did in training; where the second
is close, the text is flagged ambiguous. The code corrects bits that single classifiers get wrong.

Fitted on a sample of at most ``SAMPLE`` rows in all, equally many for each language, those with the
least hash of their id; everything else reads every row and whole texts. Null texts and texts
without a letter are `und` with score 0. Without a single labelled row all are `und`. Equal rows get
equal results. Nothing is shuffled but ids, and of those only the ones with the least hashes: how many rows a
language has in each of ``SLICES`` slices of the hash range is counted first. Very long texts are read whole; an
empty table gives no rows; ties between languages go to the first name; only the id, the text and (for
learning) the language are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.llm.common import LETTERS, frames, held_out, opened, share, type_of
from clozemill.operators.common import small

BITS = 11
SAMPLE = 6000
UNKNOWN = "und"
CLOSE = 0.10
SLICES = 1 << 16


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(texts, 2**bits) rows of unit length; zero where a text has no letters."""
    n, size = len(offsets) - 1, 1 << bits
    counts = np.zeros(n * size)
    code = LETTERS[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    for grams, seed in ((2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        m = len(code) - grams + 1
        if m < 1:
            continue
        value = np.full(m, seed, np.uint32)
        letters = np.zeros(m, bool)
        for j in range(grams):
            value = value * np.uint32(0x01000193) + code[j:j + m] * np.uint32(0x9E3779B1)
            letters |= code[j:j + m] != 0
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        keep = letters & (owner[:m] == owner[grams - 1:])
        cell = owner[:m][keep] * size + (value[keep] >> np.uint32(32 - bits))
        counts += np.bincount(cell, minlength=n * size)
    grid = counts.reshape(n, size)
    total = grid.sum(1, keepdims=True)
    return np.sqrt(grid / np.maximum(total, 1)).astype(np.float32)


def code_matrix(classes: int, seed: int = 1) -> np.ndarray:
    """(classes, bits) of -1 and 1: all splits for few classes, else the best of random codes."""
    if classes <= 5:
        n = max((1 << (classes - 1)) - 1, 1)
        rows = [[1] * n] + [[1 if (b >> (c - 1)) & 1 else -1 for b in range(n)] for c in range(1, classes)]
        return np.array(rows, np.float32)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(classes)))
    best, far = None, -1.0
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (classes, length))
        apart = (length - m @ m.T)[~np.eye(classes, dtype=bool)].min()
        if apart > far and (np.abs(m.sum(0)) < classes).all():
            best, far = m, apart
    return best


class Coder:
    """Fitted bit classifiers and the languages they tell apart."""

    def __init__(self, x: np.ndarray, labels: list[str], rounds: int = 150, penalty: float = 1e-5):
        self.names = sorted(set(labels))
        y = np.searchsorted(self.names, labels)
        self.code = code_matrix(len(self.names))
        target = self.code[y]
        share = np.bincount(y, minlength=len(self.names))
        weight = (1.0 / (share[y] * len(self.names)))[:, None].astype(np.float32)
        bits = target.shape[1]
        self.w = np.zeros((x.shape[1], bits), np.float32)
        self.b = np.zeros(bits, np.float32)
        ahead, ahead_b, old, old_b = self.w.copy(), self.b.copy(), self.w, self.b
        rate = 7.0  # rows have unit length, so the curvature is at most 1/2
        for step in range(rounds):
            margin = target * (x @ ahead + ahead_b)
            pull = target * weight / (1 + np.exp(np.minimum(margin, 50)))
            new = ahead + rate * (x.T @ pull - penalty * ahead)
            new_b = ahead_b + rate * 0.25 * pull.sum(0)
            speed = step / (step + 3)
            ahead, ahead_b = new + speed * (new - old), new_b + speed * (new_b - old_b)
            old, old_b = new, new_b
        self.w, self.b = old, old_b
        wrong = ((target * (x @ self.w + self.b) <= 0) * weight).sum(0)
        wrong = np.clip(wrong, 1e-3, 0.5)
        self.bit_weight = np.log((1 - wrong) / wrong) + 1e-3

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages): weighted mean logistic loss against each codeword."""
        f = x @ self.w + self.b
        loss = np.stack([np.logaddexp(0, -f), np.logaddexp(0, f)])
        share = self.bit_weight / self.bit_weight.sum()
        return np.stack([(np.where(row > 0, loss[0], loss[1]) * share).sum(1) for row in self.code], 1)

    def predict(self, x: np.ndarray):
        """Number of the language, score, and whether the second is close."""
        loss = self.losses(x)
        best = loss.argmin(1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        score = 1 / odds.sum(1)
        if loss.shape[1] == 1:
            return best, score, np.zeros(len(x), bool)
        order = np.sort(loss, 1)
        return best, score, order[:, 1] - order[:, 0] < CLOSE


def fit(docs: DataFrame, lang: str = "lang", id_column: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> Coder | None:
    """Train on rows of ``docs`` with a language; the caller leaves out what is held out."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_column).isNotNull())
    classes = known.select(lang).distinct().count()
    if not classes:
        return None
    each = max(1, sample // classes)
    chosen = least_hashes(known.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang")), each, classes)
    # At most ``sample`` ids, so the broadcast is bounded.
    rows = known.select(id_column, text).join(
        F.broadcast(chosen), F.col(id_column) == F.col("_id")).select("_id", "_lang", text)

    def work(batches):
        for rows_, data, offsets in frames(batches, text, rows=256):
            x = features(data, offsets).astype(np.float16)
            full = x.any(1)
            names = rows_.column(1).filter(pa.array(full))
            yield pa.record_batch({"id": rows_.column(0).filter(pa.array(full)), "lang": names,
                                   "x": pa.array([r.tobytes() for r in x[full]], pa.binary())})

    found = rows.mapInArrow(work, f"id {type_of(docs, id_column)}, lang string, x binary").orderBy(
        "id", "lang").toArrow()
    if not found.num_rows:
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in found.column("x")])
    return Coder(x.astype(np.float32), found.column("lang").to_pylist())


def least_hashes(rows: DataFrame, each: int, classes: int) -> DataFrame:
    """The ``each`` rows of every language with the least hashes of their ids.

    Slices are counted on the map side; only rows of the slices up to the one that fills a language are
    sorted, so a language that holds most rows is no larger a group than any other."""
    named = rows.withColumn("_h", F.xxhash64(F.col("_id").cast("string"))).withColumn(
        "_slice", F.shiftright("_h", 64 - int(SLICES).bit_length() + 1))
    before = W.partitionBy("_lang").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = named.groupBy("_lang", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    last = counts.withColumn("_had", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(
        F.col("_had") < each).groupBy("_lang").agg(F.max("_slice").alias("_last"))
    # A row a language.
    near = named.join(small(last, classes), "_lang").where(F.col("_slice") <= F.col("_last"))
    order = W.partitionBy("_lang").orderBy("_h", "_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("_id", "_lang")


def identify(docs: DataFrame, coder: Coder | None, id_column: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row."""
    shared = share(docs.sparkSession, coder)

    def work(batches):
        model = opened(shared)
        for rows, data, offsets in frames(batches, text, rows=512):
            n = len(offsets) - 1
            best, score, close = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            texts = rows.column(rows.schema.get_field_index(text)).cast(pa.string())
            has = pc.match_substring_regex(texts, r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
            if model is not None and has.any():
                best, score, close = model.predict(features(data, offsets))
            else:
                has = np.zeros(n, bool)
            names = [model.names[b] if h else UNKNOWN for b, h in zip(best, has)]
            yield pa.record_batch({
                id_column: rows.column(rows.schema.get_field_index(id_column)),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(np.where(has, score, 0.0).astype(np.float64)),
                "ambiguous": pa.array(close & has)})

    return docs.select(id_column, text).mapInArrow(
        work, f"{id_column} {type_of(docs, id_column)}, lang_pred string, score double, ambiguous boolean")


def query(docs: DataFrame) -> DataFrame:
    coder = fit(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, coder).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
