"""Toxicity: a sparse logistic classifier, regularised by counterfactuals.

Features are the words of the whole text (letters only, A-Z lowered) and their beginnings of 2 to 8 bytes,
since languages with compounds spell one insult in many words; each is present or absent, and hashed.
Features whose share among toxic texts is what chance gives (z under a screen) are left out; which of ``SCREENS`` is
used is chosen by ``FOLDS`` folds inside the learning rows. Training
minimises the logistic loss, an L1 penalty, and for every training text that names a group the squared
change of its score when the term is swapped for another of its kind. So the mention of a group as such
moves a score as little as any other mention would, and cannot carry the label of the company it kept.

Fitted on at most ``SAMPLE`` labelled rows, those with the least hash of their id; every row is scored on
its whole text. Null and empty texts get the score of a text without any known word. Without labels all
scores are 0. Equal rows get equal results; nothing is shuffled but labels. Very long texts are read whole, an empty
table gives no rows, and only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import (
    INVERSE, LETTERS, frames, held_out, mixed, opened, powers, prefix_hashes, share, stage, type_of, words,
)

BITS = 20
SAMPLE = 8_000
MIN_TEXTS = 6
SCREENS = (3.0, 4.0, 5.0)
FOLDS = 3
BEGINNINGS = range(2, 9)
L1 = 1.5e-4
L2 = 1e-5
FLOOR = 0.3
SWAP = 1.0
THRESHOLD = 0.7

# Terms for groups of people, by kind; terms of one kind are swapped for each other.
GROUPS = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary",
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist atheist",
    "origin": "african american asian european arab mexican chinese indian german french spanish",
    "colour": "black white brown latino latina",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "age": "old young elderly teenager teenagers",
    "health": "blind deaf disabled autistic paralyzed",
}


def hashed(terms: str) -> np.ndarray:
    """Feature number of each word of a line of words."""
    data = np.frombuffer(terms.encode(), np.uint8)
    value, _, _, _ = words(data, np.array([0, len(data)]), LETTERS)
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def group_words() -> np.ndarray:
    """Sorted word hashes of all group terms."""
    data = np.frombuffer(" ".join(GROUPS.values()).encode(), np.uint8)
    return np.sort(words(data, np.array([0, len(data)]), LETTERS)[0])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and beginnings of a piece, and the text of each.

    A group term has no beginnings, so that its swap changes all it brings to a score.
    """
    value, owner, start, end = words(data, offsets, LETTERS)
    known = group_words()
    own = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] != value
    values, owners = [value], [owner]
    sums = prefix_hashes(LETTERS[data])
    inverse = powers(INVERSE, len(data) + 1)
    for k in BEGINNINGS:
        longer = (end - start > k) & own
        s = start[longer]
        values.append(mixed((sums[s + k] - sums[s]) * inverse[s] + np.uint64(k << 32)))
        owners.append(owner[longer])
    number = (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int64)
    return number, np.concatenate(owners)


class Scorer:
    """Fitted weights by feature."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, groups=GROUPS, swap: float = SWAP,
                 l1: float = L1, min_texts: int = MIN_TEXTS, rounds: int = 300, screen: float = SCREENS[0]):
        n = len(texts)
        row = np.repeat(np.arange(n), [len(t) for t in texts])
        feature = np.concatenate(texts) if n else np.empty(0, np.int64)
        seen, column, count = np.unique(feature, return_inverse=True, return_counts=True)
        pairs = self._pairs(texts, groups)
        ends = np.unique(np.array([p[:2] for p in pairs], np.int64)) if pairs else np.empty(0, np.int64)
        share = labels.mean() if n else 0.0
        toxic = np.bincount(column, labels[row].astype(float), len(seen))
        z = (toxic - count * share) / np.sqrt(np.maximum(count * share * (1 - share), 1e-9))
        keep = ((count >= min_texts) & (np.abs(z) >= screen)) | np.isin(seen, ends)
        self.features = np.union1d(seen[keep], ends)
        number = np.searchsorted(self.features, seen)
        live = keep[column]
        row, column = row[live], number[column[live]]
        size = len(self.features)
        y = labels.astype(np.float64)
        rate = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
        self.bias = float(np.log(rate / (1 - rate)))
        self.w = np.zeros(size)
        if not size or not 0 < y.sum() < n:
            return
        a = np.searchsorted(self.features, [p[0] for p in pairs]).astype(np.int64)
        b = np.searchsorted(self.features, [p[1] for p in pairs]).astype(np.int64)
        c = np.array([p[2] for p in pairs]) * (2 * swap / n)
        old, old_bias = self._descend(row, column, y, a, b, c, size, rounds, l1, 0.0)
        # L1 chooses the words and shrinks them; the chosen ones are fitted again without it.
        strong = np.abs(old) > FLOOR
        if strong.any():
            number = np.cumsum(strong) - 1
            live = strong[column]
            both = strong[a] & strong[b] if len(pairs) else np.empty(0, bool)
            lone = c * 0 if not len(pairs) else c * (strong[a] ^ strong[b])
            grip = np.bincount(a, lone, size) + np.bincount(b, lone, size) if len(pairs) else np.zeros(size)
            old, old_bias = self._descend(
                row[live], number[column[live]], y, number[a[both]], number[b[both]], c[both],
                int(strong.sum()), rounds, 0.0, L2, grip[strong])
            self.features = self.features[strong]
        self.w, self.bias = old, old_bias

    def _descend(self, row, column, y, a, b, c, size, rounds, l1, l2, grip=0.0):
        """Accelerated proximal descent; each weight's step comes from a bound of its curvature.

        c holds the weights of the swaps a, b; ``grip`` those of swaps whose other term has weight 0.
        """
        n = len(y)
        width = np.bincount(row, minlength=n)
        bound = 0.25 * np.bincount(column, width[row] + 1.0, size) / n + l2 + grip
        if len(a):
            bound += 2 * (np.bincount(a, c, size) + np.bincount(b, c, size))
        step, step_bias = 1 / np.maximum(bound, 1e-9), 4 / (1 + width.mean())
        ahead = old = np.zeros(size)
        bias = old_bias = self.bias
        for k in range(rounds):
            score = np.bincount(row, ahead[column], n) + bias
            off = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) / n
            grad = np.bincount(column, off[row], size) + (l2 + grip) * ahead
            if len(a):
                change = c * (ahead[a] - ahead[b])
                grad += np.bincount(a, change, size) - np.bincount(b, change, size)
            new = ahead - step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_bias = bias - step_bias * off.sum()
            speed = k / (k + 3)
            ahead, bias = new + speed * (new - old), new_bias + speed * (new_bias - old_bias)
            old, old_bias = new, new_bias
        return old, float(old_bias)

    @staticmethod
    def _pairs(texts, groups) -> list[tuple[int, int, int]]:
        """(term, other term, texts): swaps of the training texts, counted."""
        count: dict[tuple[int, int], int] = {}
        kinds = [hashed(line) for line in groups.values()]
        for text in texts:
            for kind in kinds:
                for a in np.intersect1d(kind, text).tolist():
                    for b in kind.tolist():
                        if b != a:
                            count[a, b] = count.get((a, b), 0) + 1
        return [(a, b, n) for (a, b), n in sorted(count.items())]

    def score(self, value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Score of each of n texts from the feature and text number of their words."""
        total = np.full(n, self.bias)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
            hit = self.features[at] == value
            cell = np.unique(owner[hit] * len(self.features) + at[hit])
            total += np.bincount(cell // len(self.features), self.w[cell % len(self.features)], n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE, **options) -> Scorer | None:
    """Train on labelled rows; the caller leaves out what is held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    chosen = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(sample)
    # At most ``sample`` labels, so the broadcast is bounded.
    rows = docs.select(id_column, text).join(
        F.broadcast(chosen), F.col(id_column) == F.col("_id")).select("_id", "_y", text)

    def work(batches):
        for rows_, data, offsets in frames(batches, text):
            value, owner = features(data, offsets)
            cell = np.unique((owner << BITS) | value)
            ends = np.searchsorted(cell >> BITS, np.arange(len(offsets)))
            cell = (cell & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.record_batch({
                "id": rows_.column(0), "y": rows_.column(1),
                "x": pa.array([cell[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())})

    table = stage(rows.mapInArrow(work, f"id {type_of(docs, id_column)}, y int, x binary"))
    n, toxic = table.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return None
    kept = np.union1d(screened(table, n, toxic), hashed(" ".join(GROUPS.values())))

    def narrow(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column("x")]
            yield pa.record_batch({
                "id": batch.column("id"), "y": batch.column("y"),
                "x": pa.array([v[np.isin(v, kept)].tobytes() for v in own], pa.binary())})

    # Only the features that passed the screen come to the driver.
    found = table.mapInArrow(narrow, table.schema).orderBy("id", "y", "x").toArrow()
    texts = [np.frombuffer(v.as_buffer(), np.int32).astype(np.int64) for v in found.column("x")]
    y = found.column("y").to_numpy()
    if "screen" not in options:
        options["screen"] = chosen_screen(found.column("id").to_pylist(), texts, y, **options)
    return Scorer(texts, y, **options)


def chosen_screen(ids: list, texts: list[np.ndarray], y: np.ndarray, **options) -> float:
    """The screen with the best mean of caught toxic and spared other texts, each scored by a model that has not
    seen its fold; ties go to the stronger screen."""
    fold = np.array([zlib.crc32(f"fold:{i}".encode()) % FOLDS for i in ids])
    best, chosen = -1.0, SCREENS[0]
    for screen in SCREENS:
        score = np.zeros(len(texts))
        for k in range(FOLDS):
            own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(own):
                model = Scorer([texts[i] for i in rest], y[rest], screen=screen, **options)
                owner = np.repeat(np.arange(len(own)), [len(texts[i]) for i in own])
                score[own] = model.score(np.concatenate([texts[i] for i in own]), owner, len(own))
        caught, spared = (score[y == 1] >= THRESHOLD), (score[y == 0] < THRESHOLD)
        value = (caught.mean() if len(caught) else 0.0) + (spared.mean() if len(spared) else 0.0)
        if value >= best:
            best, chosen = value, screen
    return chosen


def screened(table: DataFrame, n: int, toxic: int) -> np.ndarray:
    """Features of enough texts whose toxic share is not what chance gives; counted by Spark."""

    def counts(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column("x")]
            y = np.repeat(batch.column("y").to_numpy(), [len(v) for v in own])
            feature, number = np.unique(np.concatenate(own) if own else np.empty(0, np.int32),
                                        return_inverse=True)
            yield pa.record_batch({
                "f": pa.array(feature.astype(np.int64)),
                "c": pa.array(np.bincount(number, minlength=len(feature)).astype(np.int64)),
                "t": pa.array(np.bincount(number, y, len(feature)).astype(np.int64))})

    share = toxic / n
    each = table.mapInArrow(counts, "f long, c long, t long").groupBy("f").agg(
        F.sum("c").alias("c"), F.sum("t").alias("t"))
    off = F.abs(F.col("t") - F.col("c") * share) / F.sqrt(F.col("c") * max(share * (1 - share), 1e-9))
    rows = each.where((F.col("c") >= MIN_TEXTS) & (off >= SCREENS[0])).select("f").orderBy("f").toArrow()
    return rows.column("f").to_numpy()


def scored(docs: DataFrame, model: Scorer | None, id_column: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = share(docs.sparkSession, model)

    def work(batches):
        scorer = opened(shared)
        for rows, data, offsets in frames(batches, text):
            n = len(offsets) - 1
            score = np.zeros(n)
            if scorer is not None:
                score = scorer.score(*features(data, offsets), n)
            yield pa.record_batch({id_column: rows.column(rows.schema.get_field_index(id_column)),
                                   "score": pa.array(score)})

    return docs.select(id_column, text).mapInArrow(
        work, f"{id_column} {type_of(docs, id_column)}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    return scored(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
