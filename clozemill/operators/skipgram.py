"""Skip-gram word vectors with negative sampling as a Spark job: parameters are a table from end to end.

Texts are dealt to chunks of about ``CHUNK_TOKENS`` tokens. In every epoch a chunk gets the rows of its own words,
walks over all of its tokens in steps and hands its rows on; a word goes on with the mean of the rows of the
chunks that hold it. Neither the driver nor a task holds the vocabulary: a task holds the words of a chunk.
Between epochs a word is one stored row with its chunks, so what an epoch has shuffled can go when it ends.
Beyond ``CHUNKS`` chunks, chunks grow up to ``GROWTH`` times: a word is then in fewer of them.

A token predicts its neighbours within a window drawn from 1 to ``window``, each pair against ``NEGATIVE`` others. The
others are drawn by count to the power 0.75 among the words of the chunk and shared by the tokens of a step. Rows travel
as half-precision numbers. The result depends on the texts and the seed, not on the order of rows or the number of cores.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_TOKENS = 2_000_000
CHUNKS, GROWTH = 16, 4
NEGATIVE = 5
#: Tokens of a step are cut into tiles, which meet their neighbours in one product each.
TILE = 32
TILES = 8
#: Words drawn for a step, of which each stands for an equal share of its pairs' others.
DRAWN = 128
RATE = 0.025
#: Longest way of a row in one step.
LONGEST_STEP = 0.5
ROWS = "word string, chunk int, n long, v binary, u binary"
WORDS = "word string, chunks array<int>, n long, v binary, u binary"
BATCH = 4096


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return stored_numbers(column, kind).astype(np.float32)


def stored_numbers(column: pa.Array, kind: type) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data.view(kind).reshape(len(column), -1 if len(column) else 0)


def halves(column: pa.Array) -> np.ndarray:
    """The half-precision rows of a column, as a copy: its batch is not kept."""
    return stored_numbers(column, np.float16).copy()


def widened(parts: list[np.ndarray], rows: int) -> np.ndarray:
    """One table of single precision; the parts go as they are copied."""
    out, at = np.empty((rows, max(p.shape[1] for p in parts)), np.float32), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        if len(part):
            out[at:at + len(part)] = part
            at += len(part)
    return out


def packed(rows: np.ndarray, kind: type) -> pa.Array:
    rows = np.ascontiguousarray(rows, kind)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def add_rows(table: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """Add ``change`` to the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    total = np.add.reduceat(change[order], first, axis=0)
    length = np.sqrt((total * total).sum(1))
    total *= np.minimum(1, LONGEST_STEP / np.maximum(length, 1e-30))[:, None]
    table[at[order][first]] += total


def train_chunk(
    tokens: np.ndarray, text: np.ndarray, v: np.ndarray, u: np.ndarray, n: np.ndarray, window: int,
    rng: np.random.Generator, rate: Callable[[float], float],
) -> None:
    """One pass over ``tokens`` (rows of ``v`` and ``u``) of the texts numbered by ``text``; both tables change in place."""
    total, step = len(tokens), TILE * TILES
    chance = np.cumsum(n.astype(np.float64) ** 0.75)
    # Places beyond the ends belong to no text.
    room = window + step
    tokens = np.concatenate([np.zeros(window, tokens.dtype), tokens, np.zeros(room, tokens.dtype)])
    text = np.concatenate([np.full(window, -1), text, np.full(room, -2)])
    wide = TILE + 2 * window
    away = np.abs(np.arange(wide)[None] - window - np.arange(TILE)[:, None])
    away[away == 0] = window + 1
    tiles = np.arange(TILES)[:, None] * TILE + np.arange(wide)[None]
    for start in range(0, total, step):
        alpha = rate(start / total)
        near, own = tokens[start:start + step + 2 * window], text[start:start + step + 2 * window]
        reach = rng.integers(1, window + 1, step).reshape(TILES, TILE, 1)
        pair = (away[None] <= reach) & (
            own[window:window + step].reshape(TILES, TILE, 1) == own[tiles][:, None, :])
        x, y = v[near], u[near[window:window + step]].reshape(TILES, TILE, -1)
        around = x[tiles]
        pull = np.where(pair, alpha * (1 - sigmoid(y @ around.transpose(0, 2, 1))), 0).astype(np.float32)
        for_y = (pull @ around).reshape(step, -1)
        back, pairs = np.zeros_like(x), np.zeros(len(x), np.float32)
        parts, met = pull.transpose(0, 2, 1) @ y, pair.sum(1)
        for i in range(TILES):
            back[i * TILE:i * TILE + wide] += parts[i]
            pairs[i * TILE:i * TILE + wide] += met[i]
        drawn = np.minimum(np.searchsorted(chance, rng.random(DRAWN) * chance[-1], "right"), len(n) - 1)
        z = u[drawn]
        push = -alpha * sigmoid(x @ z.T) * (pairs * (NEGATIVE / DRAWN))[:, None]
        back += push @ z
        add_rows(v, near, back)
        add_rows(u, np.concatenate([near[window:window + step], drawn]), np.concatenate([for_y, push.T @ x]))


def chunk_rows(
    batches: Iterator[pa.RecordBatch], window: int, seed: int, epoch: int, epochs: int
) -> Iterator[pa.RecordBatch]:
    """Rows of the words of one chunk after a pass over its texts, which are the rows without ``v``."""
    words, counts, texts, parts, chunk = [], [], [], {"v": [], "u": []}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk")[0].as_py() if chunk is None else chunk
        is_text = pc.is_null(batch.column("v"))
        known = batch.filter(pc.invert(is_text))
        texts.append(batch.column("word").filter(is_text))
        words.append(known.column("word"))
        counts.append(known.column("n"))
        for c in parts:
            parts[c].append(halves(known.column(c)))
        del batch, known
    if not sum(map(len, words)):
        return
    words, texts = pa.concat_arrays(words), pa.concat_arrays(texts)
    n = pa.concat_arrays(counts).to_numpy()
    v, u = (widened(parts.pop(c), len(words)) for c in ("v", "u"))
    rng = np.random.default_rng([seed, epoch, chunk])
    lists = pc.split_pattern(texts.take(pa.array(rng.permutation(len(texts)))), " ")
    del texts
    place = pc.index_in(lists.flatten(), words)
    hit = place.is_valid().to_numpy(zero_copy_only=False)
    tokens = place.fill_null(0).to_numpy(zero_copy_only=False)[hit]
    text = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit].astype(np.int32)
    del lists, place, hit

    def rate(done: float) -> float:
        return RATE * max(1e-4, 1 - (epoch + done) / epochs)

    train_chunk(tokens, text, v, u, n, window, rng, rate)
    for at in range(0, len(words), BATCH):
        part = slice(at, at + BATCH)
        yield pa.record_batch({
            "word": words[part], "chunk": pa.array(np.full(len(v[part]), chunk, np.int32)), "n": pa.array(n[part]),
            "v": packed(v[part], np.float16), "u": packed(u[part], np.float16)})


def by_word(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on tables of whole words, from rows in order of words."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        heads = word_heads(rows)
        # The last word may go on in the next batch.
        rest = rows.slice(heads[-1]) if len(heads) else rows
        if len(heads) and heads[-1]:
            yield work(rows.slice(0, heads[-1]), heads[:-1])
    if rest is not None and len(rest):
        yield work(rest, word_heads(rest))


def word_heads(rows: pa.Table) -> np.ndarray:
    """Places where a word begins."""
    word = rows["word"].combine_chunks()
    other = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(np.concatenate([np.ones(min(len(word), 1), bool), other]))


def mean_of(rows: pa.Table, column: str, heads: np.ndarray) -> np.ndarray:
    count = np.diff(np.append(heads, len(rows)))[:, None]
    return np.add.reduceat(numbers(rows[column].combine_chunks(), np.float16), heads, axis=0) / count


def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word: its chunks and the mean of its rows."""
    def work(rows: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        at, ends = pa.array(heads), np.append(heads, len(rows)).astype(np.int32)
        return pa.record_batch({
            "word": rows["word"].combine_chunks().take(at),
            "chunks": pa.ListArray.from_arrays(pa.array(ends), rows["chunk"].combine_chunks()),
            "n": rows["n"].combine_chunks().take(at),
            **{c: packed(mean_of(rows, c, heads), np.float16) for c in ("v", "u")}})

    return by_word(batches, work)


def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word: the mean of its rows."""
    def work(rows: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        v = mean_of(rows, "v", heads).astype(np.float64)
        return pa.record_batch({
            "word": rows["word"].combine_chunks().take(pa.array(heads)), "vector": pa.ListArray.from_arrays(
                pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))})

    return by_word(batches, work)


def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First rows of words: small seeded numbers for ``v``, zeros for ``u``."""
    for batch in batches:
        if batch.num_rows:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("word", "chunks", "n")},
                "v": packed(v, np.float16), "u": packed(np.zeros_like(v), np.float16)})


def chunk_number(tokens: int, chunk_tokens: int = CHUNK_TOKENS) -> int:
    """Chunks of ``chunk_tokens`` tokens; of larger ones where that makes more than ``CHUNKS``."""
    number = max(1, -(-tokens // chunk_tokens))
    return min(number, max(CHUNKS, -(-tokens // (GROWTH * chunk_tokens))))


def train(
    cells: DataFrame, stage: Callable[[DataFrame], DataFrame], dim: int = 100, window: int = 5, min_count: int = 2,
    epochs: int = 5, seed: int = 42, chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """``word, vector`` of every token that stands ``min_count`` times or more in ``cells(id, field, tokens)``.

    ``stage`` stores a table and reads it back: the texts, and the words after each epoch.
    """
    # Tokens hold no blank, so a text joined by blanks gives them back.
    plain = stage(cells.where(F.size("tokens") > 0).select(
        "id", "field", F.concat_ws(" ", "tokens").alias("word"), F.size("tokens").cast("long").alias("size")))
    n_chunks = chunk_number(plain.agg(F.sum("size")).first()[0] or 0, chunk_tokens)
    texts = plain.select("word", F.pmod(F.xxhash64("id", "field", "word"), F.lit(n_chunks)).cast("int").alias("chunk"))
    counted = texts.select(F.explode(F.split("word", " ")).alias("word"), "chunk").groupBy("word", "chunk").agg(
        F.count(F.lit(1)).alias("n"))
    # A word is in as many chunks as there are, at most.
    words = counted.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")).where(
        F.col("n") >= min_count)
    scale = float(1 << 24)
    first = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: (
        (F.pmod(F.xxhash64("word", F.lit(seed), j), F.lit(1 << 24)) / scale - 0.5) / dim).cast("float"))
    rows = stage(words.select("word", "chunks", "n", first.alias("v")).mapInArrow(started, WORDS))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("n", "long"), ("v", "binary"), ("u", "binary"))]
    for epoch in range(epochs):
        def work(batches, epoch=epoch):
            return chunk_rows(batches, window, seed, epoch, epochs)

        # One partition a chunk; the order makes the draws repeatable.
        held = rows.select("word", F.explode("chunks").alias("chunk"), "n", "v", "u").unionByName(
            texts.select("word", "chunk", *none))
        trained = held.repartitionById(n_chunks, F.col("chunk")).sortWithinPartitions("word").mapInArrow(work, ROWS)
        ordered = trained.repartition("word").sortWithinPartitions("word", "chunk")
        if epoch < epochs - 1:
            rows = stage(ordered.mapInArrow(agreed, WORDS))
    return ordered.mapInArrow(vectors_of, "word string, vector array<double>")
