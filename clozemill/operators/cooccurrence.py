"""Word vectors without a vocabulary on the driver: window counts, shifted PMI, factors.

Counts, marginals, PMI and factors are tables from end to end. A text is cut into stretches of ``STRETCH`` tokens that
see ``window`` tokens more, so that a long text is many rows; equal pairs are added up before they are shuffled.

Where the words can be sent to the tasks, pairs are numbers up to the last step: counts are shuffled as packed blocks,
and PMI and the cells of the factors are formed beside the margins, a number a word, without another shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.arrow import pieces, unpacked, word_letters, word_runs
from clozemill.operators.common import BROADCAST_LIMIT, small
from clozemill.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = 1024
#: Tokens whose pairs are counted at a time.
TOKENS = 1 << 19
ID_BUCKETS = 4096
#: Different pairs a task adds up before it hands them on; pairs in the texts for each block of the exchange.
HELD = 1 << 22
BLOCK_PAIRS = 1 << 22
BATCH = 1 << 16
CODED = "pair long, n long"
#: Blocks of either side of the factors at least, and cells of a block.
BLOCKS = 10
BLOCK_CELLS = 8_000_000


def stretch_pairs(tokens: Column, window: int, stretch: int = STRETCH) -> Column:
    """Pairs (smaller, greater word) of the first ``stretch`` tokens with those up to ``window`` behind them."""

    def at(t: Column, d: int) -> Column:
        n = F.least(F.lit(stretch), F.greatest(F.size(t) - d, F.lit(0)))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(d + 1), n), lambda a, b: F.struct(
            F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    return X.let(tokens, lambda t: F.concat(*[at(t, d) for d in range(1, window + 1)]))


def word_counts(texts: DataFrame, tokens: str = "tokens", min_count: int = 2) -> DataFrame:
    """``word, n`` of the words that stand at least ``min_count`` times in all texts."""
    words = texts.select(F.explode(tokens).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def window_counts(texts: DataFrame, tokens: str = "tokens", window: int = 5, stretch: int = STRETCH) -> DataFrame:
    """``a, b, n``: how often two words stand at most ``window`` places apart in a text, a <= b in byte order.

    Null texts and texts of one token have no pairs. Windows count all tokens; rare words are left out later."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(stretch)))
    parts = texts.where(F.size(tokens) > 1).select(tokens, starts.alias("_s")).select(
        F.slice(F.col(tokens), F.col("_s"), F.lit(stretch + window)).alias("_t"))
    pairs = parts.select(F.inline(stretch_pairs(F.col("_t"), window, stretch)))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def text_word_counts(texts: DataFrame, text_col: str = "text", min_count: int = 2) -> DataFrame:
    """:func:`word_counts` of the ``text.word_tokens`` of whole texts, in Arrow batches."""
    letters = word_letters()

    def work(batches):
        known = unpacked(letters)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                found = word_runs(piece, known, marks=True)[0].dictionary_encode()
                yield pa.record_batch({"word": found.dictionary, "n": pa.array(
                    np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.int64))})

    low = texts.select(F.lower(X.text_or_empty(F.col(text_col))))
    return low.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def sorted_words(known: DataFrame) -> pa.Array:
    """The words of the table ``known(word)`` in byte order; a word's number is its place."""
    words = known.select("word").toArrow()["word"].cast(pa.string()).combine_chunks()
    return words.take(pc.sort_indices(words))


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order with their counts, from parts in order."""
    pair, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]]))
    return pair[first], np.add.reduceat(n, first) if len(first) else n


def _planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Whole numbers as the bytes they need, all lowest bytes first."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return size, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)


def _whole(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((data.size // size, 8), np.uint8)
    out[:, :size] = data.reshape(size, -1).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def packed_pairs(pair: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order as differences, and counts, in as many bytes as they need, compressed."""
    wide, steps = _planes(np.diff(pair, prepend=0))
    high, counts = _planes(n)
    head = np.array([len(pair), wide, high], "<i4").tobytes()
    return head + pa.compress(steps.tobytes() + counts.tobytes(), "zstd", asbytes=True)


def unpacked_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, wide, high = np.frombuffer(data, "<i4", 3).tolist()
    flat = np.frombuffer(pa.decompress(data[12:], rows * (wide + high), "zstd", asbytes=True), np.uint8)
    return np.cumsum(_whole(flat[:rows * wide], wide)), _whole(flat[rows * wide:], high)


def block_number(occurrences: int, n_words: int) -> int:
    """A prime number of blocks that is no factor of the number of words, so that pairs fall evenly."""
    number = max(2, -(-occurrences // BLOCK_PAIRS))
    while n_words % number == 0 or any(number % k == 0 for k in range(2, int(number**0.5) + 1)):
        number += 1
    return number


def coded_window_counts(texts: DataFrame, words: pa.Array, blocks: int, text_col: str = "text", window: int = 5) -> DataFrame:
    """``pair, n``: :func:`text_window_counts` with a pair as the number of its smaller word times the number of words, plus
    that of its greater one. A task adds up its pairs and hands them on as one packed row for each block."""
    letters, n = word_letters(), len(words)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def handed(pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        block, rest = pair % blocks, pair // blocks
        order = np.argsort(block, kind="stable")
        ends = np.cumsum(np.bincount(block, minlength=blocks))
        rest, times = rest[order], times[order]
        own = [(k, slice(at, end)) for k, (at, end) in enumerate(zip([0, *ends], ends)) if end > at]
        return pa.record_batch({
            "pair_block": pa.array([k for k, _ in own], pa.int32()),
            "data": pa.array([packed_pairs(rest[x], times[x]) for _, x in own], pa.binary())})

    def count(batches):
        in_words = unpacked(letters)
        held, size = [], 0
        for batch in batches:
            parts = [word_runs(p, in_words, marks=True) + (len(p),) for p in pieces(batch.column(0))]
            if not parts:
                continue
            firsts = np.cumsum([0, *[p[2] for p in parts]])
            row = np.concatenate([p[1] + first for p, first in zip(parts, firsts)])
            # the words are laid out once for all tokens of the batch
            found = pc.index_in(pa.chunked_array([p[0] for p in parts]), value_set=shared.value)
            code = pc.fill_null(found, -1).to_numpy().astype(np.int64)
            del parts, found
            for at in range(0, len(code), TOKENS):
                end = min(at + TOKENS, len(code))
                keys = []
                for d in range(1, window + 1):
                    a, b = code[at:min(end, len(code) - d)], code[at + d:end + d]
                    near = (row[at:at + len(a)] == row[at + d:end + d]) & (a >= 0) & (b >= 0)
                    a, b = a[near], b[near]
                    keys.append(np.minimum(a, b) * n + np.maximum(a, b))
                pair, times = np.unique(np.concatenate(keys), return_counts=True)
                held.append((pair, times))
                size += len(pair)
                if size >= HELD:
                    held = [added_up(held)]
                    size = len(held[0][0])
                    if 2 * size >= HELD:
                        yield handed(*held[0])
                        held, size = [], 0
        if size:
            yield handed(*added_up(held))

    def total(batches):
        held, size = [], 0
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rest, times = unpacked_pairs(data.as_py())
                held.append((rest * blocks + block, times))
                size += len(rest)
                if size >= 2 * HELD:
                    held = [added_up(held)]
                    size = len(held[0][0])
        if size:
            pair, times = added_up(held)
            for at in range(0, len(pair), BATCH):
                yield pa.record_batch({"pair": pa.array(pair[at:at + BATCH]), "n": pa.array(times[at:at + BATCH])})

    low = texts.select(F.lower(X.text_or_empty(F.col(text_col))))
    # As many partitions as blocks: what a task adds up does not grow with the texts.
    return low.mapInArrow(count, "pair_block int, data binary").repartition(blocks, "pair_block").mapInArrow(total, CODED)


def named_pairs(counts: DataFrame, words: pa.Array) -> DataFrame:
    """``a, b, n`` of :func:`coded_window_counts`."""
    n, shared = len(words), counts.sparkSession.sparkContext.broadcast(words)

    def name(batches):
        for batch in batches:
            pair = batch.column(0).to_numpy()
            yield pa.record_batch({
                "a": shared.value.take(pa.array(pair // n)), "b": shared.value.take(pa.array(pair % n)), "n": batch.column(1)})

    return counts.mapInArrow(name, "a string, b string, n long")


def window_table(texts: DataFrame, known: DataFrame, text_col: str = "text", window: int = 5,
                 limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The counts of :func:`text_window_counts`, coded as in :func:`coded_window_counts`; beyond ``limit`` bytes
    of words, pairs are counted as text and named ``a, b, n``."""
    counted = F.sum("n") if "n" in known.columns else F.lit(None).cast("long")
    seen = known.agg(F.sum(F.octet_length("word") + 8).alias("size"), counted.alias("tokens")).first()
    if (seen["size"] or 0) > limit:
        rows = texts.select(X.word_tokens(F.col(text_col)).alias("tokens"))
        return known_pairs(window_counts(rows, window=window), known, known.count())
    words = sorted_words(known)
    blocks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) if seen["tokens"] is None else 1
    blocks = block_number(max((seen["tokens"] or 0) * window, blocks * BLOCK_PAIRS), max(1, len(words)))
    return coded_window_counts(texts, words, blocks, text_col, window)


def text_window_counts(texts: DataFrame, known: DataFrame, text_col: str = "text", window: int = 5,
                       limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``a, b, n`` of :func:`window_counts` for the ``text.word_tokens`` of whole texts, pairs of words in the stored table
    ``known(word)`` only; with a column ``n`` of their counts the exchange is cut by it.

    Words are numbered in byte order and sent to the tasks; a pair is one number, counted over many texts before it is
    shuffled, and named after. Beyond ``limit`` bytes of words, pairs are counted as text."""
    return named_windows(window_table(texts, known, text_col, window, limit), known)


def named_windows(table: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b, n`` of a :func:`window_table`."""
    return table if "a" in table.columns else named_pairs(table, sorted_words(known))


def coded_margins(counts: DataFrame, n_words: int) -> np.ndarray:
    """For each word, the sum of its pairs from both sides; a task hands on a row a word at most."""
    def work(batches):
        out = np.zeros(n_words, np.int64)
        for batch in batches:
            pair, n = (batch.column(i).to_numpy() for i in (0, 1))
            np.add.at(out, pair // n_words, n)
            np.add.at(out, pair % n_words, n)
        code = np.flatnonzero(out)
        for at in range(0, len(code), BATCH):
            yield pa.record_batch({"code": pa.array(code[at:at + BATCH]), "m": pa.array(out[code[at:at + BATCH]])})

    # As few sums of a word as there are cores to add them up.
    few = counts.coalesce(max(1, counts.sparkSession.sparkContext.defaultParallelism))
    found = few.mapInArrow(work, "code long, m long").groupBy("code").agg(F.sum("m").alias("m")).toArrow()
    out = np.zeros(n_words, np.int64)
    out[found["code"].to_numpy()] = found["m"].to_numpy()
    return out


def coded_pmi(counts: DataFrame, margins: np.ndarray, shift: float = 1.0) -> DataFrame:
    """``word, context, n, pmi`` of :func:`shifted_pmi` with words as numbers, from :func:`coded_window_counts`."""
    n_words, total = len(margins), int(margins.sum())
    shared = counts.sparkSession.sparkContext.broadcast(margins)

    def work(batches):
        m = shared.value
        for batch in batches:
            pair, n = (batch.column(i).to_numpy() for i in (0, 1))
            a, b = pair // n_words, pair % n_words
            two = a != b
            word, context = np.concatenate([a, b[two]]), np.concatenate([b, a[two]])
            n = np.concatenate([np.where(two, n, 2 * n), n[two]])
            # a little more than what is kept below, by the logarithm itself
            near = n * float(total) >= (shift * (1 - 1e-9)) * (m[word].astype(np.float64) * m[context])
            word, context, n = word[near], context[near], n[near]
            yield pa.record_batch({"word": pa.array(word), "context": pa.array(context), "n": pa.array(n),
                                   "m_word": pa.array(m[word]), "m_context": pa.array(m[context])})

    found = counts.mapInArrow(work, "word long, context long, n long, m_word long, m_context long")
    return positive_pmi(found.withColumn("total", F.lit(total).cast("long")), shift)


def windows_pmi(table: DataFrame, known: DataFrame, shift: float = 1.0,
                stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """:func:`shifted_pmi` of a stored :func:`window_table`."""
    if "a" in table.columns:
        return shifted_pmi(table, shift, stage)
    words = sorted_words(known)
    shared = table.sparkSession.sparkContext.broadcast(words)

    def name(batches):
        for batch in batches:
            yield pa.record_batch({
                **{c: shared.value.take(batch.column(c)) for c in ("word", "context")}, **{c: batch.column(c) for c in ("n", "pmi")}})

    found = coded_pmi(table, coded_margins(table, len(words)), shift)
    return found.mapInArrow(name, "word string, context string, n long, pmi double")


def both_ways(counts: DataFrame) -> DataFrame:
    """``word, context, n``: every pair from both of its words; a word beside itself counts for both places."""
    def side(word: str, context: str):
        return F.struct(F.col(word).alias("word"), F.col(context).alias("context"))

    same = F.col("a") == F.col("b")
    sides = F.when(same, F.array(side("a", "b"))).otherwise(F.array(side("a", "b"), side("b", "a")))
    return counts.select(F.inline(sides), F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("n"))


def known_pairs(counts: DataFrame, vocabulary: DataFrame, n_words: int) -> DataFrame:
    """The pairs whose words both are in the vocabulary, broadcast only if its counted size allows."""
    words = small(vocabulary.select("word"), n_words)
    for side in ("a", "b"):
        counts = counts.join(words.withColumnRenamed("word", side), side, "left_semi")
    return counts.select("a", "b", "n")


def shifted_pmi(counts: DataFrame, shift: float = 1.0, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``word, context, n, pmi``: ln(n * N / (n(word) * n(context))) - ln(shift) where it is above 0.

    ``stage`` stores the margins, a row a word; they are then broadcast if their counted size allows."""
    pairs = both_ways(counts)
    margins = pairs.groupBy("word").agg(F.sum("n").alias("m"))
    rows = BROADCAST_LIMIT
    if stage is not None:
        margins = stage(margins)
        rows = margins.count()
    total = margins.agg(F.sum("m").alias("total"))
    found = pairs.join(small(margins.withColumnRenamed("m", "m_word"), rows), "word").join(
        small(margins.select(F.col("word").alias("context"), F.col("m").alias("m_context")), rows), "context")
    # One row with the total.
    return positive_pmi(found.join(F.broadcast(total)), shift)


def positive_pmi(found: DataFrame, shift: float) -> DataFrame:
    """``word, context, n, pmi`` of rows with ``n, total, m_word, m_context``."""
    pmi = F.log(F.col("n").cast("double") * F.col("total") / (F.col("m_word").cast("double") * F.col("m_context"))) - F.log(
        F.lit(float(shift)))
    return found.withColumn("pmi", pmi).where(F.col("pmi") > 0).select("word", "context", "n", "pmi")


def numbered(words: DataFrame, buckets: int = ID_BUCKETS) -> DataFrame:
    """``word, number``: 0, 1, 2, ... in hash bucket order; each bucket is numbered in its own task."""
    dealt = words.select("word").withColumn("_b", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    # A row a bucket.
    offsets = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("_b").orderBy("word")) - 1
    return dealt.withColumn("_p", place).join(small(offsets, buckets), "_b").select(
        "word", (F.col("_first") + F.col("_p")).cast("int").alias("number"))


def factor_vectors(pmi: DataFrame, dim: int = 100, rounds: int = 10, penalty: float = 0.05, seed: int = 42,
                   stage=lambda df: df) -> DataFrame:
    """``word, vector``: factors of the PMI table by alternating least squares, both sides as tables.

    Words are numbered below 2**31, as the factoriser asks for. A word without a positive PMI has no vector."""
    ids = stage(numbered(pmi.select("word").distinct()))
    cells = stage(pmi.join(ids, "word").join(
        ids.select(F.col("word").alias("context"), F.col("number").alias("other")), "context").select(
        "number", "other", F.col("pmi").cast("float").alias("pmi")))
    return cell_factors(cells, ids, dim, rounds, penalty, seed)


def cell_factors(cells: DataFrame, ids: DataFrame, dim: int, rounds: int, penalty: float, seed: int) -> DataFrame:
    """``word, vector`` from the stored cells ``number, other, pmi`` and ``ids(word, number)``.

    A block holds ``BLOCK_CELLS`` cells on average, so that what a task holds does not grow with the table. Factors are
    checkpointed in every round, which lets the shuffle of the round before go."""
    blocks = max(BLOCKS, -(-cells.count() // BLOCK_CELLS))
    context = cells.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(cells.sparkSession, "factors"))
    model = ALS(rank=dim, maxIter=rounds, regParam=penalty, userCol="number", itemCol="other", ratingCol="pmi", seed=seed,
                numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1, coldStartStrategy="drop").fit(cells)
    return model.userFactors.select(F.col("id").alias("number"), F.col("features").cast("array<double>").alias(
        "vector")).join(ids, "number").select("word", "vector")


def window_factors(table: DataFrame, known: DataFrame, dim: int = 100, rounds: int = 10, penalty: float = 0.05,
                   seed: int = 42, stage=lambda df: df) -> DataFrame:
    """:func:`factor_vectors` of the PMI of a stored :func:`window_table`; cells are numbered where they are formed."""
    if "a" in table.columns:
        return factor_vectors(shifted_pmi(table, stage=stage), dim, rounds, penalty, seed, stage)
    words = sorted_words(known)
    spark = table.sparkSession.sparkContext
    shared = spark.broadcast(words)
    pmi = coded_pmi(table, coded_margins(table, len(words)))

    def name(batches):
        for batch in batches:
            yield pa.record_batch({"word": shared.value.take(batch.column(0))})

    ids = stage(numbered(pmi.select("word").distinct().mapInArrow(name, "word string")))
    found = ids.toArrow()
    numbers = np.full(len(words), -1, np.int32)
    numbers[pc.index_in(found["word"].cast(pa.string()), value_set=words).to_numpy()] = found["number"].to_numpy()
    coded = spark.broadcast(numbers)

    def number(batches):
        for batch in batches:
            yield pa.record_batch({
                "number": pa.array(coded.value[batch.column(0).to_numpy()]), "other": pa.array(coded.value[batch.column(1).to_numpy()]),
                "pmi": batch.column(2)})

    cells = pmi.select("word", "context", F.col("pmi").cast("float").alias("pmi"))
    return cell_factors(stage(cells.mapInArrow(number, "number int, other int, pmi float")), ids, dim, rounds, penalty, seed)
