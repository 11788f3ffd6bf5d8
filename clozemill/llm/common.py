"""Shared helpers: staged tables, and whole texts as numpy byte arrays inside a task."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.session import shared_dir

# Fixed odd 64-bit constants of the word and shingle hashes.
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost
    executor costs a file read."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value with the code of its class: executors have no copy of this repository."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    """The value of ``share`` inside a task."""
    return pickle.loads(shared.value)


def frames(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK,
           rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of about ``limit`` bytes of text, whole rows only.

    Yields the rows, the UTF-8 bytes of all their texts, and the offsets of each text.
    A null text is an empty one.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_large_string(texts.type):
            width = np.int64
        else:
            texts, width = texts.cast(pa.string()), np.int32
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            continue
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, width)[texts.offset:texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), at + rows, n)
            own = offsets[at:end + 1]
            yield batch.slice(at, end - at), data[own[0]:own[-1]], own - own[0]
            at = end


def table(word_bytes: bytes, lower: bool = True) -> np.ndarray:
    """For each byte its code inside a word (A-Z lowered), 0 where words end."""
    out = np.zeros(256, np.uint16)
    for b in word_bytes:
        out[b] = (b | 0x20 if lower and 0x41 <= b <= 0x5A else b) + 1
    return out


#: `[^\x20\x09-\x0D]+` and, after lowering A-Z, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, by byte.
SPACED = table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
ALNUM = table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]))
LETTERS = table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + (1 << 12)), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s] = base**s times the polynomial hash of codes[s:e]."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * powers(BASE, len(codes)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray):
    """Word hashes of a piece, the text each word belongs to, and the words' byte ranges.

    Words never cross texts.
    """
    code = codes[data]
    inside = code != 0
    n = len(code)
    if not n or not inside.any():
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    last = offsets[1:]
    after[last] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    sums = prefix_hashes(code)
    value = (sums[end] - sums[start]) * powers(INVERSE, n)[start]
    doc = np.searchsorted(offsets, start, "right") - 1
    return mixed(value + (end - start).astype(np.uint64)), doc, start, end


def starts_of(doc: np.ndarray, n: int) -> np.ndarray:
    """First index of each text's run in a sorted column of text numbers, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def held_out(doc_id: str, parts: int, rest: int):
    """The fixed fold rule: crc32 of the id's text, modulo ``parts``."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts) == rest
