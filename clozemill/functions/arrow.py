"""Arrow helpers for what column expressions cannot say, or say slowly: stems, longest common runs, words of many texts.

The helper modules travel with the function, so executors need not have the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from clozemill.functions import stemmer
from clozemill.functions.text import WORD

cloudpickle.register_pickle_by_value(stemmer)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text at hand at a time, and code points there are.
PIECE = 4 << 20
CODE_POINTS = 0x110000


def stem_tokens(tokens: Column, longer_than: int = 0) -> Column:
    """Porter stems of the tokens with more than ``longer_than`` characters."""
    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cached = lru_cache(maxsize=1 << 17)(stemmer.porter_stem)
        for batch in batches:
            yield batch.map(lambda ts: [cached(t) if len(t) > longer_than else t for t in ts])

    return stems(tokens)


def lcs_of(a, b) -> int:
    """Length of the longest common subsequence, one bit per element of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def lcs_length(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_of(s, t) for s, t in zip(x, y)], dtype="int32")

    return length(a, b)


def counts_in_text(texts: Column, found: Column) -> Column:
    """How often each string of an array stands in the row's text, without overlaps; the text is searched, not copied.
    An empty string stands at every place and at the end."""
    @F.arrow_udf("array<int>")
    def counts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for text, own in zip(texts, lists):
                text, own = text.as_py(), own.as_py()
                out.append(None if own is None else [None if text is None or x is None else text.count(x) for x in own])
            yield pa.array(out, pa.list_(pa.int32()))

    return counts(texts, found)


def greedy_pairs(edges: Column) -> Column:
    """Pair left-over positions through synonym edges, from the right, each used once.

    ``edges`` is ``array<struct<h, r>>`` of allowed position pairs.
    """

    @F.pandas_udf("array<struct<h:int,r:int>>")
    def pairs(batch: pd.Series) -> pd.Series:
        def one(es):
            used_h, used_r, out = set(), set(), []
            for h, r in sorted(((e["h"], e["r"]) for e in es), reverse=True):
                if h not in used_h and r not in used_r:
                    used_h.add(h)
                    used_r.add(r)
                    out.append({"h": h, "r": r})
            return out

        return batch.map(one)

    return pairs(edges)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, CODE_POINTS)]))
    rows = SparkSession.active().createDataFrame(pa.table({"s": [every]}))
    found = "".join(rows.select(F.regexp_extract_all("s", F.lit(WORD), F.lit(0))).first()[0])
    out = np.zeros(CODE_POINTS, np.uint8)
    out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = 1
    return np.packbits(out)


def word_letters() -> np.ndarray:
    """A bit for each code point: set for those that words consist of, as Spark's own pattern ``text.WORD`` sees them."""
    return _letters()


def unpacked(letters: np.ndarray) -> np.ndarray:
    return np.unpackbits(letters).astype(bool)


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[pa.Array]:
    """Slices of whole texts of about ``limit`` bytes; null texts are empty ones."""
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, int(offsets[at]) + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield texts.slice(at, end - at)
        at = end


def word_runs(texts: pa.Array, letters: np.ndarray, shortest: int = 1, marks: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of ``letters`` with ``shortest`` code points or more, and the place of each one's text;
    with ``marks`` also every other character but blanks, as in ``text.WORD_OR_MARK``.

    Whole texts are looked at as UTF-8 bytes: a byte is in a word if its code point is."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    single = np.zeros(256, bool)
    single[:128] = letters[:128]
    inside = single[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        rest = [(data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        two = (first & 0x1F) << 6 | rest[0]
        three = (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
        four = (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
        code = np.where(size == 2, two, np.where(size == 3, three, np.minimum(four, CODE_POINTS - 1)))
        own = letters[code]
        lead, size = lead[own], size[own]
        inside[lead] = True
        for k in (1, 2, 3):
            inside[lead[size > k] + k] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # a word ends with its text
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if marks:
        blank = np.zeros(256, bool)
        blank[list(b" \n\t\r")] = True
        blank[0x80:0xC0] = True
        at = np.flatnonzero(~inside & ~blank[data])
        own = data[at]
        size = 1 + (own >= 0xC0).astype(np.int64) + (own >= 0xE0) + (own >= 0xF0)
        # no two overlap, so both sides stay in step when they are sorted
        begins, ends = np.sort(np.concatenate([begins, at])), np.sort(np.concatenate([ends, at + size]))
    characters = np.concatenate([np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    kept = characters[ends] - characters[begins] >= shortest
    begins, lengths = begins[kept], (ends - begins)[kept]
    places = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(lengths, out=places[1:])
    source = np.repeat((begins - places[:-1]).astype(np.int32), lengths) + np.arange(places[-1], dtype=np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[source])))
    return words, np.searchsorted(offsets, begins, "right") - 1
