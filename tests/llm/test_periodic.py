"""Periodic runs against a search that tries every period at every place."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clozemill.llm import periodic

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, own = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [own] if own else []
            own = ""
        else:
            own += c
    return out


def runs_of(words, least=24):
    """Every maximal stretch of every period; a period is the smallest if no divisor is one."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            i = j + 1
            if e - s >= max(least, 3 * q) and not any(
                    q % d == 0 and words[s:e - d] == words[s + d:e] for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(left))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
           "collapsed_sha256"]


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.where("length(text) < 6000")
    want = sorted((expected(r.doc_id, r.text) for r in short.collect()), key=repr)
    assert rows(periodic.query(short)) == want
    assert sum(r[1] > 0 for r in want) > 15
    assert periodic.query(docs).count() == docs.count()


def test_odd_rows(spark):
    loop = "a b c " * 40
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, loop), (4, loop), (4, "x " * 30), (None, loop),
             (None, None), (5, " a" * 50), (6, "y" * 100_000), (7, "q w " * 30 + "z " * 25),
             (8, ("k " * 5 + "m ") * 9 + loop)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in texts],
                                 "doc_id long, text string, row int, body string")
    assert rows(periodic.query(docs)) == sorted((expected(i, t) for i, t in texts), key=repr)
    assert periodic.query(docs.limit(0)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([("p", "go " + "la " * 30 + "on"), ("q", "plain")], "name string, body string")
    out = {r.name: r for r in periodic.collapsed(docs, "name", "body", keep_text=True).collect()}
    assert out["p"].collapsed == "go la on" and out["q"].collapsed is None
    assert out["p"].runs[0].asDict() == {"start": 1, "period": 1, "end": 31}


def test_runs_over_many_tiles(spark):
    """One period over a whole long text, and periods longer than a tile, come out as one run each."""
    unique = [f"u{i}" for i in range(9000)]
    texts = [(1, "a b " * 40_000), (2, " ".join(unique * 4)), (3, " ".join(unique[:50] + ["x", "y", "x"] * 5000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.collapsed(docs).collect()}
    assert out[1] == [(0, 2, 80_000)]
    assert out[2] == [(0, 9000, 36_000)]
    assert out[3] == [(50, 3, 15_050)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 14)),
                min_size=1, max_size=8))
def test_pieces_in_small_tiles(parts):
    """With tiny tiles, the stitched pieces are the runs of the whole text."""
    words = [w for unit, times in parts for w in unit * times]
    values = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
    by_period = {}
    for q, s, e in sorted(periodic.pieces(values, step=8)):
        mine = by_period.setdefault(q, [])
        if mine and s <= mine[-1][1] - q:
            mine[-1][1] = max(mine[-1][1], e)
        else:
            mine.append([s, e])
    got = sorted((s, e - s, q) for q, own in by_period.items() for s, e in own
                 if e - s >= max(24, 3 * q))
    assert got == sorted(runs_of([str(w) for w in words]))


@pytest.mark.parametrize("n,low", [(10, 1), (5000, 1), (100_000, 64), (100_000, 8192)])
def test_tiles_cover(n, low):
    spans = list(periodic.tiles(n, low))
    assert spans[0][0] == 0 and spans[-1][1] == n
    assert all(b[0] <= a[1] - min(6 * low, n) for a, b in zip(spans, spans[1:]))
