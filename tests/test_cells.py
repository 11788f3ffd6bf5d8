"""Neighbours by cells against a search over all pairs."""

import numpy as np
import pytest

import __spark_entry__ as entry
from clozemill.operators import cells
from clozemill.plans.stages import stored


def brute(queries, points, k, skip_same=True):
    def unit(v):
        v = np.array(v, float)
        return v / max(np.linalg.norm(v), 1e-300)

    out = set()
    for q, v in queries:
        if v is None:
            continue
        own = sorted((-round(float(unit(v) @ unit(w)), 9) + 0.0, p) for p, w in points
                     if w is not None and not (skip_same and p == q))[:k]
        out |= {(q, p, i + 1) for i, (_, p) in enumerate(own)}
    return out


def found(df):
    return {(r.q, r.p, r["rank"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, cell string")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), "x") for i in range(240)]
    out += [(1000 + i, out[0][1], "hot") for i in range(150)]
    return out + [(2000, [0.0] * 8, "zero"), (2001, [0.0] * 8, "zero"), (2002, None, "null")]


def test_exact_search_equals_all_pairs(spark, rows):
    df = frame(spark, rows)
    index = cells.build(df, stored, cells=9, block=40)
    assert index.blocks.max() > 1 and index.rows == len(rows) - 1 and cells.ZERO in index.number
    plain = [(i, v) for i, v, _ in rows]
    asked = [r for r in plain if r[0] % 7 == 0 or r[0] >= 1995]
    got = found(cells.search(df.where("id % 7 = 0 or id >= 1995"), index, 5, stored, "id", probes=2, exact=True, block=40))
    assert got == brute(asked, plain, 5)


def test_fewer_probes_lose_recall_and_all_probes_lose_nothing(spark, rows):
    df = frame(spark, rows[:240])
    index = cells.build(df, stored, cells=9)
    want = brute([(i, v) for i, v, _ in rows[:240]], [(i, v) for i, v, _ in rows[:240]], 4)
    one, every = (found(cells.search(df, index, 4, stored, "id", probes=n)) for n in (1, 9))
    assert every == want and {(q, p) for q, p, _ in one} != {(q, p) for q, p, _ in want}
    probes = cells.probes_for(index, 4, 0.9, stored)
    near = {(q, p) for q, p, _ in found(cells.search(df, index, 4, stored, "id", probes=probes))}
    assert len(near & {(q, p) for q, p, _ in want}) >= 0.87 * len(want) and 1 <= probes <= 9


def test_empty_tables(spark, rows):
    df = frame(spark, rows)
    assert cells.build(df.limit(0), stored) is None and cells.build(df.where("id = 2002"), stored) is None
    assert cells.search(df, None, 3, stored, "id").count() == 0
    index = cells.build(df.where("id < 3"), stored)
    assert cells.search(df.limit(0), index, 3, stored, "id").count() == 0
    assert len(found(cells.search(df.where("id = 1"), index, 9, stored, "id", exact=True))) == 2


def test_recall_on_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    made = entry.queries()
    near, exact = ({(r.q, r.p) for r in made[n](spark, sf).collect()} for n in ("embedding_cells", "embedding_search"))
    assert len(near & exact) >= 0.9 * len(exact)


def test_full_blocks_meet_in_little_memory():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    a = rng.normal(size=(cells.BLOCK_ROWS, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    ids = pd.Series(np.arange(len(a))[::-1])
    tracemalloc.start()
    got = cells.best_pairs(ids, a, ids, a, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * cells.BLOCK_ROWS ** 2
    # The first, the last and a middle query against all.
    for i in (0, 2000, len(a) - 1):
        sims = np.round(a @ a[i], 9)
        sims[i] = -np.inf
        want = ids.to_numpy()[np.argsort(-sims, kind="stable")[:3]]
        assert got[got.q == ids[i]].p.tolist() == want.tolist()


def test_best_of_many_parts_equals_a_full_sort(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(cells, "SLICE_ROWS", 7)
    monkeypatch.setattr(cells, "PART_ROWS", 13)
    rng = np.random.default_rng(8)
    # Few directions, so that many similarities are equal.
    a = rng.integers(-1, 2, (60, 3)).astype(float)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    for names in (np.arange(60)[::-1], np.array([f"w{i // 2}" for i in range(60)], object)):
        for k in (1, 4, 100):
            got = cells.best_pairs(pd.Series(names), a, pd.Series(names), a, k, True)
            want = []
            for i, q in enumerate(names):
                own = sorted((-round(float(a[i] @ a[j]), 9) + 0.0, p) for j, p in enumerate(names) if p != q)[:k]
                want += [(q, p, -s) for s, p in own]
            assert sorted(zip(got.q, got.p, got.sim + 0.0)) == sorted(want)


def test_a_meeting_copies_a_vector_once_for_each_large_block(spark):
    """Copies of vectors grew with the number of rows over 4,096, whatever a task can hold."""
    assert cells.large_block(64) == 65_536 and cells.large_block(100_000) == cells.BLOCK_ROWS
    df = frame(spark, [(i, np.random.default_rng(i).normal(size=8).tolist(), "x") for i in range(300)])
    index = cells.build(df, stored, cells=3, block=100)
    asked = cells.asked_cells(df.selectExpr("id as q", "cast(vector as array<double>) vector"), index, 3)
    assert asked.count() == 300 and all(sorted(r.cells) == [0, 1, 2] for r in asked.collect())
