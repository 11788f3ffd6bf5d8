"""Window counts, PMI, factors and lexicon phrases on small texts with odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.operators import cooccurrence, lexicon
from clozemill.plans.stages import stored

TEXTS = ["red fox runs red", "", None, "fox", "a b a b a", "x " * 50 + "end", "red fox runs red"]


def brute_pairs(texts, window):
    out = Counter()
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + window + 1)):
                out[tuple(sorted((w[i], w[j])))] += 1
    return out


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    return rows.select(F.when(F.col("text").isNotNull(), X.word_tokens(F.col("text"))).alias("tokens"))


@pytest.mark.parametrize("window,stretch", [(1, 1024), (3, 4), (5, 2), (60, 7)])
def test_window_counts(tokens, window, stretch):
    got = {(r.a, r.b): r.n for r in cooccurrence.window_counts(tokens, window=window, stretch=stretch).collect()}
    assert got == brute_pairs(TEXTS, window)


def test_pmi_and_vocabulary(tokens):
    counts = cooccurrence.window_counts(tokens, window=2)
    words = cooccurrence.word_counts(tokens)
    assert {r.word: r.n for r in words.collect()} == {"red": 4, "fox": 3, "runs": 2, "a": 3, "b": 2, "x": 50}
    kept = cooccurrence.known_pairs(counts, words, 6)
    both = Counter()
    for (a, b), n in brute_pairs(TEXTS, 2).items():
        if "end" not in (a, b):
            both[a, b] += n
            both[b, a] += n
    margin, total = Counter(), sum(both.values())
    for (a, _), n in both.items():
        margin[a] += n
    want = {}
    for (a, b), n in both.items():
        pmi = math.log(n * total / (margin[a] * margin[b])) - math.log(2)
        if pmi > 0:
            want[a, b] = (n, pytest.approx(pmi))
    got = {(r.word, r.context): (r.n, r.pmi) for r in cooccurrence.shifted_pmi(kept, 2.0).collect()}
    assert got == want
    assert cooccurrence.shifted_pmi(kept.limit(0)).count() == 0


def test_numbers_are_dense(spark):
    words = spark.range(500).selectExpr("concat('w', id) AS word")
    got = sorted(r.number for r in cooccurrence.numbered(words, 16).collect())
    assert got == list(range(500))


def test_factors_put_planted_groups_together(spark):
    """Words of a group share contexts; their nearest words are of the group."""
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(900):
        g = int(rng.integers(4))
        texts.append((" ".join(f"g{g}w{rng.integers(12)}" for _ in range(10)),))
    rows = spark.createDataFrame(texts, "text string").select(X.word_tokens(F.col("text")).alias("tokens"))
    pmi = stored(cooccurrence.shifted_pmi(stored(cooccurrence.window_counts(rows))))
    made = {r.word: np.array(r.vector) for r in cooccurrence.factor_vectors(pmi, 8, 8, stage=stored).collect()}
    names = sorted(made)
    m = np.stack([made[w] / np.linalg.norm(made[w]) for w in names])
    sims = m @ m.T - 2 * np.eye(len(names))
    near = np.argsort(-sims, axis=1)[:, :5]
    same = np.mean([[names[j][:2] == names[i][:2] for j in near[i]] for i in range(len(names))])
    assert len(names) == 48 and same >= 0.95


ARTICLES = [
    (1, "The Big Apple pie and apple pie, Apple."), (2, "old house old house; the garden"), (3, None), (4, ""),
    (5, "House house"), (None, "apple"), (6, "no nouns at all"), (7, "apple " * 3000),
]


def phrases_of(text, nouns):
    """Runs of equal tags, walked token by token."""
    import re

    out, last, run = [], None, []
    for token in [*re.findall(r"\w+|[^\w \n\t\r]", text or ""), ""]:
        proper = token[:1].isupper() and token.lower() not in X.STOP_WORDS
        tag = "NNP" if proper else "NN" if token.lower() in nouns else None
        if tag != last and run:
            out.append(" ".join(run).lower())
            run = []
        if tag:
            run.append(token)
        last = tag
    return list(dict.fromkeys(p for p in out if len(p) >= 3))


def test_lexicon_phrases(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ARTICLES], "id long, text string, word string")
    nouns = {"apple", "pie", "house", "garden", "old"}
    words = spark.createDataFrame([(w,) for w in [*nouns, "apple"]], "word string")
    got = {r.id: r.candidates for r in lexicon.candidate_phrases(docs, words).collect()}
    assert {i: p for i, p in got.items() if i} == {i: phrases_of(t, nouns) for i, t in ARTICLES if i}
    none = {r.id: r.candidates for r in lexicon.candidate_phrases(docs, words.limit(0)).collect()}
    assert none[1] == ["big apple", "apple"] and none[2] == []
    assert lexicon.candidate_phrases(docs.limit(0), words).count() == 0


def test_lexicon_equals_the_listed_rule(spark):
    """The join gives what the rule with an inlined list gives."""
    docs = spark.createDataFrame([(i, t) for i, t in ARTICLES if i], "id long, text string")
    nouns = ["apple", "pie", "house", "old"]
    words = spark.createDataFrame([(w,) for w in nouns], "word string")
    rule = docs.select("id", X.candidate_phrases(X.tag_tokens(X.cased_tokens(F.col("text")), nouns)).alias("c"))
    want = {r.id: r.c for r in rule.collect()}
    assert {r.id: r.candidates for r in lexicon.candidate_phrases(docs, words).collect()} == want


def test_packed_pairs_come_back(spark):
    for pair, n in (([0], [1]), ([0, 1, 7, 2**46], [1, 70000, 255, 2**33]), (list(range(5000)), [1] * 5000)):
        got = cooccurrence.unpacked_pairs(cooccurrence.packed_pairs(np.array(pair), np.array(n)))
        assert [x.tolist() for x in got] == [pair, n]
    parts = [(np.array([1, 5]), np.array([2, 3])), (np.array([0, 5, 9]), np.array([1, 1, 1]))]
    assert [x.tolist() for x in cooccurrence.added_up(parts)] == [[0, 1, 5, 9], [1, 2, 4, 1]]
    # prime, and no factor of the number of words
    assert [cooccurrence.block_number(n * cooccurrence.BLOCK_PAIRS, w) for n, w in ((0, 1), (3, 10), (3, 9), (24, 29), (24, 7))] == [2, 3, 5, 31, 29]


def test_coded_pmi_and_factors_are_those_of_named_pairs(spark, monkeypatch):
    """Before, both ways of every pair were joined with the margins and the numbers of its words."""
    rng = np.random.default_rng(4)
    texts = spark.createDataFrame(
        [(" ".join(f"w{j}" for j in (rng.zipf(1.4, 30) % 50)),) for _ in range(60)] + [("twin twin twin",), (None,), ("",)], "text string")
    known = stored(cooccurrence.text_word_counts(texts))
    monkeypatch.setattr(cooccurrence, "HELD", 40)
    table = stored(cooccurrence.window_table(texts, known))
    assert table.columns == ["pair", "n"]
    plain = stored(cooccurrence.named_windows(table, known))
    named = stored(cooccurrence.window_table(texts, known, limit=1))
    assert sorted(plain.collect()) == sorted(named.select("a", "b", "n").collect())
    for shift in (1.0, 5.0):
        want = sorted(cooccurrence.shifted_pmi(plain, shift).collect())
        assert sorted(cooccurrence.windows_pmi(table, known, shift).collect()) == want
        assert sorted(cooccurrence.windows_pmi(named, known, shift, stored).collect()) == want
        plan = cooccurrence.windows_pmi(table, known, shift)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    pmi = stored(cooccurrence.shifted_pmi(plain))
    one, other = (
        {r.word: np.array(r.vector) for r in made.collect()} for made in (
            cooccurrence.factor_vectors(pmi, 4, 3, stage=stored), cooccurrence.window_factors(table, known, 4, 3, stage=stored)))
    assert set(one) == set(other) and all(np.allclose(one[w], other[w], atol=1e-4) for w in one)
    empty = cooccurrence.window_table(texts, known.limit(0))
    assert cooccurrence.windows_pmi(empty, known.limit(0)).count() == 0


def test_blocks_of_the_factors_grow_with_the_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cells = [(int(a), int(b), float(x)) for a, b, x in zip(rng.integers(0, 20, 200), rng.integers(0, 20, 200), rng.random(200))]
    table = spark.createDataFrame(cells, "number int, other int, pmi float")
    ids = spark.createDataFrame([(f"w{i}", i) for i in range(20)], "word string, number int")
    seen = []
    real = cooccurrence.ALS
    monkeypatch.setattr(cooccurrence, "ALS", lambda **k: seen.append((k["numUserBlocks"], k["numItemBlocks"], k["checkpointInterval"])) or real(**k))
    first = cooccurrence.cell_factors(table, ids, 3, 2, 0.05, 42).count()
    monkeypatch.setattr(cooccurrence, "BLOCK_CELLS", 16)
    assert cooccurrence.cell_factors(table, ids, 3, 2, 0.05, 42).count() == first == 20
    assert seen == [(10, 10, 1), (13, 13, 1)]
