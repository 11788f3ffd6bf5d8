"""One very long text among short ones, for operators whose other tests have short texts only."""

import random

import pytest
from pyspark.sql import functions as F

from clozemill.llm import decontaminate, language, minhash, suffix_dedup, toxicity

rng = random.Random(9)
LONG = " ".join(f"word{rng.randrange(10 ** 6)}" for _ in range(120_000))
PASSAGE = " ".join(LONG.split()[70_000:70_060])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, "Before it. " + PASSAGE + " after it.", "en", "a"), (3, "Kurzer Text ohne alles.", "de", "b"),
            (4, LONG + " and a little more", "en", "b"), (5, None, None, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_suffixes(docs):
    out = {r.doc_id: r for r in suffix_dedup.query(docs).collect()}
    size = len(LONG.encode())
    assert out[1].n_removed == 0 and out[2].n_removed >= len(PASSAGE) and out[4].n_removed == size + out[4].n_bytes - size - len(
        " and a little more")
    assert out[3].n_removed == 0 and out[5].n_bytes == 0


def test_phrases(spark, docs):
    benchmark = spark.createDataFrame([("q", " ".join(PASSAGE.split()[:12]))], "item_id string, text string")
    out = {r.doc_id: r.n_hit for r in decontaminate.query(docs, benchmark).collect()}
    assert out == {1: 12, 2: 12, 3: 0, 4: 12, 5: 0}


def test_near_duplicates(docs):
    out = {r.doc_id: r.component_id for r in minhash.query(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_scores(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    out = toxicity.query(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    named = language.identify(docs, language.fit(docs.where(F.col("doc_id") < 4))).collect()
    assert {r.doc_id: r.lang_pred for r in named} == {1: "en", 2: "en", 3: "de", 4: "en", 5: "und"}
