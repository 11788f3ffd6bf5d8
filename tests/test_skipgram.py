"""Word vectors trained chunk by chunk: whole vocabulary, sense of neighbours, one result in any layout."""

import numpy as np
from pyspark.sql import functions as F

from clozemill.operators import embeddings, skipgram
from clozemill.plans.stages import stored


def cells(spark, n=400):
    rng = np.random.default_rng(5)
    topics = [[f"sea{i}" for i in range(12)], [f"hill{i}" for i in range(12)]]
    rows = [(i, "article", [topics[i % 2][j] for j in rng.integers(0, 12, 30)]) for i in range(n)]
    rows += [(n, "article", ["once"]), (n + 1, "A", ["twice", "twice"]), (n + 2, "B", []), (None, "A", ["sea1"]), (n, "article", ["two"])]
    rows += [(n, "article", ["two"])]
    return spark.createDataFrame(rows, "id long, field string, tokens array<string>")


def table(df):
    return {r.word: np.array(r.vector) for r in df.collect()}


def test_words_of_one_topic_are_near(spark):
    df = cells(spark)
    got = table(skipgram.train(df, lambda t: t, dim=16, epochs=5, chunk_tokens=3000))
    counts = {r.w: r["count"] for r in df.select(F.explode("tokens").alias("w")).groupBy("w").count().collect()}
    assert set(got) == {w for w, n in counts.items() if n >= 2} and "two" in got and "once" not in got
    sea, hill = ([got[f"{t}{i}"] / np.linalg.norm(got[f"{t}{i}"]) for i in range(12)] for t in ("sea", "hill"))
    own = np.mean(np.array(sea) @ np.array(sea).T) + np.mean(np.array(hill) @ np.array(hill).T)
    assert own / 2 > np.mean(np.array(sea) @ np.array(hill).T) + 0.5


def test_layout_of_the_rows_does_not_matter(spark):
    quiz = spark.createDataFrame(
        [(i, f"Tom{i % 5} met Ann{i % 3} in town. " * 4, "Who met?", "Tom", "Ann", "town", "none", "A") for i in range(60)],
        "id long, article string, question string, A string, B string, C string, D string, answer string")
    one, other = (
        table(embeddings.word_vectors(embeddings.train_word2vec(q, dim=8, epochs=2, chunk_tokens=500)))
        for q in (quiz.coalesce(1), quiz.orderBy(F.desc("id")).repartition(5)))
    assert set(one) == set(other) and all((one[w] == other[w]).all() and len(one[w]) == 8 for w in one)


def test_nothing_to_learn(spark):
    df = cells(spark).where("id is null or field = 'B'")
    assert skipgram.train(df, lambda t: t, dim=4).collect() == []


def test_chunks_grow_with_many_texts():
    number = skipgram.chunk_number
    assert [number(n, 10) for n in (0, 10, 11, 160, 161, 640, 641, 6400)] == [1, 1, 2, 16, 16, 16, 17, 160]


def test_an_epoch_hands_on_one_row_a_word(spark):
    seen = []

    def stage(df):
        seen.append(stored(df))
        return seen[-1]

    got = table(skipgram.train(cells(spark), stage, dim=8, epochs=3, chunk_tokens=3000))
    lazy = table(skipgram.train(cells(spark), lambda t: t, dim=8, epochs=3, chunk_tokens=3000))
    assert set(got) == set(lazy) and all((got[w] == lazy[w]).all() for w in got)
    # the texts, and the words before each epoch: a row a word with all of its chunks
    assert len(seen) == 4
    for words in seen[1:]:
        rows = words.collect()
        assert len(rows) == len({r.word for r in rows}) == len(got)
        assert {r.word: len(set(r.chunks)) for r in rows}["sea1"] == 5 and all(len(set(r.chunks)) == len(r.chunks) for r in rows)
