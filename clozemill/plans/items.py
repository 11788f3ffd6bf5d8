"""Quiz items for a whole table of passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.words import BLANK, NO_DISTRACTOR
from clozemill.operators import clusters, distractors, relational, tfidf
from clozemill.operators.cloze import (
    Tagger, blank_key_chunk, hint_texts, rule_tagger, sentence_words,
)
from clozemill.operators.common import keyed, once
from clozemill.operators.similarity import NO_SCORES, best_position, sentence_scores

# Fixed values. Items per passage and wrong options per item.
MIN_ITEMS, MAX_ITEMS = 3, 5
ASKED, SHOWN = 6, 3


def pivot_positions(n_sents: Column) -> Column:
    """Evenly spaced sentence positions: a third of the sentences, 3 to 5 of them."""
    want = F.least(F.lit(MAX_ITEMS), F.greatest(F.lit(MIN_ITEMS), F.floor(n_sents / 3).cast("int")))

    def spaced(q: Column) -> Column:
        stride = F.greatest(F.lit(1), F.floor(n_sents / q).cast("int"))
        return F.filter(
            F.transform(F.sequence(F.lit(0), q - 1), lambda i: i * stride), lambda p: p < n_sents
        )

    return X.let(want, spaced)


def passage_stems(
    articles: DataFrame, terms: DataFrame, tagger: Tagger | None = None, distinct_pivots: bool = False
) -> DataFrame:
    """``id, stems``: per passage the array of ``struct<pivot_pos, best_pos, stem, chunk>``.

    The sentence closest to each pivot sentence is blanked; a pivot without a usable
    chunk is dropped. ``distinct_pivots`` keeps one item per chosen sentence.
    """
    tagger = tagger or rule_tagger()
    rows = once(keyed(articles.select("id", "article"), "id"), sents=X.sentences(F.col("article")))
    rows = once(rows.drop("article"), pivots=pivot_positions(F.size("sents")))
    rows = once(rows, _queries=F.transform("pivots", lambda p: F.get("sents", p)))
    scored = sentence_scores(rows, terms, "_queries", MAX_ITEMS)
    joined = rows.join(scored, "id", "left")

    def item(p: Column, i: Column) -> Column:
        pivot = F.get("_queries", i)
        return X.let(
            best_position(F.col("scored"), i),
            lambda at: F.struct(
                p.alias("pivot_pos"), at.alias("best_pos"), pivot.alias("pivot"),
                blank_key_chunk(F.get("sents", at), pivot, tagger).alias("c"),
            ),
        )

    built = once(joined, _items=F.transform("pivots", item)).select(
        "id",
        F.transform(
            F.filter("_items", lambda t: (t["c"]["chunk"] != "") & (t["c"]["chunk"] != t["pivot"])),
            lambda t: F.struct(
                t["pivot_pos"].alias("pivot_pos"), t["best_pos"].alias("best_pos"),
                t["c"]["stem"].alias("stem"), t["c"]["chunk"].alias("chunk"),
            ),
        ).alias("stems"),
    )
    if distinct_pivots:
        built = once(built, _kept=F.filter(
            "stems",
            lambda t, i: ~F.exists(
                F.slice("stems", F.lit(1), i), lambda u: u["best_pos"] == t["best_pos"]
            ),
        )).select("id", F.col("_kept").alias("stems"))
    return built.filter(F.size("stems") > 0)


def clean_distractors(found: Column, answer: Column) -> Column:
    """First three, distinct in lower case, none equal to the answer, cased like it."""
    usable = F.array_distinct(F.filter(F.transform(found, lambda d: F.lower(d)), lambda d: d != F.lower(answer)))
    return F.transform(F.slice(usable, 1, SHOWN), lambda d: X.format_like(d, answer))


def option_pool(stem: Column, chunk: Column, wrong: Column, seed: int = 42) -> Column:
    """Shuffled array of four ``struct<h, text, right, word>``, padded where options lack."""

    def option(word: Column, right: bool) -> Column:
        return F.struct(
            relational.option_sentence(stem, word).alias("text"), F.lit(right).alias("right"),
            word.alias("word"),
        )

    pad = F.struct(F.lit(NO_DISTRACTOR).alias("text"), F.lit(False).alias("right"), F.lit("").alias("word"))
    pool = F.slice(
        F.concat(
            F.array(option(chunk, True)), F.transform(wrong, lambda w: option(w, False)),
            F.array_repeat(pad, SHOWN),
        ),
        1, SHOWN + 1,
    )
    shuffled = F.transform(
        pool,
        lambda o, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), "id", "pivot_pos", i.cast("string"))).alias("h"),
            o["text"].alias("text"), o["right"].alias("right"), o["word"].alias("word"),
        ),
    )
    return F.sort_array(shuffled)


def quiz_items(
    articles: DataFrame,
    terms: DataFrame,
    stage: Callable[[DataFrame], DataFrame],
    seed: int = 42,
    tagger: Tagger | None = None,
    vectors: DataFrame | None = None,
    n_words: int = 0,
    dim: int = 100,
    ranker=None,
    kmeans=None,
    with_distractors: bool = True,
    distinct_pivots: bool = False,
    stage_items: Callable[[DataFrame], DataFrame] = lambda df: df,
    stage_pairs: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Up to five items per passage of ``articles(id, article)``: ``id, pivot_pos,
    question_stem, answer_chunk, options, option_words, correct_idx, hints, cluster_id``.

    ``stage`` stores the small table of stems (a few sentences per passage) between the
    two similarity passes, so that the second does not run the first again. Models are
    optional: without a ranker the first candidates are taken, without k-means the
    cluster is null, without distractors the options are padded. With a ranker the items
    and the candidate pairs are each read more than once; ``stage_items`` and
    ``stage_pairs`` store them. Candidates are counted once per passage, which never
    leaves its row.
    """
    stems = stage(passage_stems(articles, terms, tagger, distinct_pivots))
    rows = keyed(articles.select("id", "article"), "id").join(stems, "id")
    rows = once(rows, sents=X.sentences(F.col("article")))
    asked = rows.select("id", "sents", F.col("stems.stem").alias("_queries"))
    scored = sentence_scores(asked, terms, "_queries", MAX_ITEMS)
    joined = rows.join(scored, "id", "left").withColumn(
        "scored", F.coalesce("scored", F.array().cast(NO_SCORES))
    )
    if with_distractors:
        joined = distractors.with_candidates(joined, "article", tagger)
    else:
        joined = joined.withColumn("candidates", F.array().cast("array<string>"))
    words = once(joined, _words=sentence_words(F.col("sents")))
    hinted = once(words, _hints=F.transform(
        "stems",
        lambda t, i: hint_texts(F.col("sents"), F.col("_words"), F.col("scored"), t["stem"], i),
    ))
    ranked = ranker is not None and vectors is not None
    if ranked:
        low = hinted.withColumn("_low", F.lower("article"))
        hinted = once(low, freqs=distractors.frequencies(F.col("candidates"), F.col("_low")))
    counted = ["freqs"] if ranked else []
    items = hinted.select(
        "id", *counted, "candidates",
        F.inline(F.arrays_zip(F.col("stems").alias("s"), F.col("_hints").alias("h"))),
    ).select(
        "id", *counted, "candidates", "s.*", "h",
    )
    if not with_distractors:
        found = items.withColumn("distractors", F.array().cast("array<string>"))
    elif ranked:
        found = distractors.generate_distractors(
            stage_items(items), ["id", "pivot_pos"], "chunk", ASKED, vectors, ranker, n_words, dim, stage_pairs
        )
    else:
        found = distractors.generate_distractors(items, ["id", "pivot_pos"], "chunk", ASKED)
    wrong = once(found, _wrong=clean_distractors(F.col("distractors"), F.col("chunk")))
    pooled = once(wrong, _pool=option_pool(F.col("stem"), F.col("chunk"), F.col("_wrong"), seed))
    out = pooled.select(
        "id", "pivot_pos",
        F.col("stem").alias("question_stem"),
        F.col("chunk").alias("answer_chunk"),
        F.col("_pool.text").alias("options"),
        F.col("_pool.word").alias("option_words"),
        (F.array_position(F.col("_pool.right"), True) - 1).cast("int").alias("correct_idx"),
        F.transform("h", lambda t: X.mask_answer(t, F.col("chunk"))).alias("hints"),
    )
    if kmeans is None:
        return out.withColumn("cluster_id", F.lit(None).cast("int"))
    return with_clusters(out, terms, kmeans)


def with_clusters(items: DataFrame, terms: DataFrame, kmeans) -> DataFrame:
    rows = items.withColumn("uid", F.concat_ws(":", "id", "pivot_pos")).withColumn(
        "text", relational.cluster_text(F.col("question_stem"), F.col("answer_chunk"))
    )
    vectors = tfidf.tfidf_vectors(rows, terms, "uid")
    return clusters.assign(kmeans, vectors).drop("features", "uid")


def passage_status(articles: DataFrame, items: DataFrame) -> DataFrame:
    """``id, status, items``: blank, insufficient (no item could be made) or ok."""
    counts = items.groupBy("id").agg(F.count(F.lit(1)).alias("items"))
    return articles.select("id", "article").join(counts, "id", "left").select(
        "id",
        F.when(X.is_blank(F.col("article")), "blank")
        .when(F.col("items").isNull(), "insufficient").otherwise("ok").alias("status"),
        F.coalesce("items", F.lit(0)).alias("items"),
    )
