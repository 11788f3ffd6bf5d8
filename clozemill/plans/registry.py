"""The queries by name: each takes a session and a table folder, and reads whole tables."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.operators import (
    cells, cloze, clusters, cooccurrence, distractors, embeddings, lexicon, metrics, profile, relational, reports, sampling,
    similarity, tablemodels, tfidf, verifier,
)
from clozemill.operators.common import keyed, once, spread
from clozemill.plans import items as item_plan
from clozemill.plans import models
from clozemill.plans.quizview import documents
from clozemill.plans.quizview import quiz_view as derive_quiz
from clozemill.plans.stages import corpus, quiz_table, stage_path, stage_runs, staged, stored, vocabulary
from clozemill.session import shared_dir
from clozemill.sources.tables import materialise, read_quiz_csv_split
from clozemill.streaming import articles, latency, sessions

FLAGSHIP = "quiz_items"
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir).select("doc_id", "text"))


# ---- quiz table, splits, samples ------------------------------------------------


@query
def quiz_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_quiz(spark, sf_dir).select("id", "question", "A", "B", "C", "D", "answer")


@query
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query
def split_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("article_key"))
    return sampling.split_exact(docs, "doc_id", group_col="article_key").drop("article_key")


@query
def split_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_threshold(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.split_exact(documents(spark, sf_dir).select("doc_id"), "doc_id")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP3-SP5: seeded samples of three sizes, each below the size of the tables in the checks."""
    docs = documents(spark, sf_dir).select("doc_id")
    parts = [
        sampling.sample_exact(docs, k, "doc_id").select(F.lit(k).alias("k"), "doc_id")
        for k in (1, 100, 500)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    return sampling.first_rows(docs, 150, "doc_id")


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    ranked = sampling.two_level_rank(docs, "lang", "doc_id")
    return ranked.select("doc_id", "lang", F.pmod("rank", F.lit(3)).alias("fold"))


# ---- options and labels ---------------------------------------------------------


@query
def option_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unpivot_options(quiz_table(spark, sf_dir))


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.unpivot_options(quiz_table(spark, sf_dir))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def text_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = relational.unpivot_texts(quiz_table(spark, sf_dir))
    return cells.select(
        "id", "field", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("h")
    )


@query
def wrong_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz_table(spark, sf_dir).select(
        "id",
        relational.correct_option().alias("correct"),
        F.array_join(relational.wrong_options(), "|").alias("wrong"),
        relational.cluster_text().alias("cluster_text"),
        F.md5(relational.corpus_text()).alias("corpus_hash"),
        F.md5(
            relational.with_anchor(F.col("article"), relational.wrong_options())
        ).alias("anchored_hash"),
    )


# ---- profile --------------------------------------------------------------------


@query
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left"
    )
    return profile.column_profile(table).select("column", "type", "filled", "missing")


@query
def answer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.answer_distribution(quiz_table(spark, sf_dir))


@query
def wordcount_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = profile.length_histogram(_docs(spark, sf_dir), "text")
    return hist.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query
def wordcount_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = profile.length_density(_docs(spark, sf_dir), "text")
    return grid.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14: the 100 top words of 100 sampled passages."""
    docs = sampling.sample_exact(_docs(spark, sf_dir), 100, "doc_id")
    return profile.top_keywords(docs, "text")


# ---- text -----------------------------------------------------------------------


@query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")
    )


@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _docs(spark, sf_dir).select(F.explode(X.word_tokens(F.col("text"))).alias("token"))
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 1- and 2-grams per passage with their counts, summed up per passage."""
    runs = _docs(spark, sf_dir).select("doc_id", X.run_lengths(X.terms(F.col("text"))).alias("r"))
    return once(runs, s=F.struct(
        F.size("r").alias("n_terms"),
        F.aggregate("r", F.lit(0), lambda a, x: a + x["n"]).alias("n_grams"),
        F.aggregate("r", F.lit(0), lambda a, x: F.greatest(a, x["n"])).alias("max_tf"),
    )).select("doc_id", "s.*")


@query
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vocabulary(spark, sf_dir)
    return terms.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query
def tfidf_vocab_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1 with a cap that cuts through the terms of every table: the 300 most frequent ones."""
    train = quiz_table(spark, sf_dir).filter("split = 'train'")
    terms = tfidf.fit_tfidf(corpus(train), max_terms=300)
    return terms.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query
def blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2 on rows of which some have a blank or null article, question or right option."""
    def emptied(column: str, every: int):
        gone = F.when(F.pmod("id", F.lit(2 * every)) == 0, F.lit(None)).otherwise(F.lit(" \n\t"))
        return F.when(F.pmod("id", F.lit(every)) == 0, gone).otherwise(F.col(column)).alias(column)

    rows = quiz_table(spark, sf_dir).select(
        "id", emptied("article", 7), emptied("question", 5), emptied("A", 3), "B", "C", "D", "answer")
    asked = relational.with_question_text(rows).select("id", F.lit("question").alias("kept"))
    answered = relational.with_answer_text(rows).select("id", F.lit("answer").alias("kept"))
    return asked.unionByName(answered)


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf.tfidf_weights(corpus(quiz_table(spark, sf_dir)), vocabulary(spark, sf_dir))
    return weights.select("id", "term", F.round("w", 6).alias("w"))


# ---- sentence search, questions, hints ------------------------------------------


def _with_answer(quiz: DataFrame) -> DataFrame:
    return quiz.select("id", "article", relational.correct_option().alias("query"))


@query
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.best_sentence(
        _with_answer(quiz_table(spark, sf_dir)), vocabulary(spark, sf_dir)
    )
    return best.withColumn("sim", F.round("sim", 6))


@query
def cloze_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_answer(quiz_table(spark, sf_dir))
    found = cloze.extract_questions(rows, vocabulary(spark, sf_dir))
    return found.select("id", "pos", "stem", "chunk")


@query
def hints3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quiz_table(spark, sf_dir).select("id", "article", F.col("question").alias("query"))
    found = cloze.hints(rows, vocabulary(spark, sf_dir))
    return found.select("id", *[F.get("hints", F.lit(i)).alias(f"h{i + 1}") for i in range(3)])


@query
def hints_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_answer(quiz_table(spark, sf_dir))
    found = cloze.hints(rows, vocabulary(spark, sf_dir), n=5)
    return found.select("id", F.posexplode("hints").alias("rank", "hint"))


# ---- phrases --------------------------------------------------------------------


@query
def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tag_counts(_docs(spark, sf_dir))


@query
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.posexplode(
            X.candidate_phrases(X.tag_tokens(X.cased_tokens(F.col("text"))))
        ).alias("rank", "phrase"),
    )


@query
def key_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key chunk of every sentence of every passage."""
    rows = _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")
    )
    return rows.select(
        "doc_id", "pos", X.key_chunk(X.tag_tokens(X.cased_tokens(F.col("sentence")))).alias("chunk")
    )


@query
def mask_and_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8, T9, T11: the right option blanked and masked in its question, and cased."""
    rows = quiz_table(spark, sf_dir).withColumn("correct", relational.correct_option())
    return rows.select(
        "id",
        X.blank_first(F.col("question"), F.col("correct")).alias("blanked"),
        X.mask_answer(F.col("article"), F.col("correct")).alias("masked"),
        X.format_like(F.col("correct"), F.col("question")).alias("cased"),
    )


# ---- wrong options --------------------------------------------------------------


def _candidate_pairs(quiz: DataFrame) -> DataFrame:
    """``id, answer, cand, freq``; frequencies are counted before the candidates leave the row."""
    rows = distractors.with_candidates(quiz).select(
        "id", relational.correct_option().alias("answer"), F.lower("article").alias("low"),
        F.col("candidates").alias("cand"),
    )
    counted = once(rows, freq=distractors.frequencies(F.col("cand"), F.col("low")))
    pairs = counted.select("id", "answer", F.inline(F.arrays_zip("cand", "freq")))
    return pairs.filter(F.col("cand") != F.lower("answer"))


@query
def candidate_features_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _candidate_pairs(quiz_table(spark, sf_dir))
    char_match, _, len_diff = distractors.lexical_features(F.col("cand"), F.col("answer"), F.col("cand"))
    return pairs.select("id", "cand", F.round(char_match, 6).alias("char_match"), "freq", len_diff)


@query
def distractors_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distractors.with_candidates(quiz_table(spark, sf_dir)).withColumn(
        "answer", relational.correct_option()
    )
    made = distractors.generate_distractors(rows, ["id"])
    return made.select("id", F.array_join("distractors", "|").alias("distractors"))


# ---- vectors --------------------------------------------------------------------


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = embeddings.mean_vectors(_embeddings(spark, sf_dir), "label")
    return means.select("label", F.posexplode("mean").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _embeddings(spark, sf_dir).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    # All vectors ask most cells, so cells are as large as the blocks that meet, and blocks as large as a task can hold.
    seen = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    block = cells.large_block(seen["dim"] or 1)
    index = cells.build(points, stored, "vec_id", cells=max(1, -(-seen["n"] // block)), block=block)
    near = cells.search(points, index, 10, stored, "vec_id", exact=True)
    return near.select("q", "p", F.round("sim", 6).alias("sim"), "rank")


@query
def embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9 for a stated query set: every twentieth vector against all of them, exactly."""
    points = _embeddings(spark, sf_dir).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    asked = points.filter("vec_id % 20 = 0")
    near = embeddings.nearest(asked, points, 10, asked.count(), points.count(), "vec_id", "vec_id")
    return near.select("q", "p", F.round("sim", 6).alias("sim"), "rank")


@query
def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9 by cells: every twentieth vector against those of as many cells as a recall of 0.95 takes."""
    points = _embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("vector"))
    index = cells.build(points, stored, "vec_id")
    probes = cells.probes_for(index, 10, 0.95, stored) if index else cells.PROBES
    near = cells.search(points.filter("vec_id % 20 = 0"), index, 10, stored, "vec_id", probes=probes)
    return near.select("q", "p", F.round("sim", 6).alias("sim"), "rank")


@query
def embedding_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a second round over the cells that may still hold a nearer vector."""
    points = _embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("vector"))
    index = cells.build(points, stored, "vec_id")
    near = cells.search(points.filter("vec_id % 20 = 0"), index, 10, stored, "vec_id", exact=True)
    return near.select("q", "p", F.round("sim", 6).alias("sim"), "rank")


@query
def silhouette_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _embeddings(spark, sf_dir)
    sample = sampling.sample_exact(points, clusters.SAMPLE_ROWS, "vec_id")
    parts = clusters.silhouette_parts(sample, clusters.SAMPLE_ROWS, "vec_id", "embedding", "label")
    return parts.select(
        "id", "cluster_id", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"),
        F.round("s", 6).alias("s"),
    )


@query
def silhouette_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7, SP5 with a sample smaller than the table: 200 seeded vectors."""
    sample = sampling.sample_exact(_embeddings(spark, sf_dir), 200, "vec_id")
    parts = clusters.silhouette_parts(sample, 200, "vec_id", "embedding", "label", block=64)
    return parts.select("id", "cluster_id", *[F.round(c, 6).alias(c) for c in ("own", "other", "s")])


@query
def silhouette_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7: silhouette by squared distances for every vector, from the moments of the labels."""
    parts = clusters.moment_silhouette(_embeddings(spark, sf_dir), "vec_id", "embedding", "label")
    return parts.select("id", "cluster_id", *[F.round(c, 6).alias(c) for c in ("own", "other", "s")])


# ---- word windows, noun phrases by a lexicon table ----------------------------


def _word_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Window counts of the words that stand twice or more in the passages, and these words, as stage tables."""
    words = staged(spark, sf_dir, "window_words", lambda: cooccurrence.text_word_counts(_docs(spark, sf_dir)))
    table = staged(spark, sf_dir, "windows", lambda: cooccurrence.window_table(_docs(spark, sf_dir), words))
    return table, words


@query
def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: how often two words stand at most five places apart."""
    return cooccurrence.named_windows(*_word_windows(spark, sf_dir))


@query
def word_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: PMI of a word and a context, less the logarithm of 5 negative draws."""
    found = cooccurrence.windows_pmi(*_word_windows(spark, sf_dir), 5.0, stored)
    return found.select("word", "context", "n", F.round("pmi", 6).alias("pmi"))


@query
def word_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: vectors from the PMI table, with the vocabulary in tables only."""
    table, words = _word_windows(spark, sf_dir)
    made = staged(spark, sf_dir, "factors", lambda: cooccurrence.window_factors(table, words, 32, 5, stage=stored))
    return made.select("word", F.size("vector").alias("dim"), F.round(embeddings.norm(F.col("vector")), 6).alias("norm"))


@query
def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, T7: noun runs of every passage, nouns being the words of the benchmark texts."""
    words = lexicon.lexicon_from(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    tagged = lexicon.tagged_tokens(_docs(spark, sf_dir), stored(words), "doc_id")
    return lexicon.phrase_rows(tagged).where("tag = 'NN'").select(F.col("id").alias("doc_id"), "pos", "phrase")


@query
def lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, W5: the distinct phrases of every passage, proper nouns and listed nouns."""
    words = lexicon.lexicon_from(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    made = lexicon.candidate_phrases(_docs(spark, sf_dir), stored(words), "doc_id")
    return made.select(F.col("id").alias("doc_id"), F.size("candidates").alias("n"),
                       F.array_join("candidates", "|").alias("candidates"))


# ---- text metrics ---------------------------------------------------------------


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn (hypothesis) with the user turn that follows (reference)."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    hyp = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("hyp_text")
    )
    ref = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref_text"))
    return hyp.join(ref, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "hyp_text", "ref_text"
    )


@query
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(
        text_pairs(spark, sf_dir),
        hyp=X.word_tokens(F.col("hyp_text")), ref=X.word_tokens(F.col("ref_text")),
    )
    return metrics.ngram_overlap(rows).select(
        "id", *[f"{x}{n}" for n in range(1, 5) for x in "ohr"],
        F.round(metrics.bleu4(), 6).alias("bleu"),
    )


@query
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(
        text_pairs(spark, sf_dir),
        hyp=X.rouge_tokens(F.col("hyp_text")), ref=X.rouge_tokens(F.col("ref_text")),
    )
    return metrics.ngram_overlap(rows, max_n=2).select(
        "id", *[F.round(metrics.rouge_n(n), 6).alias(f"rouge{n}") for n in (1, 2)],
        *[F.round(metrics.rouge_n_recall(n), 6).alias(f"recall{n}") for n in (1, 2)],
    )


@query
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(
        text_pairs(spark, sf_dir),
        hyp=X.rouge_tokens(F.col("hyp_text")), ref=X.rouge_tokens(F.col("ref_text")),
    )
    return rows.select("id", F.round(metrics.rouge_l(F.col("hyp"), F.col("ref")), 6).alias("rougeL"))


@query
def meteor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(
        keyed(text_pairs(spark, sf_dir), "id"),
        hyp=X.word_tokens(F.col("hyp_text")), ref=X.word_tokens(F.col("ref_text")),
    )
    found = metrics.meteor(rows, stem=False)
    return found.select("id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


@query
def meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(
        text_pairs(spark, sf_dir),
        hyp=X.word_tokens(F.col("hyp_text")), ref=X.word_tokens(F.col("ref_text")),
    ).select("id", "hyp", "ref")
    found = metrics.meteor(keyed(metrics.with_stems(rows), "id"))
    return found.select("id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


# ---- reports --------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled passages with a fixed rule as the prediction."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("quality").alias("actual"), (F.col("n_chars") >= 1000).cast("int").alias("predicted")
    )


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion_matrix(_judged(spark, sf_dir))


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.classification_report(_judged(spark, sf_dir))
    return out.select(
        "name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


# ---- quiz items and sessions ----------------------------------------------------


@query
def quiz_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = item_plan.quiz_items(
        quiz_table(spark, sf_dir).select("id", "article"),
        vocabulary(spark, sf_dir),
        lambda df: staged(spark, sf_dir, "stems", lambda: df),
    )
    return made.select(
        "id", "pivot_pos", "question_stem", "answer_chunk",
        F.array_join("options", "|").alias("options"),
        F.array_join("option_words", "|").alias("option_words"),
        "correct_idx", F.array_join("hints", "|").alias("hints"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer log from the event table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*answer_columns())


def answer_columns() -> list:
    k = F.get_json_object("props", "$.k").cast("int")
    return [
        F.col("user_id").alias("session_id"), F.pmod("event_id", F.lit(5)).alias("q_idx"),
        F.pmod(k, F.lit(4)).alias("chosen"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    ]


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive quiz ids make one session."""
    return quiz_table(spark, sf_dir).select(
        F.floor(F.col("id") / 5).alias("session_id"), F.pmod("id", F.lit(5)).alias("q_idx"),
        F.col("question").alias("question_stem"), relational.correct_option().alias("answer_chunk"),
        F.array("A", "B", "C", "D").alias("options"),
        F.pmod("id", F.lit(4)).cast("int").alias("correct_idx"),
    )


@query
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = reports.first_answers(answers(spark, sf_dir))
    return first.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = reports.first_answers(answers(spark, sf_dir))
    return reports.session_scores(session_items(spark, sf_dir), first)


@query
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = reports.first_answers(answers(spark, sf_dir))
    return reports.session_log(session_items(spark, sf_dir), first)


# ---- evaluations ----------------------------------------------------------------


def _extraction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.with_question_text(quiz_table(spark, sf_dir).filter("split = 'val'"))
    rows = rows.select("id", "article", "question", relational.correct_option().alias("query"))
    found = cloze.extract_questions(rows, vocabulary(spark, sf_dir))
    return found.select("id", F.col("stem").alias("hyp_text"), F.col("question").alias("ref_text"))


def _option_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.with_answer_text(quiz_table(spark, sf_dir).filter("split = 'val'"))
    rows = distractors.with_candidates(rows).withColumn("correct", relational.correct_option())
    made = distractors.generate_distractors(rows, ["id"], "correct").filter(F.size("distractors") > 0)
    return made.select(
        "id",
        relational.with_anchor(F.col("article"), F.col("distractors")).alias("hyp_text"),
        relational.with_anchor(F.col("article"), relational.wrong_options()).alias("ref_text"),
    )


def _scores(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    """Stage table of both evaluations over the val rows."""

    def build() -> DataFrame:
        parts = []
        for name, pairs in (("extraction", _extraction_pairs), ("options", _option_pairs)):
            # the metrics read the pairs several times; the texts are made once
            made = staged(spark, sf_dir, f"pairs_{name}", lambda: pairs(spark, sf_dir))
            tokens = f"tokens_{name}_{'stem' if stem else 'plain'}"
            scored = metrics.text_scores(
                made, stem=stem, stage=lambda df: staged(spark, sf_dir, tokens, lambda: df))
            parts.append(metrics.mean_scores(scored, name))
        return parts[0].unionByName(parts[1])

    return staged(spark, sf_dir, f"scores_{'stem' if stem else 'plain'}", build)


@query
def evaluation_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6 without stemming: mean BLEU, ROUGE-1/2, METEOR over the val rows."""
    out = _scores(spark, sf_dir, False).filter("metric <> 'ROUGE-L'")
    return out.withColumn("value", F.round("value", 6))


@query
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6 in full, with stems and ROUGE-L."""
    return _scores(spark, sf_dir, True).withColumn("value", F.round("value", 6))


@query
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_report(_scores(spark, sf_dir, False).filter("metric <> 'ROUGE-L'"))


@query
def score_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15: the three forms in which shares and scores are shown."""
    k = F.get_json_object("props", "$.k").cast("int") / 99
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", X.percent_number(k).alias("pct"), X.percent_text(k).alias("pct_text"),
        X.score_text(k).alias("score_text"),
    )


# ---- learned models -------------------------------------------------------------


@query
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = models.word_vectors(spark, sf_dir)
    return vectors.select("word", F.size("vector").alias("dim"), F.round(embeddings.norm(F.col("vector")), 6).alias("norm"))


@query
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, n = models.word_vectors(spark, sf_dir)
    asked = quiz_table(spark, sf_dir).select(
        "id", "article", relational.correct_option().alias("answer")
    )
    # Words have few close neighbours: most cells are asked, as in `embedding_knn`.
    block = cells.large_block(models.DIM)
    index = cells.build(vectors, stored, "word", cells=max(1, -(-n // block)), block=block)
    return embeddings.nearest_words(asked, vectors, n, index, stored, dim=models.DIM)


@query
def distractors_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, n = models.word_vectors(spark, sf_dir)
    rows = distractors.with_candidates(quiz_table(spark, sf_dir)).withColumn(
        "correct", relational.correct_option()
    )
    made = distractors.generate_distractors(
        rows, ["id"], "correct", 3, vectors, models.ranker(spark, sf_dir), n, models.DIM, stored
    )
    return made.select("id", F.array_join("distractors", "|").alias("distractors"))


@query
def ranked_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7: three best per key by probability, equal ones by text descending."""
    scored = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id",
        F.concat_ws("-", "event_type", "event_id").alias("cand"),
        (F.get_json_object("props", "$.k").cast("int") / 99).alias("prob"),
    )
    best = distractors.top_ranked(scored, ["user_id"], 3)
    return best.select("user_id", "cand", F.round("prob", 6).alias("prob"), "rank")


@query
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5: mean of two class-1 probabilities, a tie is 0."""
    k = F.get_json_object("props", "$.k").cast("int")
    first, second = F.pmod("event_id", F.lit(100)) / 99, k / 99
    label, mean = verifier.vote([first, second])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", label.alias("predicted"), F.round(mean, 6).alias("probability")
    )


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifier.evaluate(
        models.answer_verifier(spark, sf_dir), models.val_rows(spark, sf_dir), vocabulary(spark, sf_dir)
    )


@query
def verifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select(
        "id", "opt", "label", "predicted", F.round("probability", 6).alias("probability")
    )


@query
def verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.classification_report(_verified(spark, sf_dir), "label", "predicted")


@query
def verifier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion_matrix(_verified(spark, sf_dir), "label", "predicted")


@query
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = models.kmeans(spark, sf_dir)
    rows = models.cluster_vectors(spark, sf_dir, quiz_table(spark, sf_dir))
    return clusters.assign(model, rows).select("id", "cluster_id")


@query
def kmeans_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia and silhouette of the stored model over all train rows, as a score table."""

    def build() -> DataFrame:
        model, _ = models.kmeans(spark, sf_dir, sampled=False)
        train = models.train_rows(spark, sf_dir)
        placed = stored(clusters.assign(model, models.cluster_vectors(spark, sf_dir, train)))
        quality = clusters.silhouette(placed, vector="features").select(
            F.lit("Silhouette Score").alias("metric"), F.col("silhouette").alias("value"))
        rows = train.select(F.col("id").alias("uid"), relational.cluster_text().alias("text"))
        weights = tfidf.unit_weights(rows, vocabulary(spark, sf_dir), "uid")
        near = tablemodels.nearest_centre(rows.select("uid"), weights, tablemodels.centre_table(spark, model))
        inertia = tablemodels.cluster_inertia(near).agg(F.sum("inertia").alias("value")).select(
            F.lit("Inertia").alias("metric"), "value")
        return quality.unionByName(inertia).select(F.lit("extraction").alias("pipeline"), "metric", "value")

    return staged(spark, sf_dir, "kmeans_scores", build)


# ---- models as tables, with coefficients by a rule over the vocabulary -----------


def _digest(text, salt: str, digits: int = 4):
    """A whole number from the first hexadecimal digits of a salted md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, digits), 16, 10).cast("long")


def _rule_voters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = vocabulary(spark, sf_dir).select("term_id", "term")
    one, two = ((F.pmod(_digest(F.col("term"), f"v{k}:"), F.lit(2001)) - 1000) / 250 for k in (0, 1))
    rows = F.array(F.struct(F.lit(0).alias("voter"), one.alias("weight")), F.struct(F.lit(1).alias("voter"), two.alias("weight")))
    return terms.select("term_id", F.inline(rows)), spark.createDataFrame([(0, -0.5), (1, 0.25)], "voter int, intercept double")


def _table_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        options = relational.unpivot_options(quiz_table(spark, sf_dir)).withColumn("uid", F.concat_ws(":", "id", "opt"))
        weights = tfidf.unit_weights(options, vocabulary(spark, sf_dir), "uid")
        return tablemodels.vote_scores(options.drop("text"), weights, *_rule_voters(spark, sf_dir))

    return staged(spark, sf_dir, "table_votes", build)


@query
def verifier_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3-ML5 as tables: both voters and the vote for every option of the quiz."""
    return _table_votes(spark, sf_dir).select(
        "id", "opt", "label", "predicted", F.round("probability", 6).alias("probability"),
        *[F.round(F.col("probabilities")[k], 6).alias(f"p{k}") for k in (0, 1)])


@query
def verifier_table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML15 over the same scores."""
    made = reports.classification_report(_table_votes(spark, sf_dir), "label", "predicted")
    return made.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def kmeans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6, A7 as tables: nearest of ten stored centres for every question, rows and inertia by cluster."""
    # The 200 most frequent terms, dealt to the centres in turn, so that shared terms decide.
    terms = vocabulary(spark, sf_dir).orderBy(F.desc("cf"), "term").limit(200)
    place = F.row_number().over(W.orderBy(F.desc("cf"), "term"))
    centres = terms.select("term_id", F.pmod(place, F.lit(10)).alias("cluster_id"), (0.1 + place / 1000).alias("value"))
    rows = quiz_table(spark, sf_dir).select(F.col("id").alias("uid"), relational.cluster_text().alias("text"))
    weights = tfidf.unit_weights(rows, vocabulary(spark, sf_dir), "uid")
    placed = tablemodels.nearest_centre(rows.select("uid"), weights, centres)
    return tablemodels.cluster_inertia(placed).select("cluster_id", "n", F.round("inertia", 6).alias("inertia"))


def _rule_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, vector`` of eight numbers by a rule for every word of the passages that stands twice or more."""

    def build() -> DataFrame:
        digit = [(F.conv(F.substring(F.md5("word"), k + 1, 1), 16, 10).cast("double") - 7.5).alias(f"d{k}") for k in range(8)]
        words = cooccurrence.text_word_counts(_docs(spark, sf_dir))
        return words.select("word", F.array(*digit).alias("vector"))

    return staged(spark, sf_dir, "rule_vectors", build)


def _ruled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _rule_vectors(spark, sf_dir)
    pairs = _candidate_pairs(quiz_table(spark, sf_dir))
    return distractors.candidate_features(pairs, vectors, ["id"], vectors.count(), 8, stored)


@query
def candidate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, A15, ML10: cosine of a candidate's and an answer's mean vector, for vectors by a rule."""
    return _ruled_pairs(spark, sf_dir).select("id", "cand", F.round("sim", 6).alias("sim"))


@query
def ranked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11, ML12, W7: the three best candidates of every question by a ranker that is a table."""
    ranker = spark.createDataFrame(
        [("intercept", -0.3), ("sim", 1.7), ("char_match", 0.9), ("freq", 0.05), ("len_diff", -0.11)],
        "feature string, weight double")
    scored = tablemodels.rank_scores(_ruled_pairs(spark, sf_dir), ranker, distractors.FEATURES).withColumn(
        "prob", F.round("prob", 9))
    best = distractors.top_ranked(scored.select("id", "cand", "prob"), ["id"], 3)
    return best.select("id", "cand", F.round("prob", 6).alias("prob"), "rank")


@query
def quiz_items_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML16 with every model: ranked wrong options and cluster ids."""
    quiz_table(spark, sf_dir)
    # Neither needs the other: the short jobs of the clusters fill cores that the vectors leave free.
    with ThreadPool(2) as pool:
        found = [
            pool.apply_async(inheritable_thread_target(spark)(f), (spark, sf_dir)) for f in (models.word_vectors, models.kmeans)]
        (vectors, n), (kmeans, _) = (x.get() for x in found)
    made = item_plan.quiz_items(
        quiz_table(spark, sf_dir).select("id", "article"),
        vocabulary(spark, sf_dir),
        lambda df: staged(spark, sf_dir, "stems", lambda: df),
        vectors=vectors, n_words=n, dim=models.DIM, ranker=models.ranker(spark, sf_dir),
        kmeans=kmeans,
        stage_items=lambda df: staged(spark, sf_dir, "items_asked", lambda: df),
        stage_pairs=lambda df: staged(spark, sf_dir, "item_pairs", lambda: df),
    )
    return made.select(
        "id", "pivot_pos", "question_stem", "answer_chunk",
        F.array_join("option_words", "|").alias("option_words"), "correct_idx", "cluster_id",
    )


@query
def passage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 over every passage of the table, in any language."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("article"))
    stems = item_plan.passage_stems(docs, vocabulary(spark, sf_dir))
    found = stems.select("id", F.explode("stems"))
    return item_plan.passage_status(docs, found)


# ---- streams --------------------------------------------------------------------


def _run_dir(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"{spark.sparkContext.applicationId}/streams/{name}-{uuid.uuid4().hex}")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return sessions.read_stream(spark, f"{sf_dir}/events*.parquet", schema).select(*answer_columns())


@query
def answers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: first answer per session and question, from the event stream; state ends after 60 days."""
    out = _run_dir(spark, "answers")
    events = _event_stream(spark, sf_dir).withColumn("kind", F.lit("answer")).withWatermark("ts", "1 hour")
    sessions.run_to_table(sessions.first_answers(events, forget="60 days"), f"{out}/table", f"{out}/progress")
    return spark.read.parquet(f"{out}/table").select(
        "session_id", "q_idx", "chosen", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")
    )


@query
def windowed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: answers and right answers per day, for the days the watermark has closed."""
    out = _run_dir(spark, "windows")
    marked = _event_stream(spark, sf_dir).withColumn("correct_idx", F.pmod("session_id", F.lit(4)).cast("int"))
    sessions.run_to_table(sessions.windowed_accuracy(marked), f"{out}/table", f"{out}/progress")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return spark.read.parquet(f"{out}/table").select(
        F.date_format("start", stamp).alias("start"), F.date_format("end", stamp).alias("end"),
        "answers", "correct",
    )


@query
def answers_resets_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 with resets: every fiftieth event resets its session; state ends after 60 days."""
    out = _run_dir(spark, "resets")
    events = _event_stream(spark, sf_dir).withColumn(
        "kind", F.when(F.pmod("event_id", F.lit(50)) == 0, "reset").otherwise("answer")
    ).withWatermark("ts", "1 hour")
    made = sessions.first_answers(events, forget="60 days")
    sessions.run_to_table(made, f"{out}/table", f"{out}/progress")
    return spark.read.parquet(f"{out}/table").select("session_id", "q_idx", "epoch", "chosen", "event_id")


def _windows(spark: SparkSession, sf_dir: str, name: str, **kind) -> DataFrame:
    out = _run_dir(spark, name)
    marked = _event_stream(spark, sf_dir).withColumn("correct_idx", F.pmod("session_id", F.lit(4)).cast("int"))
    sessions.run_to_table(sessions.windowed_accuracy(marked, **kind), f"{out}/table", f"{out}/progress")
    made = spark.read.parquet(f"{out}/table")
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")]
    return made.select(*stamps, *[c for c in made.columns if c not in ("start", "end")])


@query
def windowed_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: days that begin every twelve hours."""
    return _windows(spark, sf_dir, "sliding", window="1 day", slide="12 hours")


@query
def windowed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: per session, windows that end after six hours without an answer."""
    return _windows(spark, sf_dir, "gaps", gap="6 hours")


def _items_run(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Items of passages that arrive as files, with the times of the batches."""
    terms = vocabulary(spark, sf_dir)
    source = stage_path(spark, sf_dir, "quiz")
    passages = sessions.read_stream(spark, source, quiz_table(spark, sf_dir).schema).select("id", "article")

    def job(batch: DataFrame, batch_id: int) -> DataFrame:
        stems = f"{out}/stems/{batch_id}"
        return item_plan.quiz_items(
            batch, terms, lambda df: materialise(spark, stems, lambda: df, force=True)
        )

    with latency.timed_batches(spark, f"{out}/runs"):
        articles.run_batches(passages, job, f"{out}/table", f"{out}/progress")


@query
def items_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: items of passages that arrive as files."""
    out = _run_dir(spark, "items")
    _items_run(spark, sf_dir, out)
    made = spark.read.parquet(f"{out}/table")
    return made.select(
        "id", "pivot_pos", "question_stem", "answer_chunk",
        F.array_join("options", "|").alias("options"),
        F.array_join("option_words", "|").alias("option_words"),
        "correct_idx", F.array_join("hints", "|").alias("hints"),
    )


@query
def items_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18: passages per batch of the item stream, from the run table its listener fills."""
    out = _run_dir(spark, "items")
    _items_run(spark, sf_dir, out)
    runs = latency.read_runs(spark, f"{out}/runs")
    return runs.select("batch", "rows", ((F.col("ms") > 0) & (F.col("add_ms") <= F.col("ms"))).alias("timed"))


@query
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, S3: rows of the batch stages, from the records of their artefacts."""
    quiz_table(spark, sf_dir)
    vocabulary(spark, sf_dir)
    return stage_runs(spark, sf_dir, ["quiz_raw", "quiz", "terms"]).select("stage", "rows")


@query
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2: the quiz table written as CSV files and read again split by split."""
    path = f"{_run_dir(spark, 'csv')}/quiz"
    rows = quiz_table(spark, sf_dir).select("article", "question", *"ABCD", "answer")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = read_quiz_csv_split(spark, path, stage=stored)
    return back.select(F.md5("article").alias("article"), "question", *"ABCD", "answer")


@query
def verifier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: verifier probability of question and option pairs that arrive as files."""
    out = _run_dir(spark, "verifier")
    model, terms = models.answer_verifier(spark, sf_dir), vocabulary(spark, sf_dir)
    source = stage_path(spark, sf_dir, "quiz")
    rows = sessions.read_stream(spark, source, quiz_table(spark, sf_dir).schema)
    articles.run_batches(
        rows, lambda batch, _: verifier.evaluate(model, batch, terms), f"{out}/table", f"{out}/progress"
    )
    return spark.read.parquet(f"{out}/table").select(
        "id", "opt", "predicted", F.round("probability", 6).alias("probability")
    )


@query
def kmeans_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: mini-batch clusters of questions that arrive as files."""
    out = _run_dir(spark, "kmeans")
    terms = vocabulary(spark, sf_dir)
    source = stage_path(spark, sf_dir, "quiz")
    model = articles.MiniBatchKMeans(spark, f"{out}/centres")
    rows = sessions.read_stream(
        spark, source, quiz_table(spark, sf_dir).schema, files_per_batch=4
    ).select(F.col("id").alias("uid"), relational.cluster_text().alias("text"))
    articles.run_batches(
        rows, lambda batch, i: model.step(batch, terms, i), f"{out}/table", f"{out}/progress"
    )
    return spark.read.parquet(f"{out}/table").select("uid", "cluster_id")
