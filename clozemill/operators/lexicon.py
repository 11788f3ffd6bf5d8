"""Noun phrases with a noun list that is a table: token rows joined to it, runs rebuilt by gaps and islands.

A token is a proper noun (NNP) by the capital rule, else a noun (NN) if the lexicon has it in lower case. Only tagged
tokens leave the join, so what is shuffled are nouns, by document. The lexicon is broadcast only if its counted
rows fit the limit; beyond it the token rows meet it by word, and adaptive execution splits frequent words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.operators.common import once, small


def lexicon_from(texts: DataFrame, text: str = "text", min_length: int = 4, min_count: int = 1) -> DataFrame:
    """``word``: the distinct lower-case words of a table of texts, no stop words."""
    words = texts.select(F.explode(X.term_tokens(F.col(text))).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("word")


def tagged_tokens(docs: DataFrame, lexicon: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """``id, pos, token, tag`` of the tokens that are nouns of either kind. Null texts have no tokens."""
    n_words = lexicon.count()
    rows = docs.select(F.col(id_column).alias("id"), F.posexplode(X.cased_tokens(F.col(text))).alias("pos", "token"))
    rows = once(rows, word=F.lower("token"), proper=X.is_proper(F.col("token")))
    listed = small(lexicon.select(F.col("word").alias("_word")).distinct().withColumn("_noun", F.lit(True)), n_words)
    found = rows.join(listed, F.col("word") == F.col("_word"), "left")
    tag = F.when(F.col("proper"), "NNP").when(F.col("_noun"), "NN")
    return found.select("id", "pos", "token", tag.alias("tag")).where(F.col("tag").isNotNull())


def phrase_rows(tagged: DataFrame) -> DataFrame:
    """``id, pos, tag, phrase``: maximal runs of neighbouring tokens of one tag, in lower case.

    Neighbours differ from their place among the document's tokens of the tag by the same number."""
    place = F.row_number().over(W.partitionBy("id", "tag").orderBy("pos"))
    runs = tagged.withColumn("island", F.col("pos") - place).groupBy("id", "tag", "island")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return runs.agg(F.min("pos").alias("pos"), F.lower(joined).alias("phrase")).select("id", "pos", "tag", "phrase")


def candidate_phrases(docs: DataFrame, lexicon: DataFrame, id_column: str = "id", text: str = "text",
                      min_length: int = 3) -> DataFrame:
    """``id, candidates``: distinct phrases of ``min_length`` or more by first position, [] where there are none.

    Ids are unique; a null id gets no candidates."""
    runs = phrase_rows(tagged_tokens(docs, lexicon, id_column, text)).where(F.length("phrase") >= min_length)
    packed = runs.groupBy("id").agg(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "phrase"))), lambda x: x["phrase"])).alias("candidates"))
    return docs.select(F.col(id_column).alias("id")).join(packed, "id", "left").withColumn(
        "candidates", F.coalesce("candidates", F.array().cast("array<string>")))
