"""Confusion matrix, classification report, session scores and session log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``actual, pred_0, pred_1``, both rows present."""
    cells = df.agg(*[
        F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)
    ])
    return cells.select(F.inline(F.array(*[
        F.struct(
            F.lit(a).alias("actual"), F.col(f"c{a}0").alias("pred_0"), F.col(f"c{a}1").alias("pred_1")
        )
        for a in (0, 1)
    ])))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_report(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """``name, precision, recall, f1, support``: both classes, accuracy (as f1), macro
    and weighted average. One aggregation; divisions by zero count as 0."""
    a, p = F.col(actual), F.col(predicted)
    c = df.agg(
        *[F.count_if((a == k) & (p == k)).alias(f"tp{k}") for k in (0, 1)],
        *[F.count_if(p == k).alias(f"pp{k}") for k in (0, 1)],
        *[F.count_if(a == k).alias(f"s{k}") for k in (0, 1)],
    )
    for k in (0, 1):
        c = c.withColumn(f"p{k}", _ratio(F.col(f"tp{k}"), F.col(f"pp{k}"))).withColumn(
            f"r{k}", _ratio(F.col(f"tp{k}"), F.col(f"s{k}"))
        ).withColumn(f"f{k}", _ratio(2 * F.col(f"tp{k}"), F.col(f"pp{k}") + F.col(f"s{k}")))
    n = F.col("s0") + F.col("s1")
    accuracy = _ratio(F.col("tp0") + F.col("tp1"), n)

    def row(name, precision, recall, f1, support) -> Column:
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def mean(x: str, weighted: bool) -> Column:
        if weighted:
            return _ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), n)
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    rows = [
        row(name, F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}"))
        for k, name in enumerate(("Incorrect", "Correct"))
    ]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, n))
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        rows.append(row(name, mean("p", weighted), mean("r", weighted), mean("f", weighted), n))
    return c.select(F.inline(F.array(*rows)))


def first_answers(answers: DataFrame) -> DataFrame:
    """``session_id, q_idx, chosen, ts``: the first answer counts (by time, then event)."""
    return (
        answers.groupBy("session_id", "q_idx")
        .agg(F.min(F.struct("ts", "event_id", "chosen")).alias("_f"))
        .select("session_id", "q_idx", F.col("_f.chosen").alias("chosen"), F.col("_f.ts").alias("ts"))
    )


def session_log(items: DataFrame, first: DataFrame) -> DataFrame:
    """One row per item with the user's choice; ``items`` holds ``session_id, q_idx,
    question_stem, answer_chunk, options, correct_idx``."""
    joined = items.join(first.select("session_id", "q_idx", "chosen"), ["session_id", "q_idx"], "left")
    return joined.select(
        "session_id", "q_idx",
        F.col("question_stem").alias("Question"),
        F.col("answer_chunk").alias("Correct Answer"),
        F.coalesce(F.get("options", F.col("chosen")), F.lit("N/A")).alias("User Choice"),
        F.coalesce(F.col("chosen") == F.col("correct_idx"), F.lit(False)).alias("Is Correct"),
    )


def session_scores(items: DataFrame, first: DataFrame) -> DataFrame:
    """``session_id, total, answered, correct, pct, complete`` per session."""
    joined = items.select("session_id", "q_idx", "correct_idx").join(
        first.select("session_id", "q_idx", "chosen"), ["session_id", "q_idx"], "left"
    )
    sums = joined.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("chosen").alias("answered"),
        F.count_if(F.col("chosen") == F.col("correct_idx")).alias("correct"),
    )
    return sums.withColumn("pct", percentage(F.col("correct"), F.col("total"))).withColumn(
        "complete", F.col("answered") == F.col("total")
    )


def percentage(count: Column, total: Column) -> Column:
    """Whole percent, cut off; 0 of nothing is 0."""
    return F.coalesce(F.floor(100 * count / F.nullif(total, F.lit(0))), F.lit(0)).cast("int")
