"""BLEU, ROUGE and METEOR over a table of (key, hypothesis, reference) rows.

N-grams are counted in Arrow batches where the pairs stand. For METEOR the pairs are exchanged once by key; alignments are
aggregates and windows on that partitioning.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clozemill.functions import text as X
from clozemill.functions.arrow import greedy_pairs, lcs_length, stem_tokens
from clozemill.operators.common import keyed, once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _overlaps(hyp: pa.Array, ref: pa.Array, max_n: int) -> list[np.ndarray]:
    """Clipped common n-grams of each pair for n = 1 to ``max_n``; exact, grams are numbered and not hashed."""
    rows = len(hyp)
    size = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (hyp, ref)])
    words = pa.chunked_array([hyp.flatten(), ref.flatten()]).combine_chunks().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = len(words.dictionary) + 1
    text = np.repeat(np.arange(2 * rows), size)
    gram, out = code, []
    for n in range(1, max_n + 1):
        if n > 1:
            # A gram and the word behind it, where both are of one text.
            whole, follow = text[:-(n - 1)] == text[n - 1:], code[n - 1:]
            gram = np.unique(gram[:-1] * kinds + follow, return_inverse=True)[1] if len(gram) > 1 else gram[:0]
        else:
            whole = np.ones(len(gram), bool)
        owner = text[:len(gram)]
        span = int(gram.max(initial=0)) + 1
        left, right = ((owner < rows) & whole, (owner >= rows) & whole)
        a, na = np.unique(owner[left] * span + gram[left], return_counts=True)
        b, nb = np.unique((owner[right] - rows) * span + gram[right], return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        out.append(np.bincount(both // span, np.minimum(na[i], nb[j]), rows).astype(np.int64))
    return out


def ngram_overlap(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "id", max_n: int = 4
) -> DataFrame:
    """``key`` and per n: ``o{n}`` clipped common n-grams, ``h{n}``, ``r{n}`` all n-grams.

    ``hyp`` and ``ref`` are token arrays. A pair is counted where it stands, many pairs at a time, so nothing
    is shuffled and a long text costs its row only. Two empty sides give zeros.
    """
    names = [f"o{n}" for n in range(1, max_n + 1)]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _overlaps(part.column(3), part.column(4), max_n)
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), *map(pa.array, found)],
                                      names=["key", "nh", "nr", *names])

    kind = pairs.schema[key].dataType.simpleString()
    sized = pairs.select(F.col(key).alias("key"), F.size(hyp).alias("nh"), F.size(ref).alias("nr"), hyp, ref)
    made = sized.mapInArrow(work, f"key {kind}, nh int, nr int, " + ", ".join(f"{c} long" for c in names))
    return made.select(F.col("key").alias(key), *[c for n in range(1, max_n + 1) for c in (
        F.col(f"o{n}"), F.greatest(F.col("nh") - (n - 1), F.lit(0)).cast("long").alias(f"h{n}"),
        F.greatest(F.col("nr") - (n - 1), F.lit(0)).cast("long").alias(f"r{n}"))])


def bleu4() -> Column:
    """BLEU-4 from :func:`ngram_overlap`: one reference, zero counts of order 2 and up
    smoothed to 0.1, no common word or an empty hypothesis gives 0."""
    logs = [
        F.log(
            F.when(F.col(f"o{n}") > 0, F.col(f"o{n}").cast("double")).otherwise(F.lit(0.1))
            / F.greatest(F.col(f"h{n}"), F.lit(1))
        )
        for n in range(1, 5)
    ]
    brevity = F.when(F.col("h1") > F.col("r1"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("r1") / F.nullif(F.col("h1"), F.lit(0)))
    )
    score = brevity * F.exp(reduce(lambda a, b: a + b, logs) / 4)
    return F.when((F.col("h1") == 0) | (F.col("o1") == 0), F.lit(0.0)).otherwise(score)


def f_measure(common: Column, n_hyp: Column, n_ref: Column) -> Column:
    """Harmonic mean of precision and recall; 0 when nothing is common."""
    return F.when(common > 0, 2.0 * common / (n_hyp + n_ref)).otherwise(F.lit(0.0))


def rouge_n(n: int) -> Column:
    return f_measure(F.col(f"o{n}"), F.col(f"h{n}"), F.col(f"r{n}"))


def rouge_n_recall(n: int) -> Column:
    return F.coalesce(F.col(f"o{n}") / F.nullif(F.col(f"r{n}"), F.lit(0)), F.lit(0.0))


def rouge_l(hyp: Column, ref: Column) -> Column:
    return f_measure(lcs_length(hyp, ref), F.size(hyp), F.size(ref))


def _pair_up(tokens: DataFrame, key: str, stage: str, by: str, free: Column) -> DataFrame:
    """Mark the rows of ``tokens`` for which ``free`` holds and that find a partner with
    the same ``by`` on the other side, the last with the last and so on. Adds ``stage_k``
    (place from the right) and ``stage_ok``."""
    group = [F.col(key), free, F.col(by)]
    place = F.row_number().over(W.partitionBy(*group, F.col("side")).orderBy(F.desc("pos")))
    of_side = [F.count_if(F.col("side") == s).over(W.partitionBy(*group)) for s in (0, 1)]
    return tokens.withColumn(f"{stage}_k", place).withColumn(
        f"{stage}_ok", free & (F.col(f"{stage}_k") <= F.least(*of_side))
    )


def with_stems(pairs: DataFrame, longer_than: int = 0, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Add ``hyp_stem, ref_stem``. Do this before the rows are keyed: a Python step does
    not keep the partitioning."""
    return once(
        pairs,
        **{f"{c}_stem": stem_tokens(F.col(c), longer_than) for c in (hyp, ref)},
    )


def meteor(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "id",
    stem: bool = True, synonyms: DataFrame | None = None,
    alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5,
) -> DataFrame:
    """``key, matches, chunks, meteor``: tokens are aligned by identity, then by stem
    (columns of :func:`with_stems`), then through the optional table
    ``synonyms(word, synonym)``."""
    stems = [F.col(f"{c}_stem") if stem else F.col(c) for c in (hyp, ref)]
    rows = pairs.select(key, hyp, ref, stems[0].alias("_hs"), stems[1].alias("_rs"))

    def side(tokens: str, stemmed: str, which: int) -> Column:
        return F.transform(
            F.arrays_zip(F.col(tokens).alias("token"), F.col(stemmed).alias("stem")),
            lambda t, i: F.struct(
                F.lit(which).alias("side"), i.alias("pos"), t["token"].alias("token"),
                t["stem"].alias("stem"),
            ),
        )

    flat = rows.select(
        key, F.inline_outer(F.concat(side(hyp, "_hs", 0), side(ref, "_rs", 1)))
    )
    aligned = _pair_up(flat, key, "exact", "token", F.lit(True))
    matched, label, place = F.col("exact_ok"), F.col("token"), F.col("exact_k")
    if stem:
        aligned = _pair_up(aligned, key, "stem", "stem", ~F.col("exact_ok"))
        label = F.when(matched, label).otherwise(F.col("stem"))
        place = F.when(matched, place).otherwise(-F.col("stem_k"))
        matched = matched | F.col("stem_ok")
    # one row per partner pair, and one (without place) for what is left of each text
    of_side = [F.col("side") == s for s in (0, 1)]
    found = (
        aligned.groupBy(key, F.when(matched, label).alias("_label"), F.when(matched, place).alias("_place"))
        .agg(
            *[F.max(F.when(s, F.col("pos"))).alias(c) for s, c in zip(of_side, "hr")],
            *[F.count_if(s).alias(c) for s, c in zip(of_side, ("n_h", "n_r"))],
        )
        .select(key, F.col("_place").isNotNull().alias("pair"), "h", "r", "n_h", "n_r")
    )
    if synonyms is not None:
        rest = aligned.filter(~matched)
        h = rest.filter("side = 0").select(key, F.col("pos").alias("h"), F.col("token").alias("word"))
        r = rest.filter("side = 1").select(key, F.col("pos").alias("r"), F.col("token").alias("synonym"))
        edges = h.join(synonyms, "word").join(r, [key, "synonym"]).select(key, "h", "r").distinct()
        grouped = edges.groupBy(key).agg(F.collect_list(F.struct("h", "r")).alias("_e"))
        more = grouped.select(key, F.lit(True).alias("pair"), F.inline(greedy_pairs(F.col("_e"))))
        none = F.lit(0).cast("long")
        found = found.unionByName(more.withColumns({"n_h": none, "n_r": none}))
    order = W.partitionBy(key, "pair").orderBy("h")
    step = (F.col("h") - F.lag("h").over(order) == 1) & (F.col("r") - F.lag("r").over(order) == 1)
    starts = found.withColumn("_new", F.col("pair") & ~F.coalesce(step, F.lit(False)))
    summed = starts.groupBy(key).agg(
        F.count_if("pair").alias("matches"), F.count_if("_new").alias("chunks"),
        F.sum("n_h").alias("n_h"), F.sum("n_r").alias("n_r"),
    )
    m = F.col("matches").cast("double")
    precision, recall = m / F.nullif("n_h", F.lit(0)), m / F.nullif("n_r", F.lit(0))
    f_mean = precision * recall / F.nullif(alpha * precision + (1 - alpha) * recall, F.lit(0.0))
    penalty = gamma * F.pow(F.col("chunks") / F.nullif(m, F.lit(0.0)), F.lit(beta))
    return summed.select(
        key, "matches", "chunks",
        F.when(m > 0, f_mean * (1 - penalty)).otherwise(F.lit(0.0)).alias("meteor"),
    )


def text_scores(
    pairs: DataFrame, hyp: str = "hyp_text", ref: str = "ref_text", key: str = "id",
    stem: bool = True, synonyms: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """``key, bleu, rouge1, rouge2, rougeL, meteor`` for two text columns.

    The four metrics read the token table separately; ``stage`` stores it, so that stems
    and subsequences are computed once and each metric reads only its columns.
    """
    rows = once(
        pairs.select(key, hyp, ref),
        hyp=X.word_tokens(F.col(hyp)), ref=X.word_tokens(F.col(ref)),
        rh=X.rouge_tokens(F.col(hyp)), rr=X.rouge_tokens(F.col(ref)),
    ).select(key, "hyp", "ref", "rh", "rr")
    rh, rr = F.col("rh"), F.col("rr")
    if stem:
        rows = once(
            rows, hyp_stem=stem_tokens(F.col("hyp")), ref_stem=stem_tokens(F.col("ref")),
            rh_stem=stem_tokens(rh, 3), rr_stem=stem_tokens(rr, 3),
        )
        rows = rows.drop("rh", "rr").withColumnsRenamed({"rh_stem": "rh", "rr_stem": "rr"})
    rows = keyed(stage(once(rows, rougeL=rouge_l(rh, rr))), key)
    bleu = ngram_overlap(rows, key=key).select(key, bleu4().alias("bleu"))
    rouge = ngram_overlap(rows, "rh", "rr", key, 2).select(
        key, rouge_n(1).alias("rouge1"), rouge_n(2).alias("rouge2")
    )
    met = meteor(rows, key=key, stem=stem, synonyms=synonyms).select(key, "meteor")
    return bleu.join(rouge, key).join(rows.select(key, "rougeL"), key).join(met, key)


# Fixed values. Metric names of the score table.
METRIC_NAMES = {
    "bleu": "BLEU", "rouge1": "ROUGE-1", "rouge2": "ROUGE-2", "rougeL": "ROUGE-L",
    "meteor": "METEOR",
}


def mean_scores(scores: DataFrame, pipeline: str) -> DataFrame:
    """``pipeline, metric, value``: means over the rows, 0 for no rows."""
    names = {c: n for c, n in METRIC_NAMES.items() if c in scores.columns}
    means = scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(pipeline).alias("pipeline"), F.lit(n).alias("metric"), F.col(c).alias("value"))
        for c, n in names.items()
    ])))


def metric_report(
    scores: DataFrame, left: str = "extraction", right: str = "options",
    hidden: tuple[str, ...] = ("Silhouette Score",),
) -> DataFrame:
    """Metrics of two pipelines side by side as percentages, missing ones 0, by name."""
    wide = (
        scores.filter(~F.col("metric").isin(list(hidden)))
        .groupBy("metric")
        .agg(*[
            F.coalesce(F.max(F.when(F.col("pipeline") == p, F.col("value"))), F.lit(0.0)).alias(p)
            for p in (left, right)
        ])
    )
    return wide.select(
        "metric", *[X.percent_text(F.col(p)).alias(p) for p in (left, right)]
    ).orderBy("metric")
