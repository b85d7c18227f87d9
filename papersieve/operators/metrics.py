"""Validation metrics on (label, score) rows.

Every curve is one aggregate: a row is reduced to the number of thresholds it reaches, so what
leaves the map side is at most ``len(thresholds) + 1`` rows. Thresholds are Python doubles and are
compared unrounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.session import as_threshold


# The search grid for the best threshold and what it falls back to.
SEARCH_THRESHOLDS = tuple(np.linspace(0.2, 0.8, 61).tolist())
DEFAULT_THRESHOLD = 0.5


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """H6: negatives per positive."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")
    ).withColumn("scale_pos_weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))


def tally_by_threshold(df: DataFrame, score: str, thresholds: Sequence[float],
                       label: str | None = None) -> DataFrame:
    """Per threshold: rows at or above it (``n_above``); with a label also ``tp fp fn tn``.

    ``thresholds`` must ascend. One shuffle of at most ``len(thresholds) + 1`` bins per task.
    """
    reached = reduce(add, [F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds])
    is_pos = F.col(label) == 1 if label else F.lit(False)
    bins = df.groupBy(reached.alias("_bin")).agg(
        F.count("*").alias("_n"), F.count_if(is_pos).alias("_pos")
    )
    grid = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(float(t)).alias("threshold"))
        for i, t in enumerate(thresholds)
    ])
    above = F.col("_bin") > F.col("_i")
    n, pos = F.col("_n"), F.col("_pos")
    zero = F.lit(0).cast("bigint")

    def total(value: Column, condition: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(zero))

    measures = [total(n, above).alias("n_above")]
    if label:
        measures += [
            total(pos, above).alias("tp"), total(n - pos, above).alias("fp"),
            total(pos, ~above).alias("fn"), total(n - pos, ~above).alias("tn"),
        ]
    return bins.select("*", F.inline(grid)).groupBy("threshold").agg(*measures)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of the positive class, 0 when undefined."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def precision_of(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp * 1.0, tp + fp), F.lit(0.0))


def recall_of(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp * 1.0, tp + fn), F.lit(0.0))


def threshold_sensitivity(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 of the positive class at each threshold."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tally_by_threshold(df, score, thresholds, label).select(
        "threshold",
        precision_of(tp, fp).alias("precision"),
        recall_of(tp, fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


def best_threshold(df: DataFrame, label: str, score: str,
                   thresholds: Sequence[float] = SEARCH_THRESHOLDS) -> DataFrame:
    """H9: one row ``(best_threshold, best_f1)``; ties go to the lowest, all-zero F1 to 0.5."""
    f1 = threshold_sensitivity(df, label, score, thresholds).filter("f1 > 0")
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("neg")))
    return f1.agg(best.alias("best")).select(
        F.coalesce(-F.col("best.neg"), F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        F.coalesce(F.col("best.f1"), F.lit(0.0)).alias("best_f1"),
    )


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float | DataFrame) -> DataFrame:
    """One row ``(tn, fp, fn, tp)``."""
    hit = F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False))
    pos = F.col(label) == 1
    return df.select(label, score, as_threshold(threshold).alias("_cut")).agg(
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"),
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and weighted averages.

    The accuracy row repeats the accuracy in all three measures. Undefined measures are 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    base = confusion.select(
        (tn + fp).alias("s0"), (fn + tp).alias("s1"),
        precision_of(tn, fn).alias("p0"), recall_of(tn, fp).alias("r0"), f1_of(tn, fn, fp).alias("f0"),
        precision_of(tp, fp).alias("p1"), recall_of(tp, fn).alias("r1"), f1_of(tp, fp, fn).alias("f1"),
        F.coalesce(F.try_divide((tn + tp) * 1.0, tn + fp + fn + tp), F.lit(0.0)).alias("acc"),
    )
    support = F.col("s0") + F.col("s1")

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return F.coalesce(
            F.try_divide(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), support), F.lit(0.0)
        )

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1"), s.alias("support"),
        )

    acc = F.col("acc")
    return base.select(F.inline(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", acc, acc, acc, support),
        row("macro avg", macro("p"), macro("r"), macro("f"), support),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), support),
    )))


def roc_auc(df: DataFrame, label: str, score: str, buckets: int = 256) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; one row ``(auc)``.

    Scores are first reduced to one row per distinct value. The running count of negatives is then
    taken in two levels: totals over about ``buckets`` score ranges, and inside each range. The
    ranges come from approximate quantiles of the distinct scores; any cut gives the same result,
    the quantiles only keep the ranges even.
    """
    pos, neg = F.col("_pos"), F.col("_neg")
    per_score = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    cuts = per_score.agg(
        F.percentile_approx("_s", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts")
    )
    ranged = per_score.withColumn("_cuts", cuts.scalar()).select(
        "_s", "_pos", "_neg",
        F.size(F.filter("_cuts", lambda c: c <= F.col("_s"))).alias("_range"),
    )
    # at most ``buckets`` rows: safe to sort in one task and to broadcast
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_neg").alias("_neg_in")).select(
        "_range", F.coalesce(F.sum("_neg_in").over(before), F.lit(0)).alias("_neg_before")
    )
    inside = Window.partitionBy("_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_neg_before") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    return (
        ranged.join(F.broadcast(totals), "_range")
        .select("_pos", "_neg", (pos * (below + neg * 0.5)).alias("_wins"))
        .agg(F.try_divide(F.sum("_wins"), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))
    )


def validation_summary(df: DataFrame, label: str, score: str,
                       thresholds: Sequence[float] = SEARCH_THRESHOLDS) -> DataFrame:
    """AUC, F1, best threshold and size as ``(metric, value)`` rows."""
    best = best_threshold(df, label, score, thresholds)
    return (
        df.agg(F.count("*").cast("double").alias("n"))
        .withColumn("auc", roc_auc(df, label, score).scalar())
        .withColumn("f1", best.select("best_f1").scalar())
        .withColumn("t", best.select("best_threshold").scalar())
        .select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.col(value).alias("value"))
            for name, value in (("AUC", "auc"), ("F1", "f1"), ("Best Threshold", "t"), ("Validation Size", "n"))
        ])))
    )
