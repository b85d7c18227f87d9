"""Hybrid screening: keyword tiers, model score, threshold, source of the decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.operators.metrics import tally_by_threshold
from papersieve.session import as_threshold

# Keyword tiers with their scores.
KEYWORD_TIERS = (
    (0.90, (
        r"\bLarge Language Model(s)?\b",
        r"\bLLM(s)?\b",
        r"\bTransformer(s)?\b",
    )),
    (0.75, (
        r"\bDeep Learning\b",
        r"\bNeural Network(s)?\b",
        r"\bMachine Learning\b",
        r"\bNatural Language Processing\b",
        r"\bNLP\b",
        r"\bComputer Vision\b",
        r"\bReinforcement Learning\b",
        r"\bAI\b",
    )),
)
# Thresholds of the sensitivity tables and the floor of the final screen.
SENSITIVITY_THRESHOLDS = (0.5, 0.6, 0.65, 0.7, 0.8)
SCREEN_FLOOR = 0.35


def keyword_score(text: Column, tiers: Sequence[tuple[float, Sequence[str]]] = KEYWORD_TIERS) -> Column:
    """H1: score of the first tier with a hit, else 0; case and word boundaries are Unicode-aware."""
    score = F.lit(0.0)
    for value, patterns in reversed(tiers):
        score = F.when(text.rlike("(?iuU)" + "|".join(patterns)), F.lit(value)).otherwise(score)
    return F.coalesce(score, F.lit(0.0))


def add_hybrid_score(df: DataFrame, text: str = "text", model_score: str = "model_score",
                     tiers: Sequence[tuple[float, Sequence[str]]] = KEYWORD_TIERS) -> DataFrame:
    """H1+H2: ``keyword_score`` and ``final_score``, the larger of keyword and model score."""
    return df.withColumn("keyword_score", keyword_score(F.col(text), tiers)).withColumn(
        "final_score", F.greatest(F.col(model_score), F.col("keyword_score"))
    )


def prediction_source(model: Column, keyword: Column) -> Column:
    """H4: which score decided; ``both`` is an exact tie."""
    return (
        F.when(keyword > model, "keyword_only").when(model > keyword, "model_only").otherwise("both")
    )


def screen(scored: DataFrame, best: float | DataFrame, floor: float = SCREEN_FLOOR,
           order_by: str | None = None) -> DataFrame:
    """H3+H4: rows with ``final_score`` at or above max(floor, best), flagged and explained.

    ``best`` may be the one-row result of ``best_threshold``; it stays a lazy scalar. ``order_by``
    sorts by score descending with that column as the tie key, which needs a range shuffle.
    """
    cut = F.greatest(F.lit(floor), as_threshold(best))
    out = (
        scored.filter(F.col("final_score") >= cut)
        .withColumn("predicted_is_computer", F.lit(1))
        .withColumn("prediction_source", prediction_source(F.col("model_score"), F.col("keyword_score")))
    )
    return out.orderBy(F.desc("final_score"), order_by) if order_by else out


def source_distribution(screened: DataFrame) -> DataFrame:
    """H5: rows and percentage per prediction source; no rows when nothing was selected."""
    counts = screened.groupBy(F.col("prediction_source").alias("source")).agg(
        F.count("*").alias("count")
    )
    total = screened.agg(F.count("*").alias("n"))
    return counts.withColumn(
        "percentage", F.bround(F.col("count") * 100.0 / total.scalar(), 2)
    )


def corpus_sensitivity(scored: DataFrame, initial: DataFrame,
                       thresholds: Sequence[float] = SENSITIVITY_THRESHOLDS) -> DataFrame:
    """Papers at or above each threshold, and their share of the rows before cleaning."""
    n = initial.agg(F.count("*").alias("n"))
    tally = tally_by_threshold(scored, "final_score", thresholds)
    return tally.select(
        "threshold",
        F.col("n_above").alias("ai_count"),
        F.coalesce(F.try_divide(F.col("n_above"), n.scalar()), F.lit(0.0)).alias("proportion"),
    )


def corpus_stats(initial: DataFrame, cleaned: DataFrame, final: DataFrame) -> DataFrame:
    """Rows before cleaning, after cleaning, after screening, and the final percentage."""
    n_clean = cleaned.agg(F.count("*").alias("n"))
    n_final = final.agg(F.count("*").alias("n"))
    return (
        initial.agg(F.count("*").alias("original_count"))
        .withColumn("after_cleaning_count", n_clean.scalar())
        .withColumn("final_count", n_final.scalar())
        .withColumn(
            "final_percentage",
            F.coalesce(F.try_divide(F.col("final_count"), F.col("original_count")) * 100, F.lit(0.0)),
        )
    )
