"""Screening end to end: clean, embed, train, tune, screen, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.operators import cleaning, embedding, metrics, model, screening
from papersieve.operators.split import stratified_split
from papersieve.session import materialize


def screen_corpus(
    train: DataFrame,
    papers: DataFrame,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    tiers=screening.KEYWORD_TIERS,
    **model_options,
) -> dict[str, DataFrame]:
    """``train(paper_id, title, abstract, label)`` and raw ``papers`` to all result tables, by name.

    ``embed`` maps ``(paper_id, text)`` rows to ``(paper_id, embedding)``; hashed TF-IDF by default.
    Training and corpus texts are embedded in one pass so that they share one vocabulary.
    """
    embed = embed or embedding.embed_documents
    labelled = cleaning.with_text(cleaning.clean_labels(train))
    annotated = cleaning.clean_papers(papers)
    corpus = cleaning.with_text(cleaning.kept(annotated), compat=True)  # a kept paper is always scored

    def keyed(df: DataFrame, role: str) -> DataFrame:
        return df.select(F.concat(F.lit(role), F.col("paper_id").cast("string")).alias("paper_id"), "text")

    vectors = materialize(embed(keyed(labelled, "t").unionByName(keyed(corpus, "c"))))

    def attach(df: DataFrame, role: str) -> DataFrame:
        own = vectors.filter(F.col("paper_id").startswith(role)).select(
            F.col("paper_id").alias("_key"), "embedding"
        )
        return df.withColumn(
            "_key", F.concat(F.lit(role), F.col("paper_id").cast("string"))
        ).join(own, "_key").drop("_key")

    split = materialize(stratified_split(attach(labelled, "t")))
    fitted = model.train_screener(split.filter("not is_validation"), **model_options)
    validation = materialize(screening.add_hybrid_score(
        model.score_screener(fitted, split.filter("is_validation")), tiers=tiers
    ).select("paper_id", "label", "model_score", "keyword_score", "final_score"))
    best = materialize(metrics.best_threshold(validation, "label", "final_score")).select("best_threshold")
    scored = materialize(screening.add_hybrid_score(
        model.score_screener(fitted, attach(corpus, "c")), tiers=tiers
    ).drop("embedding"))
    final = screening.screen(scored, best)
    confusion = metrics.confusion_matrix(validation, "label", "final_score", best)
    return {
        "predictions": final,
        "removed_records": cleaning.removed(annotated),
        "cleaning_waterfall": cleaning.cleaning_waterfall(annotated),
        "hybrid_performance": metrics.validation_summary(validation, "label", "final_score"),
        "confusion": confusion,
        "classification_report": metrics.classification_report(confusion),
        "validation_threshold": metrics.threshold_sensitivity(
            validation, "label", "final_score", screening.SENSITIVITY_THRESHOLDS
        ),
        "test_threshold": screening.corpus_sensitivity(scored, papers),
        "validation_source": screening.source_distribution(screening.screen(validation, best, floor=0.0)),
        "final_source": screening.source_distribution(final),
        "corpus_stats": screening.corpus_stats(papers, scored, final),
    }
