"""Discipline assignment end to end: embed, score, select, study thresholds, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import build_text
from papersieve.operators import disciplines, embedding, trends
from papersieve.session import materialize
from papersieve.sources.anchors import anchors_df
from papersieve.sources.papers import require_columns


def embed_with_anchors(papers: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and anchor texts as hashed TF-IDF vectors under the papers' document frequencies."""
    docs = papers.select("paper_id", build_text(F.col("title"), F.col("abstract"), ". ").alias("text"))
    corpus_df = materialize(embedding.document_frequencies(docs))
    doc_vectors = embedding.embed_documents(docs, corpus_df=corpus_df)
    anchor_vectors = embedding.embed_texts(anchors, corpus_df, docs.agg(F.count("*").alias("n")), "discipline")
    return doc_vectors, anchors.select("ordinal", "discipline").join(anchor_vectors, "discipline")


def assign_disciplines(papers: DataFrame, anchors: DataFrame | None = None, ratio: float = disciplines.RATIO,
                       minimum: float = disciplines.MINIMUM) -> dict[str, DataFrame]:
    """All result tables by name. A ratio of 0.95 and a floor of 0.80 suit transformer vectors;
    hashed TF-IDF cosines are lower and need a lower floor."""
    require_columns(papers, ["paper_id", "title", "abstract", "pub_year"])
    anchors = anchors_df(papers.sparkSession) if anchors is None else anchors
    vectors, anchor_vectors = embed_with_anchors(papers, anchors)
    scored = materialize(
        disciplines.add_anchor_scores(vectors, materialize(anchor_vectors)).drop("embedding")
    )
    assigned = disciplines.select_disciplines(scored, ratio, minimum, ratio, minimum)
    dated = assigned.join(papers.select("paper_id", "pub_year"), "paper_id")
    yearly = trends.discipline_trends(dated)
    return {
        "assignment": papers.join(
            assigned.withColumn("discipline_scores", disciplines.score_map(F.col("scores"))).drop("scores"),
            "paper_id",
        ),
        "breadth_stats": disciplines.breadth_stats(assigned),
        "discipline_counts": disciplines.discipline_counts(assigned),
        "threshold_grid": disciplines.threshold_grid(scored),
        "breadth_sweep": disciplines.breadth_sweep(scored),
        "discipline_trends": yearly,
        "discipline_share": trends.discipline_share(yearly),
        "research_types": trends.research_type_trends(dated),
    }
