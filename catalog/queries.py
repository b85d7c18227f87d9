"""name -> callable(spark, sf_dir) -> DataFrame. Every query reads its tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import (
    DIRTY_LABEL,
    FIXTURE_MIN, FIXTURE_MINIMA, FIXTURE_RATIO, FIXTURE_RATIOS, FIXTURE_STOP_WORDS,
    FIXTURE_SWEEP, FIXTURE_TIERS,
    documents, labelled_scores, papers, stand_in_score, table, topic_documents, vectors,
)
from papersieve.functions import text as tx
from papersieve.operators import (
    boosting, cleaning, clustering, disciplines, embedding, metrics, model, reduction, screening, terms, topic_eval, trends,
)
from papersieve.operators.split import stratified_split
from papersieve.plans import discipline_flow, topic_flow
from papersieve.session import materialize, shared_dir, store, with_computed
from papersieve.sources import sinks
from papersieve.sources.anchors import anchors_df
from papersieve.sources.papers import read_yearly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- cleaning ---------------------------------------------------------------------------------

def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_papers(papers(spark, sf_dir))


@query
def cleaning_waterfall(spark, sf_dir):
    return cleaning.cleaning_waterfall(annotated(spark, sf_dir))


@query
def clean_corpus(spark, sf_dir):
    return cleaning.kept(annotated(spark, sf_dir)).select(
        "paper_id", "ut", "title", "doc_type", "source_title", "pub_year",
        F.md5("abstract").alias("abstract_md5"),
    )


@query
def removed_records(spark, sf_dir):
    return cleaning.removed(annotated(spark, sf_dir)).select(
        "paper_id", "ut", F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        "original_source_title", "source_title", "removal_reason",
    )


@query
def text_build(spark, sf_dir):
    return cleaning.with_text(papers(spark, sf_dir)).select(
        "paper_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query
def label_clean(spark, sf_dir):
    dirty = table(spark, sf_dir, "labels").select("doc_id", F.expr(DIRTY_LABEL).alias("label"))
    return cleaning.clean_labels(dirty)


@query
def doc_type_counts(spark, sf_dir):
    typed = papers(spark, sf_dir).select(cleaning.normalize_doc_type(F.col("doc_type")).alias("doc_type"))
    return trends.value_counts(typed, "doc_type").select("doc_type", "count", F.round("share", 6).alias("share"))


# ---- hybrid screening -------------------------------------------------------------------------

def scored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.with_text(cleaning.kept(annotated(spark, sf_dir)))
    return screening.add_hybrid_score(
        clean.withColumn("model_score", stand_in_score("paper_id")), tiers=FIXTURE_TIERS
    )


@query
def keyword_scores(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select(
        "doc_id", screening.keyword_score(F.col("text")).alias("keyword_score"),
        screening.keyword_score(F.col("text"), FIXTURE_TIERS).alias("fixture_score"),
    )


@query
def hybrid_screen(spark, sf_dir):
    best = metrics.best_threshold(labelled_scores(spark, sf_dir), "label", "score")
    kept = screening.screen(scored_papers(spark, sf_dir), best.select("best_threshold"))
    return kept.select(
        "paper_id", *r6("model_score", "keyword_score", "final_score"),
        "predicted_is_computer", "prediction_source",
    )


@query
def prediction_source_dist(spark, sf_dir):
    return screening.source_distribution(screening.screen(scored_papers(spark, sf_dir), 0.5))


@query
def corpus_sensitivity(spark, sf_dir):
    return screening.corpus_sensitivity(scored_papers(spark, sf_dir), papers(spark, sf_dir)).select(
        "threshold", "ai_count", *r6("proportion")
    )


@query
def corpus_stats(spark, sf_dir):
    scored = scored_papers(spark, sf_dir)
    return screening.corpus_stats(papers(spark, sf_dir), scored, screening.screen(scored, 0.5)).select(
        "original_count", "after_cleaning_count", "final_count", *r6("final_percentage")
    )


# ---- split and validation metrics -------------------------------------------------------------

@query
def stratified_split_labels(spark, sf_dir):
    return stratified_split(labelled_scores(spark, sf_dir)).select("paper_id", "label", "is_validation")


@query
def class_weight(spark, sf_dir):
    return metrics.class_weight(labelled_scores(spark, sf_dir)).select(
        "n_neg", "n_pos", *r6("scale_pos_weight")
    )


@query
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(labelled_scores(spark, sf_dir), "label", "score").select(
        *r6("best_threshold", "best_f1")
    )


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(labelled_scores(spark, sf_dir), "label", "score", 0.5)


@query
def class_report(spark, sf_dir):
    confusion = metrics.confusion_matrix(labelled_scores(spark, sf_dir), "label", "score", 0.5)
    return metrics.classification_report(confusion).select(
        "class", *r6("precision", "recall", "f1"), "support"
    )


@query
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(labelled_scores(spark, sf_dir), "label", "score").select(*r6("auc"))


@query
def validation_sensitivity(spark, sf_dir):
    return metrics.threshold_sensitivity(
        labelled_scores(spark, sf_dir), "label", "score", screening.SENSITIVITY_THRESHOLDS
    ).select("threshold", *r6("precision", "recall", "f1"))


@query
def validation_summary(spark, sf_dir):
    return metrics.validation_summary(labelled_scores(spark, sf_dir), "label", "score").select(
        "metric", *r6("value")
    )


# ---- disciplines ------------------------------------------------------------------------------

def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return disciplines.add_anchor_scores(docs, disciplines.label_centroids(docs))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disciplines.select_disciplines(
        scored_vectors(spark, sf_dir), FIXTURE_RATIO, FIXTURE_MIN, FIXTURE_RATIO, FIXTURE_MIN
    )


def assigned_with_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = papers(spark, sf_dir).select("paper_id", tx.to_number(F.col("pub_year")).cast("int").alias("pub_year"))
    return assigned(spark, sf_dir).select("paper_id", "present_disciplines", "presence_breadth").join(
        years, "paper_id"
    )


@query
def anchor_scores(spark, sf_dir):
    return disciplines.anchor_scores(scored_vectors(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query
def discipline_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select(
        "paper_id", "presence_breadth", F.array_join("present_disciplines", "|").alias("present_disciplines")
    )


@query
def breadth_stats(spark, sf_dir):
    return disciplines.breadth_stats(assigned(spark, sf_dir)).withColumn("percentage", F.round("percentage", 6))


@query
def discipline_counts(spark, sf_dir):
    return disciplines.discipline_counts(assigned(spark, sf_dir))


@query
def threshold_grid(spark, sf_dir):
    grid = disciplines.threshold_grid(scored_vectors(spark, sf_dir), FIXTURE_RATIOS, FIXTURE_MINIMA)
    return grid.select(
        "ratio", "min", *r6("multi_rate", "single_rate", "top1_sim", "selected_sim", "entropy")
    )


@query
def threshold_grid_default(spark, sf_dir):
    grid = disciplines.threshold_grid(scored_vectors(spark, sf_dir))
    return grid.select(*r6("ratio", "min", "multi_rate", "single_rate", "top1_sim", "selected_sim", "entropy"))


@query
def current_setting(spark, sf_dir):
    grid = disciplines.threshold_grid(scored_vectors(spark, sf_dir))
    return disciplines.current_setting(grid).select(
        *r6("ratio", "min", "multi_rate", "single_rate", "top1_sim", "selected_sim", "entropy")
    )


@query
def discipline_entropy(spark, sf_dir):
    return disciplines.discipline_entropy(assigned(spark, sf_dir)).select(*r6("entropy"))


@query
def breadth_sweep(spark, sf_dir):
    return disciplines.breadth_sweep(scored_vectors(spark, sf_dir), FIXTURE_SWEEP).select(
        "threshold", "presence_breadth", *r6("share")
    )


@query
def breadth_sweep_default(spark, sf_dir):
    return disciplines.breadth_sweep(scored_vectors(spark, sf_dir)).select(
        *r6("threshold"), "presence_breadth", *r6("share")
    )


@query
def discipline_trends(spark, sf_dir):
    return trends.discipline_trends(assigned_with_year(spark, sf_dir))


@query
def discipline_share(spark, sf_dir):
    yearly = trends.discipline_trends(assigned_with_year(spark, sf_dir))
    return trends.discipline_share(yearly).withColumn("percentage", F.round("percentage", 6))


@query
def research_type_trends(spark, sf_dir):
    return trends.research_type_trends(assigned_with_year(spark, sf_dir)).withColumn(
        "percentage", F.round("percentage", 6)
    )


def literal_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments as a file stores them: a list literal in single quotes."""
    return assigned(spark, sf_dir).select(
        "paper_id",
        F.concat(F.lit("['"), F.array_join("present_disciplines", "', '"), F.lit("']")).alias("present_disciplines"),
    )


@query
def select_include(spark, sf_dir):
    return disciplines.select_by_discipline(
        literal_assignments(spark, sf_dir), "Label_3", "include", is_literal=True
    )


@query
def select_only(spark, sf_dir):
    return disciplines.select_by_discipline(
        literal_assignments(spark, sf_dir), "Label_3", "only", is_literal=True
    )


@query
def discipline_corpus(spark, sf_dir):
    chosen = disciplines.select_by_discipline(assigned(spark, sf_dir), "label_3").select("paper_id")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")
    return disciplines.discipline_corpus(docs.join(chosen, "paper_id", "left_semi")).select(
        "paper_id", F.length("text").alias("n_chars")
    )


# ---- text -------------------------------------------------------------------------------------

@query
def academic_clean(spark, sf_dir):
    return topic_flow.corpus_documents(text_documents(spark, sf_dir)).select(
        F.col("paper_id").alias("doc_id"), F.length("text").alias("n_chars"), F.md5("text").alias("cleaned_md5")
    )


@query
def alpha_tokens(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", tx.tokenize_alpha(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


# ---- topics -----------------------------------------------------------------------------------

STOP = {"stop_words": FIXTURE_STOP_WORDS}


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(
        topic_documents(spark, sf_dir), max_df=0.95, max_features=10_000, **STOP
    )


def fixture_words(spark: SparkSession, sf_dir: str, top_n: int = 15) -> DataFrame:
    """Top words; the term counts are read several times and so are stored once."""
    return terms.topic_words(terms.ctfidf(materialize(unigram_counts(spark, sf_dir))), top_n)


@query
def term_counts(spark, sf_dir):
    return unigram_counts(spark, sf_dir)


@query
def term_counts_ngrams(spark, sf_dir):
    return terms.term_counts(
        topic_documents(spark, sf_dir), ngram_range=(1, 3), min_df=2, max_df=0.9, **STOP
    )


@query
def ctfidf(spark, sf_dir):
    counts = materialize(unigram_counts(spark, sf_dir))
    return terms.ctfidf(counts).select("topic", "term", "n", *r6("idf", "weight"))


@query
def ctfidf_damped(spark, sf_dir):
    counts = terms.term_counts(
        topic_documents(spark, sf_dir), ngram_range=(1, 3), min_df=2, max_df=0.9, **STOP
    )
    return terms.ctfidf(materialize(counts), reduce_frequent_words=True).select("topic", "term", *r6("weight"))


@query
def topic_words(spark, sf_dir):
    return fixture_words(spark, sf_dir).select("topic", "rank", "term", *r6("weight"))


@query
def topic_info(spark, sf_dir):
    info = terms.topic_info(topic_documents(spark, sf_dir), fixture_words(spark, sf_dir, 10))
    return info.select("topic", "size", F.array_join("words", " ").alias("words"))


@query
def topic_count(spark, sf_dir):
    return topic_eval.topic_count(topic_documents(spark, sf_dir))


@query
def representative_docs(spark, sf_dir):
    weights = terms.ctfidf(materialize(terms.term_counts(topic_documents(spark, sf_dir), **STOP)))
    return terms.representative_docs(topic_documents(spark, sf_dir), weights, **STOP).select(
        "topic", "rank", "paper_id", *r6("similarity")
    )


@query
def topic_overlap(spark, sf_dir):
    return topic_eval.topic_overlap(fixture_words(spark, sf_dir)).select("topic_i", "topic_j", *r6("value"))


@query
def topic_overlap_matrix(spark, sf_dir):
    overlap = topic_eval.topic_overlap(fixture_words(spark, sf_dir))
    wide = sinks.matrix(overlap, [-1, *range(9)])
    return wide.select(
        "topic", *[F.round(c, 6).alias(f"t{c}".replace("-", "_")) for c in wide.columns if c != "topic"]
    )


@query
def topic_similarity(spark, sf_dir):
    return topic_eval.topic_similarity(topic_documents(spark, sf_dir)).select(
        "topic_i", "topic_j", *r6("value")
    )


@query
def max_pairs(spark, sf_dir):
    overlap = topic_eval.max_pair(topic_eval.topic_overlap(fixture_words(spark, sf_dir)))
    similar = topic_eval.max_pair(topic_eval.topic_similarity(topic_documents(spark, sf_dir)))
    return overlap.withColumn("matrix", F.lit("word_overlap")).unionByName(
        similar.withColumn("matrix", F.lit("semantic_similarity"))
    ).select("matrix", "topic_i", "topic_j", *r6("value"))


@query
def topic_diversity(spark, sf_dir):
    return topic_eval.topic_diversity(fixture_words(spark, sf_dir)).select(*r6("diversity"))


def space_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-corpus evaluation input: cleaned texts of more than ten tokens."""
    cleaned = with_computed(
        text_documents(spark, sf_dir), "text", tx.clean_academic_text(F.col("text"))
    )
    return topic_flow.evaluation_tokens(cleaned)


def letter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_documents(spark, sf_dir).select("paper_id", tx.tokenize_alpha(F.col("text")).alias("tokens"))


@query
def dictionary_filter(spark, sf_dir):
    return topic_eval.dictionary_filter(space_tokens(spark, sf_dir))


@query
def coherence_npmi(spark, sf_dir):
    return topic_eval.coherence_npmi(letter_tokens(spark, sf_dir), fixture_words(spark, sf_dir)).select(
        *r6("c_npmi")
    )


@query
def coherence_cv(spark, sf_dir):
    return topic_eval.coherence_cv(letter_tokens(spark, sf_dir), fixture_words(spark, sf_dir)).select(*r6("c_v"))


@query
def coherence_cv_dictionary(spark, sf_dir):
    docs = store(space_tokens(spark, sf_dir))
    return topic_eval.coherence_cv(
        docs, fixture_words(spark, sf_dir), top_n=10, min_topics=2,
        dictionary=topic_eval.dictionary_filter(docs),
    ).select(*r6("c_v"))


@query
def evaluation_table(spark, sf_dir):
    docs, words = letter_tokens(spark, sf_dir), fixture_words(spark, sf_dir)
    return topic_eval.evaluation_table(
        n_topics=topic_eval.topic_count(topic_documents(spark, sf_dir)),
        c_npmi=topic_eval.coherence_npmi(docs, words),
        c_v=topic_eval.coherence_cv(docs, words),
        diversity=topic_eval.topic_diversity(words, 15, on_empty=1.0),
    ).select("metric", *r6("value"))


@query
def topic_stability_given(spark, sf_dir):
    """Stability against three given re-labellings of the same documents."""
    base = fixture_words(spark, sf_dir)
    docs = topic_documents(spark, sf_dir)
    runs = [
        terms.topic_words(terms.ctfidf(materialize(terms.term_counts(
            docs.withColumn("topic", F.pmod(F.col("paper_id") * (run + 2) + F.col("topic"), F.lit(7))),
            max_df=0.95, max_features=10_000, **STOP,
        )))).withColumn("run", F.lit(run))
        for run in range(3)
    ]
    return topic_eval.topic_stability(base, runs[0].unionByName(runs[1]).unionByName(runs[2])).select(
        "topic", *r6("stability_jaccard")
    )


# ---- embeddings and models --------------------------------------------------------------------

def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")


@query
def embed_documents(spark, sf_dir):
    vectors = embedding.embed_documents(text_documents(spark, sf_dir))
    cells = vectors.select("paper_id", F.posexplode("embedding").alias("bucket", "value"))
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 5)).filter("value <> 0")


@query
def anchor_text_scores(spark, sf_dir):
    """The nine-discipline taxonomy scored against the documents through hashed TF-IDF."""
    docs, anchors = discipline_flow.embed_with_anchors(papers(spark, sf_dir), anchors_df(spark))
    scored = disciplines.add_anchor_scores(docs, materialize(anchors))
    return disciplines.anchor_scores(scored).withColumn("sim", F.round("sim", 6))


def text_shape():
    """A stand-in model: number of characters and of blanks."""
    def predict(texts):
        return np.array([[len(t), t.count(" ")] for t in texts.ravel()], dtype="float32")

    return predict


@query
def embed_with(spark, sf_dir):
    encoded = embedding.embed_with(text_documents(spark, sf_dir), text_shape)
    return encoded.select(
        "paper_id", F.get("embedding", F.lit(0)).cast("int").alias("n_chars"),
        F.get("embedding", F.lit(1)).cast("int").alias("n_blanks"),
    )


def prepared_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.reduce_dims(vectors(spark, sf_dir).drop("label"))


@query
def reduce_dims(spark, sf_dir):
    return prepared_vectors(spark, sf_dir).select("paper_id", F.posexplode("reduced").alias("component", "value"))


def labelled_vectors(spark, sf_dir):
    """The embedded text of every labelled document, ``quality`` as label, split by label.

    The split reads its rows three times, so labels are split by themselves and vectors are made once.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").alias("label"))
    docs = text_documents(spark, sf_dir)
    split = stratified_split(labels.join(docs.select("paper_id"), "paper_id", "left_semi"))
    embedded = embedding.embed_documents(docs.join(labels, "paper_id", "left_semi"))
    return materialize(embedded.join(split, "paper_id"))


@query
def screen_model(spark, sf_dir):
    """Boosted trees of the ML library."""
    rows = labelled_vectors(spark, sf_dir)
    fitted = model.train_screener(rows.filter("not is_validation"))
    return model.score_screener(fitted, rows.filter("is_validation")).select("paper_id", "label", "model_score")


@query
def screen_boosted(spark, sf_dir):
    """Second-order boosted trees with split and leaf penalties."""
    rows = labelled_vectors(spark, sf_dir)
    fitted = boosting.train_boosted(rows.filter("not is_validation"), n_trees=10, limits=boosting.Penalties(learning_rate=0.3))
    return boosting.score_boosted(fitted, rows.filter("is_validation")).select("paper_id", "label", "model_score")


@query
def cluster_topics(spark, sf_dir):
    prepared = materialize(prepared_vectors(spark, sf_dir).select("paper_id", "reduced"))
    return clustering.cluster_documents(prepared, "density", min_size=5, min_samples=2)


@query
def cluster_grid(spark, sf_dir):
    """One grid over five components of the given vectors."""
    return clustering.density_clusters(vectors(spark, sf_dir), min_size=5, min_samples=2, features="embedding", cell=0.2)


@query
def cluster_topics_bisecting(spark, sf_dir):
    prepared = materialize(prepared_vectors(spark, sf_dir).select("paper_id", "reduced"))
    return clustering.cluster_documents(
        prepared, "bisecting", k=20, min_size=clustering.min_cluster_size(prepared)
    )


@query
def merge_topics(spark, sf_dir):
    return clustering.merge_topics(topic_documents(spark, sf_dir), tau=0.2)


GIVEN_TOPICS = topic_flow.TopicSettings(
    ngram_range=(1, 1), min_df=1, max_df=0.95, max_features=10_000, reduce_frequent_words=False, stop_words=FIXTURE_STOP_WORDS,
)


def given_model(spark: SparkSession, sf_dir: str) -> topic_flow.TopicModel:
    """Model of cleaned documents with given vectors and topics; its words lie in the space of the vectors."""
    # cleaning is costly: only texts with a topic are cleaned, dealt over all tasks
    given = topic_documents(spark, sf_dir)
    docs = with_computed(given, "text", tx.clean_academic_text(F.col("text"))).filter(tx.long_enough(F.col("text")))
    return topic_flow.describe_topics(store(docs), GIVEN_TOPICS)


def merged_model(spark: SparkSession, sf_dir: str) -> topic_flow.TopicModel:
    return topic_flow.reduce_model(given_model(spark, sf_dir), tau=0.12)


def joined_words(info: DataFrame) -> DataFrame:
    lists = [c for c in info.columns if c not in ("topic", "size")]
    return info.select("topic", "size", *[F.array_join(c, " ").alias(c) for c in lists])


@query
def reduce_topics(spark, sf_dir):
    return reduction.reduce_topics(topic_documents(spark, sf_dir), tau=0.12)


@query
def similar_topics(spark, sf_dir):
    """Links of documents' vectors themselves, far more than there are topics."""
    pairs = reduction.similar_pairs(vectors(spark, sf_dir), 0.3, key="paper_id")
    return pairs.select("paper_id_i", "paper_id_j", *r6("value"))


@query
def merged_topic_info(spark, sf_dir):
    model = merged_model(spark, sf_dir)
    return joined_words(terms.topic_info(model.documents, model.words))


@query
def merged_topic_overlap(spark, sf_dir):
    return topic_eval.topic_overlap(merged_model(spark, sf_dir).words).select("topic_i", "topic_j", *r6("value"))


@query
def merged_topic_similarity(spark, sf_dir):
    return topic_eval.topic_similarity(merged_model(spark, sf_dir).documents).select("topic_i", "topic_j", *r6("value"))


@query
def merged_evaluation(spark, sf_dir):
    return topic_flow.evaluate_corpus(merged_model(spark, sf_dir)).select("metric", *r6("value"))


@query
def topic_info_views(spark, sf_dir):
    model = given_model(spark, sf_dir)
    return joined_words(topic_flow.info_views(model, topic_flow.keyword_views(model, candidates=30, top_n=10)))


FIXTURE_TOPICS = topic_flow.TopicSettings(
    method="bisecting", min_size=5, ngram_range=(1, 1), min_df=1, max_df=0.95, max_features=10_000,
    reduce_frequent_words=False, stop_words=FIXTURE_STOP_WORDS, cluster_options=(("k", 8),),
)


def text_model(spark: SparkSession, sf_dir: str) -> topic_flow.TopicModel:
    """Topic model of the documents from their own text."""
    docs = text_documents(spark, sf_dir)
    return topic_flow.fit_topics(topic_flow.prepare(docs, FIXTURE_TOPICS), FIXTURE_TOPICS)


def discipline_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_documents(spark, sf_dir).join(
        assigned(spark, sf_dir).select("paper_id", "present_disciplines"), "paper_id"
    )


@query
def keyword_views(spark, sf_dir):
    return topic_flow.keyword_views(text_model(spark, sf_dir))


@query
def topic_stability(spark, sf_dir):
    return topic_flow.stability(text_model(spark, sf_dir))


@query
def compare_modes(spark, sf_dir):
    models = topic_flow.discipline_models(discipline_docs(spark, sf_dir), "label_3", FIXTURE_TOPICS)
    return topic_flow.compare_modes(models)


# ---- sources and sinks ------------------------------------------------------------------------

@query
def yearly_corpus(spark, sf_dir):
    """Papers written as one CSV folder per year, read back, cleaned and filtered by length."""
    base = f"{shared_dir(spark)}/papersieve-yearly/{uuid.uuid4().hex}"
    dated = papers(spark, sf_dir).select(
        "paper_id", tx.build_text(F.col("title"), F.col("abstract")).alias("Full Text"),
        tx.to_number(F.col("pub_year")).cast("int").alias("year"),
    ).filter("year is not null")
    folder = dated.withColumn("year", F.col("year").cast("string"))
    sinks.write_yearly(folder, base, "year", "csv")
    docs = read_yearly(spark, base, "csv", multi_line=True).select("pub_year", F.col("paper_id").cast("bigint").alias("paper_id"), "text")
    cleaned = with_computed(docs, "text", tx.clean_academic_text(F.col("text"))).filter(tx.long_enough(F.col("text")))
    return cleaned.select("pub_year", "paper_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))
