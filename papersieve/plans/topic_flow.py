"""Topic modelling end to end, for a whole corpus or for one discipline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import clean_academic_text, long_enough, tokenize_alpha, tokenize_space
from papersieve.operators import clustering, embedding, reduction, terms, topic_eval
from papersieve.operators.disciplines import discipline_corpus, mean_vectors, select_by_discipline
from papersieve.session import materialize, store, with_computed

# Base seed and number of stability reruns.
SEED, STABILITY_RUNS = 42, 3
#: Reruns are counted in one pass if they cut the documents into at most so many parts for each topic of one run.
JOINT_PARTS = 4


@dataclass(frozen=True)
class TopicSettings:
    """Clustering and vocabulary settings of one topic model."""

    dims: int = 5
    method: str = "density"
    min_size: int | None = None  # None: max(15, documents // 50)
    min_samples: int = 5
    ngram_range: tuple[int, int] = (1, 3)
    min_df: int = 2
    max_df: float = 0.9
    max_features: int | None = None
    reduce_frequent_words: bool = True
    top_n_words: int = 15
    stop_words: Sequence[str] | None = None
    cluster_options: tuple = ()
    main_view: str = "ctfidf"  # or "reranked": the words that evaluation and topic info read
    candidates: int = 100  # class TF-IDF words that a re-ranking chooses from
    encoder: Callable[[DataFrame], DataFrame] | None = None  # adds ``embedding`` to rows with a ``text``


CORPUS_SETTINGS = TopicSettings()
DISCIPLINE_SETTINGS = TopicSettings(
    min_size=5, min_samples=2, ngram_range=(1, 1), min_df=1, max_df=0.95, max_features=10_000,
    reduce_frequent_words=False, main_view="reranked", top_n_words=10,
)


@dataclass(frozen=True)
class TopicModel:
    """``documents(paper_id, text, embedding, reduced, topic)`` with class counts, term weights and main words.

    Counts, weights and words are made when first asked for: a merged model reads only the counts of the
    model before it, and what reads the documents alone makes none of them.
    """

    documents: DataFrame
    count_terms: Callable[[], DataFrame]
    settings: TopicSettings

    @cached_property
    def counts(self) -> DataFrame:
        return store(self.count_terms(), "zstd")

    @cached_property
    def weights(self) -> DataFrame:
        return _weights(self.counts, self.documents, self.settings)

    @cached_property
    def words(self) -> DataFrame:
        return store(_main_words(self.documents, self.weights, self.settings))


def corpus_documents(papers: DataFrame, text: str = "text", min_chars: int = 50) -> DataFrame:
    """P17+P18+P22: ``(paper_id, text)`` cleaned, at least ``min_chars`` long."""
    cleaned = with_computed(
        papers.select("paper_id", F.col(text).alias("text")), "text", clean_academic_text(F.col("text"))
    )
    return cleaned.filter(long_enough(F.col("text"), min_chars))


def evaluation_tokens(documents: DataFrame, min_tokens: int = 10) -> DataFrame:
    """``(paper_id, tokens)`` of cleaned documents with more than ``min_tokens`` tokens."""
    tokens = with_computed(documents.select("paper_id", "text"), "tokens", tokenize_space(F.col("text")))
    return tokens.filter(F.size("tokens") > min_tokens).drop("text")


HASHED = {"vectors": "hashed"}


def prepare(docs: DataFrame, settings: TopicSettings) -> DataFrame:
    """``(paper_id, text, embedding, reduced)``, stored once because several jobs read it.

    A given ``embedding`` column is used as it is; otherwise the settings' encoder makes one, or the
    text is hashed, which the column's metadata then say.
    """
    if "embedding" in docs.columns:
        vectors = docs.select("paper_id", "text", "embedding")
    elif settings.encoder is not None:
        vectors = settings.encoder(docs.select("paper_id", "text")).select("paper_id", "text", "embedding")
    else:
        hashed = embedding.embed_documents(docs, keep=["text"])
        vectors = hashed.select("paper_id", "text", F.col("embedding").alias("embedding", metadata=HASHED))
    return embedding.reduce_dims(store(vectors, "zstd"), settings.dims)


def _clustered(prepared: DataFrame, settings: TopicSettings, seeds: dict[str, int]) -> DataFrame:
    """``prepared`` with a column of topics for each of the named seeds."""
    size = clustering.min_cluster_size(prepared) if settings.min_size is None else settings.min_size
    options = dict(settings.cluster_options)
    if settings.method == "density":
        options = {"dims": settings.dims, "min_samples": settings.min_samples, **options}
    runs = {name: {"seed": seed} for name, seed in seeds.items()}
    return clustering.add_topics(prepared, runs, settings.method, min_size=size, **options)


def _weights(counts: DataFrame, documents: DataFrame, settings: TopicSettings) -> DataFrame:
    chosen = store(terms.select_terms(
        counts, documents.agg(F.count_distinct("topic").alias("n")), settings.min_df, settings.max_df, settings.max_features
    ), "zstd")
    return terms.ctfidf(chosen, reduce_frequent_words=settings.reduce_frequent_words)


def word_vectors(documents: DataFrame, words: DataFrame, settings: TopicSettings) -> DataFrame:
    """``(term, embedding)`` of candidate words, in the space of the documents' vectors.

    The settings' encoder encodes them; words of hashed documents are hashed the same way; for any
    other vectors a word is the mean of the documents it occurs in.
    """
    distinct = words.select("term").distinct()
    if settings.encoder is not None:
        return settings.encoder(distinct.select("term", F.col("term").alias("text"))).select("term", "embedding")
    if documents.schema["embedding"].metadata != HASHED:
        return terms.term_vectors(documents, distinct, stop_words=settings.stop_words, ngram_range=settings.ngram_range)
    first = documents.select(F.size("embedding").alias("n")).head()
    return embedding.embed_texts(
        distinct.select("term", F.col("term").alias("text")), embedding.document_frequencies(documents),
        documents.agg(F.count("*").alias("n")), "term", dim=first.n if first else embedding.DIMENSIONS,
    )


def _main_words(documents: DataFrame, weights: DataFrame, settings: TopicSettings) -> DataFrame:
    if settings.main_view == "ctfidf":
        return terms.topic_words(weights, settings.top_n_words)
    if settings.main_view != "reranked":
        raise ValueError("main_view must be ctfidf or reranked")
    chosen = materialize(terms.topic_words(weights, settings.candidates))
    vectors = word_vectors(documents, chosen, settings)
    return clustering.rerank_keywords(chosen, vectors, mean_vectors(documents, "topic"), settings.top_n_words)


def describe_topics(documents: DataFrame, settings: TopicSettings = CORPUS_SETTINGS) -> TopicModel:
    """Model of documents whose ``topic`` is given: ``(paper_id, text, embedding, topic)``."""
    return TopicModel(documents, lambda: terms.class_counts(
        documents, stop_words=settings.stop_words, ngram_range=settings.ngram_range, min_df=settings.min_df
    ), settings)


def fit_topics(prepared: DataFrame, settings: TopicSettings = CORPUS_SETTINGS, seed: int = SEED) -> TopicModel:
    """Cluster prepared documents and describe the topics."""
    return describe_topics(_clustered(prepared, settings, {"topic": seed}), settings)


def fit_runs(prepared: DataFrame, settings: TopicSettings, seeds: Sequence[int]) -> list[TopicModel]:
    """A model for each seed, as ``fit_topics`` gives it.

    Runs that cut the documents much alike have their terms counted together, by the topics of all runs,
    and each run adds up its own: the texts are read once. Where they differ, the parts of a frequent term
    would be many, and each run counts its own.
    """
    names = {f"_topic_{i}": seed for i, seed in enumerate(seeds)}
    marked = _clustered(prepared, settings, names)
    runs = {name: marked.withColumn("topic", F.col(name)).drop(*names) for name in names}
    parts, *topics = marked.select(*names).distinct().agg(F.count("*"), *[F.count_distinct(name) for name in names]).first()
    if parts > JOINT_PARTS * max(topics):
        return [describe_topics(documents, settings) for documents in runs.values()]
    joint = store(terms.joint_counts(marked, list(names), stop_words=settings.stop_words, ngram_range=settings.ngram_range), "zstd")

    def own(name: str) -> DataFrame:
        counts = joint.groupBy(F.col(name).alias("topic"), "term").agg(F.sum("n").alias("n"))
        return terms.select_terms(counts, min_df=settings.min_df)

    return [TopicModel(documents, partial(own, name), settings) for name, documents in runs.items()]


def reduce_model(model: TopicModel, tau: float = 0.9) -> TopicModel:
    """M6: the model after close topics have become one; documents keep their first topic as ``topic_before``.

    Class counts of merged topics are sums of their parts' counts, so no text is read again for them;
    the choice of terms, their weights and the main words are made anew.
    """
    mapping = materialize(reduction.reduce_topics(model.documents, tau))
    merged = clustering.add_merged_topics(model.documents, mapping)
    documents = merged.withColumnRenamed("topic", "topic_before").withColumnRenamed("topic_merged", "topic")
    return TopicModel(documents, lambda: reduction.merge_counts(model.counts, mapping), model.settings)


def keyword_views(model: TopicModel, candidates: int = 30, top_n: int = 15, diversity: float = 0.7) -> DataFrame:
    """M4+M5: ``(view, topic, rank, term, weight)`` for the re-ranked and the diversified words."""
    chosen = materialize(terms.topic_words(model.weights, candidates))
    vectors = materialize(word_vectors(model.documents, chosen, model.settings))
    centroids = mean_vectors(model.documents, "topic")
    views = {
        "reranked": clustering.rerank_keywords(chosen, vectors, centroids, top_n),
        "diverse": clustering.mmr_keywords(chosen, vectors, centroids, top_n, diversity),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("view", F.lit(v)) for v, df in views.items()])


def info_views(model: TopicModel, views: DataFrame) -> DataFrame:
    """M7: topic, size, the main words and those of each keyword view."""
    main = model.words.select("topic", "rank", "term", F.lit("words").alias("view"))
    return terms.topic_info_views(
        model.documents, main.unionByName(views.select("topic", "rank", "term", "view")), ["words", "reranked", "diverse"]
    )


def stability(model: TopicModel, n_runs: int = STABILITY_RUNS, seed: int = SEED, top_n: int = 15) -> DataFrame:
    """Refit with seeds seed, seed+1, ... and match every topic with its best counterpart."""
    prepared = model.documents.select("paper_id", "text", "embedding", "reduced")
    models = fit_runs(prepared, model.settings, [seed + run for run in range(n_runs)])
    runs = [fitted.words.withColumn("run", F.lit(run)) for run, fitted in enumerate(models)]
    return topic_eval.topic_stability(model.words, reduce(DataFrame.unionByName, runs), n_runs, top_n)


def evaluate_corpus(model: TopicModel, top_n: int = 10, min_tokens: int = 10) -> DataFrame:
    """Whole-corpus evaluation: c_v over a filtered dictionary, and diversity, as ``(metric, value)``."""
    docs = store(evaluation_tokens(model.documents, min_tokens))  # three passes read the tokens
    return topic_eval.evaluation_table(
        c_v=topic_eval.coherence_cv(
            docs, model.words, top_n, min_topics=2, dictionary=topic_eval.dictionary_filter(docs)
        ),
        jaccard=topic_eval.topic_diversity(model.words, top_n),
    )


def evaluate_discipline(model: TopicModel, top_n: int = 15) -> DataFrame:
    """Number of topics, c_npmi, c_v and diversity as ``(metric, value)``."""
    docs = model.documents.select("paper_id", tokenize_alpha(F.col("text")).alias("tokens"))
    return topic_eval.evaluation_table(**{
        "Number of Topics": topic_eval.topic_count(model.documents),
        "Topic Coherence (c_npmi)": topic_eval.coherence_npmi(docs, model.words, top_n),
        "Topic Coherence (c_v)": topic_eval.coherence_cv(docs, model.words, top_n),
        "Topic Diversity": topic_eval.topic_diversity(model.words, top_n, on_empty=1.0),
    })


def corpus_report(model: TopicModel, tau: float = 0.9) -> dict[str, DataFrame]:
    """Everything the whole-corpus study saves, by table name.

    Documents keep the topic they were given first beside the merged one; all other tables describe
    the topics after reduction.
    """
    merged = reduce_model(model, tau)
    overlap = topic_eval.topic_overlap(merged.words)
    similarity = topic_eval.topic_similarity(merged.documents)
    pairs = topic_eval.max_pair(overlap).withColumn("matrix", F.lit("word_overlap")).unionByName(
        topic_eval.max_pair(similarity).withColumn("matrix", F.lit("semantic_similarity"))
    )
    views = materialize(keyword_views(merged))
    return {
        "documents_with_topics": merged.documents.select(
            "paper_id", "text", F.col("topic_before").alias("topic"), F.col("topic").alias("topic_merged")
        ),
        "topic_info": info_views(merged, views),
        "keyword_views": views,
        "evaluation": evaluate_corpus(merged),
        "topic_word_overlap": overlap,
        "topic_semantic_similarity": similarity,
        "overlap_analysis": pairs,
    }


def discipline_report(model: TopicModel) -> dict[str, DataFrame]:
    """Everything the per-discipline study saves for one mode, by table name."""
    s = model.settings
    return {
        "doc_topics": model.documents.select(F.col("text").alias("document"), "topic"),
        "topic_info": terms.topic_info(model.documents, model.words),
        "rep_docs": terms.representative_docs(
            model.documents, model.weights, stop_words=s.stop_words, ngram_range=s.ngram_range,
            reduce_frequent_words=s.reduce_frequent_words,
        ),
        "stability": stability(model),
        "evaluation": evaluate_discipline(model),
    }


def discipline_models(assigned: DataFrame, target: str, settings: TopicSettings = DISCIPLINE_SETTINGS,
                      modes: Sequence[str] = ("include", "only"), is_literal: bool = False) -> dict[str, TopicModel]:
    """One model per mode; a mode with too few documents is left out.

    What any mode takes contains the target, so these papers are stored first: the assignment and all
    texts are read once, not in every pass over a mode's papers.
    """
    own = store(select_by_discipline(assigned, target, "include", is_literal=is_literal))
    models = {}
    for mode in modes:
        chosen = discipline_corpus(select_by_discipline(own, target, mode, is_literal=is_literal))
        if not chosen.isEmpty():
            models[mode] = fit_topics(prepare(chosen, settings), settings)
    return models


def compare_modes(models: dict[str, TopicModel]) -> DataFrame:
    """``(mode, metric, value)`` of all modes, one below the other."""
    return reduce(DataFrame.unionByName, [
        evaluate_discipline(model).withColumn("mode", F.lit(mode)) for mode, model in models.items()
    ])
