"""Topic terms: n-gram counts, class TF-IDF, topic words, representative documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.functions.text import ngrams, remove_words, tokenize_words
from papersieve.functions.vectors import as_double
from papersieve.session import join_by_skewed_key, join_salted, join_small, store


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def document_terms(text: Column, stop_words: Sequence[str] | None = None,
                   ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Terms of one text: word tokens, stop words out, then n-grams of what is left."""
    words = english_stop_words() if stop_words is None else stop_words
    return ngrams(remove_words(tokenize_words(text), words), *ngram_range)


def joint_counts(docs: DataFrame, topics: Sequence[str], text: str = "text", stop_words: Sequence[str] | None = None,
                 ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(*topics, term, n)``: terms counted by what several columns of topics say of their document."""
    return (
        docs.select(*topics, F.explode(document_terms(F.col(text), stop_words, ngram_range)).alias("term"))
        .groupBy(*topics, "term")
        .agg(F.count("*").alias("n"))
    )


def class_counts(docs: DataFrame, topic: str = "topic", text: str = "text", stop_words: Sequence[str] | None = None,
                 ngram_range: tuple[int, int] = (1, 1), min_df: int = 1) -> DataFrame:
    """``(topic, term, n)`` of the terms of at least ``min_df`` topics, before any other choice of terms.

    Merging topics can only lower the number of topics a term is in, so what falls below ``min_df``
    here would fall below it after any merge.
    """
    return select_terms(joint_counts(docs, [topic], text, stop_words, ngram_range), min_df=min_df)


def select_terms(counts: DataFrame, n_topics: DataFrame | None = None, min_df: int = 1, max_df: float = 1.0,
                 max_features: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` topics and at most that share of the ``n_topics`` (a one-cell frame).

    ``max_features`` keeps the most frequent of these terms, ties by term.
    """
    if min_df > 1 or max_df < 1.0:
        # a term's partition has at most one row per topic
        kept = F.col("_df") >= min_df
        if max_df < 1.0:
            kept &= F.col("_df") <= n_topics.scalar() * max_df
        counts = counts.withColumn("_df", F.count("*").over(Window.partitionBy("term"))).filter(kept).drop("_df")
    if max_features is not None:
        frequent = (
            counts.groupBy("term").agg(F.sum("n").alias("_total"))
            .orderBy(F.desc("_total"), "term").limit(max_features).select("term")
        )
        small = max_features <= 200_000
        counts = counts.join(F.broadcast(frequent) if small else frequent, "term", "left_semi")
    return counts


def term_counts(
    docs: DataFrame,
    topic: str = "topic",
    text: str = "text",
    stop_words: Sequence[str] | None = None,
    ngram_range: tuple[int, int] = (1, 1),
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """``(topic, term, n)``. Document frequency counts topics, each topic being one document.

    The n-grams of a paper stay inside the paper. ``max_features`` keeps the most frequent terms,
    ties by term.
    """
    counts = class_counts(docs, topic, text, stop_words, ngram_range)
    topics = docs.agg(F.count_distinct(topic).alias("n"))
    return select_terms(counts, topics, min_df, max_df, max_features)


def ctfidf(counts: DataFrame, topic: str = "topic", reduce_frequent_words: bool = False) -> DataFrame:
    """M2: class TF-IDF, ``(topic, term, n, idf, weight)``.

    Term share of the topic (its square root with ``reduce_frequent_words``) times
    ln(1 + A / frequency of the term), A being the mean number of terms per topic, cut to an integer
    (Grootendorst 2022). ``counts`` is read three times: pass stored counts for a large corpus.
    """
    totals = counts.groupBy(topic).agg(F.sum("n").alias("_topic_total"))
    mean = totals.agg(F.floor(F.sum("_topic_total") / F.count("*")).alias("a"))
    weighted = counts.withColumn("_frequency", F.sum("n").over(Window.partitionBy("term"))).withColumn(
        "idf", F.log(mean.scalar() / F.col("_frequency") + 1)
    )
    share = F.col("n") / F.col("_topic_total")
    tf = F.sqrt(share) if reduce_frequent_words else share
    return join_salted(weighted, totals, topic, spread_by="term").select(
        topic, "term", "n", "idf", (tf * F.col("idf")).alias("weight")
    )


def topic_words(weights: DataFrame, top_n: int = 15, topic: str = "topic") -> DataFrame:
    """M3+W7: ``(topic, rank, term, weight)``, the ``top_n`` heaviest terms, ties by term.

    Spark prunes each task to ``top_n`` rows per topic before the shuffle (window group limit).
    """
    order = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    return (
        weights.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
        .select(topic, "rank", "term", "weight")
    )


def topic_info(docs: DataFrame, words: DataFrame, topic: str = "topic") -> DataFrame:
    """M7: ``(topic, size, words)``; a topic without words has an empty list."""
    listed = words.groupBy(topic).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("words")
    )
    sizes = docs.groupBy(topic).agg(F.count("*").alias("size"))
    return sizes.join(listed, topic, "left").withColumn(
        "words", F.coalesce("words", F.array().cast("array<string>"))
    )


def topic_info_views(docs: DataFrame, views: DataFrame, names: Sequence[str], topic: str = "topic") -> DataFrame:
    """M7 with every view: ``(topic, size, <name>...)``, a list of words for each of ``names``.

    ``views(view, topic, rank, term)`` holds a few words per topic and view. A topic without words in
    a view has an empty list there.
    """
    def listed(name: str) -> Column:
        own = F.collect_list(F.when(F.col("view") == name, F.struct("rank", "term")))
        return F.transform(F.array_sort(own), lambda w: w["term"]).alias(name)

    words = views.groupBy(topic).agg(*[listed(n) for n in names])
    sizes = docs.groupBy(topic).agg(F.count("*").alias("size"))
    return sizes.join(words, topic, "left").select(
        topic, "size", *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in names]
    )


def term_vectors(docs: DataFrame, terms: DataFrame, text: str = "text", vector: str = "embedding",
                 stop_words: Sequence[str] | None = None, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(term, embedding)``: the mean vector of the documents a term occurs in.

    Words so lie in the space of the documents whatever model made their vectors. ``terms`` is a few
    words per topic; what a task sends on is one sum per term.
    """
    found = docs.select(
        F.col(vector).alias("embedding"),
        F.explode(F.array_distinct(document_terms(F.col(text), stop_words, ngram_range))).alias("term"),
    )
    mean = Summarizer.mean(array_to_vector(as_double(F.col("embedding"))))
    chosen = join_small(found, terms.select("term").distinct(), "term", spread_by="embedding")
    return chosen.groupBy("term").agg(vector_to_array(mean).alias("embedding"))


def representative_docs(
    docs: DataFrame,
    weights: DataFrame,
    k: int = 3,
    id_col: str = "paper_id",
    topic: str = "topic",
    text: str = "text",
    stop_words: Sequence[str] | None = None,
    ngram_range: tuple[int, int] = (1, 1),
    reduce_frequent_words: bool = False,
    outlier: int = -1,
) -> DataFrame:
    """M8+W8: ``(topic, rank, paper_id, similarity)``, the k documents closest to their topic's weights.

    Cosine between a document's own TF-IDF weights and its topic's class TF-IDF vector, ties by id.
    A frequent term of a large topic is a hot join key, so the weights come in by the skew-proof join.
    """
    inside = docs.filter(F.col(topic) != outlier)
    # making terms is costly: both passes over a document's terms read them stored
    per_doc = store(
        inside.select(
            id_col, topic, F.explode(document_terms(F.col(text), stop_words, ngram_range)).alias("term")
        )
        .groupBy(id_col, topic, "term")
        .agg(F.count("*").alias("_tf"))
    )
    key = F.concat_ws("\u0001", F.col(topic).cast("string"), "term").alias("_key")
    listed = weights.select(key, F.struct("weight", "idf").alias("_w"))
    # counted on the documents: terms that ``weights`` leaves out are often the most frequent ones
    counted = per_doc.select(key).groupBy("_key").agg(F.count("*").alias("_rows"))
    lookup = store(counted.join(listed, "_key", "left"))
    joined = join_by_skewed_key(per_doc.select("*", key), lookup, "_key", "_w", "_rows", id_col)
    tf = F.sqrt("_tf") if reduce_frequent_words else F.col("_tf").cast("double")
    own = tf * F.col("_w.idf")
    scored = joined.filter(F.col("_w").isNotNull()).groupBy(id_col, topic).agg(
        F.sum(own * F.col("_w.weight")).alias("_dot"), F.sum(own * own).alias("_own")
    )
    order = Window.partitionBy(topic).orderBy(F.desc(F.round("_closeness", 12)), id_col)
    best = (
        scored.withColumn("_closeness", F.col("_dot") / F.sqrt("_own"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
    norms = weights.groupBy(topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return best.join(norms, topic).select(
        topic, "rank", id_col, (F.col("_closeness") / F.col("_norm")).alias("similarity")
    )
