"""Topic clustering by method, topic reduction by links, keyword views."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.functions.vectors import as_double, cosine, norm
from papersieve.operators.components import connected_components
from papersieve.operators.density import density_clusters
from papersieve.operators.disciplines import mean_vectors
from papersieve.operators.reduction import similar_pairs
from papersieve.session import join_small, materialize, store

OUTLIER = -1


def min_cluster_size(docs: DataFrame, floor: int = 15, divisor: int = 50) -> DataFrame:
    """max(floor, documents // divisor), one row ``(min_size)``."""
    return docs.agg(
        F.greatest(F.lit(floor), F.floor(F.count("*") / divisor)).cast("bigint").alias("min_size")
    )


def add_bisecting_topics(docs: DataFrame, k: int = 20, min_size: int | DataFrame = 5, features: str = "reduced",
                         seed: int = 42, output: str = "topic", points: DataFrame | None = None) -> DataFrame:
    """M1 (bisecting): ``docs`` with ``output`` from bisecting k-means; clusters below ``min_size`` are -1.

    The fitted model names the cluster of a row where it lies: nothing is moved, joined or stored for it.
    ``points`` may pass the ``features`` of all ``docs`` stored by themselves.
    """
    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_point", array_to_vector(as_double(F.col(features))))

    fitted = placed((docs if points is None else points).select(features)).select("_point")
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_point", predictionCol="_cluster").fit(fitted)
    smallest = min_size.scalar() if isinstance(min_size, DataFrame) else F.lit(min_size)
    # at most k rows
    sizes = model.transform(fitted).groupBy("_cluster").agg(F.count("*").alias("_size")).withColumn("_min", smallest)
    numbered = materialize(sizes.filter("_size >= _min").select(
        "_cluster",
        (F.row_number().over(Window.orderBy(F.desc("_size"), "_cluster")) - 1).alias("_topic"),
    ))
    found = model.transform(placed(docs)).join(F.broadcast(numbered), "_cluster", "left")
    return found.withColumn(output, F.coalesce("_topic", F.lit(OUTLIER))).drop("_cluster", "_point", "_topic")


def bisecting_clusters(docs: DataFrame, id_col: str = "paper_id", features: str = "reduced", **options) -> DataFrame:
    """M1 (bisecting): ``(id, topic)``, see ``add_bisecting_topics``."""
    return add_bisecting_topics(docs.select(id_col, features), features=features, **options).select(id_col, "topic")


def cluster_documents(docs: DataFrame, method: str = "density", **options) -> DataFrame:
    """M1: ``(id, topic)`` by ``density`` or ``bisecting``."""
    methods = {"density": density_clusters, "bisecting": bisecting_clusters}
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}")
    return methods[method](docs, **options)


def add_topics(docs: DataFrame, runs: dict[str, dict], method: str = "density", id_col: str = "paper_id",
               features: str = "reduced", **options) -> DataFrame:
    """M1: ``docs`` with a column of topics for each of ``runs``, which has the options of its own by its name.

    Density topics meet the documents in one join for all runs, stored as several passes read it.
    """
    if method == "bisecting":
        points = store(docs.select(features))  # making them from the vectors costs more than the passes of a fit
        for name, own in runs.items():
            docs = add_bisecting_topics(docs, features=features, output=name, points=points, **options, **own)
        return docs
    points = docs.select(id_col, features)
    found = [
        cluster_documents(points, method, id_col=id_col, features=features, **options, **own).withColumnRenamed("topic", name)
        for name, own in runs.items()
    ]
    return store(docs.join(reduce(lambda a, b: a.join(b, id_col), found), id_col), "zstd")


def merge_topics(docs: DataFrame, tau: float = 0.9, topic: str = "topic", vector: str = "embedding",
                 outlier: int = OUTLIER) -> DataFrame:
    """M6 (single linkage): ``(topic, topic_merged)``; topics linked by centroid cosine >= tau share their smallest id.

    ``reduction.reduce_topics`` is the agglomerative form, which the topic flow uses.

    The outlier topic merges with nothing. Assignments keep ``topic``; join this mapping for the
    merged one.
    """
    inside = docs.filter(F.col(topic) != outlier)
    links = similar_pairs(mean_vectors(inside, topic, vector).withColumnRenamed(topic, "topic"), tau, vector=vector)
    edges = links.select(F.col("topic_i").alias("src"), F.col("topic_j").alias("dst"))
    nodes = inside.select(F.col(topic).alias("node")).distinct()
    merged = connected_components(nodes, edges).select(
        F.col("node").alias("topic"), F.col("component").alias("topic_merged")
    )
    rest = docs.filter(F.col(topic) == outlier).select(
        F.col(topic).alias("topic"), F.col(topic).alias("topic_merged")
    ).distinct()
    return merged.unionByName(rest)


def add_merged_topics(docs: DataFrame, mapping: DataFrame, topic: str = "topic",
                      id_col: str = "paper_id") -> DataFrame:
    """M6+J8: attach ``topic_merged`` without moving the documents, unless the mapping is too large to broadcast."""
    return join_small(docs, mapping.withColumnRenamed("topic", topic), topic, spread_by=id_col)


def candidate_vectors(candidates: DataFrame, word_vectors: DataFrame, centroids: DataFrame,
                      topic: str = "topic") -> DataFrame:
    """``(topic, rank, term, weight, _word, _topic)``: candidates with their own and their topic's vector."""
    return (
        candidates.join(word_vectors.select("term", as_double(F.col("embedding")).alias("_word")), "term")
        .join(centroids.select(topic, as_double(F.col("embedding")).alias("_topic")), topic)
    )


def rerank_keywords(candidates: DataFrame, word_vectors: DataFrame, centroids: DataFrame, top_n: int = 10,
                    topic: str = "topic") -> DataFrame:
    """M4: candidate words by cosine to the topic centroid, ``(topic, rank, term, weight)``."""
    close = cosine(F.col("_word"), F.col("_topic"), norm(F.col("_word")), norm(F.col("_topic")))
    order = Window.partitionBy(topic).orderBy(F.desc(F.round("_close", 12)), "term")
    return (
        candidate_vectors(candidates, word_vectors, centroids, topic)
        .withColumn("_close", close)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
        .select(topic, "rank", "term", F.col("_close").alias("weight"))
    )


def mmr_keywords(candidates: DataFrame, word_vectors: DataFrame, centroids: DataFrame, top_n: int = 10,
                 diversity: float = 0.7, topic: str = "topic") -> DataFrame:
    """M5: maximal marginal relevance (Carbonell & Goldstein 1998), ``(topic, rank, term, weight)``.

    The pick is greedy over a topic's few candidate words, the one place that needs a Python group;
    a group holds only the candidates (some tens), never documents.
    """
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("term").reset_index(drop=True)
        words = np.array(group["_word"].tolist())
        centre = np.array(group["_topic"].iloc[0])
        lengths = np.linalg.norm(words, axis=1)
        unit = words / np.where(lengths > 0, lengths, 1.0)[:, None]
        relevance = np.round(unit @ centre / (np.linalg.norm(centre) or 1.0), 12)
        likeness = np.round(unit @ unit.T, 12)
        chosen: list[int] = []
        score = (1 - diversity) * relevance
        values = []
        while len(chosen) < min(top_n, len(group)):
            open_ = [i for i in range(len(group)) if i not in chosen]
            if chosen:
                score = (1 - diversity) * relevance - diversity * likeness[:, chosen].max(axis=1)
            best = max(open_, key=lambda i: (score[i], -i))
            chosen.append(best)
            values.append(float(score[best]))
        return pd.DataFrame({
            topic: group[topic].iloc[0], "rank": range(1, len(chosen) + 1),
            "term": group["term"].iloc[chosen].tolist(), "weight": values,
        })

    kind = candidates.schema[topic].dataType.simpleString()
    return (
        candidate_vectors(candidates, word_vectors, centroids, topic)
        .select(topic, "term", "_word", "_topic")
        .groupBy(topic).applyInPandas(pick, f"{topic} {kind}, rank int, term string, weight double")
    )
