"""Boosted-tree screening model (H8)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.vectors import as_double
from papersieve.operators.metrics import class_weight


def train_screener(
    train: DataFrame,
    label: str = "label",
    vector: str = "embedding",
    n_trees: int = 500,
    max_depth: int = 4,
    learning_rate: float = 0.03,
    subsample: float = 0.9,
    feature_share: float = 0.9,
    min_child: int = 3,
    seed: int = 42,
) -> GBTClassificationModel:
    """H8: gradient-boosted trees; positives weigh negatives / positives.

    MLlib has no L1/L2 leaf penalty and measures split gain differently, so those settings have no
    counterpart here.
    """
    weight = class_weight(train, label).select("scale_pos_weight")
    prepared = train.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(as_double(F.col(vector))).alias("features"),
        F.when(F.col(label) == 1, weight.scalar()).otherwise(1.0).alias("weight"),
    )
    return GBTClassifier(
        maxIter=n_trees, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample,
        featureSubsetStrategy=str(feature_share), minInstancesPerNode=min_child, weightCol="weight",
        checkpointInterval=10, seed=seed,
    ).fit(prepared)


def score_screener(model: GBTClassificationModel, docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """H8: add ``model_score``, the probability of class 1."""
    scored = model.transform(docs.withColumn("features", array_to_vector(as_double(F.col(vector)))))
    return scored.withColumn("model_score", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )
