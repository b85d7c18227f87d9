import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from papersieve.operators import metrics, screening
from papersieve.operators.split import stratified_split


@pytest.mark.parametrize("text, want", [
    ("Large language models", 0.9), ("LLMs and AI", 0.9), ("a transformer", 0.9), ("transformers' use", 0.9),
    ("neural networks", 0.75), ("ai-based", 0.75), ("AI", 0.75), ("AIé", 0.0), ("éai", 0.0),
    ("my_ai", 0.0), ("maize", 0.0), (None, 0.0),
])
def test_keyword_tiers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(screening.keyword_score(F.col("t"))).first()[0] == want


def test_screen_floor_and_source(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 0.75), (2, 0.75, 0.75), (3, 0.1, 0.75), (4, 0.34, 0.0), (5, 0.35, 0.0)],
        "paper_id int, model_score double, keyword_score double",
    ).withColumn("final_score", F.greatest("model_score", "keyword_score"))
    got = [(r.paper_id, r.prediction_source) for r in screening.screen(df, 0.2, order_by="paper_id").collect()]
    assert got == [(1, "model_only"), (2, "both"), (3, "keyword_only"), (5, "model_only")]
    best = spark.createDataFrame([(0.76,)], "t double")
    assert screening.screen(df, best).count() == 1
    assert screening.source_distribution(screening.screen(df, 0.99)).count() == 0


def scores(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def best(spark, rows):
    return tuple(metrics.best_threshold(scores(spark, rows), "label", "score").first())


def test_best_threshold_ties_and_defaults(spark):
    assert best(spark, [(1, 0.9), (0, 0.1)]) == (0.2, 1.0)
    assert best(spark, [(1, 0.1), (0, 0.9)]) == (0.5, 0.0)
    assert best(spark, []) == (0.5, 0.0)


def test_threshold_is_compared_unrounded(spark):
    t = metrics.SEARCH_THRESHOLDS[10]
    tally = metrics.tally_by_threshold(scores(spark, [(1, t)]), "score", [t], "label").first()
    assert (tally.tp, tally.fn) == (1, 0)


@pytest.mark.parametrize("rows", [
    [(random.Random(s).randint(0, 1), round(random.Random(s * 7).random(), 2)) for s in range(400)],
    [(i % 2, 0.5) for i in range(50)],
])
def test_auc_equals_mllib_and_pairs(spark, rows):
    df = scores(spark, rows)
    ours = metrics.roc_auc(df, "label", "score", buckets=16).first().auc
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        df.withColumn("label", F.col("label").cast("double"))
    )
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ours == pytest.approx(pairs, abs=1e-12) == pytest.approx(mllib, abs=1e-9)


def test_report_of_a_one_sided_prediction(spark):
    confusion = metrics.confusion_matrix(scores(spark, [(1, 0.1), (0, 0.1), (0, 0.2)]), "label", "score", 0.5)
    report = {r["class"]: r for r in metrics.classification_report(confusion).collect()}
    assert report["1"].precision == report["1"].f1 == 0.0
    assert report["accuracy"].f1 == pytest.approx(2 / 3)
    assert report["weighted avg"].support == 3


def test_split_is_exact_stable_and_stratified(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "paper_id int, label int")
    got = {r.paper_id: r for r in stratified_split(df).collect()}
    taken = {y: sum(r.is_validation for r in got.values() if r.label == y) for y in (0, 1)}
    assert taken == {0: round(333 * 0.2), 1: round(167 * 0.2)} and len(got) == 500
    again = {r.paper_id: r for r in stratified_split(df.repartition(7)).collect()}
    assert got == again
    assert got != {r.paper_id: r for r in stratified_split(df, seed=1).collect()}


def test_split_keeps_rows_without_a_label(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(50)] + [(None, 1)]
    out = stratified_split(spark.createDataFrame(rows, "paper_id long, label int")).collect()
    assert len(out) == 51 and sum(r.is_validation for r in out if r.label is None) == 2
