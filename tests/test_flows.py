"""The composed studies on the smallest test tables."""

import re
import time

import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from papersieve.operators.disciplines import select_disciplines
from papersieve.plans import discipline_flow, screening_flow, topic_flow
from papersieve.session import store
from papersieve.sources import sinks

SETTINGS = topic_flow.TopicSettings(
    method="bisecting", min_size=5, ngram_range=(1, 2), stop_words=fixtures.FIXTURE_STOP_WORDS,
    cluster_options=(("k", 5),),
)


def test_screening_study(spark, sf_dir, tmp_path):
    papers = fixtures.papers(spark, sf_dir)
    labels = fixtures.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("paper_id"), F.col("quality").alias("label")
    )
    train = papers.select("paper_id", "title", "abstract").join(labels, "paper_id")
    tables = screening_flow.screen_corpus(train, papers, tiers=fixtures.FIXTURE_TIERS, n_trees=3)
    steps = {r.item: r.paper_count for r in tables["cleaning_waterfall"].collect()}
    stats = tables["corpus_stats"].first()
    assert stats.original_count == papers.count() == steps["Initial records"]
    assert stats.after_cleaning_count == steps["Final records"]
    assert tables["removed_records"].count() == steps["Total removed"]
    assert stats.final_count == tables["predictions"].count()
    assert sum(r["count"] for r in tables["final_source"].collect()) == stats.final_count
    performance = {r.metric: r.value for r in tables["hybrid_performance"].collect()}
    confusion = tables["confusion"].first()
    assert performance["Validation Size"] == sum(confusion)
    assert 0 <= performance["AUC"] <= 1
    assert tables["validation_threshold"].count() == tables["test_threshold"].count() == 5
    sinks.write_report({"hybrid_performance": tables["hybrid_performance"]}, str(tmp_path))


def test_discipline_study(spark, sf_dir):
    papers = fixtures.papers(spark, sf_dir).withColumn("pub_year", F.expr("try_cast(pub_year as int)"))
    tables = discipline_flow.assign_disciplines(papers, ratio=0.5, minimum=0.0)
    assignment = tables["assignment"]
    assert assignment.count() == papers.count()
    assert assignment.filter("size(discipline_scores) <> 9 or presence_breadth not between 1 and 3").isEmpty()
    breadth = sum(r.paper_count for r in tables["breadth_stats"].collect())
    assert breadth == papers.count()
    assert tables["threshold_grid"].count() == 165 and tables["breadth_sweep"].count() == 60
    for table in ("discipline_trends", "discipline_share", "research_types", "discipline_counts"):
        assert not tables[table].isEmpty()
    with pytest.raises(ValueError):
        discipline_flow.assign_disciplines(papers.drop("abstract"))


def test_corpus_topic_study(spark, sf_dir):
    docs = topic_flow.corpus_documents(
        fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    )
    model = topic_flow.fit_topics(topic_flow.prepare(docs, SETTINGS), SETTINGS)
    tables = topic_flow.corpus_report(model, tau=0.99)
    n = docs.count()
    assert tables["documents_with_topics"].count() == n
    assert sum(r["size"] for r in tables["topic_info"].collect()) == n
    metrics = {r.metric: r.value for r in tables["evaluation"].collect()}
    assert set(metrics) == {"c_v", "jaccard"} and 0 <= metrics["jaccard"] <= 1
    assert {r.view for r in tables["keyword_views"].collect()} == {"reranked", "diverse"}
    assert tables["overlap_analysis"].count() <= 2


def test_per_discipline_study(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text").withColumn(
        "present_disciplines", F.expr("if(paper_id % 4 = 0, array('A', 'B'), array('A'))")
    )
    models = topic_flow.discipline_models(docs, "a", SETTINGS)
    assert set(models) == {"include", "only"}
    assert topic_flow.discipline_models(docs, "absent", SETTINGS) == {}
    compared = topic_flow.compare_modes(models)
    assert compared.count() == 8
    tables = topic_flow.discipline_report(models["only"])
    topics = {r.topic for r in tables["doc_topics"].select("topic").distinct().collect()} - {-1}
    assert {r.topic for r in tables["stability"].collect()} <= topics
    assert all(0 <= r.stability_jaccard <= 1 for r in tables["stability"].collect())
    assert {r.topic for r in tables["rep_docs"].collect()} <= topics


def test_modes_read_the_assignment_once(spark, sf_dir):
    """every pass over a mode's papers used to assign and join all documents again."""
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def present(i):
        seen.add(1)
        return ["a"] if i % 2 else ["a", "b"]

    assigned = docs.withColumn("present_disciplines", present.asNondeterministic()("paper_id"))
    models = topic_flow.discipline_models(assigned, "a", SETTINGS)
    assert {m: model.documents.count() for m, model in models.items()} == {
        "include": docs.filter("length(trim(text)) > 50").count(),
        "only": docs.filter("length(trim(text)) > 50 and paper_id % 2 = 1").count(),
    }
    assert seen.value == docs.count()


def test_stability_stores_the_texts_once(spark, sf_dir, monkeypatch):
    """the model and each rerun shuffled and stored all texts and vectors again."""
    seen = []
    for name in ("materialize", "store"):
        kept = getattr(topic_flow, name)
        monkeypatch.setattr(topic_flow, name, lambda df, *rest, kept=kept: seen.append(df.columns) or kept(df, *rest))
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")
    model = topic_flow.fit_topics(topic_flow.prepare(docs, SETTINGS), SETTINGS)
    plan = model.documents._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(paper_id" not in plan
    found = {r.topic: r.stability_jaccard for r in topic_flow.stability(model).collect()}
    assert sum("text" in columns for columns in seen) == 1
    # rerun 0 repeats the base seed, so a topic meets itself there
    assert found and all(1 / 3 <= share <= 1 for share in found.values())
    assert {r.paper_id: r.text for r in model.documents.collect()} == {r.paper_id: r.text for r in docs.collect()}


def test_a_stored_table_leaves_no_shuffle(spark):
    """shuffles of what is stored stayed on disk until the driver happened to collect its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n.split("_")[1] for n in re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllFiles().mkString(" "))}

    before = shuffles()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = store(counts)
    wait = time.time() + 20
    while (left := shuffles() - before) and time.time() < wait:
        time.sleep(0.2)
    assert not left
    assert {r.k: r["count"] for r in stored.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    assert counts.count() == 7 and "text" in topic_flow.embedding.embed_documents(
        spark.createDataFrame([(1, "one two"), (2, "two three")], "paper_id int, text string"), hot_tokens=1, keep=["text"]
    ).filter("text like '%two%'").columns


def test_runs_counted_together_have_the_words_of_runs_counted_apart(spark, sf_dir, monkeypatch):
    """each rerun read and split all texts; apart they are counted only where runs differ much."""
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")
    marked = store(topic_flow.prepare(docs, SETTINGS).withColumns({
        "_topic_0": (F.col("paper_id") % 3 - 1).cast("int"), "_topic_1": (F.col("paper_id") % 4 - 1).cast("int"),
    }))
    monkeypatch.setattr(topic_flow, "_clustered", lambda *_: marked)
    passes, joint = [], topic_flow.terms.joint_counts
    monkeypatch.setattr(topic_flow.terms, "joint_counts", lambda df, topics, *a, **b: passes.append(topics) or joint(df, topics, *a, **b))
    words = []
    for most in (4, 0):
        monkeypatch.setattr(topic_flow, "JOINT_PARTS", most)
        fitted = topic_flow.fit_runs(marked, SETTINGS, [1, 2])
        words.append([sorted((r.topic, r["rank"], r.term, round(r.weight, 9)) for r in m.words.collect()) for m in fitted])
    assert words[0] == words[1] and all(words[0]) and words[0][0] != words[0][1]
    assert passes == [["_topic_0", "_topic_1"], ["topic"], ["topic"]]
