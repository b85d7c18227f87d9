"""Topic reduction and word views against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersieve import session
from papersieve.operators import clustering, reduction, terms, topic_eval
from papersieve.plans import topic_flow


def centroids(spark, n=300, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dims))
    rows = [(i, (base[i % 40] + rng.normal(size=dims) * 0.25).tolist()) for i in range(n)]
    rows[7] = (7, [0.0] * dims)
    rows[11] = (11, rows[10][1])  # a tie
    return rows, spark.createDataFrame(rows, "topic int, embedding array<double>")


def cosines(rows):
    v = np.array([r[1] for r in rows])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length > 0, length, 1)
    return unit @ unit.T


@pytest.mark.parametrize("tau", [-0.5, 0.3, 0.9, 0.99])
def test_similar_pairs_are_all_pairs(spark, tau):
    rows, df = centroids(spark)
    c = cosines(rows)
    want = {(i, j) for i in range(len(rows)) for j in range(i) if c[i, j] >= tau and 7 not in (i, j)}
    got = [(r.topic_j, r.topic_i) for r in reduction.similar_pairs(df, tau).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("tau", [-0.5, 0.3, 0.9])
def test_similar_pairs_meet_as_blocks(spark, tau):
    """One row per block and side reaches a task, not one per pair, and no pair is lost or doubled by cells and blocks."""
    rows, df = centroids(spark)
    c = cosines(rows)
    want = {(i, j): c[i, j] for i in range(len(rows)) for j in range(i) if c[i, j] >= tau and 7 not in (i, j)}
    pairs = reduction.similar_pairs(df, tau, block_bytes=8 * 8 * 16, few=0)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "zipwith" not in plan.lower()
    got = [(r.topic_j, r.topic_i, r.value) for r in pairs.collect()]
    assert len(got) == len(want) and {(i, j): pytest.approx(v, abs=1e-9) for i, j, v in got} == want


def test_similar_pairs_of_few_rows(spark):
    _, df = centroids(spark)
    assert reduction.similar_pairs(df.limit(0), 0.5).isEmpty() and reduction.similar_pairs(df.limit(1), 0.5).isEmpty()


@pytest.mark.parametrize("tau", [0.5, 0.95])
def test_agglomeration_equals_rounds_by_hand(spark, tau):
    rows, df = centroids(spark, n=120)
    sums, into = {t: np.array(v) for t, v in rows}, {t: t for t, _ in rows}
    while True:
        ids = sorted(sums)
        c = np.round(cosines([(t, sums[t]) for t in ids]), 12)
        best = {}
        for a, t in enumerate(ids):
            near = [(-c[a, b], u) for b, u in enumerate(ids) if u != t and c[a, b] >= tau and sums[t].any() and sums[u].any()]
            if near:
                best[t] = min(near)[1]
        pairs = [(t, u) for t, u in best.items() if best.get(u) == t and t < u]
        if not pairs:
            break
        for t, u in pairs:
            sums[t] = sums[t] + sums.pop(u)
            into = {k: t if v == u else v for k, v in into.items()}
    got = {r.topic: r.topic_merged for r in reduction.agglomerate(df, tau).collect()}
    assert got == into and len(set(into.values())) < len(into)


def corpus(spark, n=60, dims=64):
    """Three kinds of documents whose vectors have nothing to do with hashing; the first two are close."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, dims))
    base[1] = base[0] + rng.normal(size=dims) * 0.2
    words = [["graph", "node", "edge"], ["graph", "node", "path"], ["cell", "gene", "protein"]]
    rows = []
    for i in range(n):
        k = i % 3
        text = " ".join(rng.choice(words[k], 12)) + f" common extra{i % 5}"
        rows.append((i, text, (base[k] + rng.normal(size=dims) * 0.1).astype(float).tolist(), k if i else -1))
    return spark.createDataFrame(rows, "paper_id long, text string, embedding array<double>, topic int")


SETTINGS = topic_flow.TopicSettings(
    ngram_range=(1, 1), min_df=1, max_df=0.95, reduce_frequent_words=False, stop_words=(), top_n_words=5
)


def test_merged_model_equals_a_model_of_relabelled_documents(spark):
    docs = corpus(spark)
    merged = topic_flow.reduce_model(topic_flow.describe_topics(docs, SETTINGS), tau=0.8)
    assert {(r.topic_before, r.topic) for r in merged.documents.select("topic_before", "topic").distinct().collect()} == {
        (-1, -1), (0, 0), (1, 0), (2, 2)
    }
    relabelled = docs.withColumn("topic", F.expr("if(topic = 1, 0, topic)"))
    fresh = topic_flow.describe_topics(relabelled, SETTINGS)
    assert sorted(map(tuple, merged.words.collect())) == sorted(map(tuple, fresh.words.collect()))
    assert sorted(map(tuple, merged.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    tables = topic_flow.corpus_report(topic_flow.describe_topics(docs, SETTINGS), tau=0.8)
    info = {r.topic: r for r in tables["topic_info"].collect()}
    assert set(info) == {-1, 0, 2} and info[0]["size"] == 39 and set(info[2].words[:3]) == {"cell", "gene", "protein"}
    assert {(r.topic_i, r.topic_j) for r in tables["topic_semantic_similarity"].collect()} == {(i, j) for i in info for j in info}
    assert {r.topic for r in tables["documents_with_topics"].select("topic").distinct().collect()} == {-1, 0, 1, 2}


def test_words_of_given_vectors_lie_in_their_space(spark):
    docs = corpus(spark)
    model = topic_flow.describe_topics(docs, SETTINGS)
    views = topic_flow.keyword_views(model, candidates=10, top_n=3).collect()
    assert views and all(r.weight is not None for r in views)
    best = {(r.view, r.topic): r.term for r in views if r["rank"] == 1}
    assert best["reranked", 2] in {"cell", "gene", "protein"} and best["reranked", 1] == "path"
    by_hand = np.mean([r.embedding for r in docs.collect() if "path" in r.text.split()], axis=0)
    (got,) = terms.term_vectors(docs, spark.createDataFrame([("path",)], "term string"), stop_words=()).collect()
    assert np.allclose(got.embedding, by_hand)


def test_one_encoder_serves_documents_and_words(spark):
    def encoder(rows):
        return rows.withColumn("embedding", F.array(*[
            F.size(F.split("text", w)).cast("double") - 1 for w in ("graph", "cell", "gene", "path", "common")
        ]))

    settings = topic_flow.TopicSettings(
        dims=2, ngram_range=(1, 1), min_df=1, max_df=0.95, stop_words=(), encoder=encoder, main_view="reranked", top_n_words=2, candidates=6
    )
    prepared = topic_flow.prepare(corpus(spark).drop("embedding"), settings)
    assert len(prepared.first().embedding) == 5
    model = topic_flow.describe_topics(prepared.join(corpus(spark).select("paper_id", "topic"), "paper_id"), settings)
    words = {(r.topic, r["rank"]): r.term for r in model.words.collect()}
    assert words[0, 1] == "graph" and {words[2, 1], words[2, 2]} <= {"cell", "gene"}


def test_hashed_documents_hash_their_words(spark):
    settings = topic_flow.TopicSettings(dims=2, ngram_range=(1, 1), min_df=1, stop_words=())
    prepared = topic_flow.prepare(corpus(spark).drop("embedding"), settings)
    assert prepared.schema["embedding"].metadata == topic_flow.HASHED
    model = topic_flow.describe_topics(prepared.join(corpus(spark).select("paper_id", "topic"), "paper_id"), settings)
    words = spark.createDataFrame([("graph",), ("cell",)], "term string")
    assert {len(r.embedding) for r in topic_flow.word_vectors(model.documents, words, settings).collect()} == {256}


def test_merged_topics_attach_by_broadcast_or_salt(spark, monkeypatch):
    docs = corpus(spark).select("paper_id", "topic")
    mapping = spark.createDataFrame([(-1, -1), (0, 0), (1, 0), (2, 2)], "topic int, topic_merged int")
    want = sorted(map(tuple, clustering.add_merged_topics(docs, mapping).select("paper_id", "topic_merged").collect()))
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 0)
    got = clustering.add_merged_topics(docs, mapping).select("paper_id", "topic_merged").collect()
    assert sorted(map(tuple, got)) == want


def test_info_views_of_a_topic_without_words(spark):
    docs = spark.createDataFrame([(1, 0), (2, 5)], "paper_id long, topic int")
    views = spark.createDataFrame([("a", 0, 2, "y"), ("a", 0, 1, "x"), ("b", 0, 1, "z")], "view string, topic int, rank int, term string")
    got = {r.topic: (r["size"], r.a, r.b) for r in terms.topic_info_views(docs, views, ["a", "b"]).collect()}
    assert got == {0: (1, ["x", "y"], ["z"]), 5: (1, [], [])}
    assert topic_eval.topic_count(docs).first().n_topics == 2


def test_models_count_no_terms_before_they_are_read(spark, monkeypatch):
    """a merged model's documents need no term counts, its words no words of the parts."""
    def refuse(*args, **kwargs):
        raise AssertionError("not asked for")

    monkeypatch.setattr(topic_flow.terms, "class_counts", refuse)
    merged = topic_flow.reduce_model(topic_flow.describe_topics(corpus(spark), SETTINGS), tau=0.8)
    assert merged.documents.count() == corpus(spark).count()
    with pytest.raises(AssertionError, match="not asked for"):
        merged.words
