import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersieve.operators import clustering, terms, topic_eval


def words_df(spark, topics):
    rows = [(t, r, w) for t, ws in topics.items() for r, w in enumerate(ws, 1)]
    return spark.createDataFrame(rows, "topic int, rank int, term string")


def tokens_df(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "paper_id int, tokens array<string>")


def brute_coherence(docs, topics, window, measure):
    """Every window spelled out."""
    windows = []
    for d in docs:
        windows += [set(d[s:s + window]) for s in range(max(1, len(d) - window + 1))]
    n, eps = len(windows), 1e-12

    def p(*ws):
        return sum(all(w in x for w in ws) for x in windows) / n

    def npmi(a, b):
        if not p(a) or not p(b):
            return 0.0
        return math.log((p(a, b) + eps) / (p(a) * p(b))) / -math.log(p(a, b) + eps)

    values = []
    for ws in topics.values():
        m = np.array([[npmi(a, b) for b in ws] for a in ws])
        if measure == "npmi":
            values.append(np.mean([m[i, j] for i, j in itertools.combinations(range(len(ws)), 2)]))
        else:
            total = m.sum(axis=0)
            values.append(np.mean([
                r @ total / (np.linalg.norm(r) * np.linalg.norm(total)) if np.linalg.norm(r) else 0.0 for r in m
            ]))
    return float(np.mean(values))


@pytest.mark.parametrize("window", [1, 3, 10, 110])
def test_coherence_equals_spelled_out_windows(spark, window):
    rng = random.Random(window)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 9, 40, 150]))] for _ in range(25)]
    topics = {0: ["a", "b", "c"], 1: ["c", "d", "never", "e"], 4: ["g", "a"]}
    words = words_df(spark, {**topics, -1: ["h", "g"]})
    npmi = topic_eval.coherence_npmi(tokens_df(spark, docs), words, window=window).first().c_npmi
    assert npmi == pytest.approx(brute_coherence(docs, topics, window, "npmi"))
    cv = topic_eval.coherence_cv(tokens_df(spark, docs), words, window=window).first().c_v
    assert cv == pytest.approx(brute_coherence(docs, topics, window, "cv"))


def test_coherence_dictionary_and_topic_floor(spark):
    docs = [["a", "b", "c"], ["a", "c"], ["b"]]
    words = words_df(spark, {0: ["a", "b c", "b"], 1: ["c", "a"]})
    dictionary = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    got = topic_eval.coherence_cv(tokens_df(spark, docs), words, dictionary=dictionary).first().c_v
    assert got == pytest.approx(brute_coherence(docs, {0: ["a", "b"], 1: ["c", "a"]}, 110, "cv"))
    single = topic_eval.coherence_cv(tokens_df(spark, docs), words.filter("topic = 0"), min_topics=2)
    assert single.first().c_v is None


def test_dictionary_bounds(spark):
    docs = [["a", "b", "a"], ["a", "c"], ["a", "b"], ["d"]]
    got = {r.term: r.df for r in topic_eval.dictionary_filter(tokens_df(spark, docs), no_below=2).collect()}
    assert got == {"b": 2}
    top = topic_eval.dictionary_filter(tokens_df(spark, docs), no_below=1, no_above=1.0, keep_n=2).collect()
    assert [(r.term, r.df) for r in top] == [("a", 3), ("b", 2)]


def test_class_tfidf_by_hand(spark):
    docs = spark.createDataFrame(
        [(0, 0, "cat cat dog"), (1, 0, "the cat"), (2, 1, "dog fish")], "paper_id int, topic int, text string"
    )
    counts = terms.term_counts(docs, stop_words=["the"])
    assert {(r.topic, r.term): r.n for r in counts.collect()} == {
        (0, "cat"): 3, (0, "dog"): 1, (1, "dog"): 1, (1, "fish"): 1}
    a = (4 + 2) // 2
    want = {(0, "cat"): 3 / 4 * math.log(a / 3 + 1), (0, "dog"): 1 / 4 * math.log(a / 2 + 1),
            (1, "dog"): 1 / 2 * math.log(a / 2 + 1), (1, "fish"): 1 / 2 * math.log(a / 1 + 1)}
    weights = terms.ctfidf(counts)
    assert {(r.topic, r.term): r.weight for r in weights.collect()} == pytest.approx(want)
    damped = {(r.topic, r.term): r.weight for r in terms.ctfidf(counts, reduce_frequent_words=True).collect()}
    assert damped[(0, "dog")] == pytest.approx(math.sqrt(1 / 4) * math.log(a / 2 + 1))
    words = terms.topic_words(weights, 1)
    assert {r.topic: r.term for r in words.collect()} == {0: "cat", 1: "fish"}
    info = {r.topic: (r["size"], r.words) for r in terms.topic_info(docs, words.filter("topic = 1")).collect()}
    assert info == {0: (2, []), 1: (1, ["fish"])}
    rep = terms.representative_docs(docs, weights, k=1, stop_words=["the"]).collect()
    cat, dog = math.log(a / 3 + 1), math.log(a / 2 + 1)
    own, topic = np.array([2 * cat, dog]), np.array([3 * cat, dog])
    close = own @ topic / (np.linalg.norm(own) * np.linalg.norm(topic))  # the other paper reaches .915
    assert {r.topic: r.paper_id for r in rep} == {0: 0, 1: 2}
    assert {r.topic: r.similarity for r in rep} == pytest.approx({0: close, 1: 1.0})


def test_document_frequency_bounds_and_feature_limit(spark):
    docs = spark.createDataFrame(
        [(t, f"common pair{t // 2} single{t} " + "loud " * (t == 0) * 9) for t in range(4)], "topic int, text string"
    )
    kept = terms.term_counts(docs, stop_words=[], min_df=2, max_df=0.9).select("term").distinct()
    assert {r.term for r in kept.collect()} == {"pair0", "pair1"}
    top = terms.term_counts(docs, stop_words=[], max_features=2).select("term").distinct()
    assert {r.term for r in top.collect()} == {"loud", "common"}


def test_overlap_diversity_and_pairs(spark):
    topics = {-1: ["a", "z"], 0: ["a", "b"], 1: ["b", "c"], 2: ["d", "e"]}
    words = words_df(spark, topics)
    cells = {(r.topic_i, r.topic_j): r.value for r in topic_eval.topic_overlap(words).collect()}
    sets = {t: set(w) for t, w in topics.items()}
    full = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets}
    assert cells == {k: pytest.approx(v) for k, v in full.items() if v}
    got = topic_eval.topic_diversity(words).first().diversity
    assert got == pytest.approx(1 - (1 / 3) / 3)
    best = topic_eval.max_pair(topic_eval.topic_overlap(words)).first()
    assert (best.topic_i, best.topic_j) == (-1, 0)
    lone = words.filter("topic = 0")
    assert topic_eval.topic_diversity(lone, on_empty=1.0).first().diversity == 1.0
    assert topic_eval.topic_diversity(lone).first().diversity is None
    assert topic_eval.max_pair(topic_eval.topic_overlap(lone)).count() == 0


def test_similarity_matrix(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), [float(x) for x in rng.normal(size=4)]) for t in rng.integers(-1, 6, size=60)]
    df = spark.createDataFrame(rows, "topic int, embedding array<float>")
    got = {(r.topic_i, r.topic_j): r.value for r in topic_eval.topic_similarity(df, blocks=3).collect()}
    means = {t: np.mean([np.float32(v) for u, v in rows if u == t], axis=0) for t, _ in rows}
    assert set(got) == set(itertools.product(means, means))
    for (i, j), value in got.items():
        want = means[i] @ means[j] / (np.linalg.norm(means[i]) * np.linalg.norm(means[j]))
        assert value == pytest.approx(want, abs=1e-6) and -1 - 1e-9 <= value <= 1 + 1e-9


def test_stability_counts_missing_runs_as_zero(spark):
    base = words_df(spark, {0: ["a", "b"], 1: ["x", "y"]})
    runs = words_df(spark, {5: ["a", "b"], 6: ["b", "c"], -1: ["x", "y"]}).withColumn("run", F.lit(0)).unionByName(
        words_df(spark, {0: ["b", "c"]}).withColumn("run", F.lit(1)))
    got = {r.topic: r.stability_jaccard for r in topic_eval.topic_stability(base, runs, n_runs=2).collect()}
    assert got == {0: pytest.approx((1 + 1 / 3) / 2), 1: 0.0}


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
    [(random.Random(i).randrange(100), random.Random(i + 999).randrange(100)) for i in range(60)], [],
])
def test_connected_components(spark, edges):
    nodes = list(range(100))
    got = clustering.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int")
    )
    assert {r.node: r.component for r in got.collect()} == components(nodes, edges)


def test_density_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(0, 0.4, (80, 2)), rng.normal(5, 0.4, (50, 2)), rng.uniform(-9, 9, (30, 2)),
                        np.full((90, 2), 20.2)])
    df = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(points)], "paper_id int, reduced array<double>"
    )
    got = {r.paper_id: r.topic for r in clustering.density_clusters(
        df, min_size=10, min_samples=3, dims=2, cell=0.8).collect()}

    cell = [tuple(np.floor(p / 0.8).astype(int)) for p in points]
    dense = [c for c in set(cell) if cell.count(c) >= 3]
    links = [(a, b) for a in dense for b in dense if a < b and max(abs(x - y) for x, y in zip(a, b)) <= 1]
    group = components(dense, links)
    members = {}
    for i, c in enumerate(cell):
        if c in group:
            members.setdefault(group[c], set()).add(i)
    want = sorted((m for m in members.values() if len(m) >= 10), key=len, reverse=True)
    found = {}
    for i, t in got.items():
        found.setdefault(t, set()).add(i)
    assert set(got) == set(range(len(points)))
    assert [found[t] for t in range(len(found) - 1)] == want
    assert found[-1] == set(got) - set().union(*want)


@pytest.mark.parametrize("seed", [None, 42, 43])
def test_density_finds_blobs_with_the_default_width(spark, seed):
    rng = np.random.default_rng(8)
    centres = [(0, 0, 0), (12, 0, 3), (0, 15, -9)]
    sizes = (400, 300, 200)
    points = np.vstack([rng.normal(c, 0.5, (n, 3)) for c, n in zip(centres, sizes)])
    df = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(points)], "paper_id int, reduced array<double>"
    )
    topics = [r.topic for r in clustering.density_clusters(
        df, min_size=50, min_samples=3, dims=3, seed=seed).orderBy("paper_id").collect()]
    start = 0
    for topic, n in enumerate(sizes):
        inside = topics[start:start + n]
        assert set(inside) <= {topic, -1} and inside.count(topic) > 0.9 * n
        start += n


def test_bisecting_drops_small_clusters(spark):
    points = [(i, [0.0, float(i % 3) / 10]) for i in range(30)] + [(99, [50.0, 50.0])]
    df = spark.createDataFrame(points, "paper_id int, reduced array<double>")
    got = {r.paper_id: r.topic for r in clustering.cluster_documents(df, "bisecting", k=2, min_size=5).collect()}
    assert got[99] == -1 and {got[i] for i in range(30)} == {0}
    assert clustering.min_cluster_size(df).first().min_size == 15


def test_topic_merging(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (-1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "paper_id int, topic int, embedding array<float>")
    mapping = clustering.merge_topics(df, 0.9)
    assert {r.topic: r.topic_merged for r in mapping.collect()} == {0: 0, 1: 0, 2: 2, -1: -1}
    merged = clustering.add_merged_topics(df, mapping)
    assert {r.paper_id: r.topic_merged for r in merged.collect()} == {0: 0, 1: 0, 2: 2, 3: -1}


def test_keyword_views(spark):
    words = words_df(spark, {0: ["a", "b", "c"]}).withColumn("weight", F.lit(1.0))
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.6, 0.8])], "term string, embedding array<float>")
    centroid = spark.createDataFrame([(0, [1.0, 0.0])], "topic int, embedding array<float>")
    ranked = clustering.rerank_keywords(words, vectors, centroid, 2).orderBy("rank").collect()
    assert [r.term for r in ranked] == ["a", "b"]
    diverse = clustering.mmr_keywords(words, vectors, centroid, 2).orderBy("rank").collect()
    assert [r.term for r in diverse] == ["a", "c"]


def test_dictionary_reads_its_documents_once(spark):
    """Tokens are costly to make: the number of documents comes from the pass that counts the terms."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, ["a", "b", "b"] if i % 2 else ["a", f"t{i % 4}"]) for i in range(40)] + [(40, []), (41, None)]

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "paper_id long, tokens array<string>")
    found = topic_eval.dictionary_filter(df.mapInArrow(read, df.schema), no_below=5, no_above=0.5)
    assert {r.term: r.df for r in found.collect()} == {"b": 20, "t0": 10, "t2": 10}
    assert seen.value == len(rows)
