import numpy as np

from papersieve.operators import boosting

SCHEMA = "paper_id long, label int, embedding array<double>"


def frame(spark, n, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 3)
    y = (x[:, 1] + 0.8 * x[:, 3] * (x[:, 0] > 0) + rng.normal(0, 0.3, n) > 0.4).astype(int)
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], SCHEMA).repartition(5), x, y


def brute_tree(bins, y, w, depth, n_bins, limits):
    """Node, component by component, bin by bin: (feature, cut) of inner nodes and weights of leaves by path."""
    g, h = w * (0.5 - y), w * 0.25

    def soft(total):
        return max(abs(total) - limits.l1, 0) ** 2

    def visit(rows, level):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = None
        for f in range(bins.shape[1]):
            for cut in range(n_bins):
                left = rows & (bins[:, f] <= cut)
                right = rows & ~left
                hl, hr = h[left].sum(), h[right].sum()
                gain = (soft(g[left].sum()) / (hl + limits.l2) + soft(g[right].sum()) / (hr + limits.l2) - soft(total_g) / (total_h + limits.l2)) / 2
                if hl >= limits.min_child and hr >= limits.min_child and gain - limits.gamma > 0 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, left, right)
        if level == depth or best is None:
            return [(rows, -np.sign(total_g) * max(abs(total_g) - limits.l1, 0) / (total_h + limits.l2) * limits.learning_rate)]
        return visit(best[3], level + 1) + visit(best[4], level + 1)

    out = np.zeros(len(y))
    for rows, weight in visit(np.ones(len(y), bool), 0):
        out[rows] = weight
    return out


def test_one_round_equals_brute_force(spark):
    docs, x, y = frame(spark, 200)
    limits = boosting.Penalties(gamma=0.2, l1=0.3, l2=1.5, min_child=2.0, learning_rate=0.5)
    model = boosting.train_boosted(docs, n_trees=1, max_depth=3, limits=limits, subsample=1.0, feature_share=1.0, bins=12)
    weight = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    want = brute_tree(model.bins(x), y, weight, 3, 12, limits)
    assert len(set(want.tolist())) > 3
    np.testing.assert_allclose(model.margin(model.bins(x)), want, atol=1e-9)
    got = {r.paper_id: r.model_score for r in boosting.score_boosted(model, docs).collect()}
    np.testing.assert_allclose([got[i] for i in range(200)], 1 / (1 + np.exp(-want)), atol=1e-9)


def test_later_rounds_fit_and_margins_are_stored(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    docs, x, y = frame(spark, 600)
    limits = boosting.Penalties(learning_rate=0.3)
    model = boosting.train_boosted(docs, n_trees=5, max_depth=3, limits=limits, bins=16)
    _, x2, y2 = frame(spark, 500, seed=9)
    margin = model.margin(model.bins(x2))
    above = (margin[y2 == 1][:, None] > margin[y2 == 0]).mean() + (margin[y2 == 1][:, None] == margin[y2 == 0]).mean() / 2
    assert above > 0.9
    monkeypatch.setattr(boosting, "STORE_EVERY", 100)
    unstored = boosting.train_boosted(docs, n_trees=5, max_depth=3, limits=limits, bins=16)
    assert all((a.feature == b.feature).all() and np.allclose(a.weight, b.weight) for a, b in zip(model.trees, unstored.trees))


def test_nulls_penalties_and_an_empty_table(spark):
    docs, _, _ = frame(spark, 120)
    holes = docs.union(spark.createDataFrame([(500, None, [0.0] * 6), (501, 1, None)], SCHEMA))
    model = boosting.train_boosted(holes, n_trees=2, max_depth=2)
    scores = {r.paper_id: r.model_score for r in boosting.score_boosted(model, holes).collect()}
    assert scores[501] is None and 0 < scores[500] < 1
    stiff = boosting.train_boosted(docs, n_trees=1, limits=boosting.Penalties(gamma=1e6))
    assert (stiff.trees[0].feature == -1).all()
    assert boosting.train_boosted(docs.limit(0), n_trees=2).trees == []
