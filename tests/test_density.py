"""The density hierarchy against a brute force of its definition, and on planted clusters."""

from itertools import product
from math import comb

import numpy as np
import pytest

from papersieve.operators import clustering, components, density


def by_hand(points, min_size, min_samples, octaves, steps=4, allow_single=False):
    """Set of clusters (frozensets of rows): boxes, levels, condensed tree and excess of mass spelled out."""
    n, dims = points.shape
    fine = 2 * points.std(axis=0).mean() / 2 ** (octaves - 1)
    finest = np.floor(points / fine).astype(int).tolist()
    around = list(product((0, 1), repeat=dims))
    levels, finer = [], []
    for octave in range(octaves):
        cell = [tuple(x >> octave for x in row) for row in finest]
        box = {}
        for c in cell:
            for o in around:
                v = tuple(a + b for a, b in zip(c, o))
                box[v] = box.get(v, 0) + 1
        dense = {v: k for v, k in box.items() if k >= min_samples}
        outer = {w for u in finer for w in product(*[range(a // 2, -(-a // 2) + 1) for a in u])}
        for step in reversed(range(steps)):
            label = {c: c for c in cell}

            def root(c):
                while label[c] != c:
                    c = label[c]
                return c

            touched = set()
            for v, k in dense.items():
                if k >= min_samples * 2 ** (step * dims / steps) or v in outer:
                    met = [c for c in (tuple(a - b for a, b in zip(v, o)) for o in around) if c in label]
                    touched |= set(met)
                    low = min(root(c) for c in met)
                    for c in met:
                        label[root(c)] = low
            groups = {}
            for i, c in enumerate(cell):
                if c in touched:
                    groups.setdefault(root(c), set()).add(i)
            levels.append((2.0 ** (-octave + step / steps), [frozenset(g) for g in groups.values() if len(g) >= min_size]))
        finer = list(dense)
    rating = {}
    for i, (scale, groups) in enumerate(levels):
        for g in groups:
            kids = [k for k in (levels[i - 1][1] if i else []) if k <= g]
            own = len(g) * scale * (2 ** (1 / steps) - 1)
            inside = [x for k in kids for x in rating[i - 1, k][2]]
            if len(kids) == 1:
                stable, below, rest = own + rating[i - 1, kids[0]][0], rating[i - 1, kids[0]][1], rating[i - 1, kids[0]][3]
            else:
                stable, below, rest = own, sum(max(rating[i - 1, k][:2]) for k in kids), inside
            rating[i, g] = (stable, below, [g] if round(stable, 9) >= round(below, 9) else rest, rest)
    top = len(levels) - 1
    roots = levels[top][1]
    which = 3 if len(roots) == 1 and not allow_single else 2
    return {x for g in roots for x in rating[top, g][which]}


def rand_index(a, b):
    table = np.zeros((len(set(a)), len(set(b))), int)
    np.add.at(table, (np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]), 1)
    pairs, rows, cols = (sum(comb(int(x), 2) for x in t.ravel()) for t in (table, table.sum(axis=1), table.sum(axis=0)))
    expected = rows * cols / comb(len(a), 2)
    return (pairs - expected) / ((rows + cols) / 2 - expected)


def clustered(spark, points, **options):
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "paper_id int, reduced array<double>")
    got = {r.paper_id: r.topic for r in clustering.density_clusters(df, dims=points.shape[1], **options).collect()}
    return np.array([got[i] for i in range(len(points))])


def as_sets(topics):
    return {frozenset(np.flatnonzero(topics == t).tolist()) for t in set(topics.tolist()) - {-1}}


def test_hierarchy_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([
        rng.normal([0, 0], 0.1, (120, 2)), rng.normal([1, 0], 0.12, (80, 2)), rng.normal([6, 3], 0.8, (100, 2)),
        np.full((40, 2), 3.3), rng.uniform(-8, 8, (60, 2)),
    ])
    topics = clustered(spark, points, min_size=10, min_samples=4, octaves=6)
    want = by_hand(points, 10, 4, 6)
    assert as_sets(topics) == want and len(want) >= 3
    sizes = [int((topics == t).sum()) for t in range(len(want))]
    assert sizes == sorted(sizes, reverse=True)


def test_hierarchy_finds_a_ring_a_core_and_noise(spark):
    rng = np.random.default_rng(0)
    angle = rng.uniform(0, 2 * np.pi, 500)
    ring = np.c_[6 * np.cos(angle), 6 * np.sin(angle)] + rng.normal(0, 0.25, (500, 2))
    points = np.vstack([ring, rng.normal(0, 0.8, (300, 2)), rng.uniform(-10, 10, (80, 2))])
    truth = np.repeat([0, 1, 2], [500, 300, 80])
    topics = clustered(spark, points, min_size=30, min_samples=4)
    assert rand_index(truth[truth < 2], topics[truth < 2]) >= 0.9


def test_hierarchy_finds_blobs_of_unequal_density(spark):
    rng = np.random.default_rng(0)
    spread = (0.15, 0.5, 1.5)
    points = np.vstack([rng.normal(c, s, (250, 3)) for c, s in zip([(0, 0, 0), (4, 0, 0), (0, 9, 0)], spread)])
    topics = clustered(spark, points, min_size=25, min_samples=4)
    assert rand_index(np.repeat(range(3), 250), topics) >= 0.9


def test_one_cluster_is_only_chosen_on_request(spark):
    points = np.random.default_rng(1).normal(size=(200, 2))
    assert set(clustered(spark, points, min_size=60, min_samples=4, octaves=4)) == {-1}
    assert set(clustered(spark, points, min_size=60, min_samples=4, octaves=4, allow_single=True)) <= {0, -1}
    assert (clustered(spark, points, min_size=60, min_samples=4, octaves=4, allow_single=True) == 0).mean() > 0.9


def test_points_without_a_vector_are_outliers(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(i, [9.0, 9.0]) for i in range(30, 60)] + [(90, None), (91, [1.0]), (92, [None, 2.0])]
    df = spark.createDataFrame(rows, "paper_id int, reduced array<double>")
    got = {r.paper_id: r.topic for r in clustering.density_clusters(df, min_size=5, min_samples=2, dims=2).collect()}
    assert [got[i] for i in (0, 30, 90, 91, 92)] == [0, 1, -1, -1, -1] or [got[i] for i in (0, 30, 90, 91, 92)] == [1, 0, -1, -1, -1]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(7)
    links = {
        "chain": [(i, i + 1) for i in range(200) if i % 50], "star": [(0, i) for i in range(1, 150)],
        "random": [tuple(map(int, x)) for x in rng.integers(0, 200, (150, 2))],
    }[shape]
    label = list(range(205))
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.createDataFrame([(i,) for i in range(205)], "node int")
    edges = spark.createDataFrame(links, "src int, dst int")
    got = {r.node: r.component for r in components.connected_components(nodes, edges).collect()}
    assert got == dict(enumerate(label))


def test_numbering_by_size(spark):
    groups = [(f"g{i:03}", int(n)) for i, n in enumerate(np.random.default_rng(3).integers(1, 6, 300))]
    got = {r.group: r.topic for r in components.numbered(spark.createDataFrame(groups, "group string, size long").repartition(5)).collect()}
    assert [g for g, _ in sorted(groups, key=lambda x: (-x[1], x[0]))] == sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(300))


def test_lone_cells_have_no_links(spark, monkeypatch):
    """The component search gets the dense cells, and links between cells that touch: none for crowds far apart."""
    given = {}
    search = density.connected_components

    def counted(nodes, edges):
        given["nodes"], given["edges"] = nodes.count(), edges.count()
        return search(nodes, edges)

    monkeypatch.setattr(density, "connected_components", counted)
    rows = [(5 * i + k, [float(1000 * (i % 4)), float(1000 * (i // 4))]) for i in range(16) for k in range(5)]
    docs = spark.createDataFrame(rows, "paper_id long, reduced array<double>")
    found = density.density_clusters(docs, min_size=3, dims=2, octaves=4, steps=2).collect()
    assert len({r.topic for r in found}) == 16 and all(r.topic >= 0 for r in found)
    assert given["nodes"] <= 16 * 4 * 2
    assert given["edges"] < given["nodes"]
