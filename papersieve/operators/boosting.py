"""Second-order boosted trees with split and leaf penalties (H8).

Rows are cut to bin numbers once, by approximate quantiles of every component. A level of a tree is one
pass: each task sums gradients and hessians of its rows by (node, component, bin), Spark adds these
histograms up, running sums over the bins give every split's gain (Chen and Guestrin, 2016), and the best
split of each node, at most 2^depth rows, comes to the driver. What moves depends on nodes, components and
bins, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.functions.vectors import as_double
from papersieve.operators.metrics import class_weight
from papersieve.session import store

#: Trees after which margins are stored with the rows, so that a pass evaluates no more than these.
STORE_EVERY = 25


@dataclass(frozen=True)
class Penalties:
    """What a split must gain (``gamma``), L1 and L2 of leaf weights, least hessian of a child, shrinkage."""

    gamma: float = 0.1
    l1: float = 0.1
    l2: float = 1.0
    min_child: float = 3.0
    learning_rate: float = 0.03


@dataclass
class Tree:
    """Nodes in heap order: 2i + 1 and 2i + 2 are the children of i; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    weight: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of ``bins`` ends in."""
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = 2 * at + 1 + (bins[inner, self.feature[at]] > self.cut[at])


@dataclass
class BoostedTrees:
    """``edges[f]`` are the ascending bin bounds of component f: a value is in the bin of the bounds below it."""

    edges: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def bins(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v) for e, v in zip(self.edges, vectors.T)], axis=1).astype(np.uint8)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.weight[t.leaf(bins)] for t in self.trees), np.zeros(len(bins)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 0))


def quantile_edges(train: DataFrame, vector: str, bins: int) -> np.ndarray:
    """[components, bins - 1] approximate quantiles; tasks send sketches, not values."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = (
        train.select(F.posexplode(as_double(F.col(vector))).alias("f", "x"))
        .groupBy("f").agg(F.percentile_approx("x", shares, 10_000).alias("edges")).orderBy("f").collect()
    )
    return np.array([r.edges for r in rows], float)


def binned(train: DataFrame, edges: np.ndarray, label: str, vector: str) -> DataFrame:
    """(bins, y, w, key, margin): bin numbers packed a byte each; positives weigh negatives / positives."""
    weight = class_weight(train, label).select("scale_pos_weight")
    rows = train.select(
        as_double(F.col(vector)).alias("v"), F.col(label).cast("double").alias("y"),
        F.when(F.col(label) == 1, weight.scalar()).otherwise(1.0).cast("double").alias("w"), F.xxhash64(vector).alias("key"),
    )
    model = BoostedTrees(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = [row.tobytes() for row in model.bins(_matrix(batch.column("v")))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), *(batch.column(c) for c in ("y", "w", "key")), pa.array(np.zeros(len(packed)))],
                ["bins", "y", "w", "key", "margin"],
            )

    return store(rows.mapInArrow(pack, "bins binary, y double, w double, key long, margin double"))


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.uint8) for b in batch.column("bins").to_pylist()])


def histograms(rows: DataFrame, recent: BoostedTrees, tree: Tree, level: int, features: np.ndarray, bins: int) -> DataFrame:
    """(node, feature, bin, g, h) summed over ``rows`` for the nodes of ``level`` that ``tree`` has so far."""
    first, width = 2**level - 1, 2**level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * len(features) * bins
        total = np.zeros((2, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch)
            y, w, margin = (batch.column(c).to_numpy() for c in ("y", "w", "margin"))
            p = 1 / (1 + np.exp(-(margin + recent.margin(x))))
            node = tree.leaf(x) - first
            here = node >= 0
            place = ((node[here, None] * len(features) + np.arange(len(features))) * bins + x[here][:, features]).ravel()
            for sums, value in zip(total, (w * (p - y), w * p * (1 - p))):
                sums += np.bincount(place, np.repeat(value[here], len(features)), size)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([
            pa.array((first + some // (len(features) * bins)).astype(np.int32)),
            pa.array(features[some // bins % len(features)].astype(np.int32)),
            pa.array((some % bins).astype(np.int32)), *(pa.array(t[some]) for t in total),
        ], ["node", "feature", "bin", "g", "h"])

    # a task sends a bin once; dealt by component, the sums and the running sums over bins need no further shuffle
    return (
        rows.mapInArrow(add, "node int, feature int, bin int, g double, h double").repartition("node", "feature")
        .groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )


def best_splits(found: DataFrame, limits: Penalties) -> DataFrame:
    """(node, g, h, best): sums of each node and its split of largest gain, null where none gains enough.

    Equal gains go to the lower component, then the lower bin.
    """
    run = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")

    def score(g: Column, h: Column) -> Column:
        held = F.greatest(F.abs(g) - limits.l1, F.lit(0.0))
        return held * held / (h + limits.l2)

    sides = found.select(
        "node", "feature", "bin", F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"),
        F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"),
    )
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = (score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("g"), F.col("h"))) / 2 - limits.gamma
    good = (F.col("hl") >= limits.min_child) & (hr >= limits.min_child) & (gain > 0)
    split = F.struct(
        F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"),
        "gl", "hl", gr.alias("gr"), hr.alias("hr"),
    )
    return sides.groupBy("node").agg(F.max_by("g", -F.col("feature")).alias("g"), F.max_by("h", -F.col("feature")).alias("h"), F.max(F.when(good, split)).alias("best"))


def leaf_weight(g: float, h: float, limits: Penalties) -> float:
    return -float(np.sign(g)) * max(abs(g) - limits.l1, 0.0) / (h + limits.l2) * limits.learning_rate


def grow(rows: DataFrame, recent: BoostedTrees, features: np.ndarray, depth: int, bins: int, limits: Penalties) -> Tree:
    """One tree on ``rows``, whose margins ``recent`` completes."""
    tree = Tree.empty(depth)
    for level in range(depth):
        splits = best_splits(histograms(rows, recent, tree, level, features, bins), limits).collect()
        for r in splits:
            if level == 0:
                tree.weight[0] = leaf_weight(r.g, r.h, limits)
            if r.best is not None:
                tree.feature[r.node], tree.cut[r.node] = -r.best.feature, -r.best.bin
                tree.weight[2 * r.node + 1] = leaf_weight(r.best.gl, r.best.hl, limits)
                tree.weight[2 * r.node + 2] = leaf_weight(r.best.gr, r.best.hr, limits)
        if not any(r.best is not None for r in splits):
            break
    return tree


def train_boosted(
    train: DataFrame,
    label: str = "label",
    vector: str = "embedding",
    n_trees: int = 500,
    max_depth: int = 4,
    limits: Penalties = Penalties(),
    subsample: float = 0.9,
    feature_share: float = 0.9,
    bins: int = 64,
    seed: int = 42,
) -> BoostedTrees:
    """H8: boosted trees on the rows that have a label and a vector.

    A tree sees the rows whose hash with its number falls into ``subsample`` (equal vectors go
    together) and a random ``feature_share`` of the components. ``bins`` is at most 256.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    train = train.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    model = BoostedTrees(quantile_edges(train, vector, bins))
    if not len(model.edges):
        return model
    rows, recent = binned(train, model.edges, label, vector), BoostedTrees(model.edges)
    rng = np.random.Generator(np.random.PCG64(seed))
    n_features = max(1, round(feature_share * len(model.edges)))
    for number in range(n_trees):
        features = np.sort(rng.choice(len(model.edges), n_features, replace=False))
        drawn = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(number)), F.lit(1 << 20)) < int(subsample * (1 << 20))
        tree = grow(rows.filter(drawn), recent, features, max_depth, bins, limits)
        model.trees.append(tree)
        recent.trees.append(tree)
        if len(recent.trees) == STORE_EVERY and number + 1 < n_trees:
            rows, recent = _with_margins(rows, recent), BoostedTrees(model.edges)
    return model


def _with_margins(rows: DataFrame, recent: BoostedTrees) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = batch.column("margin").to_numpy() + recent.margin(_unpacked(batch))
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return store(rows.mapInArrow(add, rows.schema))


def score_boosted(model: BoostedTrees, docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """H8: add ``model_score``, the probability of class 1; null where the vector is null."""

    @F.pandas_udf("double")
    def score(vectors):
        import pandas as pd

        out = np.full(len(vectors), np.nan)
        have = np.flatnonzero(vectors.notna().to_numpy())
        if len(have):
            out[have] = 1 / (1 + np.exp(-model.margin(model.bins(np.stack(vectors.iloc[have].to_list())))))
        return pd.Series(out).astype("Float64").where(~np.isnan(out), None)

    return docs.withColumn("model_score", score(as_double(F.col(vector))))
