"""Discipline assignment by similarity to anchors, and threshold studies.

Papers never meet anchors in a join: the few anchors travel as one array value, and scoring, ranking
and selection are row-local. A parameter study does not multiply papers by parameter points either:
each paper contributes at most three rows telling which points admit its first, second and third
discipline, those rows collapse under a partial aggregate to a size set by the parameters alone, and
only that small result is expanded over the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.functions.text import long_enough, parse_list_column, strip
from papersieve.functions.vectors import as_double
from papersieve.session import with_computed

# Relative and absolute bound of the second and third discipline.
RATIO, MINIMUM = 0.95, 0.80

# The grid of the threshold study and the sweep of the breadth study.
GRID_RATIOS = tuple(np.arange(0.85, 0.99, 0.01).tolist())
GRID_MINIMA = tuple(np.arange(0.70, 0.91, 0.02).tolist())
SWEEP = tuple(np.arange(0.75, 0.95, 0.01).tolist())


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """M9: mean vector per key, summed map-side so a large group costs no more than a small one."""
    mean = Summarizer.mean(array_to_vector(as_double(F.col(vector))))
    return df.groupBy(key).agg(vector_to_array(mean).alias(vector))


def label_centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Anchors from labelled vectors, named ``label_<n>`` and ordered by label."""
    return mean_vectors(df, label, vector).select(
        F.col(label).cast("int").alias("ordinal"),
        F.concat(F.lit("label_"), F.col(label).cast("string")).alias("discipline"),
        F.col(vector),
    )


def anchor_cosines(anchors: np.ndarray):
    """Arrow function from a batch of vectors to their cosines with all anchors, by one matrix product.

    The zero vector and a null vector have cosine 0; a vector of another length or with a null
    component has no cosines. Values are kept to 15 places, so equal anchors tie.
    """
    length = np.linalg.norm(anchors, axis=1)
    unit = (anchors / np.where(length > 0, length, 1.0)[:, None]).T
    dims, k = anchors.shape[1], len(anchors)

    def cosines(vectors: pa.Array) -> pa.Array:
        fits = pc.equal(pc.list_value_length(vectors), dims).fill_null(False).to_numpy(zero_copy_only=False)
        flat = vectors.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
        out = np.zeros((len(vectors), k))
        norms = np.linalg.norm(flat, axis=1, keepdims=True)
        out[fits] = np.round(flat @ unit / np.where(norms > 0, norms, 1.0), 15) + 0.0
        absent = ~fits & pc.is_valid(vectors).to_numpy(zero_copy_only=False)
        missing = np.repeat(absent, k) | np.isnan(out.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * k, pa.int32()), pa.array(out.ravel(), mask=missing))

    return cosines


def add_anchor_scores(docs: DataFrame, anchors: DataFrame, vector: str = "embedding") -> DataFrame:
    """T7+W1: add ``scores``, an array of (sim, ordinal, discipline) by descending similarity.

    Ties keep anchor order. ``anchors(ordinal, discipline, embedding)`` is a list the study states, nine
    in the taxonomy; every paper's result holds a score for each, so its length sets the output's width.
    The similarities of an Arrow batch of papers are one matrix product.
    """
    stated = sorted(anchors.select("ordinal", "discipline", as_double(F.col(vector)).alias("v")).collect(), key=lambda a: a.ordinal)
    if not stated:
        return docs.withColumn("scores", F.array().cast("array<struct<sim:double,ordinal:int,discipline:string>>"))
    product = F.arrow_udf(anchor_cosines(np.array([a.v for a in stated], np.float64).reshape(len(stated), -1)), "array<double>")
    names = F.array(*[F.struct(F.lit(a.ordinal).alias("ordinal"), F.lit(a.discipline).alias("discipline")) for a in stated])
    ranked = F.array_sort(F.zip_with("_cosines", names, lambda c, a: F.struct(
        (-c).alias("neg"), a["ordinal"].alias("ordinal"), a["discipline"].alias("discipline"),
    )))
    return (
        docs.withColumn("_cosines", product(F.col(vector)))
        .withColumn("scores", F.transform(ranked, lambda s: F.struct(
            (-s["neg"]).alias("sim"), s["ordinal"].alias("ordinal"), s["discipline"].alias("discipline"),
        )))
        .drop("_cosines")
    )


def anchor_scores(scored: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Long form ``(paper_id, ordinal, discipline, sim)``."""
    return scored.select(id_col, F.inline("scores")).select(id_col, "ordinal", "discipline", "sim")


def score_map(scores: Column) -> Column:
    """The score map of one paper: discipline -> similarity."""
    return F.map_from_entries(F.transform(scores, lambda s: F.struct(s["discipline"], s["sim"])))


def _sim(rank: int) -> Column:
    return F.get(F.col("scores"), F.lit(rank))["sim"]


def select_disciplines(
    scored: DataFrame,
    second_ratio: float = RATIO, second_min: float = MINIMUM,
    third_ratio: float = RATIO, third_min: float = MINIMUM,
) -> DataFrame:
    """Add ``present_disciplines`` (1-3 names, best first) and ``presence_breadth``.

    The second must reach a share of the first and a floor; the third a share of the second, and only
    if the second was taken. No scores give an empty list.
    """
    s1, s2, s3 = _sim(0), _sim(1), _sim(2)
    two = F.coalesce((s2 >= second_ratio * s1) & (s2 >= second_min), F.lit(False))
    three = two & F.coalesce((s3 >= third_ratio * s2) & (s3 >= third_min), F.lit(False))
    breadth = F.least(F.when(three, 3).when(two, 2).otherwise(1), F.size("scores"))
    return scored.withColumn("presence_breadth", breadth).withColumn(
        "present_disciplines",
        F.transform(F.slice("scores", 1, F.col("presence_breadth")), lambda s: s["discipline"]),
    )


def breadth_stats(assigned: DataFrame, zero_fill: bool = True) -> DataFrame:
    """A3: papers and percentage per breadth; 1-3 always listed when ``zero_fill``."""
    n = F.col("presence_breadth")
    if not zero_fill:
        total = assigned.agg(F.count("*").alias("n"))
        return assigned.groupBy(n).agg(F.count("*").alias("paper_count")).withColumn(
            "percentage", F.col("paper_count") * 100.0 / total.scalar()
        )
    counts = assigned.agg(
        F.count("*").alias("n"), *[F.count_if(n == b).alias(f"b{b}") for b in (1, 2, 3)]
    )
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(b).alias("presence_breadth"), F.col(f"b{b}").alias("paper_count"),
            F.coalesce(F.try_divide(F.col(f"b{b}") * 100.0, F.col("n")), F.lit(0.0)).alias("percentage"),
        ) for b in (1, 2, 3)
    ])))


def discipline_counts(assigned: DataFrame, ordered: bool = False) -> DataFrame:
    """Papers per discipline."""
    out = (
        assigned.select(F.explode("present_disciplines").alias("discipline"))
        .groupBy("discipline").agg(F.count("*").alias("paper_count"))
    )
    return out.orderBy(F.desc("paper_count"), "discipline") if ordered else out


def _reached(tests: Sequence[Column]) -> Column:
    """Number of tests that hold; NULL counts as not holding."""
    return reduce(add, [F.when(test, 1).otherwise(0) for test in tests], F.lit(0))


def _admissions(scored: DataFrame, ratios: Sequence[float], minima: Sequence[float]) -> DataFrame:
    """Papers reduced to ``(level, ratio_from, ratio_to, min_to, discipline, n, gain)``.

    With both parameters in ascending order, a row of level k stands for ``n`` papers whose k-th
    discipline is taken exactly with the ratios from place ``ratio_from`` up to before ``ratio_to`` and the
    first ``min_to`` minima: bounds are nested, so the number reached tells all of them (from below, or
    for a negative score from above). ``gain`` sums what taking it changes in the paper's mean selected
    similarity.
    """
    ratios, minima = sorted(ratios), sorted(minima)
    s1, s2, s3 = F.col("_s1"), F.col("_s2"), F.col("_s3")
    top = scored.select(
        *[_sim(k).alias(f"_s{k + 1}") for k in range(3)],
        *[F.get(F.col("scores"), F.lit(k))["discipline"].alias(f"_d{k + 1}") for k in range(3)],
    ).select(
        "*",
        _reached([s2 >= r * s1 for r in ratios]).alias("_r2"),
        _reached([s2 >= m for m in minima]).alias("_m2"),
        _reached([s3 >= r * s2 for r in ratios]).alias("_r3"),
        _reached([s3 >= m for m in minima]).alias("_m3"),
    )
    n_ratios, n_minima = F.lit(len(ratios)), F.lit(len(minima))
    mean2 = (s1 + s2) / 2

    def level(k: int, first: Column, last: Column, min_to: Column, gain: Column) -> Column:
        return F.struct(
            F.lit(k).alias("level"), first.alias("ratio_from"), last.alias("ratio_to"), min_to.alias("min_to"),
            F.col(f"_d{k}").alias("discipline"), gain.alias("_gain"),
        )

    def span(of: Column, reached: Column) -> tuple[Column, Column]:
        return F.when(of < 0, n_ratios - reached).otherwise(0), F.when(of < 0, n_ratios).otherwise(reached)

    (from2, to2), (from3, to3) = span(s1, F.col("_r2")), span(s2, F.col("_r3"))
    levels = F.array(
        level(1, F.lit(0), n_ratios, n_minima, s1),
        level(2, from2, to2, F.col("_m2"), mean2 - s1),
        level(3, F.greatest(from2, from3), F.least(to2, to3), F.least("_m2", "_m3"), (s1 + s2 + s3) / 3 - mean2),
    )
    return (
        top.select(F.inline(levels))
        .filter((F.col("ratio_from") < F.col("ratio_to")) & (F.col("min_to") > 0) & F.col("discipline").isNotNull())
        .groupBy("level", "ratio_from", "ratio_to", "min_to", "discipline")
        .agg(F.count("*").alias("n"), F.sum("_gain").alias("gain"))
    )


def _taken_per_point(scored: DataFrame, ratios: Sequence[float], minima: Sequence[float],
                     points: Sequence[tuple[int, int]]) -> DataFrame:
    """``(ratio, min, level, discipline, n, gain)`` for each point, from the collapsed admissions."""
    places = [{v: i for i, v in enumerate(sorted(values))} for values in (ratios, minima)]
    rows = [(places[0][ratios[i]], places[1][minima[j]], float(ratios[i]), float(minima[j])) for i, j in points]
    grid = F.broadcast(scored.sparkSession.createDataFrame(rows, "_i int, _j int, ratio double, min double"))  # as stated
    held = (F.col("_i") >= F.col("ratio_from")) & (F.col("_i") < F.col("ratio_to")) & (F.col("_j") < F.col("min_to"))
    return (
        _admissions(scored, ratios, minima).join(grid, held)
        .groupBy("ratio", "min", "level", "discipline")
        .agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    )


def threshold_grid(scored: DataFrame, ratios: Sequence[float] = GRID_RATIOS,
                   minima: Sequence[float] = GRID_MINIMA) -> DataFrame:
    """A9+A10: rates, mean similarities and assignment entropy per (ratio, min).

    ``multi_rate``/``single_rate`` are shares of all papers, ``top1_sim`` and ``selected_sim`` means
    over papers with scores, ``entropy`` is -sum p ln(p + 1e-10) over assignment shares.
    """
    points = [(i, j) for i in range(len(ratios)) for j in range(len(minima))]
    taken = _taken_per_point(scored, ratios, minima, points)
    papers = scored.agg(F.count("*").alias("n"))
    at_point = Window.partitionBy("ratio", "min")
    per_discipline = (
        taken.groupBy("ratio", "min", "discipline")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2)],
            F.sum(F.when(F.col("level") == 1, F.col("gain"))).alias("top1"),
            F.sum("gain").alias("gain"),
        )
        .withColumn("_p", F.col("n") / F.sum("n").over(at_point))
    )
    return (
        per_discipline.groupBy("ratio", "min")
        .agg(
            F.sum("n1").alias("_one"), F.sum("n2").alias("_two"),
            F.sum("top1").alias("_top1"), F.sum("gain").alias("_selected"),
            F.sum(-F.col("_p") * F.log(F.col("_p") + 1e-10)).alias("entropy"),
        )
        .withColumn("_all", papers.scalar())
        .select(
            "ratio", "min",
            (F.col("_two") / F.col("_all")).alias("multi_rate"),
            ((F.col("_one") - F.col("_two")) / F.col("_all")).alias("single_rate"),
            (F.col("_top1") / F.col("_one")).alias("top1_sim"),
            (F.col("_selected") / F.col("_one")).alias("selected_sim"),
            "entropy",
        )
    )


def current_setting(grid: DataFrame, ratio: float = RATIO, minimum: float = MINIMUM) -> DataFrame:
    """The grid row whose parameters equal the given ones up to 1e-8 + 1e-5 relative."""

    def close(c: Column, v: float) -> Column:
        return F.abs(c - v) <= 1e-8 + 1e-5 * abs(v)

    return grid.filter(close(F.col("ratio"), ratio) & close(F.col("min"), minimum))


def breadth_sweep(scored: DataFrame, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Share of papers of breadth 1, 2, 3 with one value as both bounds; absent ones are 0."""
    taken = _taken_per_point(
        scored, thresholds, thresholds, [(i, i) for i in range(len(thresholds))]
    )
    papers = scored.agg(F.count("*").alias("n"))
    at_least = taken.groupBy(F.col("ratio").alias("threshold")).agg(*[
        F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3)
    ]).withColumn("_all", papers.scalar())
    exactly = {1: F.col("n1") - F.col("n2"), 2: F.col("n2") - F.col("n3"), 3: F.col("n3")}
    return at_least.select("threshold", F.inline(F.array(*[
        F.struct(F.lit(b).alias("presence_breadth"), (n / F.col("_all")).alias("share"))
        for b, n in exactly.items()
    ])))


def discipline_entropy(assigned: DataFrame) -> DataFrame:
    """A10: entropy of the assignment shares of one assignment; 0 when there is none."""
    counts = discipline_counts(assigned)
    total = counts.agg(F.sum("paper_count").alias("n"))
    p = F.col("paper_count") / F.col("_n")
    return counts.withColumn("_n", total.scalar()).agg(
        F.coalesce(F.sum(-p * F.log(p + 1e-10)), F.lit(0.0)).alias("entropy")
    )


def select_by_discipline(df: DataFrame, target: str, mode: str = "include",
                         column: str = "present_disciplines", is_literal: bool = False) -> DataFrame:
    """P19+P20: papers whose list contains the target (``include``) or is just the target (``only``)."""
    if mode not in ("include", "only"):
        raise ValueError(f"mode must be include or only, not {mode!r}")
    items = parse_list_column(F.col(column)) if is_literal else F.transform(
        F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.lower(strip(x))
    )
    wanted = F.lit(target.lower())
    return df.filter(
        F.array_contains(items, wanted) if mode == "include"
        else (F.size(items) == 1) & (F.get(items, F.lit(0)) == wanted)
    )


def discipline_corpus(df: DataFrame, text: str = "text", min_chars: int = 50,
                      min_docs: int = 20) -> DataFrame:
    """P18+P21: trimmed texts longer than ``min_chars``; empty when fewer than ``min_docs`` remain."""
    docs = with_computed(df, text, strip(F.col(text))).filter(
        long_enough(F.col(text), min_chars, inclusive=False)
    )
    n = docs.agg(F.count("*").alias("n"))
    return docs.withColumn("_n", n.scalar()).filter(F.col("_n") >= min_docs).drop("_n")
