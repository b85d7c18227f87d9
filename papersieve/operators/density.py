"""Density clustering over a hierarchy of grids (M1).

Points are counted per cell of nested grids, so a crowd of near-copies is one row and no pair of
points is ever formed. The density at a corner of a grid is the number of points in the cells
around it, a box two cells wide; a corner with ``min_samples`` points is dense, and non-empty cells
around a dense corner are connected. A box of a finer grid lies in a box of the coarser one, so
clusters nest as the scale shrinks: finer clusters lie in coarser ones.

Between two grids (an octave) corners drop out in ``steps`` by the scale at which their box would
just hold ``min_samples`` points, those that hold a dense box of the finer grid last. That gives the
density hierarchy of HDBSCAN* (Campello et al. 2013) with cells for points: clusters below the
minimum size fall out, a cluster ends where two large parts part, its stability is its excess of
mass, the integral of its size over density scale, and a cluster is chosen when it is more stable than
all that can be chosen inside it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.functions.vectors import as_double
from papersieve.operators.components import connected_components, numbered
from papersieve.session import join_by_skewed_key, join_salted, join_small, materialize, store

OUTLIER = -1


def _exploded(rows: DataFrame, at: str, options: list[Column], output: str) -> DataFrame:
    """A row for every combination of ``options[i]`` (an array per dimension); ``output`` is the array of choices."""
    for i, option in enumerate(options):
        rows = rows.withColumn(f"_o{i}", F.explode(option))
    names = [f"_o{i}" for i in range(len(options))]
    return rows.withColumn(output, F.array(*names)).drop(*names)


def corners(cells: DataFrame, dims: int, at: str = "_at") -> DataFrame:
    """Each cell with the 2**dims corners around it; cells touch exactly where they share one."""
    x = [F.get(at, F.lit(i)) for i in range(dims)]
    return _exploded(cells, at, [F.array(v, v + 1) for v in x], "_corner")


def _named(level: Column, kind: str, at: str) -> Column:
    return F.concat_ws(",", level, F.lit(kind), F.array_join(F.col(at).cast("array<string>"), ","))


def _octave(cells: DataFrame, dims: int, min_samples: int, steps: int, finer: DataFrame | None) -> DataFrame:
    """``(_corner, _cells, _step)`` of the dense corners: the cells around, at most 2**dims, and the last step each is dense in."""
    around = corners(cells, dims).groupBy("_corner").agg(F.sum("_n").alias("_box"), F.collect_list(F.struct("_at", "_n")).alias("_cells"))
    dense = around.filter(F.col("_box") >= min_samples)
    passed = sum((F.col("_box") >= min_samples * 2 ** (j * dims / steps)).cast("int") for j in range(1, steps)) if steps > 1 else F.lit(0)
    held = dense.withColumn("_step", passed)
    if finer is not None:
        x = [F.get("_corner", F.lit(i)) for i in range(dims)]
        halves = [F.sequence(F.shiftright(v, 1), F.shiftright(v + 1, 1)) for v in x]
        inside = _exploded(finer.select("_corner"), "_corner", halves, "_outer")
        inside = inside.select(F.col("_outer").alias("_corner"), F.lit(True).alias("_holds")).distinct()
        held = held.join(inside, "_corner", "left").withColumn("_step", F.when(F.col("_holds"), steps - 1).otherwise(F.col("_step")))
    return materialize(held.select("_corner", "_cells", "_step"))


def _hierarchy(counted: DataFrame, dims: int, min_samples: int, min_size: Column, octaves: int, steps: int) -> DataFrame:
    """``(_level, _at, _n, component)`` of cells in large components; level 0 is the densest, ``_at`` a cell of its octave's grid.

    The cells around a corner are linked to the first of them; a link that several corners give is taken
    once, with the last step of any, before it is spread over its levels.
    """
    links, places, cells, finer = [], [], counted, None
    for octave in range(octaves):
        if octave:
            cells = materialize(cells.groupBy(F.transform("_at", lambda x: F.shiftright(x, 1)).alias("_at")).agg(F.sum("_n").alias("_n")))
        finer = _octave(cells, dims, min_samples, steps, finer)
        level = F.explode(F.transform(F.sequence(F.lit(0), F.col("_step")), lambda j: F.lit(octave * steps + steps - 1) - j)).alias("_level")
        last = F.max("_step").alias("_step")
        places.append(finer.select("_step", F.inline("_cells")).groupBy("_at", "_n").agg(last).select("_at", "_n", level))
        met = finer.filter(F.size("_cells") > 1).select("_step", F.array_min("_cells")["_at"].alias("_hub"), F.inline("_cells"))
        links.append(met.filter("_at <> _hub").groupBy("_at", "_hub").agg(last).select("_at", "_hub", level))
    every = materialize(reduce(DataFrame.unionByName, places).withColumn("_cell", _named(F.col("_level"), "c", "_at")))
    edges = reduce(DataFrame.unionByName, links).select(
        _named(F.col("_level"), "c", "_at").alias("src"), _named(F.col("_level"), "c", "_hub").alias("dst")
    )
    found = connected_components(every.select(F.col("_cell").alias("node")), edges)
    held = every.join(found.withColumnRenamed("node", "_cell"), "_cell")
    held = materialize(held.drop("_cell"))
    large = held.groupBy("component").agg(F.sum("_n").alias("_size")).withColumn("_min", min_size).filter("_size >= _min")
    # one component may hold most cells of a level
    return materialize(join_small(held, large.select("component", "_size"), "component", spread_by="_at"))


def _chosen(held: DataFrame, octaves: int, steps: int, allow_single: bool) -> DataFrame:
    """Components that start a cluster which is at least as stable as what is inside it: ``(_level, component)``."""
    top = octaves * steps - 1
    sizes = held.groupBy("_level", "component", "_size").agg(F.min("_at").alias("_at"))
    outer = F.when((F.col("_level") + 1) % steps == 0, F.transform("_at", lambda x: F.shiftright(x, 1))).otherwise(F.col("_at"))
    above = held.select((F.col("_level") - 1).alias("_level"), "_at", F.col("component").alias("_parent"))
    tree = materialize(
        sizes.withColumn("_at", outer).join(above, ["_level", "_at"], "left").select("_level", "component", "_size", "_parent")
    )
    levels = sorted(r["_level"] for r in tree.select("_level").distinct().collect())  # at most octaves * steps rows
    state, rated, pending = None, [], []
    for level in levels:
        width = 2.0 ** (-(level // steps) + (steps - 1 - level % steps) / steps) * (2 ** (1 / steps) - 1)
        here = tree.filter(F.col("_level") == level).withColumn("_own", F.col("_size") * width)
        if state is None:
            here = here.select("*", F.lit(0).alias("_kids"), F.lit(0.0).alias("_inside"), F.lit(0.0).alias("_chain"), F.lit(0.0).alias("_rest"))
        else:
            parts = state.groupBy(F.col("_parent").alias("component")).agg(
                F.count("*").alias("_kids"), F.sum(F.greatest("_stable", "_below")).alias("_inside"),
                F.max("_stable").alias("_chain"), F.max("_below").alias("_rest"),
            )
            here = here.join(parts, "component", "left").fillna(0, ["_kids", "_inside", "_chain", "_rest"])
        one = F.col("_kids") == 1
        state = here.select(
            "_level", "component", "_parent", "_kids",
            (F.col("_own") + F.when(one, F.col("_chain")).otherwise(0.0)).alias("_stable"),
            F.when(one, F.col("_rest")).otherwise(F.col("_inside")).alias("_below"),
        )
        pending.append(state)
        if len(pending) == steps or level == levels[-1]:  # an octave at a time
            done = store(reduce(DataFrame.unionByName, pending))
            rated.append(done)
            state, pending = done.filter(F.col("_level") == level), []
    every = reduce(DataFrame.unionByName, rated)
    split = every.filter("_kids > 1").select(F.col("component").alias("_parent"), F.lit(True).alias("_split"))
    starts = every.join(split, "_parent", "left").filter(F.col("_split") | F.col("_parent").isNull())
    good = starts.filter(F.round("_stable", 9) >= F.round("_below", 9))
    if not allow_single and every.filter(F.col("_level") == top).count() == 1:
        good = good.filter(F.col("_level") != top)
    return good.select("_level", "component")


def _flat(counted: DataFrame, dims: int, min_samples: int, min_size: Column) -> DataFrame:
    """``(_at, group, _n)`` of one grid: cells of ``min_samples`` points, linked where they touch."""
    dense = materialize(counted.filter(F.col("_n") >= min_samples).withColumn("_cell", _named(F.lit(0), "c", "_at")))
    meet = corners(dense, dims).groupBy("_corner").agg(F.sort_array(F.collect_set("_cell")).alias("_cells"))  # at most 2**dims
    edges = meet.filter(F.size("_cells") > 1).select(F.get("_cells", F.lit(0)).alias("src"), F.explode("_cells").alias("dst")).filter("src <> dst").distinct()
    found = connected_components(dense.select(F.col("_cell").alias("node")), edges)
    cells = materialize(dense.join(found.withColumnRenamed("node", "_cell"), "_cell").select("_at", "_n", F.col("component").alias("group")))
    large = cells.groupBy("group").agg(F.sum("_n").alias("_size")).withColumn("_min", min_size).filter("_size >= _min").select("group")
    return join_small(cells, large, "group", spread_by="_at")


def density_clusters(
    docs: DataFrame,
    min_size: int | DataFrame = 5,
    min_samples: int = 2,
    id_col: str = "paper_id",
    features: str = "reduced",
    dims: int = 5,
    cell: float | None = None,
    octaves: int | None = None,
    steps: int = 4,
    allow_single: bool = False,
    seed: int | None = None,
) -> DataFrame:
    """M1 (density): ``(id, topic)``, topics numbered by size, -1 for outliers and small clusters.

    ``features`` holds ``dims`` coordinates. Cells of the coarsest grid are two mean standard
    deviations wide, those of the finest 2**(1 - ``octaves``) of that; each octave has ``steps``. By
    default there are log2(points) / ``dims`` + 3 octaves, past which cells of so many points are single. A
    point belongs to the outermost chosen cluster around it. As long as all large clusters lie in
    one, that one is only chosen with ``allow_single``. With ``cell`` there is one grid of that side and
    its linked cells of ``min_samples`` points are the clusters. ``seed`` shifts the grid origin, which
    gives the reruns of a stability study. A null or short vector is an outlier.
    """
    if octaves is None:
        octaves = int(np.ceil(np.log2(max(docs.count(), 2)) / dims)) + 3
    depth = octaves if cell is None else 1
    shift = np.random.default_rng(seed).random(dims) if seed is not None else np.zeros(dims)
    origin = (shift * 2 ** (depth - 1)).tolist()
    points = docs.select(id_col, *[F.get(as_double(F.col(features)), F.lit(i)).alias(f"_x{i}") for i in range(dims)])
    if cell is None:
        spread = sum((F.stddev_pop(f"_x{i}") for i in range(dims)), F.lit(0.0)) / dims
        side = F.greatest(points.agg((spread * 2 / 2 ** (octaves - 1)).alias("side")).scalar(), F.lit(1e-12))
    else:
        side = F.lit(float(cell))
    placed = points.withColumn("_side", side).select(
        id_col, F.array(*[F.floor(F.col(f"_x{i}") / F.col("_side") + origin[i]) for i in range(dims)]).alias("_at")
    ).withColumn("_at", F.when(F.forall("_at", lambda x: x.isNotNull()), F.col("_at")))
    counted = materialize(placed.filter("_at is not null").groupBy("_at").agg(F.count("*").alias("_n")))
    smallest = min_size.scalar() if isinstance(min_size, DataFrame) else F.lit(min_size)
    if cell is not None:
        owned = _flat(counted, dims, min_samples, smallest)
    else:
        held = _hierarchy(counted, dims, min_samples, smallest, octaves, steps)
        chosen = materialize(_chosen(held, octaves, steps, allow_single))
        marked = join_small(held.drop("_level"), chosen, "component", spread_by="_at")
        outermost = materialize(
            marked.groupBy(F.floor(F.col("_level") / steps).cast("int").alias("_octave"), "_at")
            .agg(F.max(F.struct("_level", "component")).alias("_best"))
        )
        each = counted.select("_at", "_n", F.explode(F.sequence(F.lit(0), F.lit(octaves - 1))).alias("_octave"))
        wider = each.select("_n", "_octave", F.col("_at").alias("_own"), F.expr("transform(_at, x -> shiftright(x, _octave))").alias("_at"))
        owned = (
            wider.join(outermost, ["_octave", "_at"]).groupBy(F.col("_own").alias("_at"), "_n")
            .agg(F.max("_best")["component"].alias("group"))
        )
    owned = materialize(owned)
    topics = numbered(owned.groupBy("group").agg(F.sum("_n").alias("size")))
    lookup = join_salted(owned, topics, "group", spread_by="_at").select(_named(F.lit(0), "c", "_at").alias("_cell"), "topic", "_n")
    own_cell = placed.select(id_col, F.when(F.col("_at").isNotNull(), _named(F.lit(0), "c", "_at")).alias("_cell"))
    return join_by_skewed_key(own_cell, lookup, "_cell", "topic", "_n", id_col).select(
        id_col, F.coalesce("topic", F.lit(OUTLIER)).alias("topic")
    )
