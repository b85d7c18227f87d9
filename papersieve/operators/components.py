"""Connected components and numbering of groups, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.session import materialize, store


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected ``edges(src, dst)``.

    Alternating large-star and small-star steps (Kiveris et al. 2014): a node first hands its larger
    neighbours to its smallest one, then all its smaller neighbours. Every step is an aggregate that
    combines before the shuffle and a join whose large keys are split at run time; each round is
    stored, and it stops when a round changes nothing, after about the logarithm of the longest chain.
    """
    u, v = F.col("u"), F.col("v")
    pairs = store(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter(u > v).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u > v).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = F.array(F.struct(u, F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))
        pairs = store(large.join(least, "u").select(F.inline(linked)).filter(u > v).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    rooted = pairs.select(u.alias("node"), v.alias("_root"))
    return nodes.select("node").join(rooted, "node", "left").select("node", F.coalesce("_root", "node").alias("component"))


def numbered(groups: DataFrame) -> DataFrame:
    """``groups(group, size)`` with ``topic``: 0 for the largest group, ties by group.

    Sorted partitions number their rows and are shifted by the rows before them; the one window
    without a key runs over a row per partition.
    """
    order = (F.desc("size"), F.asc("group"))
    placed = materialize(
        groups.select("group", "size").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", 33))
    rows = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "_part").select("group", place.cast("int").alias("topic"))
