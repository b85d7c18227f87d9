"""Topic reduction: links between centroids, agglomerative rounds, class counts of merged topics.

Everything works on one row per topic: documents are read once, for the vector sums. Merged topics
get their sums and term counts from those of their parts.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from papersieve.functions.vectors import as_double, l2_normalize, norm
from papersieve.session import join_salted, join_small, materialize, runs, store

OUTLIER = -1
#: Projections that place a vector in a cell; a cell then has (3**AXES - 1) / 2 neighbours on one side.
AXES = 3
#: Bytes of vectors in a block, cells of a product held at once, pairs that make a task worth having.
BLOCK, STRIP, TASK_PAIRS = 8 << 20, 1 << 21, 1 << 22
#: Vectors that are one cell.
FEW = 1024


def similar_pairs(vectors: DataFrame, tau: float, key: str = "topic", vector: str = "embedding",
                  axes: int = AXES, block_bytes: int = BLOCK, few: int = FEW) -> DataFrame:
    """M10 cut at ``tau``: ``(key_i, key_j, value)`` of all pairs i < j with cosine >= tau, none lost.

    Unit vectors of cosine tau are sqrt(2 - 2 tau) apart, and no projection on a unit direction moves
    them farther apart. So with cells of that side along a few principal directions, partners lie in
    touching cells, and only those meet; ``few`` vectors are one cell. A cell is cut into blocks of
    ``block_bytes``, and two blocks are one matrix product, so a task holds two blocks however many
    vectors share a cell. Zero vectors have no partner.
    """
    reach = float(max(2.0 - 2.0 * tau, 0.0) ** 0.5) + 1e-9
    v = as_double(F.col(vector))
    unit = vectors.select(F.col(key).alias("_key"), v.alias("_raw"), norm(v).alias("_length")).filter("_length > 0")
    unit = store(unit.select("_key", l2_normalize(F.col("_raw"), F.col("_length")).alias("_v")))
    i, j = f"{key}_i", f"{key}_j"
    n, head = unit.count(), unit.select("_v").head()
    if n < 2:
        return unit.select(F.col("_key").alias(i), F.col("_key").alias(j), F.lit(0.0).alias("value")).limit(0)
    dims = len(head["_v"])
    axes = 0 if n <= few else min(axes, dims)
    if axes:
        featured = unit.select("_key", "_v", array_to_vector("_v").alias("_features"))
        projected = PCA(k=axes, inputCol="_features", outputCol="_at").fit(featured).transform(featured)
        cells = projected.select("_key", "_v", F.transform(vector_to_array("_at"), lambda x: F.floor(x / reach)).alias("_cell"))
    else:
        cells = unit.withColumn("_cell", F.array().cast("array<bigint>"))
    size = max(block_bytes // (8 * dims), 1)
    counted = store(cells.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / size)))
    seats, places, work = _seats(counted, axes)
    members = join_small(cells, counted.select("_cell", "_parts"), "_cell", spread_by="_key")
    members = members.withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts"))).drop("_parts")
    met = (
        members.join(seats, ["_cell", "_part"]).select("_place", "_side", "_key", "_v")
        .repartition(max(1, min(places, 1 + work // TASK_PAIRS)), "_place").sortWithinPartitions("_place")
    )
    kind = unit.schema["_key"].dataType
    close = met.mapInArrow(_close_pairs(tau, dims), StructType([
        StructField("_a", kind), StructField("_b", kind), StructField("value", DoubleType())
    ]))
    return close.filter("_a <> _b").select(F.least("_a", "_b").alias(i), F.greatest("_a", "_b").alias(j), "value")


def _seats(counted: DataFrame, axes: int) -> tuple[DataFrame, int, int]:
    """``(_cell, _part, _place, _side)``: each two blocks of touching cells have a place, their sides 0 and 1.

    A block meets itself as side 2. With the number of places and of pairs to be compared.
    """
    blocks = counted.select(
        "_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"), (F.col("_n") / F.col("_parts")).alias("_size")
    )
    steps = [o for o in product((-1, 0, 1), repeat=axes) if o >= (0,) * axes]
    offsets = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]).cast("array<bigint>") for o in steps])
    left = blocks.select(
        F.col("_cell").alias("_from"), F.col("_part").alias("_pa"), F.col("_size").alias("_na"), F.explode(offsets).alias("_step")
    ).withColumn("_cell", F.zip_with("_from", "_step", lambda a, b: a + b))
    own = F.col("_from") == F.col("_cell")
    met = left.join(blocks, "_cell").filter(~own | (F.col("_pa") <= F.col("_part")))
    met = store(met.select("*", own.alias("_own")).withColumn("_place", F.monotonically_increasing_id()))

    def seat(cell: str, part: str, side: int) -> Column:
        return F.struct(F.col(cell).alias("_cell"), F.col(part).alias("_part"), F.lit(side).alias("_side"))

    alone = F.col("_own") & (F.col("_pa") == F.col("_part"))
    seats = met.select("_place", F.inline(
        F.when(alone, F.array(seat("_cell", "_part", 2))).otherwise(F.array(seat("_from", "_pa", 0), seat("_cell", "_part", 1)))
    ))
    totals = met.agg(F.count("*").alias("places"), F.sum(F.col("_na") * F.col("_size")).alias("work")).head()
    return seats, totals.places, int(totals.work or 0)


def _close_pairs(tau: float, dims: int):
    """Pairs of each place's sides (or of side 2 with itself, once) with cosine >= ``tau``, a strip of a block at a time."""

    def compare(batches):
        for place in runs(batches, "_place"):
            side = place.column("_side").to_numpy()
            v = place.column("_v").flatten().to_numpy().reshape(-1, dims)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            other, strip = v[right].T, max(STRIP // max(len(right), 1), 1)
            for start in range(0, len(left), strip):
                mine = left[start : start + strip]
                value = v[mine] @ other
                a, b = np.nonzero(value >= tau)
                once = (side[mine[a]] != 2) | (mine[a] < right[b])
                a, b = a[once], b[once]
                yield pa.RecordBatch.from_arrays([
                    place.column("_key").take(pa.array(mine[a])), place.column("_key").take(pa.array(right[b])), pa.array(value[a, b])
                ], ["_a", "_b", "value"])

    return compare


def vector_sums(docs: DataFrame, topic: str = "topic", vector: str = "embedding") -> DataFrame:
    """``(topic, embedding)``: the sum of each topic's vectors, which points where their mean does."""
    total = Summarizer.sum(array_to_vector(as_double(F.col(vector))))
    return docs.groupBy(F.col(topic).alias("topic")).agg(vector_to_array(total).alias("embedding"))


def agglomerate(sums: DataFrame, tau: float, decimals: int = 12) -> DataFrame:
    """``(topic, topic_merged)`` of ``sums(topic, embedding)`` by centroid linkage.

    In each round every topic names its closest partner of cosine >= tau (ties to the smaller id), and
    pairs that name each other become one topic with the smaller id and the sum of both vectors. The
    closest pair of all always does, so rounds end when no pair is left. Unlike linked components, a
    chain of close topics does not pull its ends together.
    """
    state = store(sums)
    mapping = state.select("topic", F.col("topic").alias("topic_merged"))
    while True:
        pairs = similar_pairs(state, tau).withColumn("value", F.round("value", decimals))
        named = store(
            pairs.select(F.inline(F.array(
                F.struct(F.col("topic_i").alias("topic"), F.col("topic_j").alias("other"), "value"),
                F.struct(F.col("topic_j").alias("topic"), F.col("topic_i").alias("other"), "value"),
            ))).groupBy("topic").agg((-F.max(F.struct("value", (-F.col("other")).alias("o")))["o"]).alias("other"))
        )
        back = named.select(F.col("topic").alias("other"), F.col("other").alias("topic"))
        joined = store(
            named.join(back, ["topic", "other"]).filter("topic < other").select(F.col("other").alias("topic"), F.col("topic").alias("_into"))
        )
        if joined.isEmpty():
            return mapping
        into = F.coalesce("_into", "topic")
        state = store(vector_sums(state.join(joined, "topic", "left").withColumn("topic", into)))
        mapping = store(
            mapping.join(joined.withColumnRenamed("topic", "topic_merged"), "topic_merged", "left")
            .select("topic", F.coalesce("_into", "topic_merged").alias("topic_merged"))
        )


def reduce_topics(docs: DataFrame, tau: float = 0.9, topic: str = "topic", vector: str = "embedding",
                  outlier: int = OUTLIER) -> DataFrame:
    """M6: ``(topic, topic_merged)`` of all topics of ``docs``; the outlier topic merges with nothing."""
    sums = materialize(vector_sums(docs, topic, vector))
    merged = agglomerate(sums.filter(F.col("topic") != outlier), tau)
    rest = sums.filter(F.col("topic") == outlier).select("topic", F.col("topic").alias("topic_merged"))
    return merged.unionByName(rest)


def merge_counts(counts: DataFrame, mapping: DataFrame, topic: str = "topic") -> DataFrame:
    """Class counts ``(topic, term, n)`` of merged topics, summed from those of their parts."""
    joined = join_salted(counts, mapping.select(F.col("topic").alias(topic), "topic_merged"), topic, spread_by="term")
    return joined.groupBy(F.col("topic_merged").alias(topic), "term").agg(F.sum("n").alias("n"))
