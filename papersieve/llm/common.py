"""Small helpers the operators share: blocks of rows, words as bytes, checkpoints, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: Narrow and wide rows that loops keep in a partition: every exchange writes files per partition it
#: reads, so many small ones cost more disk than their rows.
NARROW_ROWS, WIDE_ROWS = 500_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut anew so that a block holds about ``limit`` bytes of ``text``, or one longer text, and no more than ``rows`` rows.

    A block is the unit of work of the operators: large enough to share work between its rows, small
    enough that a task's memory doesn't depend on the size of its partition.
    """
    held, size, count = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if (size and size + n > limit) or count == rows:
                held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, size, count, start = [], 0, 0, i
            size += n
            count += 1
        held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches([b for b in held if b.num_rows] or held[:1]).combine_chunks()
    return (rows.to_batches() or held[:1])[0]


def shielded(docs: DataFrame, own: Sequence[str], work: Callable[[DataFrame], DataFrame], added: Sequence[str] = ()) -> DataFrame:
    """``work(docs)`` in the columns of ``docs`` and ``added``, all but ``own`` of them under names that no operator uses.

    Whatever a caller's further columns are called, they reach the result with their values.
    """
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    names = {c: c if c in own else f"_kept_column_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[quoted[c].alias(n) for c, n in names.items()]))
    return done.select(*[F.col(n).alias(c) for c, n in names.items()], *added)


def look_up(big: DataFrame, lookup: DataFrame, key: str, value: str, rows: str, spread_by: str) -> DataFrame:
    """``big`` with ``value`` of the stored ``lookup(key, value, rows)``, null where it has none.

    The lookup is broadcast where its counted size allows it; beyond, rows meet it in a join that
    spreads hot keys by ``spread_by``, where ``rows`` is the number of rows of ``big`` with the key.
    """
    from papersieve.session import MAX_BROADCAST_ROWS, join_by_skewed_key

    if lookup.count() <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(lookup.select(key, value)), key, "left")
    return join_by_skewed_key(big, lookup, key, value, rows, spread_by)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node reaches over ``edges``, for nodes with an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014) hook every node to the
    smallest of its neighbourhood until all edges point at roots. Each step is two aggregations that
    combine before the shuffle, and is checkpointed; nothing is collected but one changed/unchanged sum.
    The least neighbours are broadcast where the number of edges bounds them.
    """
    from papersieve.session import MAX_BROADCAST_ROWS, materialize

    n = edges.count()
    parts = 1 + 2 * n // NARROW_ROWS
    # every step has at most as many nodes as the edges have ends
    beside = F.broadcast if 2 * n <= MAX_BROADCAST_ROWS else lambda least: least
    pairs = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct().coalesce(parts)
    )
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(beside(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u > v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(beside(least), "u")
            .select(F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.*").filter("u > v").distinct()
        )
        pairs = materialize(small.coalesce(parts))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
