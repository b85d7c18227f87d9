"""Exact top-k inner products over a bit-sliced index.

Every block of vectors is stored as bitmaps: one for each bit of each quantised attribute, over the
block's rows. For a block of queries the attribute slices, weighted by the bits of the query, are
added with bitmap arithmetic (three bitmaps of equal weight become a sum and a carry), which gives
the slices of all scores. The best rows are then taken from the most significant slice downward;
the rows still tied after the last slice are resolved by their id. The quantised values are whole
numbers, so nothing is rounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of an index block and queries of a query block.
ROWS, QUERIES = 4096, 64


def quantise(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, dims, value): floor(scale * x) of each component; rows without a usable vector drop out.

    So do vectors with a component of 2**30 / sqrt(length) or more in size, whose scores may outgrow 64 bits.
    """
    usable = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    bound = (1 << 30) / F.sqrt(F.size(embedding))
    small = F.forall(embedding, lambda x: F.abs(x.cast("double")) * float(scale) < bound)
    return vectors.filter(F.coalesce(usable & small, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.size(embedding).alias("dims"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * float(scale))).alias("value"),
    )


def build_index(values: DataFrame, rows: int = ROWS) -> DataFrame:
    """Bit slices of ``values``, a row for each block of vectors of one length: dims, ids, low, bits, slices.

    Attribute d of a row is low[d] plus the number its bits[d] slices spell; rows are in order of id.
    """

    def pack(batches):
        for batch in batches:
            dims = np.array(batch.column("dims"))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                for start in range(0, part.num_rows, rows):
                    piece = part.slice(start, rows)
                    ids = np.array(piece.column("vec_id"))
                    order = np.argsort(ids, kind="stable")
                    v = np.array(piece.column("value").flatten(), np.int64).reshape(len(ids), d)[order]
                    low = v.min(axis=0, initial=np.iinfo(np.int64).max)
                    v = (v - low).astype(np.uint64)
                    bits = [int(x).bit_length() for x in v.max(axis=0, initial=0)]
                    n = -(-len(v) // 64) * 64
                    planes = np.zeros((sum(bits), n), np.uint8)
                    at = 0
                    for i, b in enumerate(bits):
                        for j in range(b):
                            planes[at, : len(v)] = (v[:, i] >> np.uint64(j)) & np.uint64(1)
                            at += 1
                    slices = np.packbits(planes, axis=1, bitorder="little")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d], pa.int32()), pa.array([int(ids.min())], pa.int64()),
                        pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                        pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.list_(pa.int32())),
                        pa.array([slices.tobytes()], pa.binary()),
                    ], ["dims", "block", "ids", "low", "bits", "slices"])

    return values.mapInArrow(pack, "dims int, block long, ids binary, low array<long>, bits array<int>, slices binary")


def add_slices(columns: list[list[np.ndarray]], weight: int, bitmap: np.ndarray) -> None:
    """Add a bitmap of weight 2**weight; three of one weight become their sum and, one weight up, their carry."""
    while True:
        while len(columns) <= weight:
            columns.append([])
        held = columns[weight]
        held.append(bitmap)
        if len(held) < 3:
            return
        a, b, c = held
        either = a ^ b
        columns[weight] = [either ^ c]
        bitmap = (a & b) | (c & either)
        weight += 1


def score_slices(slices: np.ndarray, bits: list[int], query: np.ndarray) -> list[np.ndarray]:
    """Bitmaps [queries, words] of the scores' bits, least first, for whole-number queries [queries, dims].

    A negative factor counts by its size against the complement of the attribute, which only shifts
    the scores of a query by a constant.
    """
    size = np.abs(query).astype(np.uint64)
    negative = np.where(query < 0, ONES, np.uint64(0))
    columns: list[list[np.ndarray]] = []
    at = 0
    for d, b in enumerate(bits):
        masks = [
            (j, np.where((size[:, d] >> np.uint64(j)) & np.uint64(1) > 0, ONES, np.uint64(0))[:, None])
            for j in range(int(size[:, d].max(initial=0)).bit_length())
        ]
        masks = [(j, m) for j, m in masks if m.any()]
        for i in range(b):
            plane = slices[at] ^ negative[:, d, None]
            at += 1
            for j, mask in masks:
                add_slices(columns, i + j, plane & mask)
    weight = 0
    while weight < len(columns):  # what is left: at most two of a weight
        if len(columns[weight]) == 2:
            a, b = columns[weight]
            columns[weight] = [a ^ b]
            add_slices(columns, weight + 1, a & b)
        weight += 1
    empty = np.zeros((len(query), slices.shape[1]), np.uint64)
    return [c[0] if c else empty for c in columns]


def select_top(score: list[np.ndarray], candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(certain, tied): bitmaps of the rows surely among the k best, and of those tied for the places left."""
    certain, tied = np.zeros_like(candidates), candidates.copy()
    for plane in reversed(score):
        upper = tied & plane
        n = np.bitwise_count(certain | upper).sum(axis=1)
        fits = (n <= k)[:, None]
        certain = np.where(fits, certain | upper, certain)
        tied = np.where(fits, tied & ~plane, upper)
    return certain, tied


def search_block(row: dict, query_ids: np.ndarray, query: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of one index block for each query."""
    ids = np.frombuffer(row["ids"], "<i8")
    n, bits = len(ids), list(row["bits"])
    words = -(-n // 64)
    slices = np.frombuffer(row["slices"], np.uint8).view("<u8").reshape(sum(bits), words)
    score = score_slices(slices, bits, query)
    if len(score) > 62:
        raise ValueError("scores of these vectors don't fit a long")
    flags = np.zeros((len(query), words * 64), bool)
    flags[:, :n] = ids[None, :] != query_ids[:, None]
    candidates = np.packbits(flags, axis=1, bitorder="little").view("<u8")
    certain, tied = select_top(score, candidates, k)
    unpack = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").astype(bool)
    sure, open_ = unpack(certain), unpack(tied)
    left = k - sure.sum(axis=1)
    taken = sure | (open_ & (np.cumsum(open_, axis=1) <= left[:, None]))  # rows are in order of id
    q, r = np.nonzero(taken)
    raw = np.zeros(len(q), np.int64)
    for weight, plane in enumerate(score):
        raw += ((plane[q, r // 64] >> (r % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
    low, top = np.array(row["low"], np.int64), (np.int64(1) << np.array(bits, np.int64)) - 1
    shift = query @ low + np.where(query < 0, query, 0) @ top
    return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": raw + shift[q]})


def top_k(
    vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query with all other vectors.

    Queries are the rows whose id is divisible by ``every``; they meet the index block by block: an
    index block goes to one cell, and every block of queries to all cells, where they join by cell.
    Each pair of blocks gives at most k rows a query before anything is shuffled by query. Ties go to
    the smaller id. Rows with a null id, a null vector, or a null or non-finite component take no
    part, nor do those with components beyond 2**30 / sqrt(length) after scaling; vectors only meet
    vectors of their own length, an empty vector other empty ones with score 0. A repeated query id is asked once, with the
    least of its vectors; repeated candidates count each. An empty table gives no rows.
    """
    values = quantise(vectors, vec_id, embedding, scale)
    n = values.count()
    blocks = max(1, -(-n // ROWS))
    index = build_index(values.coalesce(blocks)).withColumn("cell", F.pmod(F.xxhash64("block", "dims"), F.lit(blocks)))
    asked = (
        values.filter(F.col("vec_id") % every == 0)
        .groupBy("dims", "vec_id").agg(F.min("value").alias("value"))
        .repartition(max(1, -(-n // (every * QUERIES))))
    )

    def bundle(batches):
        for batch in batches:
            dims = np.array(batch.column("dims"))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                for start in range(0, part.num_rows, QUERIES):
                    piece = part.slice(start, QUERIES)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d], pa.int32()),
                        pa.array([np.array(piece.column("vec_id"), "<i8").tobytes()], pa.binary()),
                        pa.array([np.array(piece.column("value").flatten(), "<i8").tobytes()], pa.binary()),
                    ], ["dims", "query_ids", "query"])

    queries = asked.mapInArrow(bundle, "dims int, query_ids binary, query binary").withColumn(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asked_ids = np.frombuffer(row["query_ids"], "<i8")
                found = search_block(row, asked_ids, np.frombuffer(row["query"], "<i8").reshape(len(asked_ids), row["dims"]), k)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    by_cell = (blocks, "dims", "cell")  # a stated number: a few small rows make much work
    found = index.repartition(*by_cell).join(queries.repartition(*by_cell), ["dims", "cell"]).mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
