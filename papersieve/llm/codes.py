"""Vector codes from product codebooks, whose nearest entries are found by Orchard's search.

A vector is cut into equal parts; every part position has a codebook. For each entry the other
entries are listed by their distance to it. A search walks the list of the best entry so far, marks
what it has measured, jumps to the list of an entry that is nearer, and ends where the list is
farther than twice the distance of the best: by the triangle inequality nothing behind that point
can be as near. Vectors are whole numbers (floors of scaled components), so distances, sums and ties
are exact. Training passes move (part, entry, position) sums only, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersieve.session import join_by_skewed_key, materialize

#: Vectors searched together, and neighbours looked at in a step.
ROWS, STEP = 4096, 8
#: Components below this size give distances and sums of squares within 64 bits.
SMALL = 1 << 24

#: For each vector length, one array [entries, width] per part.
Codebooks = dict[int, list[np.ndarray]]


class Neighbours:
    """A codebook with the distance-sorted neighbour list of every entry."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gaps = np.stack([((book - entry) ** 2).sum(axis=1) for entry in book])
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)
        sums = book.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each point; equal distances go to the lower entry."""
        size = len(self.book)
        far = points.dtype.type(np.iinfo(np.int64).max) if points.dtype != object else 1 << 400
        first = np.searchsorted(self.sums, points.sum(axis=1))
        best = self.by_sum[np.minimum(first, size - 1)]
        distance = ((points - self.book[best]) ** 2).sum(axis=1)
        seen = np.zeros((len(points), size), bool)
        seen[np.arange(len(points)), best] = True
        at = np.zeros(len(points), np.int64)
        open_ = np.arange(len(points))
        while len(open_):
            here = best[open_][:, None]
            place = at[open_][:, None] + np.arange(STEP)
            listed = np.minimum(place, size - 1)
            entry = self.lists[here, listed]
            within = (place < size) & (self.gaps[here, listed] <= 4 * distance[open_][:, None])
            q, s = np.nonzero(within & ~seen[open_[:, None], entry])
            rows, found = open_[q], entry[q, s]
            seen[rows, found] = True
            measured = np.full(entry.shape, far, points.dtype)
            measured[q, s] = ((points[rows] - self.book[found]) ** 2).sum(axis=1)
            low = measured.min(axis=1)
            lowest = np.where(measured == low[:, None], entry, size).min(axis=1)
            better = (low < distance[open_]) | ((low == distance[open_]) & (lowest < here[:, 0]))
            best[open_[better]], distance[open_[better]] = lowest[better], low[better]
            at[open_] = np.where(better, 0, at[open_] + STEP)
            open_ = open_[better | within.all(axis=1)]
        return best, distance


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Whole floats as 64-bit numbers, or as Python's where squares could outgrow them."""
    if np.abs(values).max(initial=0) < SMALL:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def cut(values: np.ndarray, parts: int) -> list[np.ndarray]:
    """The equal parts of each vector; a length that ``parts`` doesn't divide is filled up with zeros."""
    lack = -values.shape[1] % parts
    if lack:
        values = np.concatenate([values, np.zeros((len(values), lack), values.dtype)], axis=1)
    return [np.ascontiguousarray(p) for p in np.split(values, parts, axis=1)]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dims, value) of the vectors without null or non-finite components."""
    good = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.size(embedding).alias("dims"), F.col(embedding).cast("array<double>").alias("value"),
    )


def _pieces(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, whole numbers [rows, length]) of at most ROWS rows each."""
    dims = np.array(batch.column("dims"))
    for d in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == d))
        for start in range(0, part.num_rows, ROWS):
            piece = part.slice(start, ROWS)
            flat = piece.column("value").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield d, piece, whole_numbers(np.floor(flat * float(scale)).reshape(piece.num_rows, d))


def _searches(books: Codebooks, dims: int, made: dict) -> list[Neighbours]:
    if dims not in made:
        made[dims] = [Neighbours(b) for b in books[dims]]
    return made[dims]


def _nearest(search: Neighbours, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if points.dtype != search.book.dtype:  # one side has huge numbers
        search, points = Neighbours(search.book.astype(object)), points.astype(object)
    return search.nearest(points)


def train_codebooks(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks for each vector length of ``usable`` vectors.

    A book starts as the parts of the ``entries`` smallest ids (nulls last). Each round is one pass:
    tasks sum their parts by nearest entry, the sums meet by (part, entry, position), and the driver
    holds no more than the codebooks.
    """
    books: Codebooks = {}
    for (dims,) in kept.select("dims").distinct().orderBy("dims").collect():
        first = kept.filter(F.col("dims") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "value").limit(entries)
        rows = [r.value for r in first.select("value").collect()]
        values = np.array(rows, np.float64).reshape(len(rows), dims)
        books[dims] = cut(whole_numbers(np.floor(values * float(scale))), parts)
    for _ in range(rounds if books else 0):
        books = _next_books(kept, books, scale)
    return books


def _limbs(x: int) -> list[int]:
    """Signed digits of base 2**60, lowest first, so that sums of any size travel as 64-bit numbers."""
    sign, x, digits = (-1 if x < 0 else 1), abs(x), []
    while x or not digits:
        digits.append(sign * (x & ((1 << 60) - 1)))
        x >>= 60
    return digits


def _next_books(kept: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    parts = len(next(iter(books.values())))

    def sums(batches):
        made: dict = {}
        held: dict = {}
        for batch in batches:
            for d, _, values in _pieces(batch, scale):
                for p, (points, search) in enumerate(zip(cut(values, parts), _searches(books, d, made))):
                    entry, _ = _nearest(search, points)
                    order = np.argsort(entry, kind="stable")
                    used, start = np.unique(entry[order], return_index=True)
                    totals = np.add.reduceat(points[order], start, axis=0) if points.shape[1] else points[:0]
                    counts = np.diff(np.append(start, len(order)))
                    for i, e in enumerate(used.tolist()):
                        total, count = held.get((d, p, e), (0, 0))
                        held[d, p, e] = (totals[i].astype(object) + total if points.shape[1] else (), count + int(counts[i]))
        rows = [
            (d, p, e, i, limb, digits, n)
            for (d, p, e), (total, n) in held.items() for i, x in enumerate(total) for limb, digits in enumerate(_limbs(int(x)))
        ]
        types = [pa.int32()] * 5 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)],
            ["dims", "part", "entry", "position", "limb", "total", "n"],
        )

    found = (
        kept.mapInArrow(sums, "dims int, part int, entry int, position int, limb int, total long, n long")
        .groupBy("dims", "part", "entry", "position", "limb")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    )
    totals: dict = {}
    counts: dict = {}
    for r in found.toLocalIterator():
        at = (r.dims, r.part, r.entry, r.position)
        totals[at] = totals.get(at, 0) + (int(r.total) << (60 * r.limb))
        if r.limb == 0:
            counts[at] = r.n
    after = {d: [b.astype(object) for b in by_part] for d, by_part in books.items()}
    for at, total in totals.items():
        d, p, e, i = at
        after[d][p][e, i] = total // counts[at]
    return {d: [whole_numbers(b) for b in by_part] for d, by_part in after.items()}


def encode(kept: DataFrame, books: Codebooks, scale: int = 1024) -> DataFrame:
    """(vec_id, label, code, error): hex index of the nearest entry of every part, and the summed squared distance.

    An error beyond 64 bits is null.
    """
    label = kept.schema["label"].dataType
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("label", label),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    parts = len(next(iter(books.values()), []))

    def codes(batches):
        made: dict = {}
        for batch in batches:
            for d, piece, values in _pieces(batch, scale):
                met = [_nearest(s, p) for p, s in zip(cut(values, parts), _searches(books, d, made))]
                index = np.stack([entry for entry, _ in met], axis=1).astype(np.uint8)
                text = index.tobytes().hex()
                error = [x if x < 1 << 63 else None for x in sum(distance for _, distance in met).tolist()]
                yield pa.RecordBatch.from_arrays([
                    piece.column("vec_id"), piece.column("label"),
                    pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                    pa.array(error, pa.int64()),
                ], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(codes, schema)


def books_digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components by length, part, entry and position, joined by commas."""
    numbers = [str(x) for d in sorted(books) for part in books[d] for row in part.tolist() for x in row]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without a null or non-finite component.

    ``label_error`` is the error summed over all vectors of the same label, null labels together.
    Vectors of another length have codebooks of their own; a length that ``parts`` doesn't divide is
    filled up with zeros, an empty vector has empty parts (code zero, error 0). A null id sorts last
    among the first entries and keeps its row; of repeated ids each row counts, in order of its vector.
    With fewer vectors than ``entries`` the books are as short. Components of any finite size are
    exact; an error or a sum beyond 64 bits is null. Other columns of the input are not read, an empty
    table gives no rows. At most 256 entries fit the two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = usable(vectors, vec_id, embedding, label)
    books = train_codebooks(kept, parts, entries, rounds, scale)
    if not books:
        return kept.limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    coded = materialize(encode(kept, books, scale).select(
        "vec_id", "code", "error", F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("none")).alias("group")
    ))
    sums = coded.groupBy("group").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("rows"))
    return join_by_skewed_key(coded, sums, "group", "label_error", "rows", "vec_id").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
