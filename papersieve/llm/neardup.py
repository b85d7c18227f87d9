"""Near-duplicate classes by improved consistent weighted sampling (Ioffe, 2010).

A document is a weighted set of its five-word shingles: term frequency times inverse document
frequency. For every sample the shingle of least ``ln a`` is drawn so that two documents draw the same
with the probability of their weighted Jaccard similarity. Samples are banded; documents that share a
band are candidates. First each member meets the bucket's leader, the member that shares buckets
most; the same is done in the finer buckets of two neighbouring bands, and again among the classes
still apart until a round finds no link. Then, in every bucket that still holds several classes, all
members of different classes meet; a pair leaves its bucket only if a bound on its similarity allows
a link. Each such pair of different texts is verified by its exact weighted Jaccard similarity; classes
are the components of the links.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import NARROW_ROWS, WIDE_ROWS, blocks, connected, shielded
from papersieve.llm.decontaminate import words
from papersieve.llm.substrings import NO_ID, mix, sequence_hash
from papersieve.session import MAX_BROADCAST_ROWS, join_by_skewed_key, materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 22, 6
#: Document frequencies count in steps of this share of the corpus.
STEPS = 64
#: Frequent shingles that one counting step broadcasts; more take more steps.
CHUNK = 1 << 21
#: Documents and shingles that are looked through together for frequent shingles.
POOL_ROWS, POOL_SHINGLES = 4096, 1 << 22
#: Pairs whose samples agree less are not verified: over four standard deviations below 0.8.
LEAST_AGREEMENT = 0.65
#: Bytes of text worked on at once; bounds a worker's memory.
BLOCK = 2 << 20
#: Members of a bucket that are compared with as many others at once; larger buckets take several steps.
GROUP = 1024
#: Parts of a text's weight that bound what it can share with another, and pairs bounded at once.
SKETCH, BOUNDED = 256, 1 << 13
_POOL = 1 << 16
_IDS = np.uint64((1 << 48) - 1)


def idf(step: np.ndarray) -> np.ndarray:
    """1 + ln(2N / (N + df)), df in whole steps of N / STEPS.

    The smoothing mass of one corpus keeps a shingle that a large group of copies shares from losing
    its weight against those that the copies do not share.
    """
    return 1.0 + np.log(2.0 / (1.0 + step / STEPS))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Sorted by text: text number, shingle (48 bits), times in the text; and the words of each text.

    A text of fewer than five words, but not none, is one shingle.
    """
    split = [words(t) for t in texts]
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    lengths = np.array([len(t) for t in split], np.int64)
    ids = np.fromiter(itertools.chain.from_iterable(map(number.__getitem__, t) for t in split), np.int64, lengths.sum())
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[ids]
    text = np.repeat(np.arange(len(split)), lengths)
    ends = np.cumsum(lengths)
    if len(word) >= SHINGLE:
        value = sequence_hash(word, SHINGLE)
        inside = np.arange(len(value)) + SHINGLE <= ends[text[: len(value)]]
        value, of = value[inside], text[: len(inside)][inside]
    else:
        value, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = [i for i, t in enumerate(split) if 0 < len(t) < SHINGLE]
    value = np.append(value, np.array([xxhash.xxh3_64_intdigest(b" ".join(split[i])) for i in short], np.uint64))
    of = np.append(of, np.array(short, np.int64))
    key, times = np.unique(of.astype(np.uint64) << np.uint64(48) | (value & _IDS), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & _IDS, times, [b" ".join(t) for t in split]


def _lookup(value: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Step of each shingle's document frequency; 0 for those not in the table."""
    keys, steps = frequent
    if not len(keys):
        return np.zeros(len(value), np.int64)
    slot = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
    return np.where(keys[slot] == value, steps[slot], 0)


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Exactly the shingles in at least one STEPS-th of the ``n`` documents, and their steps.

    Such a shingle is in at least that share of some pool of documents (or the shares of all pools
    would be smaller). A first pass names those, a second counts them in all documents. A pool holds
    POOL_ROWS documents or POOL_SHINGLES shingles; partitions of fewer documents are read together, so
    that no small pool names all it holds. Names and result are bounded: fewer than STEPS times the
    mean number of shingles in a document, for each pool and for the corpus.
    """

    def nominate(batches):
        found, pool, held, rows = np.empty(0, np.uint64), [], 0, 0

        def named_of_pool():
            value, here = np.unique(np.concatenate(pool), return_counts=True)
            return np.union1d(found, value[here * STEPS >= rows])

        for block in blocks(batches, "text", BLOCK, _POOL - 1):
            _, value, _, _ = shingles(block.column("text").to_pylist())
            pool.append(value)
            held, rows = held + len(value), rows + block.num_rows
            if held >= POOL_SHINGLES or rows >= POOL_ROWS:
                found, pool, held, rows = named_of_pool(), [], 0, 0
        if pool:
            found = named_of_pool()
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["shingle"])

    together = docs.coalesce(1 + n // POOL_ROWS)
    named = materialize(together.mapInArrow(nominate, "shingle long").distinct().coalesce(1 + n // POOL_ROWS))
    steps = 1 + named.count() // CHUNK
    kept = []
    for step in range(steps):
        mine = named.filter(F.pmod(F.xxhash64("shingle"), F.lit(steps)) == step)
        sent = docs.sparkSession.sparkContext.broadcast(
            np.sort(np.array([r.shingle for r in mine.collect()], np.int64)).astype(np.uint64)
        )

        def count(batches):
            wanted = sent.value
            total = np.zeros(len(wanted), np.int64)
            for block in blocks(batches, "text", BLOCK, _POOL - 1):
                _, value, _, _ = shingles(block.column("text").to_pylist())
                if len(wanted):
                    slot = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                    total += np.bincount(slot[wanted[slot] == value], minlength=len(wanted))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[some].astype(np.int64)), pa.array(total[some])], ["shingle", "df"]
            )

        kept += (
            docs.mapInArrow(count, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
            .filter(F.col("df") * STEPS >= n).collect()
        )
    kept.sort(key=lambda r: r.shingle)
    return (
        np.array([r.shingle for r in kept], np.uint64),
        np.array([r.df * STEPS // max(1, n) for r in kept], np.int64),
    )


class Sampler:
    """Consistent weighted samples: r and c drawn from Gamma(2, 1) and b from U(0, 1) for each (shingle, sample).

    The draws come from a pool that a hash of shingle and sample picks from. A sample is the least
    ``ln a`` in the upper 32 bits (as an ordered whole number) and bits of its shingle in the lower.
    """

    def __init__(self, samples: int, common: float):
        rng = np.random.Generator(np.random.PCG64(20100613))
        self.r, self.b = rng.gamma(2.0, 1.0, _POOL), rng.random(_POOL)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, _POOL))
        self.factors = rng.integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.common = common
        self.table = self.value(np.arange(_POOL), np.full(_POOL, common))

    def value(self, pool: np.ndarray, weight: np.ndarray) -> np.ndarray:
        r = self.r[pool]
        t = np.floor(np.log(weight) / r + self.b[pool])
        a = np.exp(self.ln_c[pool] - r * (t - self.b[pool]) - r).astype(np.float32)
        return a.view(np.uint32).astype(np.uint64) << np.uint64(32)

    def draw(self, shingle: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[sets, samples] for sets that begin at ``first``."""
        spread = mix(shingle + np.uint64(0x9E3779B97F4A7C15))
        low = spread & np.uint64(0xFFFFFFFF)
        rest = np.flatnonzero(weight != self.common)
        out = np.empty((len(first), len(self.factors)), np.uint64)
        for s, factor in enumerate(self.factors):
            pool = ((spread * factor) >> np.uint64(48)).astype(np.int64)
            value = self.table[pool]
            value[rest] = self.value(pool[rest], weight[rest])
            out[:, s] = np.minimum.reduceat(value | low, first)
        return out


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, hash, node, bands, samples) per row: node is a digest of the words, null where a text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches):
        sampler = Sampler(bands * rows, float(idf(np.zeros(1))[0]))
        for block in blocks(batches, "text", BLOCK, _POOL - 1):
            text, value, times, joined = shingles(block.column("text").to_pylist())
            weight = times * idf(_lookup(value, sent.value))
            have, first = np.unique(text, return_index=True)
            drawn = sampler.draw(value, weight, first) if len(have) else np.empty((0, bands * rows), np.uint64)
            band = np.stack([
                sequence_hash_rows(drawn[:, i * rows : (i + 1) * rows], i) for i in range(bands)
            ], axis=1) if len(have) else np.empty((0, bands), np.uint64)
            short = (mix(drawn) >> np.uint64(48)).astype("<u2")
            node, band_lists, samples = ([None] * block.num_rows for _ in range(3))
            for i, t in enumerate(have.tolist()):
                node[t] = hashlib.blake2b(joined[t], digest_size=16).digest()
                band_lists[t] = band[i].astype(np.int64)
                samples[t] = short[i].tobytes()
            yield pa.RecordBatch.from_arrays([
                block.column("doc"), block.column("hash"), pa.array(node, pa.binary()), pa.array(band_lists, pa.list_(pa.int64())),
                pa.array(samples, pa.binary()),
            ], ["doc", "hash", "node", "bands", "samples"])

    return docs.mapInArrow(sign, "doc long, hash long, node binary, bands array<long>, samples binary")


def sequence_hash_rows(values: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(len(values), seed + 1, np.uint64)
    for column in values.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def features(docs: DataFrame, nodes: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, shingle, weight) with packed arrays, for the stored ``nodes`` (doc, node).

    Nodes of a counted size are broadcast, so that only their features leave the scan, not all texts.
    """
    nodes = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_ROWS else nodes
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def weigh(batches):
        for block in blocks(batches, "text", BLOCK, _POOL - 1):
            text, value, times, joined = shingles(block.column("text").to_pylist())
            weight = (times * idf(_lookup(value, sent.value))).astype("<f4")
            cuts = np.searchsorted(text, np.arange(block.num_rows + 1))
            out = [
                (node, value[a:b].astype("<u8").tobytes(), weight[a:b].tobytes())
                for node, own, a, b in zip(block.column("node").to_pylist(), joined, cuts, cuts[1:])
                if hashlib.blake2b(own, digest_size=16).digest() == node
            ]
            cols = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["node", "shingle", "weight"])

    return (
        docs.join(nodes, "doc").select("node", "text").mapInArrow(weigh, "node binary, shingle binary, weight binary")
        .groupBy("node").agg(F.first("shingle").alias("shingle"), F.first("weight").alias("weight"))
    )


def weighted_jaccard(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    u, v = np.frombuffer(wa, "<f4").astype(float), np.frombuffer(wb, "<f4").astype(float)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.minimum(u[i], v[j]).sum()
    return float(least / (u.sum() + v.sum() - least))


def sketch(shingle: bytes, weight: bytes) -> tuple[float, bytes]:
    """Weight of a set, and of its shingles dealt into SKETCH parts by their bits, these rounded up to half floats."""
    w = np.frombuffer(weight, "<f4").astype(float)
    parts = np.bincount((np.frombuffer(shingle, "<u8") % np.uint64(SKETCH)).astype(np.int64), w, SKETCH)
    with np.errstate(over="ignore"):  # beyond half floats infinite, which still is an upper bound
        up = parts.astype(np.float16)
    return float(w.sum()), np.where(up < parts, np.nextafter(up, np.float16(np.inf)), up).astype("<f2").tobytes()


def may_link(total: np.ndarray, parts: np.ndarray, other_total: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of sets (a row each) can have that weighted Jaccard similarity.

    Two sets share at most the lesser weight of every part; a pair that reaches the similarity with
    that is kept, so none that has it is lost.
    """
    shared = np.minimum(parts, other).sum(axis=1, dtype=np.float64)
    return shared * (1 + 1e-5) * (1 + similarity) >= similarity * (total + other_total)


def sketches(weighed: DataFrame) -> DataFrame:
    """(node, total, parts) of the stored features."""

    def cut(batches):
        for batch in batches:
            made = [sketch(s, w) for s, w in zip(batch.column("shingle").to_pylist(), batch.column("weight").to_pylist())]
            total, parts = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(total, pa.float64()), pa.array(parts, pa.binary())], ["node", "total", "parts"]
            )

    return weighed.mapInArrow(cut, "node binary, total double, parts binary")


def _sided(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """The stored ``pairs`` with ``columns`` of both sides; few pairs pick the facts they need before these are shuffled."""
    if pairs.count() <= MAX_BROADCAST_ROWS:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        facts = facts.join(F.broadcast(needed), "node", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def verify(pairs: DataFrame, nodes: DataFrame, weighed: DataFrame, parts: int) -> DataFrame:
    """(a, b, similarity) of the pairs whose samples agree enough to be looked at, these kept in ``parts`` partitions."""

    def agree(batches):
        for batch in batches:
            share = [
                float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean())
                for x, y in zip(batch.column("a_samples").to_pylist(), batch.column("b_samples").to_pylist())
            ]
            keep = pa.array([s >= LEAST_AGREEMENT for s in share], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    def compare(batches):
        for batch in batches:
            sim = [
                weighted_jaccard(*row) for row in zip(*(
                    batch.column(c).to_pylist() for c in ("a_shingle", "a_weight", "b_shingle", "b_weight")
                ))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], ["a", "b", "similarity"]
            )

    near = materialize(_sided(pairs, nodes, ["samples"]).mapInArrow(agree, "a binary, b binary")).coalesce(parts)
    return _sided(near, weighed, ["shingle", "weight"]).mapInArrow(compare, "a binary, b binary, similarity double")


def open_pairs(
    placed: DataFrame, active: DataFrame, component: DataFrame, floor: float, parts: int,
    weighed: DataFrame | None = None, similarity: float = SIMILARITY,
) -> DataFrame:
    """(a, b), once, of all members of different classes in one of the buckets ``placed`` (node, bucket) whose samples agree in
    ``floor`` and whose sketches, given their features ``weighed``, allow ``similarity``.

    A bucket is cut into groups of about GROUP members: those of one large class, or of several small
    ones. Each two groups (and each group of small classes with itself) meet in one place, so a large
    class meets only what is not of it. Members that share several buckets are a
    pair in that of their first shared band alone. Buckets of two members are left to the leaders. Members are
    kept in ``parts`` partitions.
    """
    member = placed.join(component, "node").select("bucket", "node", F.xxhash64("component").alias("class"))
    sizes = member.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    several = sizes.groupBy("bucket").agg(
        F.count("*").alias("classes"), F.sum("size").alias("n"),
        F.sum(F.when(F.col("size") <= GROUP, F.col("size")).otherwise(0)).alias("small"),
    ).filter("classes > 1 and n > 2")
    groups_of = lambda n: F.ceil(F.col(n) / GROUP)
    large = sizes.join(several, "bucket").select(
        "bucket", "class", "small", F.when(F.col("size") > GROUP, groups_of("size")).alias("parts"),
    )
    part = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("class"), groups_of("small"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("parts"))
    )
    whole = F.when(F.col("parts").isNotNull(), F.col("class"))
    grouped = materialize(member.join(large, ["bucket", "class"]).select(
        "bucket", "class", "node", whole.alias("whole"), F.xxhash64(whole, part).alias("group")
    )).coalesce(parts)
    groups = grouped.select("bucket", "group", "whole").distinct()
    other = groups.select("bucket", F.col("group").alias("group_b"), F.col("whole").alias("whole_b"))
    meet = groups.join(other, "bucket").filter("group <= group_b and not coalesce(whole = whole_b, false)").select(
        "bucket", F.xxhash64("bucket", "group", "group_b").alias("place"),
        F.inline(F.when(
            F.col("group") == F.col("group_b"), F.array(F.struct(F.col("group").alias("group"), F.lit(2).alias("side")))
        ).otherwise(F.array(
            F.struct(F.col("group").alias("group"), F.lit(0).alias("side")),
            F.struct(F.col("group_b").alias("group"), F.lit(1).alias("side")),
        ))),
    )
    facts = active.select("node", "samples", "bands")
    if weighed is not None:
        if grouped.count() <= MAX_BROADCAST_ROWS:  # only their facts leave the scan
            there = F.broadcast(grouped.select("node").distinct())
            facts, weighed = facts.join(there, "node", "left_semi"), weighed.join(there, "node", "left_semi")
        facts = facts.join(sketches(weighed), "node")
    seated = (
        grouped.join(meet, ["bucket", "group"]).select("place", "bucket", "side", "class", "node")
        .join(facts, "node")
        # the bands before the bucket's own
        .withColumn("before", F.expr("slice(bands, 1, cast(array_position(bands, bucket) as int) - 1)"))
        .drop("bands", "bucket").repartition("place").sortWithinPartitions("place")
    )

    bounded = weighed is not None

    def agree(batches):
        for place in _runs(batches, "place"):
            node = np.array(place.column("node").to_pylist(), object)
            own, side = (place.column(c).to_numpy() for c in ("class", "side"))
            drawn = np.stack([np.frombuffer(x, "<u2") for x in place.column("samples").to_pylist()])
            before = np.array(place.column("before").to_pylist(), np.int64).reshape(len(node), -1)
            if bounded:
                total = place.column("total").to_numpy()
                shares = np.stack([np.frombuffer(x, "<f2") for x in place.column("parts").to_pylist()])
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            for i in range(0, len(left), GROUP):
                for j in range(0, len(right), GROUP):
                    x, y = left[i : i + GROUP], right[j : j + GROUP]
                    same = np.zeros((len(x), len(y)), np.uint16)
                    for s in range(drawn.shape[1]):
                        same += drawn[x, s][:, None] == drawn[y, s][None, :]
                    near = (same >= floor * drawn.shape[1]) & (own[x][:, None] != own[y][None, :])
                    u, v = np.nonzero(near & ((side[x] != 2)[:, None] | (x[:, None] < y[None, :])))
                    for k in range(0, len(u), BOUNDED):
                        p, q = x[u[k : k + BOUNDED]], y[v[k : k + BOUNDED]]
                        here = ~(before[p] == before[q]).any(axis=1)
                        p, q = p[here], q[here]
                        if bounded:
                            here = may_link(total[p], shares[p], total[q], shares[q], similarity)
                            p, q = p[here], q[here]
                        both = [sorted(pair) for pair in zip(node[p], node[q])]
                        a, b = zip(*both) if both else ((), ())
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return seated.mapInArrow(agree, "a binary, b binary")


def _runs(batches, key: str):
    """The rows of each run of equal keys as one batch."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != value[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def classified(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc, hash, node, fact) of every row: id, hash of the text, digest of its words, and what is known of it.

    ``fact`` holds the class (the id and hash of its first row, its number of rows) and the links of
    the text; it is null where the text has no words.
    """
    source = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("hash"), F.col(text).alias("text"),
    )
    n = source.count()
    frequent = frequent_shingles(source.select("text"), n)
    signed = materialize(signatures(source, frequent, bands, rows))
    nodes = (
        signed.filter("node is not null").groupBy("node")
        .agg(
            F.min(F.struct("doc", "hash")).alias("least"), F.count("*").alias("copies"),
            F.first("bands").alias("bands"), F.first("samples").alias("samples"),
        )
        .select("node", "least.*", "copies", "bands", "samples")
    )
    # no more nodes than rows
    wide, narrow = 1 + n // WIDE_ROWS, 1 + n * bands // NARROW_ROWS
    nodes = materialize(nodes.coalesce(wide))
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    coarse = materialize(placed.join(shared, "bucket").coalesce(narrow))
    active = materialize(
        coarse.groupBy("node").agg(F.sum("n").alias("popularity"))
        .join(nodes.select("node", "doc", "bands", "samples"), "node").coalesce(wide)
    )
    n_active = active.count()
    parts = 1 + n_active * 2 * bands // NARROW_ROWS
    beside = F.broadcast if n_active <= MAX_BROADCAST_ROWS else lambda facts: facts
    weighed = materialize(features(source, active.select("doc", "node"), frequent))
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(F.get("bands", i), F.get("bands", (i + 1) % bands)),
    )
    state = active.select("node", "popularity", F.explode(F.concat("bands", ring)).alias("bucket"))
    links = None
    asked = None
    component = active.select("node", F.col("node").alias("component"))
    # leaders until a round adds no link, then all that still share a bucket
    leading = True
    while True:
        if leading:
            # one member of each class in a bucket speaks for it; the most popular class leads
            member = state.join(beside(component), "node").groupBy("bucket", "component").agg(
                F.max(F.struct("popularity", "node")).alias("m")
            ).coalesce(parts)
            leader = member.groupBy("bucket").agg(F.max("m").alias("lead"), F.count("*").alias("n")).filter("n > 1")
            pairs = (
                member.join(leader, "bucket").filter("m.node <> lead.node")
                .select(F.least("m.node", "lead.node").alias("a"), F.greatest("m.node", "lead.node").alias("b"))
                .coalesce(parts).distinct()
            )
        else:
            floor = min(LEAST_AGREEMENT, similarity)
            pairs = open_pairs(coarse.select("node", "bucket"), active, beside(component), floor, parts, weighed, similarity)
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = materialize(pairs).coalesce(parts)
        found = materialize(verify(pairs, active, weighed, parts).filter(F.col("similarity") >= similarity)).coalesce(parts)
        new = found.count()
        links = found if links is None else links.union(found)
        asked = pairs if asked is None else asked.union(pairs)
        if new:
            component = materialize(
                active.select("node").join(connected(links), "node", "left")
                .select("node", F.coalesce("component", "node").alias("component")).coalesce(wide)
            )
        if not leading:
            break
        leading = bool(new)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    facts = materialize(
        nodes.select("node", "doc", "hash", "copies").join(component, "node", "left").join(degree, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).coalesce(wide)
    )
    classes = materialize(
        facts.groupBy("component").agg(
            F.struct(
                F.min(F.struct("doc", "hash")).alias("kept"), F.sum("copies").alias("size")
            ).alias("class"),
            F.count("*").alias("members"),
        ).coalesce(wide)
    )
    # a class may hold a third of all texts, a text a third of all rows
    told = materialize(join_by_skewed_key(facts, classes, "component", "class", "members", "node").select(
        "node", F.struct("class", "n_links").alias("fact"), "copies"
    ).coalesce(wide))
    return join_by_skewed_key(signed.select("doc", "hash", "node"), told, "node", "fact", "copies", "doc")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, class_id, class_size, n_links of every row; class_id is the least doc_id of its class.

    A class holds the rows whose words agree and all that verified links join. ``n_links`` counts a
    row's verified links to other texts (leaders and members, not all pairs). Words are lower-cased
    runs of letters and digits. Texts without words (null, empty) are classes of their own; so is
    every text with no link. Rows that share a doc_id are told apart by their words; a null id counts
    as the least and gives a null class_id. Of an empty table nothing is returned.
    """
    real = lambda c: F.when(c != NO_ID, c)
    return classified(docs, similarity, bands, rows, text, doc_id).select(
        real(F.col("doc")).alias("doc_id"),
        real(F.coalesce("fact.class.kept.doc", "doc")).alias("class_id"),
        F.coalesce("fact.class.size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("fact.n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one of least doc_id.

    Of rows of a class that share that id, the one whose text has the least hash; of equal rows one.
    Texts without words stay, one row for each id and text. A null id counts as the least. Further
    columns keep their values whatever their names.
    """
    return shielded(docs, (text, doc_id), lambda rows: _keep_one(rows, text, doc_id, **options))


def _keep_one(docs: DataFrame, text: str, doc_id: str, **options) -> DataFrame:
    found = classified(docs, text=text, doc_id=doc_id, **options)
    own = F.struct("doc", "hash")
    first = found.filter(F.coalesce(F.col("fact.class.kept") == own, F.lit(True))).select(
        F.col("doc").alias("_keep_doc"), F.col("hash").alias("_keep_hash")
    )
    keyed = docs.withColumn("_keep_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn("_keep_hash", F.xxhash64(text))
    kept = keyed.join(first, ["_keep_doc", "_keep_hash"], "left_semi")
    return kept.dropDuplicates(["_keep_doc", "_keep_hash"]).select(docs.columns)
