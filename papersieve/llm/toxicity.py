"""Convolutional toxicity classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the mean of the hashed embeddings of the word itself and of its 3- to 5-byte
sequences, so unseen forms of a word share its parts. Filters of one, two and three words slide over
the whole text; the best response of each filter feeds a logistic layer. The network is trained in
numpy on a bounded sample of labelled rows and scores blocks of documents in the executors.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import blocks
from papersieve.llm.decontaminate import words
from papersieve.llm.substrings import mix

#: The training sample: rows of either label at most, and characters of a text that may be in it.
POSITIVES, NEGATIVES, TRAIN_CHARS = 3000, 5000, 8_000
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 64, 0.02
BROADCAST_LABELS = 1_000_000


def parts(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first): the hash buckets of every word's parts, and where each word's begin."""
    made = [_parts(distinct[a : a + 20_000]) for a in range(0, len(distinct), 20_000)]
    sizes = np.cumsum([0] + [len(b) for b, _ in made])
    if not made:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate([b for b, _ in made]), np.concatenate([f + n for (_, f), n in zip(made, sizes)])


def _parts(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"<" + w + b">" for w in distinct]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(marked)), lengths)
    ends = np.cumsum(lengths)
    owner = [np.arange(len(marked))]
    value = [np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))]
    for n in (3, 4, 5):
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | data[i : i + len(code)]
        inside = np.arange(len(code)) + n <= ends[word[: len(code)]]
        owner.append(word[: len(code)][inside])
        value.append(code[inside])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(owner, kind="stable")
    bucket = (mix(value[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    return bucket.astype(np.int32), np.searchsorted(owner[order], np.arange(len(distinct)))


def number_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The texts' words as numbers in one array, each text's number of words, and the distinct words."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    rows = [list(map(number.__getitem__, words(t))) for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.fromiter(itertools.chain.from_iterable(rows), np.int32, lengths.sum()), lengths, list(number)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.scale = (1.0, 0.0)

    def start_from(self, bucket, first, ids, lengths, label) -> None:
        """First dimension: log odds of the label given a part; the first filter reads it."""
        ends = np.append(first[1:], len(bucket))
        seen = np.zeros((2, BUCKETS), np.int64)
        stops = np.cumsum(lengths)
        for stop, size, y in zip(stops.tolist(), lengths.tolist(), label.tolist()):
            own = np.unique(ids[stop - size : stop])
            n = (ends - first)[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen[y][np.unique(bucket[at])] += 1
        no, yes = seen
        odds = np.log((yes + 0.5) / (label.sum() + 1)) - np.log((no + 0.5) / ((label == 0).sum() + 1))
        self.embedding[:, 0] = np.where(yes + no > 1, np.clip(odds, -3, 3), 0)
        self.filters[1][0, :, 0] = 0
        self.filters[1][0, 0, 0] = 1
        self.out[0] = 1

    def word_vectors(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(first), 20_000):
            starts = first[a : a + 20_000]
            end = first[a + 20_000] if a + 20_000 < len(first) else len(bucket)
            n = np.diff(np.append(starts, end))
            out.append(np.add.reduceat(self.embedding[bucket[starts[0] : end]], starts - starts[0], axis=0) / n[:, None])
        return np.concatenate(out) if out else np.empty((0, DIMS), np.float32)

    def pool(self, vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, where: bool = False):
        """Best response of each filter in each text (0 where none is positive), and its place if asked."""
        best = np.zeros((len(lengths), len(WIDTHS) * FILTERS), np.float32)
        place = np.full(best.shape, -1, np.int64)
        ends = np.cumsum(lengths)
        for k, w in enumerate(WIDTHS):
            have = np.flatnonzero(lengths >= w)
            if not len(have):
                continue
            n = len(ids) - w + 1
            response = np.tile(self.bias[w], (n, 1))
            for j in range(w):
                response += (vectors @ self.filters[w][j])[ids[j : j + n]]
            end = np.repeat(ends, lengths)[:n]
            response[np.arange(n) + w > end] = -np.inf
            starts = (ends - lengths)[have]
            cut = starts if len(have) == len(lengths) else starts
            top = np.maximum.reduceat(response, cut, axis=0)
            side = slice(k * FILTERS, (k + 1) * FILTERS)
            best[have, side] = np.maximum(top, 0)
            if where:
                for row, (a, b) in zip(have, zip(starts, np.append(starts[1:], n))):
                    place[row, side] = a + np.argmax(response[a:b], axis=0)
        return (best, place) if where else best

    def logit(self, best: np.ndarray) -> np.ndarray:
        return best @ self.out + self.shift

    def fit(self, texts: list[str], label: np.ndarray) -> None:
        label = np.asarray(label, np.int64)
        ids, lengths, distinct = number_words(texts)
        bucket, first = parts(distinct)
        hold = np.arange(len(texts)) % 5 == 4
        ends = np.cumsum(lengths)
        spans = [ids[b - n : b] for n, b in zip(lengths, ends)]
        if label[~hold].min(initial=1) == label[~hold].max(initial=0):
            hold[:] = False
        keep = np.flatnonzero(~hold)
        if not len(keep) or label.min() == label.max():
            self.out[:], self.shift = 0, np.float32(5.0 if len(label) and label.min() == 1 else -5.0)
            return
        self.start_from(bucket, first, np.concatenate([spans[i] for i in keep]), lengths[keep], label[keep])
        weight = np.where(label == 1, (label == 0).sum() / max(1, label.sum()), 1.0) ** 0.5
        rng = np.random.default_rng(11)
        state: dict = {}
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(keep)
            for a in range(0, len(keep), BATCH):
                step += 1
                self._step(keep[a : a + BATCH], spans, lengths, label, weight, bucket, first, state, step)
        self._calibrate(spans, lengths, label, np.flatnonzero(hold) if hold.any() else keep, bucket, first)

    def _step(self, rows, spans, lengths, label, weight, bucket, first, state, step) -> None:
        used, ids = np.unique(np.concatenate([spans[i] for i in rows]), return_inverse=True)
        if not len(used):
            return
        ends = np.append(first[1:], len(bucket))
        n = (ends - first)[used]
        own_first = np.cumsum(n) - n
        own = bucket[np.repeat(first[used] - own_first, n) + np.arange(n.sum())]
        vectors = self.word_vectors(own, own_first)
        best, place = self.pool(vectors, ids, lengths[rows], where=True)
        p = 1 / (1 + np.exp(-np.clip(self.logit(best), -30, 30)))
        delta = ((p - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
        grads = {"out": best.T @ delta, "shift": delta.sum(keepdims=True)}
        back = delta[:, None] * self.out[None, :] * (best > 0)
        d_vectors = np.zeros_like(vectors)
        for k, w in enumerate(WIDTHS):
            side = slice(k * FILTERS, (k + 1) * FILTERS)
            r, f = np.nonzero(back[:, side])
            at, g = place[:, side][r, f], back[:, side][r, f]
            d_filter = np.zeros_like(self.filters[w])
            for j in range(w):
                word = ids[at + j]
                np.add.at(d_filter[j].T, f, g[:, None] * vectors[word])
                np.add.at(d_vectors, word, g[:, None] * self.filters[w][j].T[f])
            grads["f", w] = d_filter
            grads["b", w] = np.bincount(f, g, FILTERS).astype(np.float32)
        for name, g in grads.items():
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = m, v
            change = (RATE / 2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if name == "out":
                self.out -= change
            elif name == "shift":
                self.shift -= change[0]
            elif name[0] == "f":
                self.filters[name[1]] -= change
            else:
                self.bias[name[1]] -= change
        hit = np.flatnonzero(np.abs(d_vectors).sum(axis=1) > 0)
        if len(hit):  # the parts of the words that won, by the sum of their squared gradients
            at = np.repeat(own_first[hit] - np.cumsum(n[hit]) + n[hit], n[hit]) + np.arange(n[hit].sum())
            grad = np.repeat(d_vectors[hit] / n[hit][:, None], n[hit], axis=0)
            b, slot = np.unique(own[at], return_inverse=True)
            total = np.zeros((len(b), DIMS), np.float32)
            np.add.at(total, slot, grad)
            squares = state.setdefault("squares", np.full(BUCKETS, 1e-8, np.float32))
            squares[b] += (total * total).mean(axis=1)
            self.embedding[b] -= RATE * total / np.sqrt(squares[b])[:, None]

    def _calibrate(self, spans, lengths, label, rows, bucket, first) -> None:
        """Slope and shift of the logits that make the score of unused rows a probability (Platt)."""
        vectors = self.word_vectors(bucket, first)
        ids = np.concatenate([spans[i] for i in rows]) if len(rows) else np.empty(0, np.int32)
        x = self.logit(self.pool(vectors, ids, lengths[rows])).astype(float)
        y = label[rows]
        yes, no = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-9 * np.eye(2)
            move = np.linalg.solve(h, g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.scale = (float(max(a, 0.05)), float(b))

    def score(self, texts: list[str | None]) -> np.ndarray:
        ids, lengths, distinct = number_words(texts)
        vectors = self.word_vectors(*parts(distinct)) if distinct else np.empty((0, DIMS), np.float32)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logit(self.pool(vectors, ids, lengths)).astype(float) + b, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """A network trained on at most POSITIVES + NEGATIVES labelled rows that are not held out.

    The rows are those least by a hash of their id, among texts of at most TRAIN_CHARS characters.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if usable.count() <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= TRAIN_CHARS)
    order = F.xxhash64("doc_id", F.lit("sample"))
    marked = short.select("doc_id").join(usable, "doc_id").select("doc_id", "toxic", order.alias("o"))
    chosen = (
        marked.filter("toxic = 1").orderBy("o").limit(POSITIVES)
        .union(marked.filter("toxic = 0").orderBy("o").limit(NEGATIVES)).dropDuplicates(["doc_id"])
    )
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "o").collect()
    rows.sort(key=lambda r: (r["o"], r["doc_id"], r["text"]))
    network = Network()
    network.fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))
    return network


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged of every row.

    ``predicted`` is 1 from ``threshold`` on. ``flagged`` uses the language's own threshold: the least
    that gives no more than one clean row in a hundred, among the labelled rows that are not held out
    (``threshold`` where a language has none, or is null). The score reads nothing but the text; a null
    or empty text gets the score of a text in which no filter responds. Without usable labels of both
    kinds all scores are equal. Equal texts get equal scores; an empty table stays empty.
    """
    network = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches):
        for block in blocks(batches, "text"):
            value = network.value.score(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("lang"), pa.array(value)], ["doc_id", "lang", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(
        score, "doc_id long, lang string, score double"
    ).withColumn("held_out", held_out(F.col("doc_id")))
    from papersieve.session import materialize

    scored = materialize(scored)
    clean = labels.filter("toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    by_lang = (
        scored.filter("not held_out and lang is not null").join(clean, "doc_id")
        .groupBy("lang").agg(F.percentile("score", 0.99).alias("cut")).collect()  # one row a language
    )
    own = F.lit(threshold)
    if by_lang:
        own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for r in by_lang for x in (r["lang"], r["cut"]))), F.col("lang")), own)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        (F.col("score") > own).cast("int").alias("flagged"),
    )
