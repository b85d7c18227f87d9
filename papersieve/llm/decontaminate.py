"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document, as large text indexes are: each block of training documents
keeps, for every indexed term, the ascending positions at which it stands. A phrase is found in a
block by intersecting the lists of its terms, each shifted back by the term's place in the phrase,
beginning with the shortest list; a phrase with a term that the block lacks costs a few lookups.
Documents are never shuffled. The phrases travel, in chunks of bounded size, each found over the
same index in a step of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import blocks

#: Bytes of phrases that one step broadcasts; more phrases take more steps.
CHUNK_BYTES = 16 << 20

# A-Z to a-z; every other ASCII character but digits and a-z separates words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

INDEX = (
    "doc_id array<long>, text_hash array<long>, doc_start array<int>, term array<binary>, term_start array<int>, "
    "positions binary, hit binary, items array<array<string>>"
)


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z (A-Z folded) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(phrase, items): every window of ``size`` words of the items' texts, with the ids that hold it.

    A text of fewer words, but not none, is one window. A null item_id counts as the empty string.
    """

    def cut(batches):
        for batch in batches:
            ids, phrases = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for i in range(max(len(w) - size + 1, min(1, len(w)))):
                    ids.append(item)
                    phrases.append(b" ".join(w[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(phrases, pa.binary())], ["item", "phrase"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return rows.mapInArrow(cut, "item string, phrase binary").groupBy("phrase").agg(F.collect_set("item").alias("items"))


def build_index(docs: DataFrame, terms: set[bytes] | None = None) -> DataFrame:
    """Postings of ``docs`` (doc_id, text), a row for each block of documents; of ``terms`` only, if given.

    ``positions`` holds the lists of all terms one after the other as little-endian int32, counted from
    the block's first word; ``doc_start`` gives each document's first position and the end.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def post(batches):
        number = None if wanted.value is None else {t: i for i, t in enumerate(wanted.value)}
        for block in blocks(batches, "text"):
            texts = [words(t) for t in block.column("text").to_pylist()]
            if number is None:
                found = {t: i for i, t in enumerate({w for t in texts for w in t})}
            else:
                found = number
            ids = np.concatenate([
                np.empty(0, np.int32),
                *(np.fromiter((found.get(w, -1) for w in t), np.int32, len(t)) for t in texts),
            ])
            starts = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=starts[1:])
            at = np.flatnonzero(ids >= 0)
            at = at[np.argsort(ids[at], kind="stable")]
            here, first = np.unique(ids[at], return_index=True)
            names = list(found)
            yield pa.RecordBatch.from_pylist([{
                "doc_id": block.column("doc_id").to_pylist(),
                "text_hash": block.column("text_hash").to_pylist(),
                "doc_start": starts.tolist(),
                "term": [names[i] for i in here.tolist()],
                "term_start": [*first.tolist(), len(at)],
                "positions": at.astype("<i4").tobytes(),
                "hit": b"",
                "items": [[] for _ in texts],
            }], pa.schema(SCHEMA))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(post, INDEX)


SCHEMA = [
    ("doc_id", pa.list_(pa.int64())), ("text_hash", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int32())),
    ("term", pa.list_(pa.binary())), ("term_start", pa.list_(pa.int32())), ("positions", pa.binary()),
    ("hit", pa.binary()), ("items", pa.list_(pa.list_(pa.string()))),
]


class Postings:
    """The index row of one block, opened for searching."""

    def __init__(self, row: dict):
        self.doc_start = np.array(row["doc_start"])
        positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        ends = row["term_start"]
        self.lists = {t: positions[a:b] for t, a, b in zip(row["term"], ends, ends[1:])}

    def in_one_document(self, start: np.ndarray, length: int) -> np.ndarray:
        doc = np.searchsorted(self.doc_start, start, side="right") - 1
        return start[start + length <= self.doc_start[doc + 1]]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """First positions of the exact phrase."""
        if any(t not in self.lists for t in terms):
            return np.empty(0, np.int64)
        order = sorted(range(len(terms)), key=lambda i: len(self.lists[terms[i]]))
        start = self.lists[terms[order[0]]] - order[0]
        for i in order[1:]:
            if not len(start):
                break
            there = self.lists[terms[i]]
            slot = np.minimum(np.searchsorted(there, start + i), len(there) - 1)
            start = start[there[slot] == start + i]
        return self.in_one_document(start[start >= 0], len(terms))

    def near(self, terms: list[bytes], span: int) -> list[tuple[int, int]]:
        """Shortest stretches (first, last position) of at most ``span`` words of one document with all terms."""
        need = set(terms)
        if any(t not in self.lists for t in need):
            return []
        order = sorted(need, key=lambda t: len(self.lists[t]))
        anchor = self.lists[order[0]]
        for t in order[1:]:
            there = self.lists[t]
            after = np.searchsorted(there, anchor)
            ahead = there[np.minimum(after, len(there) - 1)] - anchor
            behind = anchor - there[np.maximum(after - 1, 0)]
            anchor = anchor[((ahead >= 0) & (ahead < span)) | ((behind >= 0) & (behind < span))]
        found = set()
        for a in anchor.tolist():
            doc = int(np.searchsorted(self.doc_start, a, side="right")) - 1
            low, high = max(a - span + 1, self.doc_start[doc]), min(a + span, self.doc_start[doc + 1])
            at = sorted(
                (int(p), t) for t in need
                for p in self.lists[t][np.searchsorted(self.lists[t], low) : np.searchsorted(self.lists[t], high)]
            )
            last: dict[bytes, int] = {}
            for p, t in at:
                last[t] = p
                if len(last) == len(need) and p - min(last.values()) < span:
                    found.add((min(last.values()), p))
        return sorted(s for s in found if not any(s != o and s[0] <= o[0] and o[1] <= s[1] for o in found))


def find_phrases(index: DataFrame, phrases: list[tuple[bytes, list[str]]], slop: int | None = None) -> DataFrame:
    """``index`` with the words of found phrases set in ``hit`` and the phrases' items added to ``items``.

    With ``slop``, a phrase is also found where all its words stand, in any order, within its length
    plus ``slop`` words of one document; the whole stretch is hit.
    """
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches):
        listed = [(p.split(b" "), items) for p, items in sent.value]
        for batch in batches:
            for row in batch.to_pylist():
                post = Postings(row)
                size = int(post.doc_start[-1])
                edge = np.zeros(size + 1, np.int32)
                items = [set(x) for x in row["items"]]
                for terms, ids in listed:
                    first = post.phrase(terms)
                    last = first + len(terms)
                    if slop is not None:
                        near = post.near(terms, len(terms) + slop)
                        first = np.concatenate([first, np.array([a for a, _ in near], np.int64)])
                        last = np.concatenate([last, np.array([b + 1 for _, b in near], np.int64)])
                    if len(first):
                        np.add.at(edge, first, 1)
                        np.add.at(edge, last, -1)
                        for d in np.unique(np.searchsorted(post.doc_start, first, side="right") - 1).tolist():
                            items[d].update(ids)
                hit = np.cumsum(edge[:-1]) > 0
                if row["hit"]:
                    hit |= np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=size).astype(bool)
                row["hit"], row["items"] = np.packbits(hit).tobytes(), [sorted(x) for x in items]
                yield pa.RecordBatch.from_pylist([row], pa.schema(SCHEMA))

    return index.mapInArrow(search, INDEX)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """Per row of ``docs``: words, words hit by a window of ``items``, items with occurring windows.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, sorted as strings and
    comma-joined), contaminated, text_hash (xxhash64 of the text; with doc_id it leads back to the
    row). A null or empty text has no words. Equal rows, and rows that share a doc_id, are judged one
    by one. Without documents there are no rows; without items nothing is contaminated. Other columns,
    of whatever name, are not read.
    """
    found = windows(items, size)
    total, n = found.agg(F.sum(F.length("phrase") + 40), F.count("*")).first()
    steps = 1 + (total or 0) // CHUNK_BYTES
    chunk = F.pmod(F.xxhash64("phrase"), F.lit(steps))
    index = None
    for step in range(steps):
        phrases = [
            (bytes(r.phrase), sorted(r["items"])) for r in (found if steps == 1 else found.filter(chunk == step)).collect()
        ]
        if index is None:
            terms = {t for p, _ in phrases for t in p.split(b" ")} if steps == 1 else None
            index = build_index(docs, terms)
        index = find_phrases(index, phrases, slop)

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                starts = np.array(row["doc_start"])
                hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=starts[-1])
                before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                n_hit = before[starts[1:]] - before[starts[:-1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(n_hit),
                    pa.array([len(x) for x in row["items"]], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in row["items"]]),
                    pa.array(n_hit > 0), pa.array(row["text_hash"], pa.int64()),
                ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_hash"])

    return index.mapInArrow(
        tell,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, text_hash long",
    )
