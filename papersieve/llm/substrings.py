"""Removal of repeated word sequences by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the least hash of the ``part``-word sequences
in it; consecutive windows that share it form a super-k-mer, which travels as one packed string to the
minimiser's bucket. Equal windows have equal minimisers, so a bucket sees all occurrences of its windows
and finds the repeated ones by sorting. Super-k-mers of a block of documents that go to one bucket travel
together, compressed. Before that, equal super-k-mers of a block shrink to the earliest of them (the others
are repeats whatever else exists), so a group of copies sends one string a block. A bucket that outgrows
memory all the same, as a minimiser of many near copies can, hands its windows on one by one to an
ordinary aggregation.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import blocks
from papersieve.session import materialize

#: Characters of text for each bucket, and bytes of packed strings that a task opens at once.
BUCKET_CHARS, OPEN_BYTES = 4 << 20, 64 << 20
NO_ID = -(1 << 63)

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sequence_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from each place on (len(h) - length + 1 of them), by doubling."""
    out, done, power, level = None, 0, h, 0
    while length:
        step = 1 << level
        if length & step:
            part = power[done:]
            out = part.copy() if out is None else mix(out[: len(part)]) * np.uint64(_ODD[level % 5]) + part[: len(out)]
            done += step
        length -= length & step
        if length:
            power = mix(power[: max(0, len(power) - step)]) * np.uint64(_ODD[(level + 1) % 5]) + power[step:]
            level += 1
    return mix(out)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[: max(0, len(h) - step)], h[step:])
        done += step
    return h


def runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(doc, tag, begin, end) of the words that windows at ``start`` cover, neighbours joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], tag[first], start[first], start[last] + size


def super_kmers(texts: list[list[bytes]], size: int, part: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, windows, minimiser) of every super-k-mer, in order."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(itertools.chain.from_iterable(map(number.__getitem__, t) for t in texts), np.int64, lengths.sum())
    if len(ids) < size:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[ids]
    least = sliding_min(sequence_hash(word, part), size - part + 1)
    text = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    at = np.arange(len(least))
    valid = at + size <= ends[text[: len(least)]]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (text[1 : len(least)] != text[: len(least) - 1])
    first = np.flatnonzero(new)
    windows = np.add.reduceat(valid.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return text[first], first - (ends - lengths)[text[first]], windows, least[first]


def pack(docs: DataFrame, buckets: int, size: int, part: int) -> DataFrame:
    """Rows of two kinds: bucket null, ranges that repeat within a block; else a bucket's packed super-k-mers."""

    def work(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for block in blocks(batches, "text"):
            doc = np.array(block.column("_doc"), np.int64)
            tag = np.array(block.column("_tag"), np.int64)
            order = np.lexsort((tag, doc))
            doc, tag = doc[order], tag[order]
            column = block.column("text")
            texts = [(column[i].as_py() or "").encode("utf-8", "replace").split() for i in order.tolist()]
            text, start, windows, least = super_kmers(texts, size, part)
            bucket = (mix(least.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            seen: dict[bytes, tuple[int, int]] = {}
            sent: list[int] = []
            packed: list[bytes] = []
            repeat_text, repeat_from, repeat_to = [], [], []
            for i, (t, s, n) in enumerate(zip(text.tolist(), start.tolist(), windows.tolist())):
                string = b" ".join(texts[t][s : s + n + size - 1])
                before = seen.setdefault(string, (t, s))
                if before == (t, s):
                    sent.append(i)
                    packed.append(string)
                elif before[1] != s or doc[before[0]] != doc[t] or tag[before[0]] != tag[t]:
                    repeat_text.append(t)
                    repeat_from.append(s)
                    repeat_to.append(s + n + size - 1)
            del seen
            if repeat_text:
                yield _rows(None, doc[repeat_text], tag[repeat_text], repeat_from, repeat_to, None)
            sent = np.array(sent, np.int64)
            order = np.argsort(bucket[sent], kind="stable")
            here, cuts = np.unique(bucket[sent][order], return_index=True)
            for b, rows in zip(here.tolist(), np.split(order, cuts[1:])):
                i = sent[rows]
                raw = b"\n".join(packed[r] for r in rows.tolist())
                yield _rows(b, doc[text[i]], tag[text[i]], start[i].tolist(), [len(raw)], squeeze.compress(raw))

    return docs.mapInArrow(
        work, "bucket long, doc array<long>, tag array<int>, start array<int>, stop array<int>, packed binary"
    )


def _rows(bucket, doc, tag, start, stop, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([bucket], pa.int64()), pa.array([doc], pa.list_(pa.int64())), pa.array([tag], pa.list_(pa.int32())),
        pa.array([start], pa.list_(pa.int32())), pa.array([stop], pa.list_(pa.int32())), pa.array([packed], pa.binary()),
    ], ["bucket", "doc", "tag", "start", "stop", "packed"])


def repeated(held: list[dict], size: int) -> pa.RecordBatch:
    """Ranges of the windows of one bucket that also start earlier."""
    opened = zstandard.ZstdDecompressor()
    strings = [s.split(b" ") for row in held for s in opened.decompress(row["packed"]).split(b"\n")]
    doc = np.concatenate([np.array(row["doc"], np.int64) for row in held])
    tag = np.concatenate([np.array(row["tag"], np.int64) for row in held])
    start = np.concatenate([np.array(row["start"], np.int64) for row in held])
    lengths = np.array([len(s) for s in strings], np.int64)
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(itertools.chain.from_iterable(map(number.__getitem__, s) for s in strings), np.int64, lengths.sum())
    del strings, number
    windows = lengths - size + 1
    string = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(lengths) - lengths)[string] + offset
    key = sequence_hash(mix(ids.astype(np.uint64) + np.uint64(_ODD[0])), size)[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    among = np.zeros(len(order), bool)
    among[1:] |= same
    among[:-1] |= same
    w = order[among]  # windows whose key occurs again
    w = w[np.lexsort((start[string[w]] + offset[w], tag[string[w]], doc[string[w]], key[w]))]
    while len(w):
        head = np.ones(len(w), bool)
        head[1:] = key[w][1:] != key[w][:-1]
        first = w[head][np.cumsum(head) - 1]
        equal = np.ones(len(w), bool)
        for j in range(size):
            equal &= ids[at[first] + j] == ids[at[w] + j]
        if equal.all():
            break
        # two sequences under one hash: the others get another key and are judged among themselves
        key[w[~equal]] = mix(key[w[~equal]] + np.uint64(_ODD[1]))
        w = w[np.lexsort((start[string[w]] + offset[w], tag[string[w]], doc[string[w]], key[w]))]
    if len(w):
        place = start[string] + offset
        d, t, p = doc[string[w]], tag[string[w]], place[w]
        later = (d != doc[string[first]]) | (t != tag[string[first]]) | (p != place[first])
        d, t, p = d[later], t[later], p[later]
        return _ranges(*runs(d, t, p, size))
    none = np.empty(0, np.int64)
    return _ranges(none, none, none, none)


def _ranges(doc, tag, begin, end, digest=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(np.asarray(tag), pa.int64()), pa.array(begin, pa.int64()),
        pa.array(end, pa.int64()), pa.array(digest if digest is not None else [None] * len(doc), pa.binary()),
    ], ["doc", "tag", "begin", "end", "digest"])


def one_by_one(row: dict, size: int) -> pa.RecordBatch:
    """Every window of a packed row with a 128-bit digest of its words."""
    out = []
    strings = zstandard.ZstdDecompressor().decompress(row["packed"]).split(b"\n")
    for string, d, t, s in zip(strings, row["doc"], row["tag"], row["start"]):
        w = string.split(b" ")
        for i in range(len(w) - size + 1):
            digest = hashlib.blake2b(b" ".join(w[i : i + size]), digest_size=16).digest()
            out.append((d, t, s + i, s + i + size, digest))
    return _ranges(*zip(*out))


def repeated_ranges(docs: DataFrame, size: int = 20, part: int = 5, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """(doc, tag, begin, end): word ranges covered by windows that also start earlier.

    ``docs`` has _doc (order of the documents), _tag (tells rows of one _doc apart) and text.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 + chars // BUCKET_CHARS
    packed = pack(docs, buckets, size, part)

    def judge(batches):
        bucket, held, total = None, [], 0

        def close():
            return [repeated(held, size)] if held else []

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] is None:
                    yield _ranges(row["doc"], row["tag"], row["start"], row["stop"])
                    continue
                if row["bucket"] != bucket:
                    yield from close()
                    bucket, held, total = row["bucket"], [], 0
                total += row["stop"][0]
                if total <= open_bytes:
                    held.append(row)
                    continue
                for early in held:
                    yield one_by_one(early, size)
                held = []
                yield one_by_one(row, size)
        yield from close()

    spread = F.coalesce("bucket", -F.pmod(F.xxhash64("doc"), F.lit(buckets)) - 1)
    found = materialize(
        packed.repartition(spread).sortWithinPartitions("bucket")
        .mapInArrow(judge, "doc long, tag long, begin long, end long, digest binary")
    )
    open_ = found.filter("digest is not null")
    first = open_.groupBy("digest").agg(F.min(F.struct("doc", "tag", "begin")).alias("first"))
    late = (
        open_.join(first, "digest").filter(F.struct("doc", "tag", "begin") != F.col("first"))
        .select("doc", "tag", "begin", "end")
    )
    return found.filter("digest is null").drop("digest").union(late)


def dedup_substrings(docs: DataFrame, size: int = 20, part: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every row: its text without repeated words.

    Words are runs of other characters than ASCII white space. A word goes if a window of ``size``
    words covers it whose words also start earlier: in a row of smaller doc_id, or in the same row.
    Null ids come before all others; different texts under one id are ordered by a hash of the text,
    and equal rows (same id and text) count as one document and all get the same result. A null,
    empty or short text loses nothing but what its white space was; an empty table stays empty.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc"), F.hash(text).alias("_tag"),
    )
    ranges = (
        repeated_ranges(rows.select("_doc", "_tag", "text"), size, part)
        .groupBy(F.col("doc").alias("_doc"), F.col("tag").cast("int").alias("_tag"))
        .agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    )

    def cut(batches):
        for block in blocks(batches, "text"):
            out = []
            for value, ranges in zip(block.column("text").to_pylist(), block.column("ranges").to_pylist()):
                words = (value or "").encode("utf-8", "replace").split()
                kept, at = [], 0
                for r in sorted(ranges or [], key=lambda r: (r["begin"], r["end"])):
                    kept += words[at : r["begin"]]
                    at = max(at, r["end"])
                kept += words[at:]
                string = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(string).hexdigest(), string.decode()))
            n, removed, digest, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(digest, pa.string()), pa.array(kept, pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(ranges, ["_doc", "_tag"], "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
