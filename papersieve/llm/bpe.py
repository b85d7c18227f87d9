"""Byte-level BPE by merge replay.

The distinct pieces of a block of documents are its corpus. Their bytes lie in one array of symbols;
an inverted index leads from each adjacent pair that the vocabulary can merge to the positions where
it stands. Merges are replayed in rank order: a rank's positions are merged once, and only the pairs
with the two neighbours of each merged position are looked up anew. Every piece is encoded once per
block however often it occurs, so nothing is shuffled. (An index over the pieces of the whole table
would have to join one row per piece occurrence back to its document; that shuffle alone is several
times the input.)
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from papersieve.llm.common import blocks

#: Documents of this many bytes share one replay.
BLOCK = 6 << 20
#: The same where the ids leave the task: those of a block are some thirty times its size, and a worker keeps that memory.
ID_BLOCK = 1 << 20
#: Units whose digests a worker keeps between blocks, at most.
KNOWN = 400_000

#: A word after a blank, or (in a tuple) what a text begins with.
Unit = str | tuple[str]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_one(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One piece alone: merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(parts[i] + parts[i + 1], -1) for i in range(len(parts) - 1)]
        best = min((r for r in found if r >= 0), default=-1)
        if best < 0:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def mergeable_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that joins to a token, as sorted keys (left << 32 | right), and its rank."""
    found = {
        ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    }
    keys = np.fromiter(found, np.int64, len(found))
    order = np.argsort(keys)
    return keys[order], np.fromiter(found.values(), np.int32, len(found))[order]


def replay(pieces: list[bytes], ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """The ids of every piece, all merges replayed over all pieces at once.

    A merge may, in theory, open a pair of lower rank than its own; then the other merges of that
    piece are out of order, and the piece is encoded again alone.
    """
    keys, pair_ranks = pairs
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    symbol = byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    if not n:
        return [[] for _ in pieces]
    # position n stands for "no neighbour"
    symbol = np.append(symbol, -1)
    right, left = np.arange(1, n + 2), np.arange(-1, n)
    last = ends[ends > 0] - 1
    right[last], right[n] = n, n
    left[0], left[last + 1] = n, n

    def rank_of(at: np.ndarray) -> np.ndarray:
        """Rank of the merge of the symbol there and its right neighbour; -1 where there is none."""
        after = symbol[right[at]]
        key = symbol[at] << 32 | np.where(after < 0, 0, after)
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[slot] == key) & (after >= 0) & (at < n), pair_ranks[slot], -1)

    # the index: rank of the merge -> positions of the pair's left symbol
    rank_at = np.append(rank_of(np.arange(n)), -1)
    order = np.argsort(rank_at[:n], kind="stable")
    present, first = np.unique(rank_at[order], return_index=True)
    where = {int(r): x.tolist() for r, x in zip(present, np.split(order, first[1:])) if r >= 0}
    waiting = list(where)
    heapq.heapify(waiting)
    irregular: list[int] = []
    while waiting:
        rank = heapq.heappop(waiting)
        at = np.array(where.pop(rank))
        at = np.unique(at[rank_at[at] == rank])  # others are stale: merged away, or another pair by now
        if (rank_at[right[at]] == rank).any():  # runs of one symbol: every second pair from the left
            taken, free = [], -1
            for i, j in zip(at.tolist(), right[at].tolist()):
                if i != free:
                    taken.append(i)
                    free = j
            at = np.array(taken)
        gone = right[at]
        symbol[at], symbol[gone], rank_at[gone] = rank, -1, -1
        right[at] = right[gone]
        left[right[at]] = at
        left[n] = n
        before = left[at]
        touched = np.concatenate([at, before[before < n]])
        rank_at[touched] = new = rank_of(touched)
        rank_at[n] = -1
        live = new >= 0
        for r, i in zip(new[live].tolist(), touched[live].tolist()):
            if r in where:
                where[r].append(i)
            else:
                where[r] = [i]
                heapq.heappush(waiting, r)
            if r < rank:
                irregular.append(i)
    live = np.flatnonzero(symbol >= 0)
    ids, cuts = symbol[live].tolist(), np.searchsorted(live, ends).tolist()
    out = [ids[a:b] for a, b in zip([0, *cuts], cuts)]
    for p in set(np.searchsorted(ends, irregular, side="right").tolist()):
        out[p] = merge_one(pieces[p], ranks)
    return out


class Codec:
    """The two directions for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.pairs = mergeable_pairs(ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[Unit, tuple[int, str, bytes]] = {}

    def units(self, texts: list[str | None]) -> tuple[list[list[int]], list[Unit]]:
        """For every text the numbers of its units, and the numbered units.

        No piece of the pattern reaches over a blank into the next word, and none looks back; so a
        text may be cut before each blank that stands between two characters that are no white space,
        and equal units are split and encoded once. A text with any other blank is one unit.
        """
        number: dict[Unit, int] = defaultdict(itertools.count().__next__)
        rows = []
        for text in texts:
            head, *rest = (text or "").split(" ")
            rows.append([number[(head,)], *map(number.__getitem__, rest)] if text else [])
        odd = {
            n for unit, n in number.items()
            if (isinstance(unit, tuple) and unit[0][-1:].isspace())
            or (isinstance(unit, str) and (not unit or unit[0].isspace() or unit[-1].isspace()))
        }
        if odd:
            rows = [r if odd.isdisjoint(r) else [number[(text,)]] for r, text in zip(rows, texts)]
        return rows, list(number)

    def encode_units(self, units: list[Unit]) -> list[list[int]]:
        piece: dict[str, int] = defaultdict(itertools.count().__next__)
        split = [
            list(map(piece.__getitem__, self.pattern.findall(" " + u if isinstance(u, str) else u[0]))) for u in units
        ]
        ids = replay([p.encode("utf-8", "replace") for p in piece], self.ranks, self.pairs)
        return [ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]] for ps in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        rows, units = self.units(texts)
        ids = self.encode_units(units)
        return [[i for u in row for i in ids[u]] for row in rows]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes they decode to, of every text."""
        rows, units = self.units(texts)
        new = [u for u in units if u not in self.known]
        made = {
            u: (len(ids), " ".join(map(str, ids)), self.decode(ids)) for u, ids in zip(new, self.encode_units(new))
        }
        self.known.update(itertools.islice(made.items(), max(0, KNOWN - len(self.known))))
        of = [made.get(u) or self.known[u] for u in units]
        count, written, back = [x[0] for x in of], [x[1] for x in of], [x[2] for x in of]
        return [
            (
                sum(map(count.__getitem__, row)),
                hashlib.sha256(" ".join(map(written.__getitem__, row)).encode()).hexdigest(),
                hashlib.sha256(b"".join(map(back.__getitem__, row))).hexdigest(),
            )
            for row in rows
        ]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of a vocabulary, built once in each Python worker; it keeps the units it has met."""
    key = (hashlib.sha256(b"\0".join(ranks)).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column ``ids`` (which it replaces if there).

    A null or empty text has no ids. Rows keep all their other columns; equal rows stay equal rows;
    an empty table stays empty. Texts of any length: a longer text is a block of its own.
    """
    codec = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # as large as the vocabulary
    kept = docs.drop(ids)

    def encode(batches):
        coder = codec_of(*codec.value)
        for block in blocks(batches, text, ID_BLOCK):
            found = coder.encode(block.column(text).to_pylist())
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.fromiter((i for x in found for i in x), np.int32, offsets[-1])
            yield block.append_column(ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    return kept.mapInArrow(encode, f"{_ddl(kept)}, `{ids}` array<int>")


def decode_bpe(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for in a new binary column; null ids give null."""
    codec = rows.sparkSession.sparkContext.broadcast(ranks)
    kept = rows.drop(decoded)

    def decode(batches):
        tokens = {r: t for t, r in codec.value.items()}
        for batch in batches:
            out = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(ids).to_pylist()]
            yield batch.append_column(decoded, pa.array(out, pa.binary()))

    return kept.mapInArrow(decode, f"{_ddl(kept)}, `{decoded}` binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in the task that encodes it.

    The ids are encoded and decoded in full by ``Codec``; only their digests leave the task.
    """
    codec = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def digest(batches):
        coder = codec_of(*codec.value)
        for block in blocks(batches, text, BLOCK):
            digests = coder.digests(block.column(text).to_pylist())
            n, a, b = zip(*digests) if digests else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
