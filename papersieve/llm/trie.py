"""Prefix trie of conversations, encoded as balanced parentheses shard by shard.

A conversation is the sequence of its turns, each a 128-bit digest of role and text; texts don't
travel. Sequences are sorted over the cluster and cut into shards of neighbouring sequences. A shard
writes its trie as a bit string, an opening and a closing parenthesis per node in preorder, with the
smallest and largest excess of every block of bits: ``findclose`` gives the end of a node's subtree,
the rank of the pairs "()" the number of its leaves, and cumulative arrays in preorder its members
and savings.

Only nodes on a shard's first and last sequence, its spines, can be shared with other shards. Each
shard states all others as they are and passes its spines on with what hangs from them; the spines
of all shards are the sequences of the next level, which works the same, until one shard holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import look_up
from papersieve.session import materialize

#: A shard ends at so many turns, if it holds at least LEAST sequences (over two, so that levels shrink).
SHARD_TURNS, LEAST = 1 << 18, 32
#: Bytes of a turn's digest, bits of an excess block.
WIDTH, BLOCK = 16, 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max

SCHEMA = (
    "kind string, key string, parent_key string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, first long, ids string, path binary, sizes array<long>,"
    " lows array<long>, members array<long>, leaves array<long>, kids array<long>, saved array<long>"
)
_LONGS = pa.list_(pa.int64())
_FIELDS = [
    ("kind", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("first", pa.int64()), ("ids", pa.string()), ("path", pa.binary()),
    ("sizes", _LONGS), ("lows", _LONGS), ("members", _LONGS), ("leaves", _LONGS), ("kids", _LONGS), ("saved", _LONGS),
]
#: What a node passes up: its smallest conversation, and members, leaves, children and savings that hang from it.
HUNG = ("lows", "members", "leaves", "kids", "saved")


class Parentheses:
    """A balanced bit string (True opens) with excess blocks in a min-max tree."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        self.opened = np.cumsum(bits, dtype=np.int64)
        pairs = np.zeros(len(bits), bool)
        pairs[:-1] = bits[:-1] & ~bits[1:]
        self.leaf = pairs
        self.pairs = np.cumsum(pairs, dtype=np.int64)
        n = -(-len(bits) // BLOCK)
        padded = np.full(n * BLOCK, NONE)
        padded[: len(bits)] = self.excess
        low = padded.reshape(n, BLOCK).min(axis=1)
        padded[len(bits):] = -1
        high = padded.reshape(n, BLOCK).max(axis=1)
        self.tree = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, NONE), np.append(high, -1)
                self.tree[-1] = (low, high)
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.tree.append((low, high))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place whose excess is one less."""
        target = self.excess[at] - 1
        close = np.full(len(at), -1)
        self._scan(close, np.arange(len(at)), at + 1, target)
        open_ = np.flatnonzero(close < 0)
        node, level = at[open_] // BLOCK, np.zeros(len(open_), np.int64)
        found = np.full(len(open_), -1)
        left = np.arange(len(open_))
        for k in range(len(self.tree)):  # up: the first right neighbour whose range covers the target
            if not len(left):
                break
            low, high = self.tree[k]
            n = node[left]
            beside = np.minimum(n + 1, len(low) - 1)
            goal = target[open_[left]]
            hit = (n % 2 == 0) & (n + 1 < len(low)) & (low[beside] <= goal) & (goal <= high[beside])
            found[left[hit]], level[left[hit]] = n[hit] + 1, k
            left = left[~hit]
            node[left] //= 2
        for k in range(len(self.tree) - 1, 0, -1):  # down: the leftmost block that covers it
            here = np.flatnonzero((level == k) & (found >= 0))
            low, high = self.tree[k - 1]
            child, goal = found[here] * 2, target[open_[here]]
            found[here] = np.where((low[child] <= goal) & (goal <= high[child]), child, child + 1)
            level[here] = k - 1
        self._scan(close, open_, found * BLOCK, target)
        return close

    def _scan(self, close: np.ndarray, which: np.ndarray, start: np.ndarray, target: np.ndarray) -> None:
        """Step from ``start`` to the end of its block."""
        at, rest = start.copy(), which
        last = np.minimum(start // BLOCK * BLOCK + BLOCK, len(self.bits))
        for _ in range(BLOCK):
            inside = at < last
            rest, at, last = rest[inside], at[inside], last[inside]
            if not len(rest):
                return
            hit = self.excess[at] == target[rest]
            close[rest[hit]] = at[hit]
            rest, at, last = rest[~hit], at[~hit] + 1, last[~hit]


def common_turns(a: bytes, b: bytes) -> int:
    """Length, in turns, of the common start of two sequences."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest value of values[first..last], both included, by doubling ranges."""
    tables = [values]
    while 1 << len(tables) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for k, t in enumerate(tables):
        at = power == k
        out[at] = np.minimum(t[first[at]], t[last[at] - (1 << k) + 1])
    return out


def prefix_keys(path: bytes) -> list[str]:
    """Key of every prefix of a sequence, the empty one first."""
    state = hashlib.sha256()
    keys = [state.hexdigest()[:32]]
    for i in range(0, len(path), WIDTH):
        state.update(path[i : i + WIDTH])
        keys.append(state.hexdigest()[:32])
    return keys


class Shard:
    """The trie of sorted sequences with what hangs from each node."""

    def __init__(self, paths: list[bytes], sizes: list[list[int]]):
        self.paths = paths
        lengths = np.array([len(p) // WIDTH for p in paths])
        shared = np.array([0, *(common_turns(a, b) for a, b in zip(paths, paths[1:]))])
        turns = np.empty(2 * len(paths) + 1, np.int64)
        turns[0::2] = np.append(0, lengths - np.append(shared[1:], 0))  # closed before each sequence, and at the end
        turns[1::2] = lengths - shared
        bits = np.repeat(np.arange(len(turns)) % 2 == 1, turns)
        self.tree = Parentheses(np.concatenate([[True], bits, [False]]))
        starts = np.flatnonzero(self.tree.bits)
        self.close = self.tree.findclose(starts)
        self.open = starts
        n = len(starts)
        self.depth = self.tree.excess[starts] - 1
        self.last = self.tree.opened[self.close] - 1
        self.size = np.array([0, *(x for s, k in zip(sizes, shared.tolist()) for x in s[k:])], np.int64)
        order = np.argsort(self.depth, kind="stable")
        ids = np.arange(n)
        above = np.searchsorted((self.depth * n + ids)[order], (self.depth - 1) * n + ids) - 1
        self.parent = order[np.maximum(above, 0)]  # the last node before it that is one less deep
        self.end_of = np.cumsum(turns[1::2])  # node of each sequence's last turn; the empty one comes first, at the root
        self.hung = {k: np.zeros(n, np.int64) for k in HUNG}
        self.hung["lows"][:] = NONE

    def path_nodes(self, i: int) -> np.ndarray:
        """Nodes of sequence i from the root down."""
        nodes, at = [], int(self.end_of[i])
        while at:
            nodes.append(at)
            at = int(self.parent[at])
        return np.array([0, *reversed(nodes)])

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.last + 1] - total[: len(values)]

    def totals(self, spine: np.ndarray) -> dict[str, np.ndarray]:
        """Members, children, leaves, savings and smallest conversation of each subtree, spine nodes' own part left out."""
        n = len(self.open)
        members = self.below(self.hung["members"])
        childless = self.tree.leaf[self.open]
        leaves = self.tree.pairs[self.close] - np.append(0, self.tree.pairs)[self.open]
        leaves = leaves - self.below(childless & ((self.hung["kids"] > 0) | spine)) + self.below(self.hung["leaves"])
        saved = self.below(self.hung["saved"] + np.where(spine, 0, (members - 1) * self.size))
        return {
            "members": members, "leaves": leaves, "saved": saved, "lows": range_minima(self.hung["lows"], np.arange(n), self.last),
        }

    def children(self, counted: np.ndarray) -> np.ndarray:
        """Number of children among ``counted`` nodes, with those that earlier levels have stated."""
        below = np.flatnonzero(counted)
        return self.hung["kids"] + np.bincount(self.parent[below[below > 0]], minlength=len(self.open))


def _table(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS],
        [k for k, _ in _FIELDS],
    )


def _nodes(shard: Shard, totals: dict, stated: np.ndarray, spine_keys: dict[int, str], keys: list[str] | None, ends: list) -> pa.RecordBatch:
    """Rows of the nodes that no other shard shares."""
    at = np.flatnonzero(stated)
    parent = shard.parent[at]
    known = stated[parent] & (at > 0)
    return _table(
        len(at), kind=["node"] * len(at), key=[keys[i] for i in at.tolist()] if keys else [None] * len(at),
        parent_key=[spine_keys.get(p) if a else None for a, p in zip(at.tolist(), parent.tolist())],
        depth=shard.depth[at], conv_id=totals["lows"][at], parent_conv_id=pa.array(totals["lows"][parent], pa.int64(), mask=~known),
        n_convs=totals["members"][at], n_children=shard.children(np.ones(len(shard.open), bool))[at], n_leaves=totals["leaves"][at],
        saved_tokens=totals["saved"][at], ends_sha256=[ends[i] for i in at.tolist()] if ends else [None] * len(at),
    )


def _spines(shard: Shard, totals: dict, spine: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """The first and the last sequence with what hangs from their nodes, stated once where they share a node."""
    hung = {"lows": totals["lows"], "kids": shard.children(~spine)}
    on = np.flatnonzero(spine)[1:]
    for k in ("members", "leaves", "saved"):
        passed = np.zeros(len(shard.open), np.int64)
        np.add.at(passed, shard.parent[on], totals[k][on])
        hung[k] = totals[k] - passed
    rows = [(shard.paths[0], first, np.zeros(len(first), bool))]
    if len(shard.paths) > 1:
        again = np.zeros(len(last), bool)
        again[: common_turns(shard.paths[0], shard.paths[-1]) + 1] = True
        rows.append((shard.paths[-1], last, again))
    lists = {
        k: [np.where(again, NONE if k == "lows" else 0, hung[k][nodes]).tolist() for _, nodes, again in rows] for k in HUNG
    }
    return _table(
        len(rows), kind=["spine"] * len(rows), path=[p for p, *_ in rows], sizes=[shard.size[nodes[1:]].tolist() for _, nodes, _ in rows], **lists
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 0: shards of (path, sizes, conv_id) in order; nodes, spines, and the members that end on spines."""
    paths: list[bytes] = []
    sizes: list[list[int]] = []
    ids: list[list[int]] = []
    turns = rows = 0

    def state():
        shard = Shard(paths, sizes)
        first, last = shard.path_nodes(0), shard.path_nodes(len(paths) - 1)
        spine = np.zeros(len(shard.open), bool)
        spine[first] = spine[last] = True
        shard.hung["members"][shard.end_of] = [len(x) for x in ids]
        shard.hung["lows"][shard.end_of] = [x[0] for x in ids]
        totals = shard.totals(spine)
        keys = dict(zip(first.tolist(), prefix_keys(paths[0]))) | dict(zip(last.tolist(), prefix_keys(paths[-1])))
        ends = [NO_ENDS] * len(spine)
        blocks = []
        for node, members in zip(shard.end_of.tolist(), ids):
            text = ",".join(map(str, members))
            if spine[node]:
                blocks.append((keys[node], members[0], text))
            else:
                ends[node] = hashlib.sha256(text.encode()).hexdigest()
        yield _nodes(shard, totals, ~spine, keys, None, ends)
        yield _spines(shard, totals, spine, first, last)
        if blocks:
            key, low, text = zip(*blocks)
            yield _table(len(blocks), kind=["ends"] * len(blocks), key=key, first=low, ids=text)

    for batch in batches:
        for path, size, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id"))):
            if turns >= SHARD_TURNS and rows >= LEAST:
                yield from state()
                paths, sizes, ids, turns, rows = [], [], [], 0, 0
            if paths and paths[-1] == path:
                ids[-1].append(conv)
                turns += 1
            else:
                paths.append(path)
                sizes.append(size)
                ids.append([conv])
                turns += len(size) + 1
            rows += 1
    if paths:
        yield from state()


def _merge(whole: bool):
    """Later levels: shards of spines; ``whole`` if one shard holds them all, so that nothing is passed on."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        sizes: list[list[int]] = []
        hung: list[list[dict]] = []
        turns = rows = 0

        def state():
            shard = Shard(paths, sizes)
            keys: list = [None] * len(shard.open)
            for i, given in enumerate(hung):
                nodes = shard.path_nodes(i)
                for node, key in zip(nodes.tolist(), prefix_keys(paths[i])):
                    keys[node] = key
                for row in given:
                    for k in HUNG:
                        if k == "lows":
                            shard.hung[k][nodes] = np.minimum(shard.hung[k][nodes], row[k])
                        else:
                            shard.hung[k][nodes] += np.array(row[k], np.int64)
            spine = np.zeros(len(shard.open), bool)
            first, last = shard.path_nodes(0), shard.path_nodes(len(paths) - 1)
            if not whole:
                spine[first] = spine[last] = True
            totals = shard.totals(spine)
            yield _nodes(shard, totals, ~spine, {i: keys[i] for i in np.flatnonzero(spine).tolist()}, keys, [])
            if not whole:
                yield _spines(shard, totals, spine, first, last)

        for batch in batches:
            for row in batch.to_pylist():
                if not whole and turns >= SHARD_TURNS and rows >= LEAST:
                    yield from state()
                    paths, sizes, hung, turns, rows = [], [], [], 0, 0
                if paths and paths[-1] == row["path"]:
                    hung[-1].append(row)
                else:
                    paths.append(row["path"])
                    sizes.append(row["sizes"])
                    hung.append([row])
                turns += len(row["sizes"]) + 1
                rows += 1
        if paths:
            yield from state()

    return merge


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of ids of each key, in order; a block at a time."""
    held, state = None, None
    for batch in batches:
        done = []
        for key, text in zip(*(batch.column(c).to_pylist() for c in ("key", "ids"))):
            if key == held:
                state.update(b",")
            else:
                if held is not None:
                    done.append((held, state.hexdigest()))
                held, state = key, hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["key", "ends"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["key", "ends"])


def sequences(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each its place, digest and code points."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    mark = F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256), 1, 2 * WIDTH)
    return (
        conversations.filter(F.col(conv_id).isNotNull())
        .select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), mark.alias("mark"), F.length(text_).cast("long").alias("size"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "mark", "size"))).alias("turns"))
    )


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the conversation at the start of their hundred, h by their checksum.

    At most 2 * ``every`` conversations share a start, so the join has no hot key.
    """
    start = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("start"), F.slice("turns", 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = turns.withColumn("start", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    joined = own.join(start, "start", "left")
    empty = F.slice("turns", 1, 0)
    return joined.select(
        "conv_id", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns`` are ``sequences``, with at most one row per conversation. A sequence travels as one value
    of 16 bytes a turn; a node where very many conversations end gets their ids in sorted blocks that
    one task feeds to one hash, as the digest demands. No conversation gives no node.
    """
    paths = turns.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    order = ("path", "conv_id")
    level = materialize(paths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_conversations, SCHEMA))
    nodes, blocks = level.filter("kind = 'node'"), level.filter("kind = 'ends'").select("key", "first", "ids")
    upper = None
    while True:
        spines = level.filter("kind = 'spine'").select("path", "sizes", *HUNG)
        n, turns_left = spines.agg(F.count("*"), F.sum(F.size("sizes") + 1)).first()
        if not n:
            return nodes.select(*COLUMNS)
        whole = n <= LEAST or turns_left <= SHARD_TURNS
        dealt = spines.repartition(1) if whole else spines.repartitionByRange("path")
        level = materialize(dealt.sortWithinPartitions("path").mapInArrow(_merge(whole), SCHEMA))
        found = level.filter("kind = 'node'")
        upper = found if upper is None else upper.unionByName(found)
        if whole:
            break
    ends = blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_ends, "key string, ends string")
    upper = materialize(upper.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))))
    every = nodes.unionByName(upper.select(nodes.columns))
    parents = materialize(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), "n_children"))
    open_ = look_up(every.filter("parent_key is not null"), parents, "parent_key", "above", "n_children", "conv_id")
    return every.filter("parent_key is null").select(*COLUMNS).union(
        open_.withColumn("parent_conv_id", F.col("above")).select(*COLUMNS)
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(
    conversations: DataFrame, every: int = 100, heads: int = 6,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The prefix trie of the rebuilt conversations (``rebuilt``), a row per node.

    Turns are ordered by ``turn``, null first; turns of equal place by their digest. Null roles and
    texts are empty. Rows without a conv_id take no part; the hundred of a negative one starts toward zero. Repeated turns are turns like others. A
    conversation is one unit of work, of 16 bytes a turn; texts of any length travel as digests. An
    empty table gives no rows; other columns are not read.
    """
    return prefix_trie(rebuilt(sequences(conversations, conv_id, turn, role, text), every, heads))
