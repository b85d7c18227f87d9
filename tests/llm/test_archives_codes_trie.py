"""The capture index, the vector codes and the conversation trie against brute force on odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from papersieve.llm import codes, common, trie, warc
from papersieve.llm.queries import QUERIES
from papersieve import session

# --- prefix trie


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 6
        start = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        line = tuple(own.get(start, [])[:h] + own[conv][h:])
        for d in range(len(line) + 1):
            members[line[:d]].append(conv)
            if d:
                children[line[: d - 1]].add(line[:d])
        ends[line].append(conv)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return Counter(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    )


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(1)
    ids = sorted({0, 100, 200, -100, -3, *rng.sample(range(1, 300), 60)})
    rows = []
    for conv in ids:
        for turn in range(rng.choice([1, 2, 3, 9])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None])))
    rows += [(None, 1, "u", "no id"), (400, 0, "u", "long " * 20000), (400, 1, "a", "é😀"), (401, 0, "u", "long " * 20000)]
    rows += [(c, t, "u", "same") for c in range(500, 600) for t in range(3)] + [(500, 2, "u", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.selectExpr("*", "1 as key", "'x' as path", "2 as turns", "3 as kind").repartition(3)


@pytest.mark.parametrize("turns,least", [(1 << 18, 32), (40, 8), (6, 5)])
def test_trie_equals_brute_force_at_any_shard_size(spark, chats, monkeypatch, turns, least):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(trie, "LEAST", least)
    rows, df = chats
    assert Counter(tuple(r) for r in trie.conversation_trie(df).collect()) == trie_by_hand(rows)


def test_trie_joins_spread_parents_where_they_may_not_be_broadcast(spark, chats, monkeypatch):
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 0)
    rows, df = chats
    assert Counter(tuple(r) for r in trie.conversation_trie(df).collect()) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    alone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 0)  # its start is absent, its turn replaced
    (root,) = trie.conversation_trie(spark.createDataFrame([(alone, 0, "u", "x")], schema)).collect()
    assert tuple(root)[:7] == (alone, 0, None, 1, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(str(alone).encode()).hexdigest()


def test_trie_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert Counter(tuple(r) for r in QUERIES["op11_prefix_trie"](spark, sf_dir).collect()) == trie_by_hand([tuple(r) for r in rows])


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 3000):
        for deep in (False, True):
            bits, left, height = [], n, 0
            while left or height:
                up = left and (not height or rng.random() < (0.9 if deep else 0.5))
                bits.append(bool(up))
                left, height = left - bool(up), height + (1 if up else -1)
            stack, close = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            at = np.flatnonzero(bits)
            assert trie.Parentheses(np.array(bits)).findclose(at).tolist() == [close[i] for i in at.tolist()]


# --- capture index


def archive_by_hand(rows):
    groups = defaultdict(list)
    order = lambda p, u: (p is not None, p or 0, u is not None, u or "")
    for page, url, html in rows:
        groups[(html or "").encode()].append((order(page, url), page))
    out, done = [], set()
    for page, url, html in rows:
        payload = (html or "").encode()
        best, keeper = max(groups[payload])
        first = order(page, url) == best and payload not in done
        if first:
            done.add(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if first else "revisit", None if first else keeper))
    return Counter(out)


ODD_PAGES = [
    (1, "http://a.b.com/x", None), (2, "http://a.b.com/x", ""), (3, None, "same"), (4, "http://WWW.c.org:80/p?q=1#f", "same"), (None, "x", "same"),
    (None, None, None), (4, "http://WWW.c.org:80/p?q=1#f", "same"), (4, "http://z/", "same"), (5, "http://[bad", "é" * 100000),
    (6, "http://t\tab/ \n", " \r\n\r\n x"), (7, "http://a.b.com/x", "\r\n"), (7, "http://a.b.com/x", "\r\n"), (8, "", "tail\r\n\r\n"),
    *[(i, "http://hot.org/", "hot") for i in range(100, 160)],
]
RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    return df.selectExpr("*", "1 as keeper", "2 as content", "3 as copies", "'k' as key", "4 as rows").repartition(3)


@pytest.mark.parametrize("broadcast,archive,lines", [(200_000, 64 << 20, 3000), (0, 500, 4)])
def test_archive_round_trip_equals_brute_force(spark, pages, tmp_path, monkeypatch, broadcast, archive, lines):
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    found = warc.archive_round_trip(pages, str(tmp_path / "set")).select(*RESULT)
    assert Counter(tuple(r) for r in found.collect()) == archive_by_hand(ODD_PAGES)


def test_archive_of_nothing(spark, pages, tmp_path):
    assert warc.archive_round_trip(pages.limit(0), str(tmp_path / "set")).count() == 0


def test_index_finds_urls_and_returns_payloads(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    archive = warc.write_archive(pages, str(tmp_path / "set"))
    asked = spark.createDataFrame([("http://a.b.com/x",), ("http://nowhere.org/",), ("http://hot.org/",), ("http://hot.org/",)], "url string")
    found = warc.fetch(spark, archive, warc.keys(asked)).collect()
    assert Counter(r.page_id for r in found) == Counter([1, 2, 7, 7, *range(100, 160)])
    assert {r.page_id: bytes(r.payload) for r in found if r.record_type == "response" and r.page_id > 50} == {159: b"hot"}
    one = warc.fetch(spark, archive, warc.keys(spark.createDataFrame([("http://hot.org/", 120)], "url string, page long"), page_id="page")).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in one] == [(120, "revisit", 159)]


def test_archives_are_gzip_members_with_sorted_keys(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "set"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "set" / "archives").iterdir())
    kinds = Counter()
    while raw:
        member = zlib.decompressobj(31)
        text = member.decompress(raw)
        raw = member.unused_data
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        kinds[text.split(b"\r\n")[1]] += 1
    assert kinds[b"WARC-Type: response"] == len({h or "" for *_, h in ODD_PAGES})
    assert kinds[b"WARC-Type: response"] + kinds[b"WARC-Type: revisit"] == len(ODD_PAGES)
    assert warc.url_key("http://WWW.c.org:80/p?q=1#f") == "org,c,www:80)/p?q=1" and warc.url_key(None) == "" and warc.url_key("x y") == "x%20y"


def test_damaged_payload_is_told():
    good = warc.capture_record(1, "http://a/", b"text", False, None)
    assert warc.parse_record(good)["payload"] == b"text"
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(bad.compress(zlib.decompress(good, 31).replace(b"text\r\n\r\n", b"tixt\r\n\r\n")) + bad.flush())


# --- vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error)} and the digest, with Python's numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = np.array([[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in r[1]] for r in rows], object)
    width = values.shape[1] // parts
    cut = [values[:, k * width : (k + 1) * width] for k in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def assign(points, book):
        d = np.stack([((points - e) ** 2).sum(axis=1) for e in book], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for k in range(parts):
            at, _ = assign(cut[k], books[k])
            for e in range(len(books[k])):
                if (at == e).any():
                    books[k][e] = cut[k][at == e].sum(axis=0) // int((at == e).sum())
    met = [assign(cut[k], books[k]) for k in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{m[0][i]:02x}" for m in met), int(sum(m[1][i] for m in met))) for i, r in enumerate(rows)}, digest


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 as value", "2 as dims", "3 as code", "'g' as group", "4 as rows").repartition(3)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), i % 3 if i % 4 else None) for i in range(420)]
    rows += [(i, rows[i % 7][1], 1) for i in range(420, 500)]  # equal vectors and ties
    odd = [(601, None, 1), (602, [float("nan")] * 8, 1), (603, [1.0, None] * 4, 1), (604, [float("inf")] * 8, 1)]
    want, digest = codes_by_hand(rows)
    sums = defaultdict(int)
    for i, _, label in rows:
        sums[label] += want[i][1]
    got = codes.vector_codes(vectors(spark, rows + odd)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {
        i: (*want[i], sums[label], digest) for i, _, label in rows
    }
    assert codes.vector_codes(vectors(spark, rows).limit(0)).count() == 0


def test_codes_of_huge_few_and_odd_vectors(spark):
    rows = [(i, [float(i * j % 5) for j in range(4)], None) for i in range(6)] + [(9, [1e30, -3e38, 2.0**25, 0.0], 1)]
    want, digest = codes_by_hand(rows)
    got = {r.vec_id: r for r in codes.vector_codes(vectors(spark, rows)).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want and got[9].codebooks_sha256 == digest
    mixed = {r.vec_id: r for r in codes.vector_codes(vectors(spark, [(1, [], 1), (2, [1.0, 2.0, 3.0], 1), (None, [5.0] * 4, 2)])).collect()}
    assert {i: (r.code, r.error, r.label_error) for i, r in mixed.items()} == {i: ("00000000", 0, 0) for i in (1, 2, None)}


def test_orchard_search_marks_ties_to_the_lower_entry():
    rng = np.random.default_rng(5)
    for spread in (2, 40):
        book = rng.integers(-spread, spread, (97, 3))
        points = rng.integers(-spread, spread, (500, 3))
        entry, distance = codes.Neighbours(book).nearest(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_lookup_by_broadcast_and_by_spread_join_agree(spark, monkeypatch):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "id long, key string")
    lookup = spark.createDataFrame([("hot", 1, 60), ("k0", 2, 1), ("absent", 3, 0)], "key string, value long, rows long")
    plain = sorted(map(tuple, common.look_up(big, lookup, "key", "value", "rows", "id").select("id", "value").collect()))
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, common.look_up(big, lookup, "key", "value", "rows", "id").select("id", "value").collect())) == plain
