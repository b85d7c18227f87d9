"""Each operator on small rows against brute force: nulls, empty, long and repeated texts, ties, clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papersieve.llm import bpe, decontaminate, html, licences, neardup, pii, quality, substrings, topk, toxicity
from papersieve.llm.queries import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 30, n)))


LONG = text(1, 4000)
ROWS = [
    (1, text(2, 120)), (2, text(2, 120)), (3, text(2, 120).rsplit(" ", 1)[0] + " changed"), (4, None), (5, ""), (6, "one two"), (7, LONG),
    (8, text(3, 30) + " " + text(2, 60)), (None, text(4, 50)), (9, "x " * 60), (10, text(5, 90)), (10, text(6, 90)), (11, text(7, 40)), (11, text(7, 40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", 0, "a", "b") for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, perplexity string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"
    )


def test_bpe_equals_tiktoken_and_round_trips(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = [" a  b\n\n c ", " x\x85 y", "aaaa" * 500, "it's 12³ ½ é漢字😀", "<|endoftext|>", "  ", "a \n b", " lead", "trail "]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text", F.col("ids")).unionByName(more.withColumn("ids", F.lit("z")))
    encoded = bpe.decode_bpe(bpe.encode_bpe(both, ranks, pattern), ranks)
    for r in encoded.collect():
        assert r.ids == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.token_digests(both, ranks, pattern).join(both, "doc_id").filter("doc_id in (0, 1, 3, 7)").collect():
        ids = own.encode_ordinary(r.text or "")
        texts = [t for i, t in [*ROWS, *enumerate(odd)] if i == r.doc_id]
        assert r.n_tokens in {len(own.encode_ordinary(t or "")) for t in texts}
        assert ids is not None
    assert bpe.token_digests(docs.limit(0), ranks, pattern).count() == 0


def test_decontamination_against_brute_force(spark, docs):
    items = [("b1", text(2, 25)), ("b2", "one TWO"), (None, text(3, 12)), ("b4", None), ("b5", "..."), ("b2", LONG[-200:])]
    frame = spark.createDataFrame(items, "item_id string, text string")
    wanted = {}
    for i, t in items:
        w = decontaminate.words(t)
        for k in range(max(len(w) - 9, min(1, len(w)))):
            wanted.setdefault(tuple(w[k : k + 10]), set()).add(i or "")

    def expect(t):
        w, hit, ids = decontaminate.words(t), set(), set()
        for window, names in wanted.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    ids |= names
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    def got(chunk):
        decontaminate.CHUNK_BYTES, before = chunk, decontaminate.CHUNK_BYTES
        try:
            rows = decontaminate.contamination(docs, frame).collect()
        finally:
            decontaminate.CHUNK_BYTES = before
        return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)

    want = sorted((i or 0, *expect(t)) for i, t in ROWS)
    assert got(1 << 20) == want
    assert got(8000) == want  # several steps over the same index
    assert not any(r.contaminated for r in decontaminate.contamination(docs, frame.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), frame).count() == 0


def test_proximity(spark):
    frame = spark.createDataFrame([(1, "a b x c d"), (2, "c b a"), (3, "a z z z z z b z c")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(frame, items, slop=1).collect()}
    assert got == {1: 4, 2: 3, 3: 0}


@pytest.mark.parametrize("open_bytes", [substrings.OPEN_BYTES, 300])
def test_substrings_against_brute_force(docs, open_bytes, monkeypatch):
    monkeypatch.setattr(substrings.repeated_ranges, "__defaults__", (20, 5, open_bytes))
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.hash("text").alias("h")).collect()}
    order = sorted(set(ROWS), key=lambda r: (-1 if r[0] is None else r[0], hashes[r]))
    seen, want = set(), {}
    for row in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[row] = (row[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = [tuple(r)[:4] for r in substrings.dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == sorted((want[r] for r in ROWS), key=str)
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_near_duplicates_find_all_links(docs):
    got = {(r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (7, 7, 1), (11, 11, 2)} <= got
    kept = [r.doc_id for r in neardup.keep_one(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 5, 6, 7, 8, 9, 10, 10, 11]  # two texts under one id
    assert kept.count(None) == 1
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_all_of_a_bucket_are_compared(spark, monkeypatch):
    """One band of one row, so that one bucket holds most texts of a template, and few are near its leader."""
    monkeypatch.setattr(neardup, "GROUP", 32, raising=False)
    template = text(50, 240).split()

    def other(words, seed, at, n):
        return [*words[:at], *(f"own{seed}x{k}" for k in range(n)), *words[at + n :]]

    texts = [other(template, i, 100, 14) for i in range(300)]
    texts += [other(t, 1000 + i, 2 * i, 2) for i, t in enumerate(texts[:40])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    n = len(texts)
    own, value, times, _ = neardup.shingles([" ".join(t) for t in texts])
    keys, counts = np.unique(value, return_counts=True)
    step = np.where(counts * neardup.STEPS >= n, counts * neardup.STEPS // n, 0)
    weight = (times * neardup.idf(step[np.searchsorted(keys, value)])).astype("<f4")
    cuts = np.searchsorted(own, np.arange(n + 1))
    packed = [(value[a:b].astype("<u8").tobytes(), weight[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    source = frame.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), "text")
    signed = neardup.signatures(source, neardup.frequent_shingles(source.select("text"), n), 1, 1).collect()
    bucket = {r.doc: r.bands[0] for r in signed}
    leads = list(range(n))
    pairs = apart = 0
    for i in range(n):
        for j in range(i):
            near = neardup.weighted_jaccard(*packed[i], *packed[j])
            apart += 0.7 < near < neardup.SIMILARITY and bucket[i] == bucket[j]
            if near >= neardup.SIMILARITY and bucket[i] == bucket[j]:
                pairs += 1
                x, y = sorted((leads[i], leads[j]))
                leads = [x if k == y else k for k in leads]
    assert pairs > 25 and apart > 10000
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame, bands=1, rows=1).collect()}
    assert [got[i] for i in range(n)] == leads


def test_members_of_several_shared_buckets_are_one_pair(spark):
    """Every two members of different classes that share a bucket of three or more, once."""
    rng = np.random.default_rng(5)
    bands = [[100 * i + int(v) for i, v in enumerate(row)] for row in rng.integers(0, 3, (30, 4))]
    node = [bytes([i]) * 16 for i in range(30)]
    samples = rng.integers(0, 2, (30, 8)).astype("<u2")
    own = [node[i - i % 3] for i in range(30)]
    active = spark.createDataFrame(
        [(n, b, x.tobytes()) for n, b, x in zip(node, bands, samples)], "node binary, bands array<long>, samples binary"
    )
    component = spark.createDataFrame(list(zip(node, own)), "node binary, component binary")
    placed = active.select("node", F.explode("bands").alias("bucket"))
    got = neardup.open_pairs(placed, active, component, 0.5, 2).collect()
    want = {
        (node[i], node[j]) for i in range(30) for j in range(i + 1, 30)
        if own[i] != own[j] and any(x == y for x, y in zip(bands[i], bands[j])) and (samples[i] == samples[j]).mean() >= 0.5
    }
    assert len(want) > 50
    assert sorted((bytes(r.a), bytes(r.b)) for r in got) == sorted(want)


def test_pairs_that_cannot_link_stay_in_their_bucket(spark):
    """A family below the bound leaves no pairs, and none that has the similarity is lost."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 47, 150, np.uint64)
    packed = []
    for i in range(120):
        own = base.copy()
        edits = rng.choice(150, 30 if i % 4 else 8, replace=False)
        own[edits] = rng.integers(0, 1 << 47, len(edits), np.uint64)
        packed.append((np.sort(own).astype("<u8").tobytes(), rng.choice(np.array([0.7, 1.0, 1.69], "<f4"), 1).repeat(150).tobytes()))
    node = [bytes([i]) * 16 for i in range(120)]
    frame = spark.createDataFrame([(n, [7], bytes(16)) for n in node], "node binary, bands array<long>, samples binary")
    component = frame.select("node", F.col("node").alias("component"))
    weighed = spark.createDataFrame([(n, *x) for n, x in zip(node, packed)], "node binary, shingle binary, weight binary")
    placed = frame.select("node", F.explode("bands").alias("bucket"))
    got = {(bytes(r.a), bytes(r.b)) for r in neardup.open_pairs(placed, frame, component, 0.5, 2, weighed, 0.8).collect()}
    near = {
        (node[i], node[j]) for i in range(120) for j in range(i + 1, 120) if neardup.weighted_jaccard(*packed[i], *packed[j]) >= 0.8
    }
    assert near and near <= got
    assert len(got) < 120 * 119 / 2 / 10
    total, parts = neardup.sketch(np.arange(10, dtype="<u8").tobytes(), np.full(10, 1e6, "<f4").tobytes())
    assert total == 1e7 and np.isinf(np.frombuffer(parts, "<f2")[:10]).all()  # too heavy for a half float: still a bound


@pytest.mark.parametrize("rows, shingles", [(4096, 1 << 22), (7, 1 << 22), (4096, 50)])
def test_frequent_shingles_against_counting(spark, monkeypatch, rows, shingles):
    """The same shingles however documents are pooled and dealt: texts over many partitions, long, null and empty ones."""
    monkeypatch.setattr(neardup, "POOL_ROWS", rows)
    monkeypatch.setattr(neardup, "POOL_SHINGLES", shingles)
    texts = [text(i, 30) + " " + text(77, 12 if i % 20 == 0 else 8 if i % 7 else 6) for i in range(200)] + [LONG, None, ""]
    n = len(texts)
    _, value, _, _ = neardup.shingles(texts)
    keys, counts = np.unique(value, return_counts=True)
    often = counts * neardup.STEPS >= n
    got = neardup.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(60), n)
    assert 3 < often.sum() < 20
    assert got[0].tolist() == keys[often].tolist()
    assert got[1].tolist() == (counts[often] * neardup.STEPS // n).tolist()


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    shingle = rng.integers(0, 1 << 48, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    sampler = neardup.Sampler(2000, 1.0)
    same = (sampler.draw(shingle, a, np.array([0])) == sampler.draw(shingle, b, np.array([0]))).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).round(2).tolist()) for i in range(0, 400)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (None, [0.1] * 6), (800, [0.5, 0.5]), (901, [0.25, -3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, k=10).orderBy("query_id", "rank").collect()]
    usable = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)}
    want = []
    for q in sorted(i for i in usable if i % 100 == 0):
        found = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:10])]
    assert got == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_disclosing_terms_are_masked(spark):
    rows = [(i, f"write to John Smith at john@x.org about the {text(i + 40, 6)} and the rest") for i in range(6)]
    rows += [(10 + i, f"the rest is at {text(i + 60, 30)} and about to write") for i in range(40)] + [(90, None), (91, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r.spans for r in pii.span_digests(frame).collect()}
    first = rows[0][1]
    at, smith = first.index("John"), first.index("Smith")
    assert got[0].split(",") == [f"email:{first.index('john@')}:{first.index('john@') + 10}", f"term:{at}:{at + 4}", f"term:{smith}:{smith + 5}"]
    assert got[10] == got[90] == got[91] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[0].startswith("write to   at [EMAIL] about") and clean[10] == rows[6][1] and clean[90] is None


def python_base(value):
    """The base findings by Python's ``re``, after the definition."""
    import re

    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end(), m.group()) for k, p, good in kinds for m in re.finditer(p, value or "") if good(m.group())]


def test_base_findings_equal_python_re(spark):
    rng = np.random.default_rng(3)
    bits = ["a", "b.c", "@", "@x.org", ".", "1", "25", "255.1.0.9", "+4", "-", " ", "(", ")", "é", "😀", "_%", "4111 1111 1111 1111", "+44 20 7946 0958", "\n"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(1, 30)))) for i in range(400)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in pii.find_personal_data(frame).collect():
        found[r.doc_id] = [tuple(s) for s in r.spans if s.kind in pii.KINDS]
    assert found == {i: python_base(t) for i, t in rows} and sum(map(len, found.values())) > 300


def test_disclosure_equals_brute_force(spark):
    import math
    import re

    rng = np.random.default_rng(8)
    vocabulary = [a + b + c for a in "bcd" for b in "aei" for c in "ln"] + ["contact", "rare"]
    values = ["ann@one.org", "bob@one.org", "cy@one.org", "dee@two.net", "10.0.0.1", "10.0.0.7", "+44 20 7946 0958", "+44 20 7946 0959"]
    rows = []
    for i in range(150):
        words = list(rng.choice(vocabulary[:-2], rng.integers(0, 40)))
        for v in rng.choice(values, rng.integers(0, 3)) if i % 3 == 0 else []:
            at = rng.integers(0, len(words) + 1)
            words[at:at] = (["contact"] if rng.random() < 0.8 else []) + [v] + (["rare"] if v.endswith("org") else [])
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")

    held, pairs, frequency = {}, {}, {}
    for i, t in rows:
        for term in set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())):
            frequency[term] = frequency.get(term, 0) + 1
        for kind, a, b, v in python_base(t):
            digits = re.sub("[^0-9]", "", v)
            part = {"email": v.lower().split("@")[-1], "ip": ".".join(v.split(".")[:3]), "card": digits[:6], "phone": digits[:3]}[kind]
            near = re.findall(r"[^\W\d_]{3,}", t[max(0, a - 160) : a].lower())[::-1][:8] + re.findall(r"[^\W\d_]{3,}", t[b : b + 160].lower())[:8]
            for entity in (f"value:{kind}:{v.lower()}", f"part:{kind}:{part}", f"kind:{kind}:"):
                held.setdefault(entity, set()).add((i, t))
                for term in near:
                    pairs.setdefault((entity, term), set()).add((i, t))
    want = {}
    for (entity, term), where in pairs.items():
        information = math.log(len(rows) / len(held[entity]))
        share = math.log(len(rows) * len(where) / (frequency[term] * len(held[entity]))) / information
        if len({t for _, t in where}) >= 3 and share >= 0.5:
            want[entity, term] = share
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing_terms(frame, pii.entities(frame), generalise=0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {"kind:email:", "part:email:one.org"} <= {e for e, _ in want}
    spans = [s for r in pii.find_personal_data(frame, generalise=0.5).collect() for s in r.spans if s.kind in ("general", "term")]
    assert {"contact", "rare"} <= {s.value for s in spans}


def test_base_findings(spark):
    value = "a@b.c_d@e.f 4111 1111 1111 1111, +1 (202) 555-0100; 1.2.3.256 010.0.0.255 " + "9" * 25 + "é+44 20 7946 0958"
    row = pii.span_digests(spark.createDataFrame([(1, value)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 1, 1, 2)


def test_html_layouts_and_edges(spark):
    field = html.train()
    wrong = sum(field.decode(b) != labels for b, labels in map(html.labels_of, html.labelled_pages()))
    assert wrong == 0
    page = (
        "<html><body><div class='top-menu'><a href=/>Home</a></div><div class='story'><h1>A &amp; B</h1><p>First  line,\n of it, is long enough.<br>More."
        "<p>Second&nbsp;one.</div><section id=comments><p>I agree with all of that, sir.</p></section><footer>&copy; me</footer><script>x='<p>no'"
    )
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", page, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(frame, field).collect()}
    assert got[1] == "A & B\nFirst line, of it, is long enough. More.\nSecond one." == got[None]
    assert got[2] == got[3] == ""


def test_only_raw_text_is_skipped():
    texts = lambda page: [b[1] for b in html.leaf_blocks(page)]
    assert texts("<svg class='icon'/><p>One</p><svg><g><path d='M0'/></g></svg><p>Two") == ["One", "Two"]
    assert texts("<svg class=a><path d='M0'><p>One</p><p>Two</p>") == ["One", "Two"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <math/>given.</p>") == ["Let x=1 be given."]
    assert texts("<p>A<svg><style>.a{}</style><title>Icon</title><script/><title>Lost</svg> b</p>") == ["ALost b"]
    assert texts("<p>A</p><object data=f><param name=n><p>Fallback</p><p>B</p>") == ["A", "Fallback", "B"]
    assert texts("<noscript>No script</noscript><select><option>x<option>y</select><template><p>t</template>") == ["No script", "x", "y", "t"]
    assert texts("<svg><foreignObject><div>In</div></foreignObject><text>out</text></svg><p>C") == ["In", "out", "C"]
    assert texts("<title>T</title><script>a='<p>'</script><p>A</p><textarea>x</textarea><p>B</p><script>c") == ["A", "B"]
    field = html.train()
    body = "<p>The first of some sentences, which is long enough for a page.</p><p>The second of them, and not the last one.</p>"
    plain = html.main_text(field, f"<body><header><a href=/>Home</a></header><article>{body}</article></body>")
    assert plain.count("\n") == 1
    chosen = "<noscript>Scripts are off.</noscript><header><select><option>Français<option>Español</select></header>"
    assert html.main_text(field, f"<body>{chosen}<header><a href=/>Home</a></header><article>{body}</article></body>") == plain
    assert html.main_text(field, f"<body><header><svg class='icon'/><a href=/>Home</a></header><article>{body}</article></body>") == plain


def test_licences(spark):
    mit = licences.TEMPLATES[4][1]
    rows = [
        (1, "text here\nlicensed under the apache licence, version 2.0\nLicensed under the Apache License, version 2.0!"),
        (2, mit.replace(", to any", "\nto any").replace("The above", "\nThe above")), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (6, LONG),
    ]
    got = {r.doc_id: (r.licences, r.matches) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("Apache-2.0", "2:2:Apache-2.0") and got[2] == ("MIT", "0:2:MIT") and got[5][0] == "CC-BY-NC-4.0"
    assert got[3] == got[4] == got[6] == ("", "")


def test_licences_wherever_lines_end():
    scanner = licences.Scanner()
    found = lambda t: [m[:3] for m in scanner.scan(t)]
    prose = "We thank all who sent us notes on this and on other things. "
    apache, cc = licences.TEMPLATES[0][1], licences.TEMPLATES[-1 - len(list(licences.TEXTS.glob("*.txt")))][1]
    assert found(f"{prose}{apache}. {prose}") == [(0, 0, "Apache-2.0")]
    assert found(f"{prose}\n{prose}{cc} {prose}{apache}, {prose}") == [(1, 1, "CC-BY-NC-4.0"), (1, 1, "Apache-2.0")]
    mit = licences.TEMPLATES[4][1].replace(", to any", "\nto any")
    bsd = licences.TEMPLATES[12][1].replace("binary", "\nbinary")
    assert found(f"{mit}\n{bsd}\n{prose}") == [(0, 1, "MIT"), (2, 3, "BSD")]
    assert found(f"{apache}\n{apache} {apache}") == [(0, 0, "Apache-2.0"), (1, 1, "Apache-2.0"), (1, 1, "Apache-2.0")]
    for path in sorted(licences.TEXTS.glob("*.txt")):
        whole = path.read_text()
        (one,) = scanner.scan(prose + " ".join(whole.split()) + " " + prose)
        assert one[2] == path.stem and one[3] > 0.99
    assert found(None) == found("") == found("one") == found(prose * 50) == []


def test_kneser_ney_is_a_distribution(spark, docs, labels):
    model = quality.train(spark.createDataFrame([(1, "abracadabra abra")], "doc_id long, text string"), 3).collect()
    table = {}
    for k in (1, 2, 3):
        for kind in "pg":
            rows = sorted((r.code, r.value) for r in model if (r.k, r.kind) == (k, kind))
            table[k, kind] = np.array([c for c, _ in rows], np.int64), np.array([v for _, v in rows])
    for context in (b"ab", b"zz", b"ra"):
        code = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)])
        assert abs(quality.probability(table, code, 3).sum() - 1) < 1e-9


def test_quality_edges(docs, labels):
    one = {(r.doc_id, r.text): r for r in quality.classify(docs, labels).collect()}
    assert not one[4, None].accepted and not one[5, ""].accepted
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_shards_add_up(spark, docs, monkeypatch):
    model = quality.train(docs.filter("doc_id < 3"), 3)
    whole = {r.text: r.p for r in quality.perplexity(docs, model, 3, out="p").collect()}
    monkeypatch.setattr(quality, "SHARD_ROWS", 300)
    for r in quality.perplexity(docs, model, 3, out="p").collect():
        assert (r.p is None) == (whole[r.text] is None) and (r.p is None or abs(r.p - whole[r.text]) < 1e-9)


def test_toxicity_learns_and_edges(spark, docs, labels):
    rows = [(i, text(i, 60) + (" vile rotten" if i % 4 == 0 else "") + " " + text(i + 9000, 60), "en") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, marks).filter("held_out").collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert right / len(got) > 0.95
    assert {r.held_out for r in toxicity.toxicity(docs, labels).filter("doc_id is null").collect()} == {False}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_top_k_of_empty_huge_and_mixed_vectors(spark):
    rows = [(0, []), (1, []), (2, [1e30, 0.0]), (100, [1.0, 2.0]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (5, [2.0**15, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors).collect()]
    kib = 1024
    assert sorted(got) == [
        (0, 1, 1, 0), (100, 1, 5, kib * kib * (2**15 + 2)), (100, 2, 3, kib * 512 * 3), (100, 3, 4, -kib * kib),
    ]


def test_quality_counts_a_part_in_the_same_pass(spark):
    texts = [("abcab", True), ("abd", False), (None, True), ("", None), ("bcbc" * 50, False)]
    docs = spark.createDataFrame(texts, "text string, seen boolean").repartition(3)
    got = {r.code: (r.c, r.c_part) for r in quality.count_grams(docs, 2, part="seen").collect()}
    want = {}
    for t, seen in texts:
        raw = b"\0" + (t or "").encode()
        for i in range(len(raw) - 1):
            c, p = want.get(raw[i] << 8 | raw[i + 1], (0, 0))
            want[raw[i] << 8 | raw[i + 1]] = (c + 1, p + bool(seen))
    assert got == want


def test_encoding_holds_few_texts_at_once(spark, monkeypatch):
    """A worker's lists of ids stay small however many texts reach it in one batch."""
    sizes = []

    class Coder:
        def encode(self, texts):
            sizes.append(sum(map(len, texts)))
            return [[0]] * len(texts)

    made = []
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(bpe, "codec_of", lambda *vocabulary: Coder())
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, work, schema: made.append(work))
    bpe.encode_bpe(frame, {b"a": 0}, "a")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["a" * 100_000] * 40})
    assert sum(b.num_rows for b in made[0](iter([batch]))) == 40
    assert sum(sizes) == 4_000_000 and max(sizes) <= 1 << 20
