import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from papersieve.functions import text as tx
from papersieve.functions.vectors import jaccard
from papersieve.operators import embedding


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    (None, ""),
    ("Mail me@x.org now", "mail now"),
    ("see http://a.b/c?d and doi:10.1/x.", "see and"),
    ("as shown [12] in Fig 3, Table 4", "as shown in 3 4"),
    ("éfig fig", "fig"),
    ("MIT and Google-DeepMind labs", "and labs"),
    ("summit my_ai", "summit my_ai"),
    ("a[SEP]b \tc", "a sep b c"),
])
def test_academic_cleaning(spark, raw, want):
    assert one(spark, raw, tx.clean_academic_text) == want


def test_tokens(spark):
    assert one(spark, "Don't x2 Été!", tx.tokenize_alpha) == ["don", "t", "x", "t"]
    assert one(spark, "12 !", tx.tokenize_alpha) == []
    assert one(spark, " a  b c\n", tx.tokenize_space) == ["a", "b", "c"]
    assert one(spark, "A b2 Été_x c", tx.tokenize_words) == ["b2", "été_x"]


@pytest.mark.parametrize("text, want", [
    ("aa bb cc", ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]), ("aa", ["aa"]), ("", []),
])
def test_ngrams_stay_in_order(spark, text, want):
    assert one(spark, text, lambda c: tx.ngrams(tx.tokenize_words(c), 1, 3)) == want


def test_strip_and_length_bounds(spark):
    assert one(spark, "  a b \n", tx.strip) == "a b"
    assert one(spark, "x" * 50, lambda c: tx.long_enough(c)) is True
    assert one(spark, "x" * 50, lambda c: tx.long_enough(c, inclusive=False)) is False


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


def expected_vector(tokens, df, n, dim):
    v = np.zeros(dim)
    for t in set(tokens):
        h = hashlib.md5(t.encode()).hexdigest()
        sign = -1 if int(h[8], 16) % 2 else 1
        v[int(h[:8], 16) % dim] += sign * tokens.count(t) * math.log((n + 1) / (df.get(t, 0) + 1))
    return v / (np.linalg.norm(v) or 1)


def test_hashed_embedding_by_hand(spark):
    texts = ["aa bb aa", "bb cc", "", "aa dd ee"] + ["aa"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "paper_id int, text string")
    df = {t: sum(t in x.split() for x in texts) for t in ("aa", "bb", "cc", "dd", "ee")}
    got = {r.paper_id: r.embedding for r in embedding.embed_documents(docs, dim=16).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        np.testing.assert_allclose(got[i], expected_vector(text.split(), df, len(texts), 16), atol=1e-6)
    extra = spark.createDataFrame([("q", "cc zz")], "name string, text string")
    row = embedding.embed_texts(
        extra, embedding.document_frequencies(docs), docs.agg(F.count("*").alias("n")), "name", dim=16
    ).first()
    np.testing.assert_allclose(row.embedding, expected_vector(["cc", "zz"], df, len(texts), 16), atol=1e-6)


def test_user_model_runs_in_batches(spark):
    def load():
        return lambda texts: np.array([[len(t)] for t in texts.ravel()], dtype="float32")

    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 30)], "paper_id int, text string")
    got = {r.paper_id: r.embedding for r in embedding.embed_with(docs, load).collect()}
    assert got == {i: [float(i)] for i in range(1, 30)}


def test_projection_finds_the_line(spark):
    docs = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(20)], "paper_id int, embedding array<float>")
    rows = embedding.reduce_dims(docs, k=1).collect()
    assert all(abs(r.reduced[0]) == pytest.approx(r.paper_id * math.sqrt(5), abs=1e-6) for r in rows)


@pytest.mark.parametrize("hot", [1, 3, 200])
def test_embedding_is_the_same_for_any_number_of_hot_tokens(spark, hot):
    rows = [(i, " ".join(f"w{j}" for j in range(60) if (i * j) % 7 < 2)) for i in range(40)] + [(90, ""), (91, None), (92, "w1 w1 w1")]
    docs = spark.createDataFrame(rows, "paper_id long, text string").repartition(3)
    plain = {r.paper_id: r.embedding for r in embedding.embed_documents(docs, dim=16).collect()}
    got = {r.paper_id: r.embedding for r in embedding.embed_documents(docs, dim=16, hot_tokens=hot).collect()}
    assert got.keys() == plain.keys() and len(got) == len(rows)
    assert all(np.allclose(got[i], plain[i], atol=1e-6) for i in got)
    assert not any(plain[90]) and not any(plain[91]) and np.isclose(np.linalg.norm(plain[92]), 1)
    want = np.zeros(16)
    for token in (rows[7][1] or "").split():
        digest = hashlib.md5(token.encode()).hexdigest()
        n = sum(token in set((x or "").split()) for _, x in rows)
        want[int(digest[:8], 16) % 16] += (-1 if digest[8] in "13579bdf" else 1) * np.log((len(rows) + 1) / (n + 1))
    assert np.allclose(plain[7], want / np.linalg.norm(want), atol=1e-6)


def test_embedding_of_no_documents(spark):
    docs = spark.createDataFrame([], "paper_id long, text string")
    assert embedding.embed_documents(docs, dim=16).count() == 0


def test_cleaning_takes_words_out_instead_of_replacing_what_is_between(spark):
    """Same text as by replacement, whatever stands between, before and after the words."""
    texts = ["", " ", "...", "\u3000a--b\n\tc!", "edu", "x edu.cn, y_edu edu", "\u00e9t\u00e9 na\u00efve", "fig 1: [2] b_c", "a" * 50 + "\u4e2d" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.lower("text")
    for pattern in (r"(?U)(?<!\S)\S+@\S+", r"(?U)http\S+|doi:\S+", r"(?U)\[\d+\]", r"(?U)\b(?:" + "|".join(tx.LAYOUT_WORDS) + r")\b",
                    r"[^a-z0-9_]+", r"\b(?:" + "|".join(tx.DOMAIN_WORDS) + r")\b", " {2,}"):
        c = F.regexp_replace(c, pattern, " ")
    cleaned = df.select(tx.clean_academic_text(F.col("text")).alias("got"), F.trim(c).alias("want"))
    assert all(r.got == r.want for r in cleaned.collect())
    assert "regexp_extract_all" in cleaned.select("got")._jdf.queryExecution().analyzed().toString().lower()


def test_ngrams_make_their_tokens_once(spark):
    """tokens were made nine times for n-grams of one to three words."""
    df = spark.createDataFrame([("a b c",), ("d",), ("",), (None,)], "text string")
    grams = df.select(tx.ngrams(tx.tokenize_space(F.col("text")), 1, 3).alias("g"))
    assert [r.g for r in grams.collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["d"], [], None]
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_documents_with_topics_are_dealt_anew(spark, sf_dir):
    """documents that have a vector may lie in a few files, whose tasks did all the work."""
    plan = fixtures.topic_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("RepartitionByExpression [xxhash64(")
