"""Quality classifier: an interpolated modified Kneser-Ney model of the trusted text.

The n-grams are of bytes, so that the tables are bounded by the alphabet and not by the vocabulary.
Counting is an aggregation over all trusted documents; the continuation counts, the context sums and
the interpolated probabilities come from joins of the count tables by n-gram, context and suffix. For
scoring the tables are cut into shards by the byte that precedes the predicted one: all that the
probability of a position needs is in one shard. Each shard, of bounded size, is joined to all
documents in a step of its own, and the steps' log probabilities add up.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.bpe import _ddl
from papersieve.llm.common import blocks
from papersieve.session import materialize

ORDER = 5
#: Share of the trusted documents of a language that passes its threshold.
QUANTILE = 0.995
#: Table rows that one step broadcasts, and trusted ids that are broadcast rather than shuffled.
SHARD_ROWS, BROADCAST_IDS = 4_000_000, 1_000_000
#: Text of a counting task, and rows of a partition of the model's tables.
PARTITION_BYTES, TABLE_ROWS = 8 << 20, 500_000

#: Bytes of text worked on at once; the arrays of a block are some sixty times as large.
BLOCK = 512 << 10


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as whole numbers, first byte highest, and each text's number of bytes.

    ``order - 1`` zero bytes stand before every text.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    pad = bytes(order - 1)
    data = np.frombuffer(b"".join(pad + r for r in raw), np.uint8).astype(np.int64)
    lengths = np.array([len(r) for r in raw], np.int64)
    code = np.zeros(max(0, len(data) - order + 1), np.int64)
    for i in range(order):
        code = code << 8 | data[i : i + len(code)]
    first = np.cumsum(lengths + order - 1) - (lengths + order - 1)
    at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return code[at], lengths


def together(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with small partitions joined, without a shuffle, until they hold some PARTITION_BYTES of text.

    Every counting task sends nearly the whole table of n-grams on, so many small tasks would send it
    many times.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.coalesce(1 + size // PARTITION_BYTES)


def count_grams(docs: DataFrame, order: int = ORDER, text: str = "text", part: str | None = None) -> DataFrame:
    """(code, c, c_part): how often each n-gram occurs in ``docs``, and in its rows where ``part`` is true."""

    def count(batches):
        for block in blocks(batches, text, BLOCK):
            code, lengths = grams(block.column(text).to_pylist(), order)
            flags = np.array(block.column("part").to_pylist(), bool)
            distinct, where = np.unique(code, return_inverse=True)
            c = np.bincount(where, minlength=len(distinct))
            c_part = np.bincount(where[np.repeat(flags, lengths)], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (distinct, c, c_part)], ["code", "c", "c_part"])

    chosen = F.coalesce(F.col(part), F.lit(False)) if part else F.lit(False)
    rows = docs.select(F.col(text), chosen.alias("part"))
    return together(rows, text).mapInArrow(count, "code long, c long, c_part long").groupBy("code").agg(
        F.sum("c").alias("c"), F.sum("c_part").alias("c_part")
    )


def train(trusted: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """The model of all n-grams of ``trusted``; see ``train_counts``."""
    return train_counts(count_grams(trusted, order, text), order)


def train_counts(found: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of the counts (code, c) of the longest n-grams, as rows (k, kind, code, value).

    Kind p: probability of the n-gram's last byte after the others; kind g: what a context leaves to
    the next shorter one. Order 1 interpolates with the uniform distribution over 256 bytes. Tables are
    kept in partitions of some TABLE_ROWS rows.
    """
    longest = materialize(found.select("code", "c"))
    parts = 1 + longest.count() // TABLE_ROWS
    counts = {order: longest.coalesce(parts)}
    for k in range(order - 1, 0, -1):  # distinct bytes to the left
        suffix = F.col("code").bitwiseAND((1 << 8 * k) - 1)
        counts[k] = materialize(counts[k + 1].groupBy(suffix.alias("code")).agg(F.count("*").alias("c")).coalesce(parts))
    tables, lower = [], None
    for k in range(1, order + 1):
        table = counts[k].withColumn("context", F.shiftright("code", 8))
        n1, n2, n3, n4 = (float(x or 0) for x in table.agg(*(F.sum((F.col("c") == i).cast("long")) for i in range(1, 5))).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        discount = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d1, d2, d3 = (min(max(d, 0.05), i + 0.95) for i, d in enumerate(discount))
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        taken = F.least(taken, F.col("c").cast("double"))
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(taken) / F.sum("c")).alias("gamma"))
        joined = table.join(contexts, "context")
        if lower is None:
            shorter = F.lit(1.0 / 256)
        else:
            joined = joined.withColumn("suffix", F.col("code").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(
                lower.select(F.col("code").alias("suffix"), F.col("value").alias("shorter")), "suffix"
            )
            shorter = F.col("shorter")
        p = (F.col("c") - taken) / F.col("total") + F.col("gamma") * shorter
        lower = materialize(joined.select(F.lit(k).alias("k"), F.lit("p").alias("kind"), "code", p.alias("value")).coalesce(parts))
        left = contexts.coalesce(parts)
        tables += [lower, left.select(F.lit(k).alias("k"), F.lit("g").alias("kind"), F.col("context").alias("code"), F.col("gamma").alias("value"))]
    return reduce(DataFrame.union, tables)


def _value(table: dict, k: int, kind: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table.get((k, kind), (np.empty(0, np.int64), np.empty(0)))
    if not len(keys):
        return np.zeros(len(code), bool), np.zeros(len(code))
    slot = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    return keys[slot] == code, values[slot]


def probability(table: dict, code: np.ndarray, order: int) -> np.ndarray:
    """Interpolated probability of the last byte of each n-gram."""
    seen, p = _value(table, 1, "p", code & 0xFF)
    _, g = _value(table, 1, "g", np.zeros(len(code), np.int64))
    p = np.where(seen, p, np.where(g > 0, g, 1.0) / 256)
    for k in range(2, order + 1):
        here = code & ((1 << 8 * k) - 1)
        known, left = _value(table, k, "g", here >> 8)
        seen, full = _value(table, k, "p", here)
        p = np.where(seen, full, np.where(known, left * p, p))
    return p


def perplexity(docs: DataFrame, model: DataFrame, order: int = ORDER, text: str = "text", out: str = "perplexity") -> DataFrame:
    """``docs`` with the perplexity per byte of ``text`` in a new column; null for a null or empty text."""
    model = materialize(model)
    shards = min(256, 1 + model.count() // SHARD_ROWS)
    rows = docs.drop(out).withColumn(out, F.lit(0.0))
    before = F.when(F.col("kind") == "g", F.col("code")).otherwise(F.shiftright("code", 8)).bitwiseAND(0xFF) % shards

    def add(shard: int, rows: DataFrame) -> DataFrame:
        mine = model if shards == 1 else model.filter((F.col("k") == 1) | (before == shard))
        got = mine.toArrow()
        table = {}
        for k in range(1, order + 1):
            for kind in "pg":
                keep = (np.array(got["k"]) == k) & (np.array(got["kind"]) == kind)
                code, value = np.array(got["code"])[keep], np.array(got["value"])[keep]
                by = np.argsort(code)
                table[k, kind] = code[by], value[by]
        sent = rows.sparkSession.sparkContext.broadcast(table)

        def score(batches):
            for block in blocks(batches, text, BLOCK):
                code, lengths = grams(block.column(text).to_pylist(), order)
                distinct, where = np.unique(code, return_inverse=True)
                logp = np.log(probability(sent.value, distinct, order))
                logp[(distinct >> 8 & 0xFF) % shards != shard] = 0.0
                sums = np.concatenate([[0.0], np.cumsum(logp[where])])
                ends = np.cumsum(lengths)
                total = sums[ends] - sums[ends - lengths] + np.array(block.column(out))
                yield block.set_column(block.schema.get_field_index(out), out, pa.array(total))

        return rows.mapInArrow(score, _ddl(rows))

    for shard in range(shards):
        rows = add(shard, rows)
    size = F.octet_length(F.col(text))
    return rows.withColumn(out, F.when(size > 0, F.exp(-F.col(out) / size)))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``labels`` (doc_id, quality) mark as good."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """``docs`` with perplexity, threshold and accepted.

    The model is trained on every row that is labelled good. Trained rows look better than others, so
    thresholds come from rows the model has not seen: one half of the trusted rows (by a hash of the
    id) trains a second model, and a language's threshold is the quantile of the other half's
    perplexities under it. A language without any, or none (null), takes that of all trusted
    rows. A text is accepted up to its threshold; a null or empty text is not; without any trusted text
    every other text is. Equal rows are judged alike, an empty table stays empty. Of further columns
    only perplexity, threshold and accepted are replaced.
    """
    docs = docs.drop("threshold", "accepted")
    trusted = trusted_rows(docs.select("doc_id", "lang", "text"), labels)
    unseen = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1
    counts = materialize(count_grams(trusted.withColumn("seen", ~unseen), order, part="seen"))
    scored = perplexity(docs, train_counts(counts, order), order)
    half = train_counts(counts.filter("c_part > 0").select("code", F.col("c_part").alias("c")), order)
    good = materialize(
        perplexity(trusted.filter(unseen), half, order).filter("perplexity is not null").select("lang", "perplexity")
    )
    by_lang = good.groupBy("lang").agg(F.percentile("perplexity", quantile).alias("own")).filter("lang is not null")
    overall = good.agg(F.percentile("perplexity", quantile).alias("all")).first()["all"]
    languages = [(r["lang"], r["own"]) for r in by_lang.collect()]  # one row a language
    threshold = F.lit(overall).cast("double")
    if languages:
        table = F.create_map(*(F.lit(x) for pair in languages for x in pair))
        threshold = F.coalesce(F.try_element_at(table, F.col("lang")), threshold)
    return scored.withColumn("threshold", threshold).withColumn(
        "accepted", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    )
