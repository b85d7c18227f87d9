"""Topic evaluation: overlap, similarity, diversity, coherence, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from papersieve.functions.vectors import as_double, cosine, norm
from papersieve.operators.disciplines import mean_vectors
from papersieve.session import MAX_BROADCAST_ROWS, join_salted, materialize

EPSILON = 1e-12


def top_terms(words: DataFrame, top_n: int, topic: str = "topic", outlier: int | None = None) -> DataFrame:
    """Distinct ``(topic, term)`` of the first ``top_n`` ranks, optionally without the outlier topic."""
    chosen = words.filter(F.col("rank") <= top_n)
    if outlier is not None:
        chosen = chosen.filter(F.col(topic) != outlier)
    return chosen.select(F.col(topic).alias("topic"), "term").distinct()


def _shared_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left keys..., right keys..., jaccard)`` of topics with a common term, by an inverted index.

    Both sides hold ``(key, term, size)`` with at most a few terms per key, so a matched pair of keys
    is one cell of the result and appears once per common term. A term common to many topics is
    spread by salt.
    """
    shared = join_salted(left, right, "term", spread_by="_left")
    both = F.col("_shared")
    return (
        shared.groupBy("_left", "_right", "_left_size", "_right_size")
        .agg(F.count("*").alias("_shared"))
        .withColumn("value", both / (F.col("_left_size") + F.col("_right_size") - both))
    )


def _side(terms: DataFrame, key: str, side: str) -> DataFrame:
    size = F.count("*").over(Window.partitionBy(key))
    return terms.select(F.col(key).alias(f"_{side}"), "term", size.alias(f"_{side}_size"))


def topic_overlap(words: DataFrame, top_n: int = 10, topic: str = "topic") -> DataFrame:
    """M11+J5: Jaccard of the top words, ``(topic_i, topic_j, value)``, all ordered pairs that share a word.

    The diagonal is 1; pairs not listed are 0. ``sinks.matrix`` fills them in.
    """
    terms = top_terms(words, top_n, topic)
    return _shared_terms(_side(terms, "topic", "left"), _side(terms, "topic", "right")).select(
        F.col("_left").alias("topic_i"), F.col("_right").alias("topic_j"), "value"
    )


def topic_similarity(vectors: DataFrame, topic: str = "topic", vector: str = "embedding",
                     blocks: int = 8) -> DataFrame:
    """M9+M10+J6: cosine of topic centroids, ``(topic_i, topic_j, value)``, every ordered pair.

    The result is the topic x topic matrix itself. It is built in blocks x blocks tiles: each centroid
    is sent to the tiles of its row and of its column, and a tile is an equi-join on the tile's key.
    """
    v = as_double(F.col(vector))
    rows = mean_vectors(vectors, topic, vector).select(
        F.col(topic).alias("topic"), v.alias("_v"), norm(v).alias("_n"),
        F.pmod(F.xxhash64(topic), F.lit(blocks)).alias("_block"),
    )
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = rows.select(
        F.col("topic").alias("topic_i"), F.col("_v").alias("_vi"), F.col("_n").alias("_ni"),
        F.col("_block").alias("_bi"), others.alias("_bj"),
    )
    right = rows.select(
        F.col("topic").alias("topic_j"), F.col("_v").alias("_vj"), F.col("_n").alias("_nj"),
        F.col("_block").alias("_bj"), others.alias("_bi"),
    )
    return left.join(right, ["_bi", "_bj"]).select(
        "topic_i", "topic_j",
        cosine(F.col("_vi"), F.col("_vj"), F.col("_ni"), F.col("_nj")).alias("value"),
    )


def max_pair(matrix: DataFrame, decimals: int = 12) -> DataFrame:
    """M12+W9: ``(topic_i, topic_j, value)`` of the largest off-diagonal cell, first in row order on ties.

    One aggregate, no sort. Values equal to ``decimals`` places tie, so the two halves of a symmetric
    matrix do not differ by rounding noise. No row when the matrix has no off-diagonal cell.
    """
    rank = F.struct(
        F.round("value", decimals).alias("value"), (-F.col("topic_i")).alias("i"), (-F.col("topic_j")).alias("j")
    )
    return (
        matrix.filter("topic_i <> topic_j").agg(F.max(rank).alias("best"))
        .filter("best is not null")
        .select(
            (-F.col("best.i")).alias("topic_i"), (-F.col("best.j")).alias("topic_j"),
            F.col("best.value").alias("value"),
        )
    )


def topic_diversity(words: DataFrame, top_n: int = 10, topic: str = "topic", outlier: int = -1,
                    on_empty: float | None = None) -> DataFrame:
    """1 - mean Jaccard over unordered topic pairs, one row ``(diversity)``.

    Pairs without a common word add 0, so only their number is needed. With fewer than two topics
    the value is ``on_empty``.
    """
    terms = top_terms(words, top_n, topic, outlier)
    pairs = _shared_terms(_side(terms, "topic", "left"), _side(terms, "topic", "right"))
    overlap = pairs.filter("_left < _right").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    n = F.col("_topics")
    return terms.agg(F.count_distinct("topic").alias("_topics")).withColumn("_overlap", overlap.scalar()).select(
        F.when(n >= 2, 1 - F.col("_overlap") / (n * (n - 1) / 2))
        .otherwise(F.lit(on_empty).cast("double")).alias("diversity")
    )


def topic_count(docs: DataFrame, topic: str = "topic", outlier: int = -1) -> DataFrame:
    """Number of topics without the outlier topic, one row ``(n_topics)``."""
    return docs.filter(F.col(topic) != outlier).agg(F.count_distinct(topic).alias("n_topics"))


def dictionary_filter(docs: DataFrame, tokens: str = "tokens", no_below: int = 5, no_above: float = 0.5,
                      keep_n: int | None = None) -> DataFrame:
    """``(term, df)`` of tokens in at least ``no_below`` documents and at most that share of all.

    ``keep_n``, if given, keeps the most frequent, ties by term; by default no term is dropped. A
    null beside each document's terms counts the documents in the same pass, as their tokens may be
    costly to make.
    """
    own = F.coalesce(F.array_compact(F.array_distinct(tokens)), F.array().cast("array<string>"))
    counts = materialize(
        docs.select(F.explode(F.concat(own, F.array(F.lit(None).cast("string")))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df"))
    )
    n = counts.filter("term is null").select("df")
    kept = counts.filter("term is not null").filter((F.col("df") >= no_below) & (F.col("df") <= n.scalar() * no_above))
    return kept if keep_n is None else kept.orderBy(F.desc("df"), "term").limit(keep_n)


def _window_masks(docs: DataFrame, words: DataFrame, window: int, id_col: str, tokens: str,
                  small: bool) -> DataFrame:
    """``(topic, mask, n)``: number of sliding windows whose set of the topic's words is ``mask``.

    A topic has at most 62 words, one bit each. Within a document the set changes only where a
    window starts to see a word or stops seeing it, so each occurrence adds two cut points instead of
    ``window`` windows, and a stretch between cuts counts with its length. All rows of a group belong
    to one document. What leaves is one row per topic and distinct set.
    """
    bits = words.select("topic", "term", F.expr("shiftleft(1L, rank - 1)").alias("_bit"))
    placed = docs.select(id_col, F.size(tokens).alias("_n"), F.posexplode(tokens).alias("_pos", "term"))
    seen = placed.join(F.broadcast(bits), "term") if small else join_salted(
        placed, bits, "term", spread_by=id_col
    )
    last = F.greatest(F.col("_n") - window, F.lit(0))
    zero = F.lit(0).cast("bigint")

    def event(at: Column, bit: Column, cut: bool) -> Column:
        return F.struct(at.alias("_at"), bit.alias("_bit"), F.lit(cut).alias("_cut"))

    events = seen.select(id_col, "topic", last.alias("_last"), F.inline(F.array(
        event(F.col("_pos"), F.col("_bit"), False),
        event(F.greatest(F.col("_pos") - (window - 1), F.lit(0)), zero, True),
        event(F.least(F.col("_pos"), last) + 1, zero, True),
    )))
    in_doc = Window.partitionBy(id_col, "topic").orderBy("_at")
    stretches = (
        events.withColumn("mask", F.bit_or("_bit").over(in_doc.rangeBetween(0, window - 1)))
        .filter(F.col("_cut") & (F.col("_at") <= F.col("_last")))
        .withColumn("_len", F.coalesce(F.lead("_at").over(in_doc), F.col("_last") + 1) - F.col("_at"))
    )
    return (
        stretches.filter((F.col("mask") != 0) & (F.col("_len") > 0))
        .groupBy("topic", "mask").agg(F.sum("_len").alias("n"))
    )


def pair_npmi(docs: DataFrame, words: DataFrame, window: int, top_n: int, id_col: str = "paper_id",
              tokens: str = "tokens", topic: str = "topic", outlier: int = -1,
              dictionary: DataFrame | None = None) -> DataFrame:
    """``(topic, i, j, npmi)`` for all ordered pairs of a topic's words, i = j included.

    NPMI over boolean sliding windows; a document shorter than the window is one window. A word
    that never occurs has NPMI 0 with every word; words outside ``dictionary`` are left out.
    """
    if top_n > 62:
        raise ValueError("top_n must be at most 62")
    chosen = words.filter((F.col("rank") <= top_n) & (F.col(topic) != outlier)).select(
        F.col(topic).alias("topic"), F.col("rank").cast("int").alias("rank"), "term"
    )
    if dictionary is not None:
        chosen = chosen.join(dictionary.select("term"), "term", "left_semi").select("topic", "rank", "term")
    chosen = materialize(chosen)
    masks = _window_masks(docs, chosen, window, id_col, tokens, small=chosen.count() <= MAX_BROADCAST_ROWS)
    ranks = F.filter(
        F.sequence(F.lit(1), F.lit(top_n)), lambda r: F.getbit(F.col("mask"), r - 1) == 1
    )
    together = (
        masks.select("topic", "n", ranks.alias("_ranks"))
        .select("topic", "n", "_ranks", F.explode("_ranks").alias("i"))
        .select("topic", "n", "i", F.explode("_ranks").alias("j"))
        .groupBy("topic", "i", "j").agg(F.sum("n").alias("_both"))
    )
    alone = together.filter("i = j")
    total = docs.agg(F.sum(F.greatest(F.size(tokens) - (window - 1), F.lit(1))).cast("double").alias("n"))
    grid = chosen.select("topic", F.col("rank").alias("i")).join(
        chosen.select("topic", F.col("rank").alias("j")), "topic"
    )
    p_i, p_j, p_ij = F.col("_pi"), F.col("_pj"), F.coalesce(F.col("_pij"), F.lit(0.0))
    return (
        grid.join(together.select("topic", "i", "j", F.col("_both").alias("_cij")), ["topic", "i", "j"], "left")
        .join(alone.select("topic", "i", F.col("_both").alias("_ci")), ["topic", "i"], "left")
        .join(alone.select("topic", "j", F.col("_both").alias("_cj")), ["topic", "j"], "left")
        .withColumn("_total", total.scalar())
        .select(
            "topic", "i", "j", (F.col("_ci") / F.col("_total")).alias("_pi"),
            (F.col("_cj") / F.col("_total")).alias("_pj"), (F.col("_cij") / F.col("_total")).alias("_pij"),
        )
        .select(
            "topic", "i", "j",
            F.coalesce(
                F.log((p_ij + EPSILON) / (p_i * p_j)) / -F.log(p_ij + EPSILON), F.lit(0.0)
            ).alias("npmi"),
        )
    )


def npmi_per_topic(pairs: DataFrame) -> DataFrame:
    """M15 per topic: mean NPMI over pairs of different words."""
    return pairs.filter("i <> j").groupBy("topic").agg(F.avg("npmi").alias("coherence"))


def cv_per_topic(pairs: DataFrame) -> DataFrame:
    """M14 per topic: mean cosine between each word's NPMI vector and the sum of all of them.

    (Roeder, Both, Hinneburg 2015.) The groups hold at most ``top_n`` rows.
    """
    summed = F.sum("npmi").over(Window.partitionBy("topic", "j"))
    per_word = pairs.withColumn("_sum", summed).groupBy("topic", "i").agg(
        F.sum(F.col("npmi") * F.col("_sum")).alias("_dot"),
        F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))).alias("_own"),
        F.sqrt(F.sum(F.col("_sum") * F.col("_sum"))).alias("_all"),
    )
    close = F.coalesce(F.try_divide(F.col("_dot"), F.col("_own") * F.col("_all")), F.lit(0.0))
    return per_word.groupBy("topic").agg(F.avg(close).alias("coherence"))


def coherence_npmi(docs: DataFrame, words: DataFrame, top_n: int = 15, window: int = 10, **options) -> DataFrame:
    """Mean over topics, one row ``(c_npmi)``; NULL without a pair of words."""
    per_topic = npmi_per_topic(pair_npmi(docs, words, window, top_n, **options))
    return per_topic.agg(F.avg("coherence").alias("c_npmi"))


def coherence_cv(docs: DataFrame, words: DataFrame, top_n: int = 15, window: int = 110,
                 min_topics: int = 1, **options) -> DataFrame:
    """Mean over topics, one row ``(c_v)``; NULL below ``min_topics`` topics."""
    per_topic = cv_per_topic(pair_npmi(docs, words, window, top_n, **options))
    return per_topic.agg(F.when(F.count("*") >= min_topics, F.avg("coherence")).alias("c_v"))


def topic_stability(base: DataFrame, runs: DataFrame, n_runs: int = 3, top_n: int = 15,
                    topic: str = "topic", outlier: int = -1) -> DataFrame:
    """M17+J7: ``(topic, stability_jaccard)``, the mean over runs of the best match in each run.

    ``base(topic, rank, term)`` and ``runs(run, topic, rank, term)``. A run without a common word
    counts 0, and so does a run without topics.
    """
    base_terms = top_terms(base, top_n, topic, outlier)
    run_terms = (
        runs.filter((F.col("rank") <= top_n) & (F.col(topic) != outlier))
        .select(F.struct(F.col("run"), F.col(topic).alias("topic")).alias("_key"), "term").distinct()
    )
    matches = _shared_terms(_side(base_terms, "topic", "left"), _side(run_terms, "_key", "right"))
    best = matches.groupBy(F.col("_left").alias("topic"), F.col("_right.run").alias("_run")).agg(
        F.max("value").alias("_best")
    )
    total = best.groupBy("topic").agg(F.sum("_best").alias("_sum"))
    return base_terms.select("topic").distinct().join(total, "topic", "left").select(
        "topic", (F.coalesce(F.col("_sum"), F.lit(0.0)) / n_runs).alias("stability_jaccard")
    )


def evaluation_table(**metrics: DataFrame) -> DataFrame:
    """One-row, one-column frames as ``(metric, value)`` rows, in the order given."""
    first = next(iter(metrics.values()))
    row = first.sparkSession.range(1).select(
        *[frame.scalar().cast("double").alias(name) for name, frame in metrics.items()]
    )
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in metrics
    ])))
