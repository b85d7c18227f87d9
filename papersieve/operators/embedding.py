"""Document vectors: hashed TF-IDF, user model inference, anchors, projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from papersieve.functions.text import remove_words, tokenize_words
from papersieve.functions.vectors import as_double, l2_normalize, norm
from papersieve.session import store, with_computed

DIMENSIONS = 256
#: Tokens whose weights every task holds, and documents whose sums it holds at a time.
HOT_TOKENS, ROWS = 200_000, 2048


def _tokens(text: str, stop_words: Sequence[str]) -> Column:
    return remove_words(tokenize_words(F.coalesce(F.col(text), F.lit(""))), stop_words)


def token_frequencies(docs: DataFrame, id_col: str = "paper_id", text: str = "text",
                      stop_words: Sequence[str] = ()) -> DataFrame:
    """``(id, token, tf)``; a document without tokens keeps one row with a NULL token."""
    return (
        docs.select(id_col, F.explode_outer(_tokens(text, stop_words)).alias("token"))
        .groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    )


def document_frequencies(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """``(token, df)``, the corpus vocabulary. Only partial counts per token are shuffled."""
    return (
        docs.select(F.explode(F.array_distinct(_tokens(text, stop_words))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("df"))
    )


def _cell(token: Column, df: Column, n_docs: Column, dim: int) -> Column:
    """Bucket and signed idf of a token: md5 digits 1-8 modulo ``dim``, sign by the parity of digit 9."""
    digest = F.md5(token)
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.substring(digest, 9, 1).isin(*"13579bdf"), -1.0).otherwise(1.0)
    return F.struct(bucket.alias("bucket"), (sign * F.log((n_docs + 1) / (df + 1))).alias("weight"))


def _vectors(cells: DataFrame, id_col: str, dim: int) -> DataFrame:
    """``(id, tf, _cell)`` to ``(id, embedding)``. One shuffle by id serves both aggregates."""
    summed = (
        cells.select(id_col, F.col("_cell.bucket").alias("_bucket"), (F.col("tf") * F.col("_cell.weight")).alias("_w"))
        .repartition(id_col)
        .groupBy(id_col).pivot("_bucket", list(range(dim))).agg(F.sum("_w"))
    )
    # the wide array is computed once, not again for its length and each use of it
    dense = F.array(*[F.coalesce(F.col(str(i)), F.lit(0.0)) for i in range(dim)])
    raw = with_computed(summed, "_raw", dense).select(id_col, "_raw")
    return with_computed(raw, "_length", norm(F.col("_raw"))).select(
        id_col, l2_normalize(F.col("_raw"), F.col("_length")).cast("array<float>").alias("embedding")
    )


def _of_rows(lists: pa.Array) -> np.ndarray:
    """The row of each item of the lists."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _row_sums(tokens: pa.Array, known: pa.Array, bucket: np.ndarray, weight: np.ndarray, dim: int) -> np.ndarray:
    """Each row's weights of known tokens summed by bucket [rows, dim]."""
    at = pc.index_in(tokens.flatten(), value_set=known)
    found = pc.is_valid(at).to_numpy(zero_copy_only=False)
    index = at.drop_null().to_numpy()
    sums = np.bincount(_of_rows(tokens)[found] * dim + bucket[index], weights=weight[index], minlength=len(tokens) * dim)
    return sums.astype(float, copy=False).reshape(len(tokens), dim)  # without any known token the counts are whole numbers


def _unit_lists(sums: np.ndarray) -> pa.Array:
    """Rows of unit length as lists of floats; a zero row stays zero."""
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    flat = (sums / np.where(length > 0, length, 1.0)).astype(np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(flat, pa.float32()))


def embed_documents(docs: DataFrame, id_col: str = "paper_id", text: str = "text", dim: int = DIMENSIONS,
                    stop_words: Sequence[str] = (), corpus_df: DataFrame | None = None, hot_tokens: int = HOT_TOKENS,
                    keep: Sequence[str] = ()) -> DataFrame:
    """T4: ``(id, *keep, embedding)`` of every row, signed hashed TF-IDF of the whole text, unit length.

    A token's weight is tf * ln((N + 1) / (df + 1)); a text without tokens is the zero vector. Hashing
    is done once per vocabulary entry. Weights add up over occurrences, so the most frequent tokens, a
    broadcast of ``hot_tokens`` at most that leaves out what ties with one beyond, are summed by bucket in
    the task that reads the text; with a vocabulary no larger than that nothing is shuffled. The occurrences
    of rarer tokens meet the rest of the vocabulary in one join and are summed by (id, bucket). These few
    cells are stored and meet the texts, which a sum of ``dim`` doubles a row would often outweigh. The
    vocabulary is read several times and so is stored first; ``corpus_df`` may pass one that is stored
    already. The columns of ``keep`` go along, which spares a join of the texts with their vectors.
    """
    if corpus_df is None:
        corpus_df = store(document_frequencies(docs, text, stop_words))
    vocabulary = corpus_df.filter("token is not null").withColumn("_n", F.lit(docs.count())).withColumn(
        "_cell", _cell(F.col("token"), F.col("df"), F.col("_n"), dim)
    ).select("token", "df", F.col("_cell.bucket").alias("bucket"), F.col("_cell.weight").alias("weight"))
    # a row per frequency; no task gathers the tokens themselves
    steps = corpus_df.filter("token is not null").groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).limit(hot_tokens + 1).toArrow()
    fits = int((np.cumsum(steps.column("n").to_numpy()) <= hot_tokens).sum())
    least = steps.column("df")[fits - 1].as_py() if fits else None
    hot = vocabulary.filter(F.col("df") >= least if fits else F.lit(False)).toArrow()
    known = hot.column("token").combine_chunks().cast(pa.string())
    bucket, weight = (hot.column(c).to_numpy() for c in ("bucket", "weight"))
    kept = [id_col, *keep]
    read = list(dict.fromkeys([*kept, text]))
    tokens = _tokens(text, stop_words).alias("_tokens")

    def whole(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                found = _row_sums(piece.column("_tokens"), known, bucket, weight, dim)
                if "_more" in piece.schema.names:
                    more = piece.column("_more")
                    cells = more.flatten()
                    np.add.at(found, (_of_rows(more), cells.field("bucket").to_numpy()), cells.field("w").to_numpy())
                yield pa.RecordBatch.from_arrays([*map(piece.column, kept), _unit_lists(found)], [*kept, "embedding"])

    schema = StructType([*(docs.schema[c] for c in kept), StructField("embedding", ArrayType(FloatType()))])
    if fits == steps.num_rows:
        return docs.select(*kept, tokens).mapInArrow(whole, schema)

    def rare(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, lists = batch.slice(start, ROWS).columns
                flat = lists.flatten()
                rest = pc.is_null(pc.index_in(flat, value_set=known))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(_of_rows(lists)).filter(rest)), flat.filter(rest)], [id_col, "token"])

    rest = docs.select(id_col, tokens).mapInArrow(rare, StructType([docs.schema[id_col], StructField("token", StringType())]))
    rarer = vocabulary.filter(F.col("df") < least) if fits else vocabulary
    cells = store(
        rest.join(rarer, "token")
        .groupBy(id_col, "bucket").agg(F.sum("weight").alias("w"))
        .groupBy(id_col).agg(F.collect_list(F.struct("bucket", "w")).alias("_more"))  # at most dim
    )
    # hashed on the side of the cells: the texts are not sorted
    met = docs.select(*read).join(cells.hint("shuffle_hash"), id_col, "left")
    return met.select(*kept, tokens, "_more").mapInArrow(whole, schema)


def embed_texts(texts: DataFrame, corpus_df: DataFrame, n_docs: DataFrame, id_col: str, text: str = "text",
                dim: int = DIMENSIONS, stop_words: Sequence[str] = ()) -> DataFrame:
    """A few texts (anchors, candidate words) in the space of a corpus, ``(id, embedding)``.

    ``corpus_df(token, df)`` is cut to the tokens of these texts before the join; a token the corpus
    does not know has df 0.
    """
    counts = token_frequencies(texts, id_col, text, stop_words)
    known = corpus_df.join(counts.select("token").distinct(), "token", "left_semi")
    df = F.coalesce(F.col("df"), F.lit(0))
    cells = counts.join(known, "token", "left").withColumn("_n", n_docs.scalar()).withColumn(
        "_cell", F.when(F.col("token").isNotNull(), _cell(F.col("token"), df, F.col("_n"), dim))
    )
    return _vectors(cells, id_col, dim)


def embed_with(docs: DataFrame, make_predict_fn: Callable, text: str = "text", batch_size: int = 8) -> DataFrame:
    """T5: add ``embedding`` from a user model run on Arrow batches inside the tasks.

    ``make_predict_fn()`` is called once per Python worker, loads the model, and returns a function
    from a batch of texts to a 2-D array of floats.
    """
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return docs.withColumn("embedding", encode(F.col(text)))


def reduce_dims(df: DataFrame, k: int = 5, vector: str = "embedding", output: str = "reduced") -> DataFrame:
    """Projection on the first k principal components; only a dims x dims matrix leaves the tasks."""
    prepared = df.withColumn("_features", array_to_vector(as_double(F.col(vector))))
    model = PCA(k=k, inputCol="_features", outputCol="_reduced").fit(prepared.select("_features"))
    return (
        model.transform(prepared)
        .withColumn(output, vector_to_array("_reduced"))
        .drop("_features", "_reduced")
    )
