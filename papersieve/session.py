"""Session helpers: checkpoint folder, materialised intermediates, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_BROADCAST_ROWS = 200_000
#: Of Spark 4.1 and later; others ignore it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster the setting is required, because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured or current:
        return configured or current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="papersieve-")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, for loops and for whole texts.

    A checkpoint keeps the size that was estimated for its plan, and a join's estimate is the product
    of both sides: over the rounds of a loop that number, and the time to plan with it, grows without
    bound. A table's estimate is the size of its files. Those are compressed, which checkpoints are not.

    What the write shuffled goes with it: nothing reads it again, as a write has a plan of its own, and
    else it stays on the executors' disks until the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly expression that a later filter reads.

    The optimizer copies a plain column's expression into a filter pushed below it and so evaluates
    it twice; a generated column stays where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.inline(F.array(F.struct(value.alias(name)))))


def join_by_skewed_key(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    value: str,
    rows_per_key: str,
    spread_by: str,
    hot_share: int = 4096,
) -> DataFrame:
    """Left-join ``lookup(key, value, rows_per_key)`` to ``big`` without piling a hot key on one task.

    ``rows_per_key`` tells how many rows of ``big`` carry the key. A key is hot when it holds more
    than 1/hot_share of all of them, so fewer than ``hot_share`` keys can be hot and that part of the
    lookup is safe to broadcast. Rows with a hot (or NULL) key skip the shuffle key and are spread
    by ``spread_by``; all other keys are light and meet their value in an ordinary shuffle join.
    A frequent key that ``lookup`` lacks would be taken for a light one: list it with a NULL ``value``
    and its count, and its rows are spread as well.
    """
    total = lookup.agg(F.sum(rows_per_key).alias("total"))
    marked = lookup.withColumn("_hot", F.col(rows_per_key) * hot_share > total.scalar())
    hot = marked.filter("_hot").select(F.col(key), F.struct(F.col(value).alias("v")).alias("_hot_value"))
    light = marked.filter("not _hot").select(
        F.concat(F.lit("k:"), F.col(key).cast("string")).alias("_join_key"),
        F.col(value).alias("_light_value"),
    )
    joined = big.join(F.broadcast(hot), key, "left").withColumn(
        "_join_key",
        F.when(
            F.col("_hot_value").isNull() & F.col(key).isNotNull(),
            F.concat(F.lit("k:"), F.col(key).cast("string")),
        ).otherwise(F.concat(F.lit("s:"), F.pmod(F.xxhash64(spread_by), F.lit(65536)).cast("string"))),
    )
    return (
        joined.join(light, "_join_key", "left")
        .withColumn(value, F.coalesce("_hot_value.v", "_light_value"))
        .drop("_join_key", "_hot_value", "_light_value")
    )


def join_salted(big: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 32) -> DataFrame:
    """Inner join where one key may hold a large part of ``big``: its rows spread over ``salts`` tasks."""
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
        .join(
            small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
            [key, "_salt"],
        )
        .drop("_salt")
    )


def join_small(big: DataFrame, small: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join of a derived dimension: broadcast where its counted size allows, else salted."""
    stored = materialize(small)
    if stored.count() <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(stored), key)
    return join_salted(big, stored, key, spread_by)


def as_threshold(value: float | DataFrame) -> Column:
    """A number, or the single cell of a one-row DataFrame, as a column."""
    return value.scalar() if isinstance(value, DataFrame) else F.lit(float(value))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys as one batch, inside ``mapInArrow``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != value[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
