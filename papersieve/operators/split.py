"""Stratified hold-out split (H7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def stratified_split(df: DataFrame, id_col: str = "paper_id", label: str = "label",
                     fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: per label, exactly round(fraction * rows) rows, by rank of a seeded hash.

    A label is never sorted as a whole. Rows fall into 65,536 hash buckets; running bucket totals
    decide every bucket but the one that straddles the cut, and only that one is ranked. Rows without a
    label are a class of their own; no row is lost.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    hashed = df.withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, 4))
    sizes = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_bucket")
    # 65,536 buckets per label at most, whatever the table holds
    plan = sizes.select(
        label, "_bucket", "_n",
        F.sum("_n").over(upto).alias("_end"),
        F.round(F.sum("_n").over(Window.partitionBy(label)) * fraction).cast("bigint").alias("_take"),
    ).select(
        label, "_bucket", "_take",
        (F.col("_end") - F.col("_n")).alias("_start"),
        ((F.col("_end") > F.col("_take")) & (F.col("_end") - F.col("_n") < F.col("_take"))).alias("_split"),
    )
    plan = plan.withColumnsRenamed({label: "_label", "_bucket": "_plan_bucket"})
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_plan_bucket"))
    placed = hashed.join(plan, same).drop("_label", "_plan_bucket")  # Spark broadcasts it if it is small
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash", id_col)
    whole = placed.filter("not _split").withColumn("is_validation", F.col("_start") < F.col("_take"))
    straddling = placed.filter("_split").withColumn(
        "is_validation", F.col("_start") + F.row_number().over(in_bucket) <= F.col("_take")
    )
    return whole.unionByName(straddling).drop("_hash", "_bucket", "_take", "_start", "_split")
