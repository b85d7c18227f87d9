"""Result sinks: tables, rejected records, multi-table reports, metrics, matrices.

Excel workbooks have no Spark writer; every table becomes a dataset in a columnar or text format.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """One result as one dataset, replacing what was there. CSV gets a header and no index."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_removed(annotated: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Removed records, one folder per reason; nothing is written when none was removed."""
    gone = annotated.filter(F.col("removal_reason").isNotNull())
    if gone.isEmpty():
        return False
    write_table(gone, path, fmt, partition_by=["removal_reason"])
    return True


def write_yearly(df: DataFrame, base: str, year: str = "pub_year", fmt: str = "parquet") -> None:
    """One folder ``base/<year>`` per year, the layout ``read_yearly`` expects; NULL years are left out.

    One job partitions the rows by year; the folders are then renamed, which moves no data.
    """
    dated = df.filter(F.col(year).isNotNull()).withColumn("_folder", F.col(year).cast("string")).drop(year)
    write_table(dated, base, fmt, partition_by=["_folder"])
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(base)):
        name = status.getPath().getName()
        if name.startswith("_folder="):
            fs.rename(status.getPath(), path(f"{base}/{name.removeprefix('_folder=')}"))


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Several named tables under one report folder."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small metric frame as JSON lines in one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def matrix(cells: DataFrame, topics: Sequence[int] | None = None) -> DataFrame:
    """``(topic_i, topic_j, value)`` as a square matrix; missing cells are 0.

    Without ``topics`` Spark first finds the column labels, one small job over the cells.
    """
    wide = (
        cells.groupBy(F.col("topic_i").alias("topic"))
        .pivot("topic_j", None if topics is None else list(topics))
        .agg(F.first("value"))
    )
    return wide.fillna(0.0, subset=[c for c in wide.columns if c != "topic"])
