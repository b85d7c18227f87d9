"""Paper tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from papersieve.session import materialize

# Column headers of a bibliographic export and their names here.
HEADERS = {
    "UT": "ut",
    "Article Title": "title",
    "Abstract": "abstract",
    "Document Type": "doc_type",
    "Source Title": "source_title",
    "Publication Year": "pub_year",
    "is_computer": "label",
}


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def rename_headers(df: DataFrame, headers: Mapping[str, str] = HEADERS) -> DataFrame:
    """Known headers to their names, any other to snake case."""
    return df.select(*[F.col(f"`{c}`").alias(headers.get(c.strip(), snake_case(c))) for c in df.columns])


def read_papers(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv",
                columns: Sequence[str] | None = None, multi_line: bool = False,
                id_col: str | None = "paper_id") -> DataFrame:
    """A header-first table (csv, json, parquet, orc) with names in snake case.

    ``columns`` lists the file's headers and spares CSV and JSON the schema pass; text formats are read as
    strings and coerced later by rule. Abstracts with quoted line breaks need ``multi_line``, which reads
    a CSV file in one piece; without it large files are split.

    A table without ``id_col`` gets one, a LONG that grows with the row's place in its file; several files
    follow each other as Spark lists them, large ones first. The table is then stored, so that every
    later job sees the same ids. ``id_col=None`` adds none.
    """
    reader = spark.read.format(fmt)
    if columns is not None and fmt in ("csv", "json"):
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    df = rename_headers(reader.load(path))
    if id_col is None or id_col in df.columns:
        return df
    return materialize(df.withColumn(id_col, F.monotonically_increasing_id()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a table that arrives in fewer pieces than that, e.g. one small file.

    Larger tables have more pieces than cores and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_yearly(spark: SparkSession, base: str, fmt: str = "parquet", key: str = "text",
                stamp_year: bool = True, multi_line: bool = False) -> DataFrame:
    """S2+S3: all tables under ``base/<digits>/``, each row with the folder's year and a ``text`` column.

    ``year=<digits>`` folders are read too; other names are not, nor are folders without a file. Years
    may differ in their columns; a year without a column whose name contains ``key`` is skipped; no
    usable year at all is an error.
    """
    parts = []
    for year, path in _year_folders(spark, base):
        df = read_papers(spark, path, fmt, multi_line=multi_line, id_col=None)
        column = resolve_column(df, [key])
        if column is None:
            continue
        df = df.withColumn("text", F.coalesce(F.col(column).cast("string"), F.lit("")))
        parts.append(df.withColumn("pub_year", F.lit(year)) if stamp_year else df)
    if not parts:
        raise ValueError(f"no data loaded from {base}")
    return union_all(parts)


def _year_folders(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Names only, through the Hadoop file system, so any store works."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(root):
        path = status.getPath()
        year = path.getName().removeprefix("year=")
        if status.isDirectory() and year.isdigit() and any(
            not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(path)
        ):
            found.append((int(year), path.toString()))
    return sorted(found)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail before any job when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, keys: Sequence[str]) -> str | None:
    """The first column, in column order, whose name contains any key, whatever the case."""
    return next((c for c in df.columns if any(k.lower() in c.lower() for k in keys)), None)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables one below the other; columns missing in some are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
