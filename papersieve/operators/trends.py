"""Counts and yearly shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def value_counts(df: DataFrame, column: str, ordered: bool = False) -> DataFrame:
    """A1+A2: rows per non-null value and their share of all non-null rows."""
    present = df.filter(F.col(column).isNotNull())
    total = present.agg(F.count("*").alias("n"))
    counts = present.groupBy(column).agg(F.count("*").alias("count")).withColumn(
        "share", F.col("count") / total.scalar()
    )
    return counts.orderBy(F.desc("count"), column) if ordered else counts


def discipline_trends(assigned: DataFrame, year: str = "pub_year",
                      disciplines: str = "present_disciplines") -> DataFrame:
    """A4: papers per year and discipline; a paper counts once per discipline, NULL years drop out."""
    return (
        assigned.filter(F.col(year).isNotNull())
        .select(F.col(year), F.explode(disciplines).alias("discipline"))
        .groupBy(year, "discipline")
        .agg(F.count("*").alias("paper_count"))
    )


def discipline_share(trends: DataFrame, year: str = "pub_year", ordered: bool = False) -> DataFrame:
    """A5+A6: each count with its year's assignments and the percentage of them.

    ``trends`` holds one row per year and discipline, so the window partitions are tiny.
    """
    out = trends.withColumn(
        "total", F.sum("paper_count").over(Window.partitionBy(year))
    ).withColumn("percentage", F.col("paper_count") / F.col("total") * 100)
    return out.orderBy(year, F.desc("percentage"), "discipline") if ordered else out


def research_type_trends(assigned: DataFrame, year: str = "pub_year", breadth: str = "presence_breadth",
                         merge_types: bool = False) -> DataFrame:
    """Single- versus interdisciplinary papers per year, with the percentage of the year's papers.

    Rows keep the grain (year, breadth), so a year may have two interdisciplinary rows;
    ``merge_types`` adds them up.
    """
    label = F.when(F.col(breadth) == 1, "Single-disciplinary").otherwise("Interdisciplinary")
    typed = assigned.filter(F.col(year).isNotNull()).withColumn("research_type", label)
    keys = [year, "research_type"] if merge_types else [year, "research_type", breadth]
    counts = typed.groupBy(*keys).agg(F.count("*").alias("paper_count"))
    out = counts.withColumn("total_papers", F.sum("paper_count").over(Window.partitionBy(year))).withColumn(
        "percentage", F.col("paper_count") / F.col("total_papers") * 100
    )
    return out if merge_types else out.drop(breadth)
