"""Inputs of the registered queries, all derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.sources.papers import spread

# One SQL text for both engines: documents read as a bibliographic export.
PAPERS_SQL = """
select doc_id as paper_id,
 concat('WOS:', cast(case when doc_id % 50 = 49 then doc_id - 1 else doc_id end as string)) as ut,
 split_part(text, chr(10), 1) as title,
 case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) end as abstract,
 case doc_id % 16 when 3 then 'News Item' when 7 then 'Editorial Material' when 9 then 'Review'
   when 11 then 'Article; Proceedings Paper' when 12 then 'Review; Book Chapter' when 13 then 'Letter'
   when 14 then null when 15 then 'Article; Retracted Publication' else 'Article' end as doc_type,
 case doc_id % 7 when 0 then 'Nature' when 1 then ' science (New York, N.Y.)' when 2 then 'CELL'
   when 3 then 'Science ' when 4 then 'nature' when 5 then 'PNAS' else 'Cell' end as source_title,
 case when doc_id % 41 = 0 then 'n.d.' else cast(2014 + n_chars % 13 as string) end as pub_year
from {documents}
"""

# Labels as a hand-filled sheet holds them; one SQL text for both engines.
DIRTY_LABEL = """case when doc_id % 11 = 0 then 'n/a' when doc_id % 13 = 0 then '2'
 when doc_id % 3 = 0 then concat(' ', cast(quality as string), '.0') else cast(quality as string) end"""

# Keyword tiers that occur in the test prose; the library defaults name computing terms.
FIXTURE_TIERS = ((0.90, (r"\b(thing|thou)\b",)), (0.75, (r"\bAI\b", r"\bNLP\b")))

# Selection bounds that suit the test vectors (their cosines stay far below .80).
FIXTURE_RATIO, FIXTURE_MIN = 0.85, 0.10
FIXTURE_RATIOS = (0.75, 0.8, 0.85, 0.9, 0.95)
FIXTURE_MINIMA = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25)
FIXTURE_SWEEP = tuple(i / 20 for i in range(20))

# Frequent words of the test prose, in its four languages; the library default is English only.
FIXTURE_STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "it", "that", "de", "la", "le", "les", "des", "un", "une", "et",
    "der", "die", "das", "und", "den", "ein", "el", "los", "las", "que", "en", "por",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAPERS_SQL.format(documents="{documents}"), documents=documents(spark, sf_dir))


def stand_in_score(id_col: str = "doc_id"):
    """Reproducible number in [0, 1] from the id, used where a trained model is not the point."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":score")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the stand-in model score."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("paper_id"),
        F.col("quality").alias("label"),
        (0.6 * stand_in_score() + 0.3 * F.col("quality")).alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("paper_id"), "embedding", "label"
    )


def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a given topic; label 9 plays the outliers.

    The documents that have a vector may all lie in a few files, so what the join leaves is dealt anew:
    by a hash of the id, as a deal by the id itself is taken for the join's own and left out, though
    that join may turn into a broadcast at run time.
    """
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic")
    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").alias("paper_id"), "text")
        .join(vectors(spark, sf_dir).select("paper_id", "embedding", topic), "paper_id")
        .repartition(F.xxhash64("paper_id"))
    )
