"""Record cleaning with one recorded reason per removed row.

Row rules are one CASE chain, so they stay inside one codegen stage over the scan. Keep-first
de-duplication never sorts a group: each key is reduced to its smallest ``order_col`` by a partial
aggregate, and rows meet the outcome on ``order_col``, which is unique. A key shared by a third of
the table (a NULL record id, say) therefore costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import build_text, is_blank, strip, to_number

# Phrases that mark a document type as unusable.
INVALID_TYPES = (
    "Retracted Publication", "Retraction", "News", "Book Review",
    "Editorial", "Interview", "Correction", "Meeting Abstract",
)
# Spellings of the journals of interest.
SOURCE_NAMES = {
    "SCIENCE (NEW YORK, N.Y.)": "SCIENCE",
    "SCIENCE": "SCIENCE",
    "NATURE": "NATURE",
    "CELL": "CELL",
}
ALLOWED_SOURCES = ("NATURE", "SCIENCE", "CELL")
SUPPORTED_TYPES = ("article", "review")
# The removal reasons, in the order the rules apply.
INVALID_TYPE = "Invalid document type"
MISSING_YEAR = "Missing publication year"
OUTSIDE_YEARS = "Publication year outside {}-{}"
UNSUPPORTED_TYPE = "Unsupported document type"
MISSING_TEXT = "Missing title or abstract"
DUPLICATE_UT = "Duplicate identical UT"
DUPLICATE_TITLE = "Duplicate normalized title and year"
FOREIGN_SOURCE = "Non-CNS source"


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label reads as 0 or 1, as INT."""
    number = to_number(F.col(label))
    return df.withColumn(label, number).filter(F.col(label).isin(0.0, 1.0)).withColumn(
        label, F.col(label).cast("int")
    )


def with_text(
    df: DataFrame,
    title: str = "title",
    abstract: str = "abstract",
    sep: str = "[SEP]",
    drop_blank: bool = True,
    compat: bool = False,
) -> DataFrame:
    """P2+P3: add ``text`` and drop rows without any.

    ``compat=True`` tests the joined text, so a visible separator keeps every row.
    """
    out = df.withColumn("text", build_text(F.col(title), F.col(abstract), sep))
    if not drop_blank:
        return out
    return out.filter(strip(F.col("text")) != "") if compat else out.filter(
        ~is_blank(F.col(title), F.col(abstract))
    )


def normalize_source(c: Column, names: Mapping[str, str] = SOURCE_NAMES) -> Column:
    """P5: trimmed upper-case source; known spellings mapped to one name, others kept."""
    key = F.upper(strip(c))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), key)


def normalize_doc_type(c: Column) -> Column:
    """``review`` wins over ``article``; other types are only lower-cased."""
    low = F.lower(c)
    return F.when(low.contains("review"), "review").when(low.contains("article"), "article").otherwise(low)


def has_invalid_type(c: Column, phrases: Sequence[str] = INVALID_TYPES) -> Column:
    """Any phrase occurs, whatever the case; NULL never matches."""
    return F.coalesce(c.rlike("(?iu)" + "|".join(phrases)), F.lit(False))


def row_reason(doc_type: Column, year: Column, title: Column, abstract: Column,
               years: tuple[int, int]) -> Column:
    """P6-P11 as one CASE: the first rule that rejects the row, or NULL."""
    kind = normalize_doc_type(doc_type)
    return (
        F.when(has_invalid_type(doc_type), INVALID_TYPE)
        .when(year.isNull(), MISSING_YEAR)
        .when(~year.between(*years), OUTSIDE_YEARS.format(*years))
        .when(~F.coalesce(kind.isin(*SUPPORTED_TYPES), F.lit(False)), UNSUPPORTED_TYPE)
        .when(title.isNull() | abstract.isNull(), MISSING_TEXT)
    )


def clean_papers(
    papers: DataFrame,
    order_col: str = "paper_id",
    years: tuple[int, int] = (2016, 2025),
    allowed_sources: Sequence[str] = ALLOWED_SOURCES,
    source_names: Mapping[str, str] = SOURCE_NAMES,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Every input row with its normalised fields and ``removal_reason`` (NULL = kept).

    ``order_col`` must be unique; "first" of several copies means smallest. NULL record ids count
    as equal to each other unless ``keep_null_keys``. Without a ``ut`` column that rule is skipped.
    """
    present = set(papers.columns)
    base = papers
    for name in ("doc_type", "source_title"):
        base = base.withColumn(
            f"original_{name}", F.col(name) if name in present else F.lit(None).cast("string")
        )
    base = (
        base.withColumn("source_title", normalize_source(F.col("original_source_title"), source_names))
        .withColumn("_year", to_number(F.col("pub_year")))
        .withColumn(
            "_reason",
            row_reason(F.col("original_doc_type"), F.col("_year"), F.col("title"), F.col("abstract"), years),
        )
        .withColumn("_title_key", F.lower(strip(F.col("title"))))
    )

    live = base.filter(F.col("_reason").isNull())
    if "ut" in present:
        keys = [F.col("ut")]
        if keep_null_keys:
            keys.append(F.when(F.col("ut").isNull(), F.col(order_col)).alias("_null_key"))
        first_ut = live.groupBy(*keys).agg(F.min(order_col).alias(order_col)).select(order_col)
        distinct_ut = live.select(order_col, "_title_key", "_year").join(first_ut, order_col, "left_semi")
    else:
        distinct_ut = live.select(order_col, "_title_key", "_year")
        first_ut = distinct_ut.select(order_col)
    first_title = distinct_ut.groupBy("_title_key", "_year").agg(F.min(order_col).alias(order_col))
    outcome = first_ut.join(
        first_title.select(order_col, F.lit(True).alias("_first_title")), order_col, "left"
    ).select(order_col, F.coalesce("_first_title", F.lit(False)).alias("_first_title"))

    reason = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("_first_title").isNull(), DUPLICATE_UT)
        .when(~F.col("_first_title"), DUPLICATE_TITLE)
        .when(~F.coalesce(F.col("source_title").isin(*allowed_sources), F.lit(False)), FOREIGN_SOURCE)
    )
    reached_type_step = ~F.coalesce(
        F.col("_reason").isin(INVALID_TYPE, MISSING_YEAR, OUTSIDE_YEARS.format(*years)), F.lit(False)
    )
    return (
        base.join(outcome, order_col, "left")
        .withColumn("removal_reason", reason)
        .withColumn(
            "doc_type",
            F.when(reached_type_step, normalize_doc_type(F.col("original_doc_type"))).otherwise(
                F.col("original_doc_type")
            ),
        )
        .withColumn("pub_year", F.col("_year").try_cast("int"))
        .drop("_year", "_reason", "_title_key", "_first_title")
    )


def kept(annotated: DataFrame) -> DataFrame:
    """Rows no rule removed."""
    return annotated.filter(F.col("removal_reason").isNull()).drop("removal_reason")


def removed(annotated: DataFrame) -> DataFrame:
    """The removal log, one row per removed record."""
    return annotated.filter(F.col("removal_reason").isNotNull())


def cleaning_waterfall(annotated: DataFrame, years: tuple[int, int] = (2016, 2025)) -> DataFrame:
    """Rows in, rows removed by each rule in rule order, rows removed, rows left.

    One global aggregate (partial sums per task), unpivoted to ``(step, item, paper_count)``.
    """
    reasons = (
        INVALID_TYPE, MISSING_YEAR, OUTSIDE_YEARS.format(*years), UNSUPPORTED_TYPE,
        MISSING_TEXT, DUPLICATE_UT, DUPLICATE_TITLE, FOREIGN_SOURCE,
    )
    reason = F.col("removal_reason")
    counts = annotated.agg(
        F.count("*").alias("n"),
        F.count(reason).alias("gone"),
        *[F.count_if(reason == r).alias(f"r{i}") for i, r in enumerate(reasons)],
    )
    items = [("Initial records", F.col("n"))]
    items += [(r, F.col(f"r{i}")) for i, r in enumerate(reasons)]
    items += [("Total removed", F.col("gone")), ("Final records", F.col("n") - F.col("gone"))]
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("item"), value.alias("paper_count"))
        for i, (name, value) in enumerate(items)
    ])
    return counts.select(F.inline(rows))
