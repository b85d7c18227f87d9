import pytest
from pyspark.sql import functions as F

from papersieve.functions.text import to_number
from papersieve.operators import cleaning

SCHEMA = "paper_id int, ut string, title string, abstract string, doc_type string, source_title string, pub_year string"
OUTSIDE = "Publication year outside 2016-2025"


def paper(i, ut=None, title="a title", abstract="x", doc_type="Article", source="Nature", year="2020"):
    return (i, f"u{i}" if ut is None else ut, title, abstract, doc_type, source, year)


def reasons(spark, rows, **options):
    df = cleaning.clean_papers(spark.createDataFrame(rows, SCHEMA), **options)
    return {r.paper_id: r.removal_reason for r in df.collect()}


@pytest.mark.parametrize("kind, want", [
    ("Book Review", "Invalid document type"),
    ("RETRACTED PUBLICATION", "Invalid document type"),
    ("Review; Article", None),
    ("ARTICLE", None),
    ("Letter", "Unsupported document type"),
    (None, "Unsupported document type"),
])
def test_document_types(spark, kind, want):
    assert reasons(spark, [paper(1, doc_type=kind)]) == {1: want}


@pytest.mark.parametrize("year, want", [
    ("2015", OUTSIDE), ("2016", None), ("2025", None), ("2026", OUTSIDE), ("2016.0", None), (" 2017 ", None),
    ("n.d.", "Missing publication year"), (None, "Missing publication year"), ("", "Missing publication year"),
    ("2016d", "Missing publication year"), ("NaN", "Missing publication year"), ("inf", OUTSIDE),
])
def test_years(spark, year, want):
    assert reasons(spark, [paper(1, year=year)]) == {1: want}


def test_review_wins_over_article(spark):
    df = spark.createDataFrame([("Review; Article",), ("Journal Article",), ("Letter",), (None,)], "t string")
    got = [r[0] for r in df.select(cleaning.normalize_doc_type(F.col("t"))).collect()]
    assert got == ["review", "article", "letter", None]


def test_source_names(spark):
    df = spark.createDataFrame([(" science (New York, N.Y.) ",), ("cell",), ("PNAS",), (None,)], "s string")
    got = [r[0] for r in df.select(cleaning.normalize_source(F.col("s"))).collect()]
    assert got == ["SCIENCE", "CELL", "PNAS", None]


def test_missing_and_blank_text(spark):
    rows = [paper(1, title=None), paper(2, abstract=None), paper(3, title="  ", abstract="")]
    assert reasons(spark, rows) == {1: "Missing title or abstract", 2: "Missing title or abstract", 3: None}


def test_null_ids_are_one_key_unless_kept(spark):
    rows = [(i, None, f"t{i}", "x", "Article", "Cell", "2020") for i in range(1, 4)]
    assert reasons(spark, rows) == {1: None, 2: "Duplicate identical UT", 3: "Duplicate identical UT"}
    assert set(reasons(spark, rows, keep_null_keys=True).values()) == {None}


def test_title_rule_sees_only_survivors_of_the_id_rule(spark):
    rows = [paper(1, ut="a", title="One"), paper(2, ut="a", title="Two"), paper(3, ut="b", title=" two "),
            paper(4, ut="c", title="ONE")]
    assert reasons(spark, rows) == {
        1: None, 2: "Duplicate identical UT", 3: None, 4: "Duplicate normalized title and year",
    }


def test_foreign_first_copy_shadows_a_wanted_one(spark):
    rows = [paper(1, source="PNAS", title="same"), paper(2, source="Nature", title="same")]
    assert reasons(spark, rows) == {1: "Non-CNS source", 2: "Duplicate normalized title and year"}


def test_rejected_rows_do_not_count_as_first_copies(spark):
    rows = [paper(1, title="same", doc_type="Letter"), paper(2, title="same")]
    assert reasons(spark, rows) == {1: "Unsupported document type", 2: None}


def test_without_id_column(spark):
    df = spark.createDataFrame([paper(1, title="t"), paper(2, title="T")], SCHEMA).drop("ut")
    got = {r.paper_id: r.removal_reason for r in cleaning.clean_papers(df).collect()}
    assert got == {1: None, 2: "Duplicate normalized title and year"}


def test_order_and_partitioning_do_not_matter(spark):
    rows = [paper(i, ut=f"u{i % 7}", title=f"t{i % 5}", source=["Nature", "PNAS"][i % 2]) for i in range(60)]
    assert reasons(spark, rows) == reasons(spark, rows[::-1])


def test_waterfall_adds_up(spark):
    rows = [paper(i, ut=f"u{i % 7}", title=f"t{i % 5}", year=str(2010 + i % 20)) for i in range(80)]
    annotated = cleaning.clean_papers(spark.createDataFrame(rows, SCHEMA))
    steps = {r.item: r.paper_count for r in cleaning.cleaning_waterfall(annotated).collect()}
    first, removed, last = (steps.pop(k) for k in ("Initial records", "Total removed", "Final records"))
    assert first == 80 == removed + last
    assert sum(steps.values()) == removed == cleaning.removed(annotated).count()


def test_labels(spark):
    df = spark.createDataFrame([("1",), ("0.0",), ("2",), ("x",), (None,)], "label string")
    assert [r.label for r in cleaning.clean_labels(df).collect()] == [1, 0]


def test_blank_text_rule_and_its_compatible_form(spark):
    df = spark.createDataFrame([(1, " ", None), (2, "a", None)], "paper_id int, title string, abstract string")
    assert [r.text for r in cleaning.with_text(df).collect()] == ["a[SEP]"]
    assert cleaning.with_text(df, compat=True).count() == 2


def test_number_coercion(spark):
    df = spark.createDataFrame([("1e3",), (".5",), ("1f",), ("0x1",), ("-2.",)], "s string")
    assert [r[0] for r in df.select(to_number(F.col("s"))).collect()] == [1000.0, 0.5, None, None, -2.0]
