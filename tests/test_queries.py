"""Every registered query: equal to its SQL, or at least runnable with rows."""

import pytest

import __spark_entry__ as driver
from catalog import queries
from catalog.check import compare, duck

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(request):
    from tests.conftest import SF_DIR

    connection = duck(SF_DIR)
    yield connection
    connection.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert problem in ("", "both empty"), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 11


def test_given_stability_reads_counts_not_texts(spark, sf_dir):
    """Class counts are read three times for their weights: each run's are stored, so no plan goes back to the texts."""
    assert not QUERIES["topic_stability_given"](spark, sf_dir).inputFiles()


def test_labels_are_split_before_vectors_are_made(spark, sf_dir, monkeypatch):
    """The split reads its rows three times, and vectors were made for each of them."""
    seen, split = [], queries.stratified_split
    monkeypatch.setattr(queries, "stratified_split", lambda df: seen.append(df.columns) or split(df))
    rows = queries.labelled_vectors(spark, sf_dir)
    assert seen == [["paper_id", "label"]] and rows.columns == ["paper_id", "embedding", "label", "is_validation"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id as paper_id", "quality as label")
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as paper_id")
    want = split(labels.join(ids, "paper_id")).collect()
    assert sorted(map(tuple, rows.drop("embedding").collect())) == sorted(map(tuple, want))


def test_representative_documents_make_their_terms_once(spark, sf_dir):
    """a document's terms were made anew to count them and to weigh them."""
    plan = queries.representative_docs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
