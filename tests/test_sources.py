import pytest
from pyspark.sql import functions as F

from papersieve.session import join_by_skewed_key, join_salted
from papersieve.sources import papers as src
from papersieve.sources import sinks


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame(
        [("u1", 'A "quoted", title', "line one\nline two", "2020"), ("u2", "B", None, "x")],
        "`UT` string, `Article Title` string, `Abstract` string, `Publication Year` string",
    )
    path = str(tmp_path / "papers")
    sinks.write_table(df, path, "csv")
    for columns in (None, df.columns):
        got = src.read_papers(spark, path, columns=columns, multi_line=True, id_col=None).orderBy("ut")
        assert got.columns == ["ut", "title", "abstract", "pub_year"]
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.collect()]


def test_yearly_scan(spark, tmp_path):
    base = str(tmp_path)
    for year, column in (("2017", "Full_Text"), ("2016", "text"), ("2018", "body"), ("notes", "text")):
        spark.createDataFrame([(year,)], f"{column} string").write.parquet(f"{base}/{year}")
    got = src.read_yearly(spark, base)
    assert sorted((r.pub_year, r.text) for r in got.collect()) == [(2016, "2016"), (2017, "2017")]
    with pytest.raises(ValueError):
        src.read_yearly(spark, base, key="absent")


def test_write_yearly_gives_the_scanned_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2016), (2, "b", 2017), (3, "c", None)], "id int, text string, pub_year int")
    sinks.write_yearly(df, str(tmp_path / "y"))
    got = src.read_yearly(spark, str(tmp_path / "y"))
    assert sorted((r.id, r.pub_year) for r in got.collect()) == [(1, 2016), (2, 2017)]


def test_yearly_scan_skips_empty_folders_and_reads_partitions(spark, tmp_path):
    spark.createDataFrame([("a",)], "text string").write.parquet(f"{tmp_path}/year=2019")
    (tmp_path / "2020").mkdir()
    assert [(r.pub_year, r.text) for r in src.read_yearly(spark, str(tmp_path)).collect()] == [(2019, "a")]


def test_export_without_ids_gets_them_in_file_order(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i:03}", "t") for i in range(50)], "`UT` string, `Article Title` string")
    df.coalesce(1).write.csv(str(tmp_path / "one"), header=True)
    got = src.read_papers(spark, str(tmp_path / "one")).orderBy("paper_id").collect()
    assert [r.ut for r in got] == [f"u{i:03}" for i in range(50)] and len({r.paper_id for r in got}) == 50


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Clean TEXT` int, `text` int")
    assert src.resolve_column(df, ["text"]) == "Clean TEXT" and src.resolve_column(df, ["year"]) is None
    with pytest.raises(ValueError):
        src.require_columns(df, ["title"])
    other = spark.createDataFrame([(1, 5)], "`text` int, extra int")
    assert src.union_all([df, other]).filter("extra is null").count() == 1


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, "r1"), (2, None), (3, "r2")], "id int, removal_reason string")
    assert sinks.write_removed(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert not sinks.write_removed(log.filter("id = 2"), str(tmp_path / "none"))
    sinks.write_report({"one": log, "two": log}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/two")).count() == 3
    sinks.write_metrics(log, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 3
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.5)], "topic_i int, topic_j int, value double")
    assert sorted(tuple(r) for r in sinks.matrix(cells).collect()) == [(0, 1.0, 0.5), (1, 0.0, 1.0)]


def test_skew_joins_equal_the_plain_join(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(3000)]
    big = spark.createDataFrame(rows, "id int, key string")
    lookup = big.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn(
        "value", F.concat(F.lit("v"), "key")).filter("key <> 'k12'")
    got = join_by_skewed_key(big, lookup, "key", "value", "n", "id", hot_share=10)
    want = big.join(lookup.select("key", "value"), "key", "left")
    assert sorted((r.id, r.value) for r in got.collect() if r.value) == sorted(
        (r.id, r.value) for r in want.collect() if r.value)
    assert got.count() == 3000
    salted = join_salted(big, lookup.select("key", "value"), "key", "id")
    assert salted.count() == want.filter("value is not null").count()


def test_hot_key_without_value_is_spread(spark):
    big = spark.range(20000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 10 != 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    lookup = big.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.when(F.col("key") != "hot", F.col("key")))
    got = join_by_skewed_key(big, lookup, "key", "value", "n", "id")
    assert got.filter("value = key").count() == 2000 and got.filter("value is null").count() == 18000
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in join_by_skewed_key(big, lookup, "key", "value", "n", "id").groupBy(
            F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
