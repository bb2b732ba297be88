import datetime

import pytest
from pyspark.sql import functions as F

from tabulary.functions.columns import nan_to_null
from tabulary.operators import charts, profile, stats


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [
        ("a", 1.0, 2.0, None),
        ("b", float("nan"), 4.0, None),
        (None, None, None, None),
        ("a", 3.0, None, None),
    ]
    return spark.createDataFrame(rows, "k string, x double, y double, e double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "k string, x double")


def as_dict(df, key="column"):
    return {row[key]: row.asDict() for row in df.collect()}


def test_nan_counts_as_missing(nulls):
    info = as_dict(profile.column_info(nulls))
    assert info["x"]["non_null"] == 2 and info["x"]["null_count"] == 2
    assert info["k"]["unique_count"] == 2
    assert info["e"]["unique_count"] == 0
    assert nan_to_null(nulls).filter("x is null").count() == 2


def test_prepare_drops_empty_rows_and_columns(nulls):
    prepared = profile.prepare(nulls)
    assert prepared.columns == ["k", "x", "y"]
    assert sorted(tuple(r) for r in prepared.collect()) == [
        ("a", "1.0", "2.0"),
        ("a", "3.0", ""),
        ("b", "", "4.0"),
    ]


def test_table_profile_and_nulls(nulls):
    row = profile.table_profile(nulls).first()
    assert (row["row_count"], row["column_count"]) == (4, 4)
    assert row["data_density"] == pytest.approx(7 / 16)
    shares = as_dict(profile.null_profile(nulls))
    assert shares["e"]["null_pct"] == 100.0
    assert shares["x"]["total_null_pct"] == pytest.approx(900 / 16)


def test_empty_table(empty):
    row = profile.table_profile(empty).first()
    assert (row["row_count"], row["data_density"]) == (0, 0.0)
    assert {r["column_class"] for r in profile.column_profile(empty).collect()} == {"unknown"}
    overview = profile.dataset_overview(empty).first()
    assert overview["row_count"] == 0 and overview["column_count"] == 2
    assert profile.avg_text_length(empty).first()[0] == 0.0
    assert stats.column_stat(empty, "x", "sum").first()["value"] == 0.0
    assert stats.column_stat(empty, "x", "mean").first()["value"] is None
    assert stats.superlative_row(empty, "x", "k").count() == 0
    assert stats.outliers(empty, "x").count() == 0
    assert charts.histogram(empty, "x").count() == 0
    assert charts.box_stats(empty, "x").count() == 0
    assert charts.kde_density(empty, "x").count() == 0


def test_statistics_skip_missing(nulls):
    found = {(r["column"], r["stat"]): r["value"] for r in stats.stats_table(nulls).collect()}
    assert found["x", "mean"] == 2.0
    assert found["x", "max"] == 3.0
    assert found["x", "count"] == 2.0
    assert found["x", "median"] == 2.0
    assert found["e", "sum"] == 0.0 and found["e", "count"] == 0.0
    assert ("e", "median") not in found


def test_spread_of_one_value_is_null(spark):
    one = spark.createDataFrame([(5.0,)], "x double")
    assert stats.column_stat(one, "x", "std").first()["value"] is None
    assert stats.column_stat(one, "x", "var").first()["value"] is None
    assert stats.correlation_pair(one, "x", "x").first()[0] is None


@pytest.mark.parametrize(
    ("values", "wanted"),
    [
        (["2024-01-0%d" % (i % 9 + 1) for i in range(71)] + ["zz"] * 29, "date"),
        (["2024-01-0%d" % (i % 9 + 1) for i in range(70)] + ["zz"] * 30, "categorical"),
        (["%d.5" % (i % 5) for i in range(81)] + ["zz"] * 19, "numeric"),
        (["%d.5" % (i % 5) for i in range(80)] + ["zz"] * 20, "categorical"),
        (["w" * 51] * 10, "text"),
        (["w" * 50] * 10, "categorical"),
        ([str(i) + "x" for i in range(10)], "text"),
        ([str(i) + "x" for i in range(9)] + ["0x"], "categorical"),
        ([None, None], "unknown"),
    ],
)
def test_column_class_thresholds(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert profile.column_classes(df).first()["column_class"] == wanted


def test_column_class_of_types(spark):
    rows = [(True, datetime.date(2024, 1, 1), [1.0, 2.0])]
    df = spark.createDataFrame(rows, "b boolean, d date, v array<double>")
    classes = {r["column"]: r["column_class"] for r in profile.column_classes(df).collect()}
    assert classes["b"] == "numeric" and classes["d"] == "date"


def test_common_words_keep_accents(spark):
    df = spark.createDataFrame(
        [("Über den Fluß, über THE Fluß",), ("café Café naïve the of",), ("ab ab ab",)], "t string"
    )
    words = [(r["word"], r["n"]) for r in profile.common_words(df, ["t"]).orderBy("rank").collect()]
    assert words == [("café", 2), ("fluß", 2), ("über", 2), ("den", 1), ("naïve", 1)]


def test_value_frequency_with_a_hot_value(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("s")
    )
    counts = {
        (r["column"], r["value_long"], r["value_text"]): r["n"]
        for r in profile.value_frequency(df).collect()
    }
    assert counts["k", 7, None] == 1001
    assert counts["s", None, "x"] == 3000


def test_ties_go_to_the_smallest_key(spark):
    df = spark.createDataFrame([(3, 9.0), (1, 9.0), (2, 1.0), (4, 1.0), (5, None)], "id int, m double")
    assert stats.superlative_row(df, "m", "id").first()["id"] == 1
    assert stats.superlative_row(df, "m", "id", largest=False).first()["id"] == 2
    bars = charts.bar_counts(df, "m").collect()
    assert [(r["value"], r["n"]) for r in bars] == [(1.0, 2), (9.0, 2)]


def test_charts_of_a_constant_column(spark):
    df = spark.createDataFrame([(4.0,)] * 5, "x double")
    bins = charts.histogram(df, "x").collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(0, 5)]
    assert charts.kde_density(df, "x").count() == 0
    box = charts.box_stats(df, "x").first()
    assert (box["q1"], box["whisker_high"], box["n_fliers"]) == (4.0, 4.0, 0)


def test_chart_sums(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 5).cast("string").alias("c"))
    assert charts.histogram(df, "x").agg(F.sum("n")).first()[0] == 1000
    shares = charts.pie_shares(df, "c").agg(F.sum("share_pct")).first()[0]
    assert shares == pytest.approx(100.0, abs=0.5)
    assert charts.box_by_category(df, "x", "c").count() == 5


def test_coerced_numbers(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3.5",), (None,)], "s string")
    row = stats.coerced_stats(df, ["s"]).first()
    assert (row["mean"], row["min"], row["max"]) == (2.25, 1.0, 3.5)
    nothing = spark.createDataFrame([("x",)], "s string")
    assert stats.coerced_stats(nothing, ["s"]).first()["mean"] == 0.0
