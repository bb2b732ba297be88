import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulary.functions import columns
from tabulary.operators import quantiles
from tabulary.operators.rowindex import with_row_index
from tabulary.operators import thresholds
from tabulary.operators.thresholds import counts_at_thresholds

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(seed=1, n=20_000):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n))  # one hot group
    x = rng.exponential(10, n)
    x[rng.random(n) < 0.33] = 5.0  # one hot value
    y = rng.normal(0, 1e6, n)
    y[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"g": group, "x": x, "y": y})


def check(found, data, by):
    for row in found:
        picked = data
        for name in by:
            picked = picked[picked[name] == row[name]]
        values = picked[row["column"]].dropna()
        wanted = np.quantile(values, row["probability"])
        assert row["value"] == pytest.approx(wanted, rel=1e-12, abs=1e-9), row


@pytest.mark.parametrize(("bins", "by"), [(64, []), (4096, []), (4096, ["g"])])
def test_exact_for_any_histogram(spark, monkeypatch, bins, by):
    monkeypatch.setattr(quantiles, "BINS", bins)
    data = frame()
    df = spark.createDataFrame(data)
    found = quantiles.exact_quantiles(df, ["x", "y"], PROBABILITIES, by).collect()
    groups = data["g"].nunique() if by else 1
    assert len(found) == 2 * len(PROBABILITIES) * groups
    check(found, data, by)


def test_many_groups_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(columns, "BROADCAST_ROWS", 5)
    data = frame(2, 5000)
    df = spark.createDataFrame(data)
    check(quantiles.exact_quantiles(df, ["x"], [0.5], ["g"]).collect(), data, ["g"])


def test_wide_ranges_and_infinite_values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 3000), [1e300, -1e300, 5e-324, 0.0, -0.0, 2.0, 4.0, 8.0]])
    data = pd.DataFrame({"x": x, "y": np.where(np.arange(len(x)) % 3, np.inf, 1.0)})
    found = quantiles.exact_quantiles(spark.createDataFrame(data), ["x"], PROBABILITIES).collect()
    check(found, data, [])
    found = quantiles.exact_quantiles(spark.createDataFrame(data), ["y"], [0.0, 0.5, 1.0]).collect()
    assert sorted(row["value"] for row in found) == [1.0, np.inf, np.inf]


def test_first_bins_rise_with_the_number(spark):
    near = [f(2.0**k) for k in range(-40, 41) for f in (lambda v: v, lambda v: np.nextafter(v, 0), lambda v: np.nextafter(v, 9e99))]
    values = sorted([*near, *(-v for v in near), 0.0, 1e308, -1e308, 5e-324, np.inf, -np.inf])
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    rows = df.select("value", quantiles.first_bin(F.col("value")).alias("bin")).collect()
    bins = [row["bin"] for row in sorted(rows, key=lambda row: row["value"])]
    assert bins == sorted(bins)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_few_values(spark, n):
    data = pd.DataFrame({"x": [float(i * i) for i in range(n)]})
    found = quantiles.exact_quantiles(spark.createDataFrame(data), ["x"], PROBABILITIES).collect()
    check(found, data, [])


def test_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    found = {r["g"]: r["value"] for r in quantiles.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert found == {None: 2.0, "a": 5.0}


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(5000).selectExpr("cast(id % 3 as int) hot", "id", "5000 - id as back")
    rows = with_row_index(df.repartition(7), ["hot", "back"]).collect()
    ordered = sorted(rows, key=lambda r: (r["hot"], r["back"]))
    assert [r["row_index"] for r in ordered] == list(range(5000))


@pytest.mark.parametrize("shared", [20_000, 0])
def test_thresholds(spark, monkeypatch, shared):
    """The same whether tasks know the thresholds or these are sorted in among the values."""
    monkeypatch.setattr(thresholds, "MOST_SHARED", shared)
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"a": rng.integers(0, 50, 4000), "b": rng.normal(0, 10, 4000)})
    data.loc[:500, "b"] = np.nan
    wanted = [("a", float(t)) for t in (-1, 0, 3, 3, 49, 60)] + [("b", t) for t in (-5.0, 0.0, 12.5)]
    conditions = spark.createDataFrame(wanted, "column string, threshold double")
    found = counts_at_thresholds(spark.createDataFrame(data), conditions).collect()
    assert len(found) == 8
    for row in found:
        v = data[row["column"]]
        t = row["threshold"]
        assert (row["below"], row["equal"], row["above"]) == (
            (v < t).sum(),
            (v == t).sum(),
            (v > t).sum(),
        )
