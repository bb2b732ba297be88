"""The data behind a chart; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.columns import (
    as_double,
    name_at,
    numeric_columns,
    quoted,
    small_side,
    stacked,
)
from tabulary.operators.quantiles import quantile_struct
from tabulary.operators.rowindex import with_row_index

# Bins of a histogram and how many categories each chart shows.
HISTOGRAM_BINS = 20
BAR_CATEGORIES = 10
PIE_CATEGORIES = 8
BOX_CATEGORIES = 10
SUGGESTIONS = 8


def histograms(
    df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins over each value range, empty ones included, the last one closed.

    A constant column has the single bin 0. Ranges are a few numbers per column.
    """
    values = stacked(df, columns).filter(F.col("value").isNotNull())
    width = (F.max("value") - F.min("value")) / F.lit(float(bins))
    ranges = small_side(
        values.groupBy("column_no").agg(F.min("value").alias("_lo"), width.alias("_width"))
    )
    place = F.least(F.floor((F.col("value") - F.col("_lo")) / F.col("_width")), F.lit(bins - 1))
    counted = (
        values.join(ranges, "column_no")
        .select("column_no", F.when(F.col("_width") > 0, place).otherwise(0).cast("int").alias("bin"))
        .groupBy("column_no", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    last = F.when(F.col("_width") > 0, F.lit(bins - 1)).otherwise(F.lit(0))
    frame = ranges.select("*", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    return frame.join(counted, ["column_no", "bin"], "left").select(
        name_at(columns, F.col("column_no")).alias("column"),
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histograms(df, [column], bins).drop("column")


def bar_counts(df: DataFrame, column: str, top: int | None = BAR_CATEGORIES) -> DataFrame:
    """Rows per value, most frequent first; equal counts in value order."""
    value = quoted(column)
    counted = (
        df.filter(value.isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc())
    )
    return counted if top is None else counted.limit(top)


def pie_shares(df: DataFrame, column: str, top: int | None = PIE_CATEGORIES) -> DataFrame:
    """Shares of the shown slices, and of all rows; without ``top`` every value is a slice."""
    shown = bar_counts(df, column, top)
    shown_total = shown.agg(F.sum("n")).scalar()
    every = df.agg(F.count(quoted(column))).scalar()
    return shown.select(
        "value",
        "n",
        F.round(F.col("n") * 100.0 / shown_total, 1).alias("share_pct"),
        F.round(F.col("n") * 100.0 / every, 1).alias("share_of_total_pct"),
    )


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares line over rows with both values."""
    a, b = as_double(df.schema[x]), as_double(df.schema[y])
    both = a.isNotNull() & b.isNotNull()
    return (
        df.filter(both)
        .groupBy(*[quoted(n) for n in by])
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.regr_slope(b, a).alias("slope"),
            F.regr_intercept(b, a).alias("intercept"),
        )
    )


def scatter_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """All points with both values and the height of the trend line at each."""
    line = trend_line(df, x, y).select(F.struct("slope", "intercept")).scalar()
    a, b = as_double(df.schema[x]), as_double(df.schema[y])
    return df.filter(a.isNotNull() & b.isNotNull()).select(
        a.alias("x"), b.alias("y"), (line["slope"] * a + line["intercept"]).alias("trend")
    )


def scatter_hue(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """Points with their colour group and the trend of that group."""
    a, b = as_double(df.schema[x]), as_double(df.schema[y])
    points = df.filter(a.isNotNull() & b.isNotNull()).select(
        a.alias("x"), b.alias("y"), quoted(hue).alias("hue")
    )
    lines = small_side(trend_line(points, "x", "y", ["hue"]), store=True).withColumnRenamed("hue", "_hue")
    return points.join(lines, F.col("hue").eqNullSafe(F.col("_hue")), "left").select(
        "x", "y", "hue", (F.col("slope") * F.col("x") + F.col("intercept")).alias("trend")
    )


def line_series(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Numeric columns against the row index, in long form."""
    columns = list(columns or numeric_columns(df))
    kept = df.select(*dict.fromkeys([*order_by, *columns]))
    indexed = with_row_index(kept, order_by)
    cells = [
        F.struct(F.lit(n).alias("series"), as_double(df.schema[n]).alias("value")) for n in columns
    ]
    return indexed.select("row_index", F.explode(F.array(*cells)).alias("_s")).select(
        "row_index", "_s.series", "_s.value"
    )


def time_series(df: DataFrame, time: str, unit: str, **aggregates: Column) -> DataFrame:
    """Aggregates per calendar unit."""
    return df.groupBy(F.date_trunc(unit, quoted(time)).alias("period")).agg(
        *[value.alias(name) for name, value in aggregates.items()]
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 interquartile ranges, fliers."""
    value = as_double(df.schema[column])
    quartiles = small_side(quantile_struct(df, [column], by).drop("column"), store=bool(by))
    keys = [f"_k{i}" for i in range(len(by))]
    renamed = quartiles.select(
        *[quoted(n).alias(k) for n, k in zip(by, keys)], "q1", "median", "q3"
    )
    points = df.select(*[quoted(n) for n in by], value.alias("_v")).filter(F.col("_v").isNotNull())
    if by:
        matched = F.lit(True)
        for name, key in zip(by, keys):
            matched = matched & quoted(name).eqNullSafe(F.col(key))
        placed = points.join(renamed, matched).drop(*keys)
    else:
        row = renamed.first()
        if row is None:
            return points.sparkSession.createDataFrame([], _box_schema())
        placed = points.withColumns({n: F.lit(row[n]) for n in ("q1", "median", "q3")})
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = placed.groupBy(*[quoted(n) for n in by], "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("_low"),
        F.max(F.when(inside, F.col("_v"))).alias("_high"),
        F.count_if(~inside).alias("n_fliers"),
    )
    return boxes.select(
        *[quoted(n) for n in by],
        "n",
        "q1",
        "median",
        "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
        "n_fliers",
    )


def _box_schema() -> str:
    return (
        "n long, q1 double, median double, q3 double, "
        "whisker_low double, whisker_high double, n_fliers long"
    )


def box_by_category(
    df: DataFrame, category: str, measure: str, top: int | None = BOX_CATEGORIES
) -> DataFrame:
    """A box per category, the first ``top`` categories by name; a numeric pair is swapped.

    Without ``top`` every category has its box, and none is listed anywhere.
    """
    if category in numeric_columns(df) and measure not in numeric_columns(df):
        category, measure = measure, category
    if top is None:
        return box_stats(df.filter(quoted(category).isNotNull()), measure, [category])
    shown = [
        row[0]
        for row in df.select(quoted(category))
        .filter(quoted(category).isNotNull())
        .distinct()
        .orderBy(quoted(category))
        .limit(top)
        .collect()
    ]
    return box_stats(df.filter(quoted(category).isin(shown)), measure, [category])


def kde_density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density with Scott's bandwidth at evenly spaced points of the value range.

    Each task adds up the kernels of its rows and hands on one number per point.
    """
    value = as_double(df.schema[column])
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    row = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.stddev_samp("v").alias("sd"),
    ).first()
    schema = "point int, x double, density double"
    if row["n"] < 2 or not row["sd"]:
        return df.sparkSession.createDataFrame([], schema)
    bandwidth = row["sd"] * row["n"] ** -0.2
    step = (row["hi"] - row["lo"]) / (points - 1)
    grid = row["lo"] + np.arange(points) * step

    def add_kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            v = batch["v"].to_numpy()
            for start in range(0, len(v), 2048):
                z = (grid[:, None] - v[None, start : start + 2048]) / bandwidth
                total += np.exp(-0.5 * z * z).sum(axis=1)
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "kernels": total})

    scale = row["n"] * bandwidth * math.sqrt(2.0 * math.pi)
    summed = values.mapInPandas(add_kernels, "point int, kernels double")
    return (
        summed.groupBy("point")
        .agg(F.sum("kernels").alias("_k"))
        .select(
            "point",
            (F.lit(float(row["lo"])) + F.col("point") * F.lit(float(step))).alias("x"),
            (F.col("_k") / F.lit(float(scale))).alias("density"),
        )
    )


def chart_suggestions(profiles: DataFrame, limit: int | None = SUGGESTIONS) -> DataFrame:
    """Up to ``limit`` charts, or all, per dataset from ``(dataset, position, column, column_class)``.

    Single columns come first in column order, then numeric pairs, then boxes by group.
    """
    numeric = F.col("column_class") == "numeric"
    grouping = F.col("column_class").isin("categorical", "text")
    single = profiles.filter(numeric | grouping).select(
        "dataset",
        F.lit(0).alias("_section"),
        F.col("position").alias("_first"),
        F.explode(
            F.when(
                numeric,
                F.array(
                    _single(0, "histogram", "Distribution of ", ""),
                    _single(1, "box", "Box Plot of ", ""),
                ),
            ).otherwise(
                F.array(
                    _single(0, "bar", "Count of ", " Categories"),
                    _single(1, "pie", "Proportion of ", " Categories"),
                )
            )
        ).alias("_s"),
    ).select("dataset", "_section", "_first", "_s.*")

    left = profiles.select(
        "dataset",
        F.col("position").alias("_first"),
        F.col("column").alias("_a"),
        F.col("column_class").alias("_ca"),
    )
    right = profiles.filter(numeric).select(
        "dataset", F.col("position").alias("_second"), F.col("column").alias("_b")
    )
    pairs = left.join(right, "dataset")
    scatter = pairs.filter((F.col("_ca") == "numeric") & (F.col("_first") < F.col("_second")))
    boxes = pairs.filter(F.col("_ca").isin("categorical", "text"))
    columns = F.concat_ws(", ", "_a", "_b").alias("columns")
    every = single.unionByName(
        scatter.select(
            "dataset",
            F.lit(1).alias("_section"),
            "_first",
            "_second",
            F.lit("scatter").alias("chart_type"),
            columns,
            F.concat("_a", F.lit(" vs "), "_b").alias("title"),
        )
    ).unionByName(
        boxes.select(
            "dataset",
            F.lit(2).alias("_section"),
            "_first",
            "_second",
            F.lit("box").alias("chart_type"),
            columns,
            F.concat("_b", F.lit(" by "), "_a").alias("title"),
        )
    )
    order = W.partitionBy("dataset").orderBy("_section", "_first", "_second")
    ranked = every.withColumn("rank", F.row_number().over(order))
    shown = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return shown.select("dataset", "rank", "chart_type", "columns", "title")


def _single(number: int, chart: str, before: str, after: str) -> Column:
    return F.struct(
        F.lit(number).alias("_second"),
        F.lit(chart).alias("chart_type"),
        F.col("column").alias("columns"),
        F.concat(F.lit(before), F.col("column"), F.lit(after)).alias("title"),
    )
