"""Column statistics: one wide pass for everything additive, exact quantiles beside it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.columns import (
    as_double,
    clean_value,
    column_list,
    name_at,
    numeric_columns,
    quoted,
    small_side,
    stacked,
)
from tabulary.operators.quantiles import exact_quantiles, quantile_struct
from tabulary.session import in_arrow

# Accepted names of a statistic and the name each one stands for.
STAT_ALIASES = {
    "mean": "mean",
    "average": "mean",
    "avg": "mean",
    "median": "median",
    "sum": "sum",
    "total": "sum",
    "min": "min",
    "minimum": "min",
    "max": "max",
    "maximum": "max",
    "count": "count",
    "std": "std",
    "variance": "var",
    "var": "var",
}

ADDITIVE = {
    "mean": F.avg,
    "sum": lambda value: F.coalesce(F.sum(value), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "count": lambda value: F.count(value).cast("double"),
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def column_stat(df: DataFrame, column: str, stat: str) -> DataFrame:
    """One statistic of one column, as ``(column, stat, value)``."""
    name = STAT_ALIASES[stat.lower()]
    if name == "median":
        found = exact_quantiles(df, [column], [0.5])
        return found.select("column", F.lit(name).alias("stat"), "value")
    field = df.schema[column]
    if name == "sum" and isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
        value = F.coalesce(F.sum(quoted(column).cast(exact_type(field.dataType))), F.lit(0))
    else:
        value = ADDITIVE[name](as_double(field))
    value = value.cast("double")
    return df.agg(value.alias("value")).select(
        F.lit(column).alias("column"), F.lit(name).alias("stat"), "value"
    )


def exact_type(data_type: T.DataType) -> str:
    """The widest decimal that holds sums of whole numbers or decimals."""
    scale = data_type.scale if isinstance(data_type, T.DecimalType) else 0
    return f"decimal(38,{scale})"


def _scale(field: T.StructField) -> int | None:
    """Decimal places of a column whose sums are exact; None for fractions and the rest."""
    if isinstance(field.dataType, T.DecimalType):
        return field.dataType.scale
    return 0 if isinstance(field.dataType, T.IntegralType) else None


def additive_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All additive statistics from one pass, one row per column.

    Whole numbers and decimals are added up and compared as decimals of 38 digits, one slot for
    each number of places, beside the doubles that deviations are made of. ``exact_sum``,
    ``exact_min`` and ``exact_max`` have their digits as text and are null for other columns; a
    sum beyond 38 digits is a double only.
    """
    fields = [df.schema[name] for name in columns]
    scales = sorted({scale for field in fields if (scale := _scale(field)) is not None})

    def slot(field: T.StructField, scale: int) -> Column:
        kind = f"decimal(38,{scale})"
        return quoted(field.name).cast(kind) if _scale(field) == scale else F.lit(None).cast(kind)

    cells = F.array(
        *[
            F.struct(
                as_double(field).alias("value"),
                *[slot(field, scale).alias(f"exact{scale}") for scale in scales],
            )
            for field in fields
        ]
    )
    value = F.col("_cell.value")
    exact = [F.col(f"_cell.exact{scale}") for scale in scales]

    def digits(name: str, of) -> Column:
        found = [of(column).cast("string") for column in exact]
        return F.coalesce(*found, F.lit(None).cast("string")).alias(name)

    measured = (
        df.select(F.posexplode(cells).alias("column_no", "_cell"))
        .groupBy("column_no")
        .agg(
            F.count(value).cast("double").alias("_count"),
            F.sum(value).alias("_float_sum"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.var_samp(value).alias("var"),
            digits("exact_sum", F.try_sum),
            digits("exact_min", F.min),
            digits("exact_max", F.max),
        )
        .withColumn("_sum", F.coalesce(F.col("exact_sum").cast("double"), F.col("_float_sum")))
    )
    return (
        column_list(df, columns)
        .join(measured, "column_no", "left")
        .select(
            "column",
            F.try_divide("_sum", "_count").alias("mean"),
            F.coalesce("_sum", F.lit(0.0)).alias("sum"),
            "min",
            "max",
            F.coalesce("_count", F.lit(0.0)).alias("count"),
            F.sqrt("var").alias("std"),
            "var",
            "exact_sum",
            "exact_min",
            "exact_max",
        )
    )


def additive_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same in long form: ``(column, stat, value, exact)``."""
    cells = [
        F.struct(
            F.lit(stat).alias("stat"),
            F.col(stat).alias("value"),
            (
                F.col(f"exact_{stat}") if stat in ("sum", "min", "max") else F.lit(None).cast("string")
            ).alias("exact"),
        )
        for stat in ADDITIVE
    ]
    wide = additive_wide(df, columns)
    return wide.select("column", F.explode(F.array(*cells)).alias("_s")).select("column", "_s.*")


def stats_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every supported statistic of every numeric column: ``(column, stat, value, exact)``.

    ``value`` is a double; ``exact`` has all digits of sums and extremes of whole numbers and
    decimals, and is null for the rest and for columns without a value.
    """
    columns = list(columns or numeric_columns(df))
    nothing = F.lit(None).cast("string").alias("exact")
    medians = exact_quantiles(df, columns, [0.5]).select(
        "column", F.lit("median").alias("stat"), "value", nothing
    )
    return additive_stats(df, columns).unionByName(medians)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    columns = list(columns or numeric_columns(df))
    wide = additive_wide(df, columns).select("column", "count", "mean", "std", "min", "max")
    return wide.join(quantile_struct(df, columns), "column", "left")


def coerced_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of values read as numbers; what is no number is skipped, no value gives 0."""
    numbers = df.select(
        *[F.expr(f"try_cast(`{name}` AS double)").alias(name) for name in columns]
    )
    wide = describe_numeric(numbers, columns)
    return wide.select(
        "column",
        *[
            F.coalesce(F.col(name), F.lit(0.0)).alias(name)
            for name in ("mean", "median", "std", "min", "max")
        ],
    )


def compare(column: Column, operator: str, value: Column) -> Column:
    return {
        ">": column > value,
        "<": column < value,
        "==": column == value,
    }[operator]


def conditional_count(df: DataFrame, column: str, operator: str, value: float) -> DataFrame:
    """Rows that satisfy a comparison, beside all rows."""
    holds = compare(clean_value(df.schema[column]), operator, F.lit(value))
    return df.agg(
        F.count_if(holds).alias("matching"), F.count(F.lit(1)).alias("total")
    )


def value_range(df: DataFrame, column: str) -> DataFrame:
    value = clean_value(df.schema[column])
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def superlative_row(df: DataFrame, measure: str, tie_key: str, largest: bool = True) -> DataFrame:
    """The whole row with the extreme measure; equal measures go to the smallest key."""
    value = clean_value(df.schema[measure])
    order = [value.desc() if largest else value.asc(), F.col(tie_key).asc()]
    return df.filter(value.isNotNull()).orderBy(*order).limit(1)


def unique_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column without nulls; the sketch needs no shuffle of values."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(quoted(n)).alias(f"_c{i}") for i, n in enumerate(columns)])
        cells = [
            F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("unique_count"))
            for i, n in enumerate(columns)
        ]
        return row.select(F.explode(F.array(*cells)).alias("_s")).select("_s.*")
    from tabulary.operators.profile import value_frequency

    return value_frequency(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))


def aggregate_by(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[value.alias(name) for name, value in aggregates.items()])


def correlation_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows with both values."""
    a, b = as_double(df.schema[x]), as_double(df.schema[y])
    return df.agg(F.corr(a, b).alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations ``(column_a, column_b, correlation)``."""
    columns = list(columns or numeric_columns(df))
    cells = df.select(*[as_double(df.schema[n]).alias(f"v{i}") for i, n in enumerate(columns)])
    # Numbers taken from their column's mean keep the sums of squares exact enough; those of a
    # constant column become zero.
    finite = [F.when(F.abs(n) < float("inf"), F.col(n)) for n in cells.columns]
    centre = [F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v)) for v in finite]
    centres = [value or 0.0 for value in cells.agg(*centre).first()]
    moments = in_arrow(cells, _pair_moments(centres), _MOMENTS)
    sums = moments.groupBy("a", "b").agg(
        *[F.sum(name).alias(name) for name in ("n", "x", "y", "xx", "yy", "xy")]
    )
    n = F.col("n")
    across = F.col("xy") - F.col("x") * F.col("y") / n
    along = (F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n)
    found = sums.select(
        "a",
        "b",
        F.when(F.col("a") == F.col("b"), F.when(along > 0, F.lit(1.0)).when(n > 0, F.lit(float("nan"))))
        .when(n > 0, F.when(along > 0, across / F.sqrt(along)).otherwise(F.lit(float("nan"))))
        .alias("correlation"),
    )
    sides = F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("l"), F.col("b").alias("r")))
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("l"), F.col("b").alias("r")),
            F.struct(F.col("b").alias("l"), F.col("a").alias("r")),
        )
    )
    return found.select("correlation", F.explode(sides).alias("_s")).select(
        name_at(columns, F.col("_s.l")).alias("column_a"),
        name_at(columns, F.col("_s.r")).alias("column_b"),
        "correlation",
    )


_MOMENTS = "a int, b int, n double, x double, y double, xx double, yy double, xy double"


def _pair_moments(centres: list[float]):
    """Sums over the rows of a task that have both values, one row for each pair of columns."""
    width = len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            values = np.column_stack(
                [column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns]
            )
            known = ~np.isnan(values)
            values = np.where(known, values - centres, 0.0)
            mask = known.astype(float)
            total[0] += mask.T @ mask
            total[1] += values.T @ mask
            total[2] += (values * values).T @ mask
            total[3] += values.T @ values
        n, x, xx, xy = total
        a, b = np.triu_indices(width)
        parts = [n[a, b], x[a, b], x[b, a], xx[a, b], xx[b, a], xy[a, b]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype("int32")), pa.array(b.astype("int32")), *map(pa.array, parts)],
            names=["a", "b", "n", "x", "y", "xx", "yy", "xy"],
        )

    return add


def outlier_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and the bounds at 1.5 interquartile ranges."""
    span = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    return quantile_struct(df, columns, by).withColumns(
        {"low_fence": F.col("q1") - span, "high_fence": F.col("q3") + span}
    )


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences of their column."""
    value = as_double(df.schema[column])
    fences = outlier_fences(df, [column]).first()
    if fences is None:
        return df.limit(0)
    return df.filter((value < F.lit(fences["low_fence"])) | (value > F.lit(fences["high_fence"])))


def analyze_statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    analysis_types: Sequence[str] = ("descriptive", "correlation", "distribution"),
) -> DataFrame:
    """Chosen analyses in one long frame ``(analysis_type, column, item, value)``."""
    from tabulary.operators.charts import histograms

    columns = list(columns or numeric_columns(df))
    parts = []
    shape = ["analysis_type", "column", "item", "value"]
    if "descriptive" in analysis_types:
        stats = ["count", "mean", "std", "min", "q1", "median", "q3", "max"]
        cells = [F.struct(F.lit(s).alias("item"), F.col(s).alias("value")) for s in stats]
        parts.append(
            describe_numeric(df, columns)
            .select("column", F.explode(F.array(*cells)).alias("_s"))
            .select(F.lit("descriptive").alias("analysis_type"), "column", "_s.item", "_s.value")
        )
    if "correlation" in analysis_types:
        parts.append(
            correlation_matrix(df, columns)
            .filter(F.col("column_a") < F.col("column_b"))
            .select(
                F.lit("correlation").alias("analysis_type"),
                F.col("column_a").alias("column"),
                F.col("column_b").alias("item"),
                F.col("correlation").alias("value"),
            )
        )
    if "distribution" in analysis_types:
        parts.append(
            histograms(df, columns).select(
                F.lit("distribution").alias("analysis_type"),
                "column",
                F.concat(F.lit("bin "), F.col("bin").cast("string")).alias("item"),
                F.col("n").cast("double").alias("value"),
            )
        )
    if "outliers" in analysis_types:
        parts.append(outlier_summary(df, columns))
    return reduce(DataFrame.unionByName, [part.select(*shape) for part in parts])


def outlier_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of values outside the fences of each column, in one pass."""
    fences = small_side(outlier_fences(df, columns).select("column", "low_fence", "high_fence"))
    outside = (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    return (
        stacked(df, columns)
        .join(column_list(df, columns), "column_no")
        .join(fences, "column")
        .groupBy("column")
        .agg(F.count_if(outside).cast("double").alias("value"))
        .select(
            F.lit("outliers").alias("analysis_type"),
            "column",
            F.lit("outlier_count").alias("item"),
            "value",
        )
    )
