"""Column kinds, null handling and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.session import written

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024

_WIDTHS = {
    T.ByteType: 1,
    T.BooleanType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def kind_of(data_type: T.DataType) -> str:
    """``numeric``, ``string``, ``time`` or ``other``; booleans count as numbers."""
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [field.name for field in df.schema.fields if kind_of(field.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "numeric")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "string")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_value(field: T.StructField) -> Column:
    """The column with NaN read as missing, as every statistic here expects."""
    value = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def as_double(field: T.StructField) -> Column:
    return clean_value(field).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {
        field.name: clean_value(field)
        for field in df.schema.fields
        if isinstance(field.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(floats) if floats else df


def cell_bytes(field: T.StructField) -> Column:
    """Bytes one cell takes in memory; text and lists by their content."""
    value = quoted(field.name)
    width = _WIDTHS.get(type(field.dataType))
    if width is not None:
        return F.when(value.isNotNull(), F.lit(width)).otherwise(F.lit(0)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        element = _WIDTHS.get(type(field.dataType.elementType), 16)
        return F.coalesce(F.size(value) * F.lit(element), F.lit(0)).cast("long")
    return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)).cast("long")


def cell_text(field: T.StructField) -> Column:
    """Text of a cell, null when missing."""
    return clean_value(field).cast("string")


def name_at(names: Sequence[str], position: Column) -> Column:
    """The name at a zero-based position of a fixed list."""
    return F.get(F.array(*[F.lit(name) for name in names]), position)


def stacked(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numbers of several columns below each other: ``(keep..., column_no, value)``.

    One narrow row per cell keeps the aggregates behind it small and compiled, however
    many columns there are.
    """
    cells = F.array(*[as_double(df.schema[name]) for name in columns])
    return df.select(
        *[quoted(name) for name in keep], F.posexplode(cells).alias("column_no", "value")
    )


def column_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fixed list ``(column_no, column)``, a few rows for broadcasting."""
    rows = list(enumerate(columns))
    return F.broadcast(df.sparkSession.createDataFrame(rows, "column_no int, column string"))


def small_side(df: DataFrame, rows: int | None = None, store: bool = False) -> DataFrame:
    """Mark ``df`` for broadcast if it is small: ``rows`` rows (``BROADCAST_ROWS``) and 64 MB at most.

    Rows of fixed width are fetched, one more than may be; where cells may be of any length their
    bytes are added up first, and nothing is fetched if there are too many. A larger frame joins
    by shuffle, where adaptive execution splits hot keys. With ``store`` the frame is written
    first: use it where it is dear to work out, as it is read again.
    """
    most = BROADCAST_ROWS if rows is None else rows
    if store:
        df = written(df, "side")
    first = df.limit(most + 1)
    if any(type(field.dataType) not in _WIDTHS for field in df.schema.fields):
        size = reduce(lambda a, b: a + b, [cell_bytes(field) for field in df.schema.fields])
        held = first.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if held[0] > most or held[1] > BROADCAST_BYTES:
            return df
    fetched = first.collect()
    if len(fetched) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, df.schema))
