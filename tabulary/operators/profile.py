"""Cleaning and profiling.

Everything additive comes from one wide pass; everything that needs distinct values
comes from one value-frequency table. Profiles always see the typed frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.columns import (
    cell_bytes,
    cell_text,
    clean_value,
    column_list,
    kind_of,
    name_at,
    quoted,
    string_columns,
)
from tabulary.functions.text import STOPWORDS, words
from tabulary.session import in_arrow

# What a date and a number look like, and the thresholds of the classes.
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
NUMBER_PATTERN = r"^\s*-?\d+\.?\d*\s*$"
DATE_SHARE = 0.7
NUMBER_SHARE = 0.8
TEXT_LENGTH = 50
TEXT_UNIQUE_RATIO = 0.9

# Chunk sizes (largest, smallest, overlap, kind) by size of the dataset.
LARGE_MEMORY_MB = 100
LARGE_ROWS = 10_000
MANY_TEXT_COLUMNS = 2
LARGE_STRATEGY = (500, 100, 25, "adaptive")
TEXT_STRATEGY = (200, 50, 20, "content_aware")
STANDARD_STRATEGY = (1000, 200, 50, "adaptive")


def _fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    names = list(columns) if columns is not None else df.columns
    return [df.schema[name] for name in names]


def prepare(df: DataFrame) -> DataFrame:
    """Without empty rows and columns, every cell as text, missing cells as ``''``."""
    present = df.agg(
        *[F.count(clean_value(f)).alias(f"_c{i}") for i, f in enumerate(df.schema.fields)]
    ).first()
    kept = [f for i, f in enumerate(df.schema.fields) if present[i] > 0]
    filled = F.lit(False)
    for field in df.schema.fields:
        filled = filled | clean_value(field).isNotNull()
    return df.filter(filled).select(
        *[F.coalesce(cell_text(f), F.lit("")).alias(f.name) for f in kept]
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, megabytes and the share of cells that hold a value."""
    fields = df.schema.fields
    cells = F.lit(0).cast("long")
    memory = F.lit(0).cast("long")
    for field in fields:
        cells = cells + F.when(clean_value(field).isNotNull(), 1).otherwise(0)
        memory = memory + cell_bytes(field)
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("_cells"),
        F.coalesce(F.sum(memory), F.lit(0)).alias("_bytes"),
    )
    every = F.col("row_count") * F.lit(len(fields))
    return row.select(
        "row_count",
        F.lit(len(fields)).cast("long").alias("column_count"),
        (F.col("_bytes") / F.lit(1024.0 * 1024.0)).alias("memory_mb"),
        F.when(every > 0, F.col("_cells") / every).otherwise(F.lit(0.0)).alias("data_density"),
    )


def value_frequency(
    df: DataFrame, columns: Sequence[str] | None = None, digests: bool = False
) -> DataFrame:
    """Counts of every distinct value of every column: ``(column, value_..., n)``.

    With ``digests`` texts are represented by a 256-bit digest in ``value_text``, so that only
    digests are shuffled where the texts themselves are not shown.

    Whole numbers, fractions and the rest are counted apart, so that numbers are grouped as
    numbers and no cell is formatted before it has been counted; each part reads only its
    own columns. Null cells are left out. Equal values meet on the map side first, so a hot
    value is no hot task.
    """
    slots = {"long": [], "double": [], "string": []}
    for field in _fields(df, columns):
        slots[_slot_of(field.dataType)].append(field)
    parts = []
    for kind, fields in slots.items():
        if not fields:
            continue
        values = [clean_value(field).cast(kind) for field in fields]
        if digests and kind == "string":
            # Short texts are no longer than their digest and stay as they are.
            values = [F.when(F.length(v) <= 32, v).otherwise(F.sha2(v, 256)) for v in values]
        cells = F.array(*values)
        counted = (
            df.select(F.posexplode(cells).alias("column_no", "value"))
            .filter(F.col("value").isNotNull())
            .groupBy("column_no", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )

        def slot(wanted: str, held: str = kind) -> Column:
            return F.col("value") if held == wanted else F.lit(None).cast(wanted)

        parts.append(
            counted.select(
                name_at([field.name for field in fields], F.col("column_no")).alias("column"),
                slot("long").alias("value_long"),
                slot("double").alias("value_double"),
                slot("string").alias("value_text"),
                "n",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _slot_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "long"
    return "double" if isinstance(data_type, (T.FloatType, T.DoubleType)) else "string"


def value_as_text() -> Column:
    return F.coalesce(
        F.col("value_text"), F.col("value_long").cast("string"), F.col("value_double").cast("string")
    )


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (
        value_frequency(df, columns, digests=True)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def column_measures(df: DataFrame) -> DataFrame:
    """One pass: counts, bytes, text lengths, date-like and number-like shares per column.

    Each cell becomes one narrow row of numbers, so no text is moved and the aggregate
    stays compiled however many columns there are.
    """
    nothing = F.lit(None).cast("int")
    cells, known = [], []
    for i, field in enumerate(df.schema.fields):
        value = clean_value(field)
        kind = kind_of(field.dataType)
        text = kind == "string"
        known.append((i, field.name, field.dataType.simpleString(), kind))
        cells.append(
            F.struct(
                value.isNotNull().alias("filled"),
                cell_bytes(field).alias("bytes"),
                (F.length(value) if text else nothing).alias("length"),
                (value.rlike(DATE_PATTERN).cast("int") if text else nothing).alias("dated"),
                (value.rlike(NUMBER_PATTERN).cast("int") if text else nothing).alias("numbered"),
            )
        )
    measured = (
        df.select(F.posexplode(F.array(*cells)).alias("position", "_cell"))
        .select("position", "_cell.*")
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if("filled").alias("non_null"),
            F.sum("bytes").alias("bytes"),
            F.avg("length").alias("avg_length"),
            F.max("length").alias("max_length"),
            F.avg("dated").alias("date_share"),
            F.avg("numbered").alias("number_share"),
        )
    )
    names = df.sparkSession.createDataFrame(
        known, "position int, column string, data_type string, kind string"
    )
    zeros = {name: F.coalesce(name, F.lit(0)) for name in ("row_count", "non_null", "bytes")}
    return F.broadcast(names).join(measured, "position", "left").withColumns(zeros)


def column_profile(df: DataFrame, unique_for: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, uniqueness, text measures and the class of the column.

    Distinct values are counted for ``unique_for``, by default for every column.
    """
    wanted = df.columns if unique_for is None else list(unique_for)
    measures = column_measures(df)
    if wanted:
        measures = measures.join(unique_counts(df, wanted), "column", "left")
    else:
        measures = measures.withColumn("unique_count", F.lit(None).cast("long"))
    return _judged(measures)


def _judged(measures: DataFrame) -> DataFrame:
    """Measures of columns with what follows from them."""
    nulls = F.col("row_count") - F.col("non_null")
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    return measures.withColumns(
        {
            "null_count": nulls,
            "null_pct": F.when(F.col("row_count") > 0, nulls * 100.0 / F.col("row_count"))
            .otherwise(F.lit(0.0)),
            "unique_count": unique,
            "unique_ratio": F.when(F.col("non_null") > 0, unique / F.col("non_null"))
            .otherwise(F.lit(0.0)),
        }
    ).withColumn("column_class", _column_class())


def _column_class() -> Column:
    text = (F.col("avg_length") > TEXT_LENGTH) | (F.col("unique_ratio") > TEXT_UNIQUE_RATIO)
    return (
        F.when(F.col("non_null") == 0, "unknown")
        .when(F.col("kind") == "numeric", "numeric")
        .when((F.col("kind") == "time") | (F.col("date_share") > DATE_SHARE), "date")
        .when(F.col("number_share") > NUMBER_SHARE, "numeric")
        .when(text, "text")
        .otherwise("categorical")
    )


def column_classes(df: DataFrame) -> DataFrame:
    """Column profile for its classes only, see ``classes_of``."""
    return classes_of({"": df}).drop("dataset")


def classes_of(datasets: dict[str, DataFrame]) -> DataFrame:
    """The classes of the columns of named tables, with ``dataset``.

    All tables are measured at once, which returns one row per column. Distinct values are counted
    only where no measure decides the class; elsewhere ``unique_count`` is zero.
    """
    measures = for_each_dataset(datasets, column_measures)
    rows = measures.collect()
    undecided: dict[str, list[str]] = {}
    for row in rows:
        decided = (
            row["kind"] not in ("string", "other")
            or not row["non_null"]
            or (row["date_share"] or 0) > DATE_SHARE
            or (row["number_share"] or 0) > NUMBER_SHARE
            or (row["avg_length"] or 0) > TEXT_LENGTH
        )
        if not decided:
            undecided.setdefault(row["dataset"], []).append(row["column"])
    spark = next(iter(datasets.values())).sparkSession
    known = spark.createDataFrame(rows, measures.schema)
    if not undecided:
        return _judged(known.withColumn("unique_count", F.lit(None).cast("long")))
    counts = [
        unique_counts(datasets[name], columns).select(F.lit(name).alias("dataset"), "*")
        for name, columns in undecided.items()
    ]
    return _judged(
        known.join(reduce(DataFrame.unionByName, counts), ["dataset", "column"], "left")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Missing share per column, beside the share of all cells and the column average."""
    cells = column_measures(df).select(
        "column",
        (F.col("row_count") - F.col("non_null")).alias("null_count"),
        "row_count",
    )
    share = F.when(F.col("row_count") > 0, F.col("null_count") * 100.0 / F.col("row_count"))
    per_column = cells.withColumn("null_pct", F.coalesce(share, F.lit(0.0)))
    # One row for each column of the table.
    every = W.partitionBy()
    nulls, rows = F.sum("null_count").over(every), F.sum("row_count").over(every)
    return per_column.select(
        "column",
        "null_count",
        "null_pct",
        (nulls * 100.0 / F.greatest(rows, F.lit(1))).alias("total_null_pct"),
        F.avg("null_pct").over(every).alias("avg_null_pct"),
    )


def unique_ratio(df: DataFrame) -> DataFrame:
    """Distinct values over filled cells, per column."""
    counted = value_frequency(df).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null")
    )
    return column_list(df, df.columns).join(counted, "column", "left").select(
        "column",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        F.coalesce(F.col("unique_count") / F.col("non_null"), F.lit(0.0)).alias("unique_ratio"),
    )


def column_info(df: DataFrame) -> DataFrame:
    return column_profile(df).select(
        "position", "column", "data_type", "non_null", "null_count", "unique_count"
    )


def column_type_counts(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return profile.groupBy(*by, "column_class").agg(F.count(F.lit(1)).alias("n_columns"))


def text_column_deep(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Average and longest text with the common words of each text column."""
    columns = list(columns or string_columns(df))
    top = common_words(df, columns)
    listed = top.groupBy("column").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]),
            ", ",
        ).alias("common_words")
    )
    return (
        column_measures(df.select(*[quoted(n) for n in columns]))
        .select("column", "avg_length", F.col("max_length").cast("long").alias("max_length"))
        .join(listed, "column", "left")
        .withColumn("common_words", F.coalesce("common_words", F.lit("")))
    )


def common_words(df: DataFrame, columns: Sequence[str], top_n: int = 5) -> DataFrame:
    """Most frequent words per column; equal counts in word order."""
    cells = [
        F.struct(F.lit(name).alias("column"), quoted(name).cast("string").alias("text"))
        for name in columns
    ]
    word = F.col("word")
    counted = (
        df.select(F.explode(F.array(*cells)).alias("_c"))
        .select("_c.column", F.explode(words(F.col("_c.text"))).alias("word"))
        .filter((F.length(word) > 2) & ~word.isin(*STOPWORDS))
        .groupBy("column", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("word").asc())
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def avg_text_length(df: DataFrame) -> DataFrame:
    """Mean text length over all cells, an empty cell counting as empty text."""
    lengths = F.lit(0).cast("long")
    for field in df.schema.fields:
        lengths = lengths + F.coalesce(F.length(cell_text(field)), F.lit(0))
    every = F.count(F.lit(1)) * F.lit(len(df.columns))
    return df.agg(
        F.coalesce(F.sum(lengths) / F.when(every > 0, every), F.lit(0.0)).alias("avg_text_length")
    )


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` smallest distinct values per column and how often they occur.

    Numbers are in number order, all else in the order of its text. A task keeps ``n`` values per
    column and their counts: a value among the smallest of all is among the smallest of what its
    task has seen at any time, so its count is whole. Only those few values are shuffled.
    """
    fields = _fields(df, columns)
    slots = [_slot_of(field.dataType) for field in fields]
    cells = df.select(
        *[clean_value(field).cast(slot).alias(f"v{i}") for i, (field, slot) in enumerate(zip(fields, slots, strict=True))]
    )

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in slots]
        for batch in batches:
            for held, values in zip(kept, batch.columns, strict=True):
                counted = pc.value_counts(values.drop_null())
                found, counts = counted.field("values"), counted.field("counts")
                order = pc.sort_indices(found)[:n]
                for value, count in zip(
                    found.take(order).to_pylist(), counts.take(order).to_pylist(), strict=True
                ):
                    held[value] = held.get(value, 0) + count
                for value in sorted(held)[n:]:
                    del held[value]
        rows = [
            (number, *(value if kind == slot else None for kind in ("long", "double", "string")), count)
            for number, (slot, held) in enumerate(zip(slots, kept, strict=True))
            for value, count in held.items()
        ]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
            names=["column_no", "value_long", "value_double", "value_text", "n"],
        )

    schema = "column_no int, value_long long, value_double double, value_text string, n long"
    merged = in_arrow(cells, smallest, schema).groupBy(
        "column_no", "value_long", "value_double", "value_text"
    ).agg(F.sum("n").alias("n"))
    order = W.partitionBy("column_no").orderBy("value_long", "value_double", "value_text")
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            name_at([field.name for field in fields], F.col("column_no")).alias("column"),
            "rank",
            value_as_text().alias("value"),
            "n",
        )
    )


def dataset_overview(df: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One row with sizes, missing shares and the number of columns of each class.

    ``classes`` is the result of ``column_classes`` if it is known already.
    """
    cells = F.sum("row_count")
    return (column_classes(df) if classes is None else classes).agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        (F.sum("bytes") / F.lit(1024.0 * 1024.0)).alias("memory_mb"),
        F.coalesce(F.try_divide(F.sum("non_null"), cells), F.lit(0.0)).alias("data_density"),
        F.count_if(F.col("column_class") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("column_class") == "text").alias("text_columns"),
        F.count_if(F.col("column_class") == "categorical").alias("categorical_columns"),
        F.count_if(F.col("column_class") == "date").alias("date_columns"),
        F.avg("null_pct").alias("avg_null_pct"),
        F.coalesce(F.try_divide(F.sum("null_count") * 100.0, cells), F.lit(0.0)).alias(
            "total_null_pct"
        ),
    )


def for_each_dataset(datasets: dict[str, DataFrame], build) -> DataFrame:
    """Union of ``build(df)`` over named tables, marked by ``dataset``."""
    parts = [
        build(df).select(F.lit(name).alias("dataset"), "*") for name, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def chunk_strategy(overview: DataFrame) -> DataFrame:
    """Chunk sizes by size of the dataset and number of text columns."""
    large = (F.col("memory_mb") > LARGE_MEMORY_MB) | (F.col("row_count") > LARGE_ROWS)
    textual = F.col("text_columns") > MANY_TEXT_COLUMNS

    def choose(i: int) -> Column:
        return (
            F.when(large, F.lit(LARGE_STRATEGY[i]))
            .when(textual, F.lit(TEXT_STRATEGY[i]))
            .otherwise(F.lit(STANDARD_STRATEGY[i]))
        )

    keep = ["dataset"] if "dataset" in overview.columns else []
    return overview.select(
        *keep,
        choose(0).alias("max_chunk_size"),
        choose(1).alias("min_chunk_size"),
        choose(2).alias("overlap_size"),
        choose(3).alias("strategy_type"),
    )


def data_insights(overview: DataFrame) -> DataFrame:
    """Sentences about size, density, column classes and missing values per dataset."""
    density, numeric, text = (F.col(c) for c in ("data_density", "numeric_columns", "text_columns"))
    missing = F.col("total_null_pct")
    notes = [
        F.format_string(
            "Dataset contains %d rows and %d columns", F.col("row_count"), F.col("column_count")
        ),
        F.when(density > 0.8, "High data density detected - minimal missing values").when(
            density < 0.5, "Low data density - significant missing values may require attention"
        ),
        F.when(
            numeric > 0,
            F.format_string("Found %d numeric columns suitable for statistical analysis", numeric),
        ),
        F.when(
            text > 0, F.format_string("Found %d text columns suitable for semantic search", text)
        ),
        F.when(
            missing > 10,
            F.format_string("Data has %.1f%% missing values - consider data cleaning", missing),
        ).otherwise(F.format_string("Good data quality - only %.1f%% missing values", missing)),
    ]
    return explode_notes(overview, notes, "insight")


def stat_recommendations(overview: DataFrame) -> DataFrame:
    """Analyses worth running, by the classes of the columns present."""
    numeric = F.col("numeric_columns")
    groups = F.col("text_columns") + F.col("categorical_columns")
    notes = [
        F.when(numeric >= 2, "Consider correlation analysis between numeric columns"),
        F.when(numeric > 0, "Visualize distributions with histograms or box plots"),
        F.when(numeric > 0, "Check for outliers in numeric data"),
        F.when(groups > 0, "Analyze categorical distributions with bar charts"),
        F.when(
            (numeric > 0) & (groups > 0),
            "Explore relationships between categorical and numeric variables",
        ),
    ]
    return explode_notes(overview, notes, "recommendation")


def explode_notes(df: DataFrame, notes: Sequence[Column], name: str) -> DataFrame:
    """One row per note that applies."""
    present = F.filter(F.array(*notes), lambda note: note.isNotNull())
    keep = ["dataset"] if "dataset" in df.columns else []
    return df.select(*keep, F.posexplode(present).alias("note_no", name))
