"""Tables cut into searchable text: row blocks, columns, and a summary.

A chunk keeps its plain ``text`` beside the masked ``embed_text``; statistics are never
read back from either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.columns import quoted
from tabulary.functions.text import labelled_cells, preprocess_text
from tabulary.operators import profile, stats
from tabulary.operators.rowindex import with_row_index
from tabulary.session import in_arrow

# Rows per block, the largest and smallest adaptive block, and what makes a
# table dense, wordy or sparse.
CHUNK_ROWS = 1000
LARGEST_BLOCK, SMALLEST_BLOCK = 1000, 200
DENSE = 0.8
SPARSE = 0.3
WORDY = 100

#: Characters of a block beyond which it is cut, so that wide rows make no block of any size.
CHUNK_LENGTH = 4_000_000

CHUNK_COLUMNS = ("chunk_id", "chunk_type", "source", "text", "meta")


def row_chunks(
    df: DataFrame, order_by: Sequence[str], source: str, size: int = CHUNK_ROWS
) -> DataFrame:
    """Blocks of ``size`` consecutive rows with a line per row.

    A block of more than ``CHUNK_LENGTH`` characters is cut into parts, and so is a longer line;
    ``chunk_part`` numbers them.
    """
    indexed = with_row_index(df, order_by)
    line = F.concat(
        F.lit("Row "),
        F.col("row_index").cast("string"),
        F.lit(":"),
        labelled_cells(df, df.columns, ": "),
    )
    header = "Data Table:\nColumns: " + ", ".join(df.columns) + "\n\n"
    return _blocks(indexed.select("row_index", line.alias("line")), source, size, F.lit(header))


def _blocks(lines: DataFrame, source: str, size: int, header: Column) -> DataFrame:
    """Lines of each block joined as they stream by in order; a task holds one part at a time."""
    most = CHUNK_LENGTH
    names = ["chunk_no", "chunk_part", "chunk_start_row", "chunk_end_row", "_body"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        number = part = first = last = length = 0

        def block(*parts: tuple) -> pa.RecordBatch:
            columns = zip(*parts, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                names=names,
            )

        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for own, row, line in rows:
                if held and (own != number or length + len(line) >= most):
                    yield block((number, part, first, last, "\n".join(held)))
                    part, held, length = (part + 1 if own == number else 0), [], 0
                elif own != number:
                    part = 0
                number = own
                while len(line) > most:
                    yield block((number, part, row, row, line[:most]))
                    part, line = part + 1, line[most:]
                first = first if held else row
                last = row
                held.append(line)
                length += len(line) + 1
        if held:
            yield block((number, part, first, last, "\n".join(held)))

    numbered = lines.select(F.floor(F.col("row_index") / size).alias("chunk_no"), "row_index", "line")
    dealt = numbered.repartition("chunk_no").sortWithinPartitions("chunk_no", "row_index")
    schema = "chunk_no long, chunk_part int, chunk_start_row long, chunk_end_row long, _body string"
    return in_arrow(dealt, join, schema).select(
        F.lit(source).alias("source"),
        "chunk_no",
        "chunk_part",
        "chunk_start_row",
        "chunk_end_row",
        (F.col("chunk_end_row") - F.col("chunk_start_row") + 1).alias("chunk_size"),
        F.concat(header, F.col("_body")).alias("text"),
    )


def adaptive_size(density: float, avg_length: float, largest: int, smallest: int) -> int:
    if density > DENSE and avg_length > WORDY:
        return max(smallest, largest // 4)
    if density < SPARSE:
        return largest
    return largest // 2


def adaptive_row_chunks(
    df: DataFrame,
    order_by: Sequence[str],
    source: str,
    overview: DataFrame | None = None,
    largest: int = LARGEST_BLOCK,
    smallest: int = SMALLEST_BLOCK,
    sampled: int | None = None,
) -> DataFrame:
    """Blocks sized by density and text length, each with all its rows.

    With ``sampled`` a block shows so many evenly spaced rows, its first and last among them;
    the others are counted where they are and can't be found by a search.
    """
    if sampled is not None and sampled < 2:
        raise ValueError("a block shows two rows at least")
    measured = (overview if overview is not None else profile.table_profile(df)).first()
    length = profile.avg_text_length(df).first()["avg_text_length"]
    size = adaptive_size(measured["data_density"], length, largest, smallest)
    total = measured["row_count"]
    number = F.floor(F.col("row_index") / size)
    place = F.col("row_index") - number * size
    rows = F.least(F.lit(size), F.lit(total) - number * size)
    shown = F.lit(True)
    if sampled is not None:
        shown = rows <= sampled
        for i in range(sampled):
            shown = shown | (place == F.floor(F.lit(i) * (rows - 1) / (sampled - 1)))
    line = F.concat(
        F.lit("Record "),
        F.col("row_index").cast("string"),
        F.lit(":"),
        labelled_cells(df, df.columns, "="),
    )
    lines = with_row_index(df, order_by).filter(shown).select("row_index", line.alias("line"))
    blocks = _blocks(lines, source, size, F.lit(""))
    header = F.format_string(
        f"Data segment with %d rows and {len(df.columns)} columns\nColumns: "
        + ", ".join(df.columns).replace("%", "%%")
        + "\n\n",
        F.col("chunk_size"),
    )
    return blocks.withColumn("text", F.concat(header, F.col("text"))).withColumn(
        "adaptive_chunk_size", F.lit(size)
    )


def column_chunks(df: DataFrame, source: str) -> DataFrame:
    """One chunk per column: class, uniqueness, missing share, measures, sample values."""
    spark = df.sparkSession
    profiled = profile.column_profile(df)
    rows = profiled.collect()  # one row per column
    known = spark.createDataFrame(rows, profiled.schema)
    numeric = [row["column"] for row in rows if row["column_class"] == "numeric"]
    samples = (
        profile.sample_values(df)
        .groupBy("column")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]
                ),
                ", ",
            ).alias("sample_values")
        )
    )
    joined = known.join(samples, "column", "left")
    if numeric:
        joined = joined.join(stats.coerced_stats(df, numeric), "column", "left")
    else:
        nothing = F.lit(None).cast("double")
        joined = joined.withColumns({n: nothing for n in ("mean", "median", "std", "min", "max")})
    kind = F.col("column_class")
    parts = [
        F.format_string("Column '%s' analysis:", F.col("column")),
        F.concat(F.lit("Type: "), kind),
        F.format_string("Unique values: %d", F.col("unique_count")),
        F.format_string("Missing data: %.1f%%", F.col("null_pct")),
        F.when(
            kind == "numeric",
            F.format_string(
                "Statistics: mean=%.2f, median=%.2f\nRange: %.2f to %.2f",
                F.col("mean"),
                F.col("median"),
                F.col("min"),
                F.col("max"),
            ),
        ).when(
            kind == "text",
            F.format_string(
                "Text length: average=%.1f, max=%d", F.col("avg_length"), F.col("max_length")
            ),
        ),
        F.concat(F.lit("Sample values: "), F.coalesce("sample_values", F.lit(""))),
    ]
    return joined.select(
        F.lit(source).alias("source"),
        F.col("column").alias("column_name"),
        "position",
        kind.alias("data_type"),
        "unique_count",
        F.col("null_pct").alias("null_percentage"),
        F.concat_ws("\n", *parts).alias("text"),
    )


def summary_chunk(df: DataFrame, source: str) -> DataFrame:
    """One chunk with the shape, size, density, column classes and missing share."""
    # One row for each column; the overview is made of the same rows.
    profiled = profile.column_classes(df)
    classes = df.sparkSession.createDataFrame(profiled.collect(), profiled.schema)
    counted = classes.groupBy("column_class").agg(
        F.min("position").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    listed = counted.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_first", "column_class", "_n"))),
                lambda c: F.concat(c["column_class"], F.lit(": "), c["_n"].cast("string")),
            ),
            ", ",
        )
    ).scalar()
    return profile.dataset_overview(df, classes).select(
        F.lit(source).alias("source"),
        F.concat_ws(
            "\n",
            F.lit("Comprehensive Dataset Analysis:"),
            F.format_string("Shape: %d rows × %d columns", F.col("row_count"), F.col("column_count")),
            F.format_string("Memory usage: %.2f MB", F.col("memory_mb")),
            F.format_string("Data density: %.1f%%", F.col("data_density") * 100),
            F.concat(F.lit("Column types: "), listed),
            F.format_string("Average missing data: %.1f%%", F.col("avg_null_pct")),
        ).alias("text"),
    )


def chunk_prefix(
    chunk_type: Column,
    text: Column,
    source: Column,
    column_name: Column,
    data_type: Column,
    start: Column,
    end: Column,
) -> Column:
    """Text with its context put in front."""
    unknown = F.lit("unknown")
    return (
        F.when(
            chunk_type == "column",
            F.concat(
                F.lit("Column analysis for '"),
                F.coalesce(column_name, unknown),
                F.lit("' (type: "),
                F.coalesce(data_type, unknown),
                F.lit("): "),
                text,
            ),
        )
        .when(
            chunk_type == "summary",
            F.concat(F.lit("Dataset summary for '"), F.coalesce(source, unknown), F.lit("': "), text),
        )
        .when(
            chunk_type == "rows",
            F.concat(
                F.lit("Data rows "),
                F.coalesce(start, F.lit(0)).cast("string"),
                F.lit("-"),
                F.coalesce(end, F.lit(0)).cast("string"),
                F.lit(": "),
                text,
            ),
        )
        .otherwise(text)
    )


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Flat columns only: a field ``b`` of ``a`` becomes ``a_b``, a list becomes one text."""
    flat = []
    for field in df.schema.fields:
        value = quoted(field.name)
        if isinstance(field.dataType, T.StructType):
            flat += [
                _scalar(value[inner.name], inner.dataType).alias(f"{field.name}_{inner.name}")
                for inner in field.dataType.fields
            ]
        else:
            flat.append(_scalar(value, field.dataType).alias(field.name))
    return df.select(*flat)


def _scalar(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return F.when(value.isNotNull(), F.concat_ws(", ", value.cast("array<string>")))
    if isinstance(data_type, (T.StringType, T.NumericType, T.BooleanType)):
        return value
    if isinstance(data_type, (T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def chunk_metrics(chunks: DataFrame, stored: str = "stored") -> DataFrame:
    """Chunks and mean text length per type, and the share that was stored."""
    return chunks.groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg(F.length("text")).alias("avg_chunk_size"),
        (F.count_if(F.col(stored)) / F.count(F.lit(1))).alias("stored_ratio"),
    )


def build_chunks(
    df: DataFrame,
    source: str,
    order_by: Sequence[str],
    size: int = CHUNK_ROWS,
    adaptive: bool = True,
) -> DataFrame:
    """All chunks of a table: ``(chunk_id, chunk_type, source, text, embed_text, meta)``.

    Blocks have at most ``size`` rows, fewer if ``adaptive`` and the table is dense; the advice
    of ``profile.chunk_strategy`` is for the caller to take. Every row is in some block.
    """
    if adaptive:
        smallest = min(size, SMALLEST_BLOCK)
        rows = adaptive_row_chunks(df, order_by, source, largest=size, smallest=smallest)
    else:
        rows = row_chunks(df, order_by, source, size)
    nothing = F.lit(None).cast("string")
    parts = [
        _chunk(
            rows,
            "rows",
            F.concat(
                F.col("chunk_no").cast("string"),
                F.when(F.col("chunk_part") > 0, F.concat(F.lit("."), F.col("chunk_part"))).otherwise(""),
            ),
            {n: F.col(n) for n in ("chunk_start_row", "chunk_end_row", "chunk_size")},
            start=F.col("chunk_start_row"),
            end=F.col("chunk_end_row"),
        ),
        _chunk(
            column_chunks(df, source),
            "column",
            F.col("column_name"),
            {n: F.col(n) for n in ("column_name", "data_type", "unique_count", "null_percentage")},
            name=F.col("column_name"),
            kind=F.col("data_type"),
        ),
        _chunk(
            summary_chunk(df, source),
            "summary",
            F.lit("overview"),
            {"summary_type": F.lit("comprehensive_overview"), "column_name": nothing},
        ),
    ]
    chunks = reduce(DataFrame.unionByName, parts)
    return chunks.withColumn("embed_text", preprocess_text(F.col("embed_text")))


def _chunk(
    df: DataFrame,
    chunk_type: str,
    number: Column,
    meta: dict[str, Column],
    name: Column | None = None,
    kind: Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    kept = F.map_filter(
        F.create_map(
            *[x for key, value in meta.items() for x in (F.lit(key), value.cast("string"))]
        ),
        lambda key, value: value.isNotNull(),
    )
    prefixed = chunk_prefix(
        F.lit(chunk_type),
        F.col("text"),
        F.col("source"),
        nothing if name is None else name,
        nothing if kind is None else kind,
        none if start is None else start,
        none if end is None else end,
    )
    return df.select(
        F.concat_ws("-", F.col("source"), F.lit(chunk_type), number).alias("chunk_id"),
        F.lit(chunk_type).alias("chunk_type"),
        "source",
        "text",
        prefixed.alias("embed_text"),
        kept.alias("meta"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Store chunks so that a search on a source or chunk type reads only its folders."""
    chunks.write.mode("append").partitionBy("source", "chunk_type").parquet(path)
