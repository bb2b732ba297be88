"""Tables from files: CSV with an encoding check, Parquet, previews, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted upload types and the largest accepted upload.
ALLOWED_TYPES = ("csv", "xlsx", "xls")
MAX_FILE_MB = 100


def clean_column_names(names: Sequence[str]) -> list[str]:
    """Lower-case names of word characters only; repeats get ``_1``, ``_2`` ..."""
    taken: set[str] = set()
    cleaned = []
    for name in names:
        base = re.sub(r"[^\w\s]", "_", name.strip())
        base = re.sub(r"\s+", "_", base).lower()
        candidate, suffix = base, 0
        while candidate in taken:
            suffix += 1
            candidate = f"{base}_{suffix}"
        taken.add(candidate)
        cleaned.append(candidate)
    return cleaned


def csv_encoding(spark: SparkSession, path: str) -> str:
    """``UTF-8`` if every line is valid UTF-8, else ``ISO-8859-1``, which reads any byte."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def files_by_encoding(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by encoding: ``UTF-8``, or ``ISO-8859-1`` where a line is no UTF-8.

    One scan of the lines; a name and a flag per file reach the driver, which lists the files
    of a table anyway.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid")
    )
    found: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min("valid").alias("valid")).collect():
        found.setdefault("UTF-8" if row["valid"] else "ISO-8859-1", []).append(row["file"])
    return found


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    clean_names: bool = False,
    multi_line: bool = False,
    **options: str,
) -> DataFrame:
    """A CSV table with a header row.

    Without ``encoding`` each file is read in its own, which scans the lines once more.
    Without a schema the types are inferred, which reads the data once more; pass a
    schema for large inputs. ``multi_line`` allows quoted line breaks and makes each
    file one split.
    """

    def read(files: str | list[str], charset: str, wanted) -> DataFrame:
        reader = (
            spark.read.option("header", True)
            .option("encoding", charset)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .options(**options)
        )
        reader = reader.option("inferSchema", True) if wanted is None else reader.schema(wanted)
        return reader.csv(files)

    groups = {} if encoding else files_by_encoding(spark, path)
    if len(groups) < 2:
        table = read(path, encoding or next(iter(groups), "UTF-8"), schema)
    else:
        parts = {charset: read(files, charset, schema) for charset, files in sorted(groups.items())}
        if schema is None:
            wanted = _common_schema([part.schema for part in parts.values()])
            parts = {charset: read(groups[charset], charset, wanted) for charset in parts}
        table = reduce(DataFrame.unionByName, parts.values())
    return table.toDF(*clean_column_names(table.columns)) if clean_names else table


def _common_schema(schemas: list[T.StructType]) -> T.StructType:
    """The columns of the first schema; text where the files' inferred types differ."""
    fields = []
    for field in schemas[0]:
        kinds = {other[field.name].dataType for other in schemas if field.name in other.names}
        kind = field.dataType if len(kinds) == 1 else T.StringType()
        fields.append(T.StructField(field.name, kind))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows by an explicit order; Spark has no file order to rely on."""
    return df.orderBy(*order_by).limit(rows)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def file_manifest(
    spark: SparkSession,
    path: str,
    allowed: Sequence[str] = ALLOWED_TYPES,
    max_mb: float = MAX_FILE_MB,
    recursive: bool = True,
) -> DataFrame:
    """Name, type, size and upload checks of every file below ``path``.

    Only file status is read: the content column is never selected.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    size_mb = F.round(F.col("length") / F.lit(1024.0 * 1024.0), 2)
    return files.select(
        name.alias("name"),
        extension.alias("extension"),
        F.col("length").alias("size_bytes"),
        size_mb.alias("size_mb"),
        F.col("modificationTime").alias("modified_time"),
        F.ltrim(extension, F.lit(".")).isin(*allowed).alias("is_allowed_type"),
        (size_mb <= F.lit(float(max_mb))).alias("is_allowed_size"),
    )


def where_metadata(filters: dict | None) -> Column:
    """A predicate from ``{column: value}`` or ``{column: {"$in": [values]}}``.

    Missing and empty values are ignored; several keys must all hold. On real columns
    the predicate reaches the scan.
    """
    predicate = F.lit(True)
    for name, wanted in (filters or {}).items():
        if wanted is None or wanted == "":
            continue
        if isinstance(wanted, dict):
            predicate = predicate & F.col(name).isin(*wanted["$in"])
        else:
            predicate = predicate & (F.col(name) == F.lit(wanted))
    return predicate
