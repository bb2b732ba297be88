"""Named datasets as temporary views, with summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.columns import numeric_columns, string_columns
from tabulary.operators.profile import column_info, for_each_dataset, table_profile


def dataset_name(path: str) -> str:
    """A dataset is always named without folder and extension."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def register(spark: SparkSession, path: str, df: DataFrame | None = None) -> str:
    """Make a table available to ``spark.sql`` under its dataset name."""
    name = dataset_name(path)
    (df if df is not None else spark.read.parquet(path)).createOrReplaceTempView(name)
    return name


def registered(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        table.name: spark.table(table.name)
        for table in spark.catalog.listTables()
        if table.isTemporary
    }


def list_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """Row, column and size summary of every dataset."""
    return for_each_dataset(datasets, table_profile)


def dataset_schema(datasets: dict[str, DataFrame]) -> DataFrame:
    """Name, type and distinct count of every column, as one JSON text per dataset."""
    columns = for_each_dataset(datasets, column_info)
    entry = F.struct(
        "position",
        F.struct(
            F.col("column").alias("name"),
            F.col("data_type").alias("type"),
            F.col("unique_count"),
        ).alias("entry"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"])
    return columns.groupBy("dataset").agg(F.to_json(ordered).alias("schema_json"))


def dataset_info(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows, column names, types, and which columns are numeric or categorical."""

    def build(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.lit(", ".join(df.columns)).alias("columns"),
            F.lit(", ".join(f"{n}: {t}" for n, t in df.dtypes)).alias("dtypes"),
            F.lit(", ".join(numeric_columns(df))).alias("numeric_columns"),
            F.lit(", ".join(string_columns(df))).alias("categorical_columns"),
        )

    return for_each_dataset(datasets, build)
