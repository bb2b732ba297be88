"""Result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.operators.rowindex import with_row_index

# The marker that stands for a chart, the summary cut and its ellipsis.
CHART_MARKER = "<base64_image_data_removed>"
SUMMARY_LENGTH = 100
ELLIPSIS = "..."


def write_csv(results: DataFrame, path: str, data_columns: Sequence[str], **options: str) -> None:
    """Data rows as CSV; if ``results`` holds none, its ``content`` as plain lines."""
    rows = results.filter(F.col("type") == "data_row").select(*data_columns)
    if rows.isEmpty():
        results.select(F.coalesce("content", F.lit("")).alias("value")).write.text(path)
    else:
        rows.write.option("header", True).option("escape", '"').options(**options).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """``results`` as JSON lines with charts replaced, and a one-row envelope beside them."""
    if "chart_data" in results.columns:
        marked = F.when(F.col("chart_data").isNotNull(), F.lit(CHART_MARKER))
        results = results.withColumn("chart_data", marked)
    results.write.json(f"{path}/results")
    written = results.sparkSession.read.schema(results.schema).json(f"{path}/results")
    written.agg(
        F.current_timestamp().cast("string").alias("timestamp"),
        F.count(F.lit(1)).alias("total_results"),
    ).write.json(f"{path}/envelope")


def result_summary(results: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Number, type, shortened content and chart flag of every result."""
    # What is shown of a row goes through the sort, beside what orders it.
    order = {f"_order{i}": F.col(name) for i, name in enumerate(order_by)}
    shown = results.select(
        *[column.alias(name) for name, column in order.items()],
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.substring(F.coalesce("content", F.lit("")), 1, SUMMARY_LENGTH + 1).alias("content"),
        F.when(F.col("chart_data").isNotNull(), "Yes").otherwise("No").alias("has_chart"),
    )
    content = F.col("content")
    shortened = F.concat(F.substring(content, 1, SUMMARY_LENGTH), F.lit(ELLIPSIS))
    return with_row_index(shown, list(order), start=1).select(
        F.col("row_index").alias("result_no"),
        "type",
        F.when(F.length(content) > SUMMARY_LENGTH, shortened).otherwise(content).alias("content"),
        "has_chart",
    )
