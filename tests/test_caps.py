"""What used to be cut off is whole, and limits that were asked for still hold."""

import numpy as np
from pyspark.sql import functions as F

from tabulary.functions import columns
from tabulary.operators import charts, chunks, conversations, stats


def test_history_is_whole_without_a_limit(spark):
    memory = spark.range(130).select(
        F.lit("s").alias("session_id"),
        F.lpad(F.col("id").cast("string"), 4, "0").alias("ts"),
        F.lit("user").alias("role"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("text"),
        F.lit("{}").alias("analysis_context"),
    )
    assert conversations.session_history(memory).count() == 130
    assert conversations.session_history(memory, 50).count() == 50


def test_adaptive_blocks_hold_every_row(spark):
    df = spark.range(1100).selectExpr("id", "concat('row', id) AS name")
    found = chunks.adaptive_row_chunks(df, ["id"], "t").collect()
    text = "\n".join(row["text"] for row in found)
    assert all(f"name=row{n};" in text for n in range(1100))
    shown = chunks.adaptive_row_chunks(df, ["id"], "t", sampled=5).collect()
    assert sum(row["text"].count("Record ") for row in shown) == 5 * len(shown)
    assert sum(row["chunk_size"] for row in shown) == 1100


def test_charts_without_a_limit(spark):
    df = spark.range(300).selectExpr("concat('c', id % 30) AS c", "cast(id AS double) AS v")
    assert charts.pie_shares(df, "c", None).count() == 30
    assert charts.box_by_category(df, "c", "v", None).count() == 30
    assert charts.box_by_category(df, "c", "v").count() == 10
    shapes = [("d", n, f"n{n}", "numeric") for n in range(6)]
    profiles = spark.createDataFrame(
        shapes, "dataset string, position int, column string, column_class string"
    )
    assert charts.chart_suggestions(profiles, None).count() == 6 * 2 + 15
    assert charts.chart_suggestions(profiles).count() == 8


def test_sums_of_whole_numbers_are_exact(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big,), (1,), (-big,), (2,)], "v long")
    assert stats.column_stat(df, "v", "sum").first()["value"] == 3.0


def test_correlations_with_gaps_and_constants(spark):
    source = np.random.default_rng(4)
    x, y = source.normal(1e9, 1, 500), source.normal(0, 1, 500)
    y = y + 0.5 * (x - 1e9)
    rows = [(float(a), float(b) if n % 3 else None, 0.1) for n, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    found = {
        (r["column_a"], r["column_b"]): r["correlation"]
        for r in stats.correlation_matrix(df).collect()
    }
    kept = np.arange(500) % 3 > 0
    wanted = np.corrcoef(x[kept], y[kept])[0, 1]
    assert abs(found["x", "y"] - wanted) < 1e-6 and found["x", "y"] == found["y", "x"]
    assert found["x", "x"] == 1.0
    assert found["x", "c"] is None or np.isnan(found["x", "c"])


def test_sides_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    def broadcast(df, **options):
        plan = df.sparkSession.range(10).join(columns.small_side(df, **options), "id")
        return "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow, wide = spark.range(50), spark.range(50).withColumn("t", F.repeat(F.lit("x"), 100))
        assert broadcast(narrow) and broadcast(wide) and broadcast(wide, store=True)
        assert not broadcast(narrow, rows=20)
        monkeypatch.setattr(columns, "BROADCAST_BYTES", 4000)
        assert broadcast(narrow) and not broadcast(wide) and not broadcast(wide, store=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
