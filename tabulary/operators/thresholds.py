"""How many values lie below, at and above each of many thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.columns import as_double, name_at, stacked
from tabulary.operators.rowindex import PARTITION_SHIFT
from tabulary.session import in_arrow, written

#: Thresholds that go to every task; more are sorted in among the values.
MOST_SHARED = 20_000
SCHEMA = "column string, threshold double, below long, equal long, above long"


def counts_at_thresholds(df: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(column, threshold, below, equal, above)`` for the distinct thresholds of ``conditions``.

    Up to ``MOST_SHARED`` thresholds go to every task, which counts its values between them, so
    no value is moved. Beyond that thresholds are mixed in among the distinct values, and one range
    sort puts them in order: sums per sort partition give every partition its offset. Either way
    it is one scan, and no group has to fit in a task.
    """
    wanted = conditions.select("column", F.col("threshold").cast("double").alias("value"))
    wanted = wanted.filter(F.col("value").isNotNull() & ~F.isnan("value")).distinct()
    wanted = written(wanted, "wanted")
    few = wanted.limit(MOST_SHARED + 1).collect()
    if len(few) <= MOST_SHARED:
        asked: dict[str, list[float]] = {}
        for row in few:
            asked.setdefault(row["column"], []).append(row["value"])
        return _between(df, {name: np.unique(values) for name, values in asked.items()})
    return _sorted_in(df, wanted)


def _between(df: DataFrame, asked: dict[str, np.ndarray]) -> DataFrame:
    """Counts at thresholds that every task knows; two counters for each of them are shuffled."""
    if not asked:
        return df.sparkSession.createDataFrame([], SCHEMA)
    names = sorted(asked)
    edges = [asked[name] for name in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each column: below the first, at it, between it and the second, and so on.
        held = [np.zeros(2 * len(own) + 1, dtype=np.int64) for own in edges]
        for batch in batches:
            for own, counts, column in zip(edges, held, batch.columns, strict=True):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                place = np.searchsorted(own, values)
                at = own[np.minimum(place, len(own) - 1)] == values
                counts += np.bincount(2 * place + at, minlength=len(counts))
        numbers = np.repeat(np.arange(len(held), dtype=np.int32), [len(counts) for counts in held])
        places = np.concatenate([np.arange(len(counts), dtype=np.int32) for counts in held])
        found = np.concatenate(held)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[some]), pa.array(places[some]), pa.array(found[some])],
            names=["column_no", "place", "n"],
        )

    cells = df.select(*[as_double(df.schema[name]).alias(f"v{i}") for i, name in enumerate(names)])
    counted = in_arrow(cells, count, "column_no int, place int, n long")
    totals = [np.zeros(2 * len(own) + 1, dtype=np.int64) for own in edges]
    for row in counted.groupBy("column_no", "place").agg(F.sum("n").alias("n")).collect():
        totals[row["column_no"]][row["place"]] = row["n"]
    rows = []
    for name, own, counts in zip(names, edges, totals, strict=True):
        upto = np.cumsum(counts)
        for number, value in enumerate(own.tolist()):
            below, equal = int(upto[2 * number]), int(counts[2 * number + 1])
            rows.append((name, value, below, equal, int(upto[-1]) - below - equal))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _sorted_in(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts at any number of thresholds, by a sort of the distinct values and thresholds."""
    # At most as many names as the table has columns.
    names = sorted(row["column"] for row in wanted.select("column").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, names)), F.col("column")) - 1
    counted = (
        stacked(df, names)
        .filter(F.col("value").isNotNull())
        .groupBy("column_no", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("asked"))
    )
    asked = wanted.select(
        number.cast("int").alias("column_no"), "value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")
    )
    merged = (
        counted.unionByName(asked)
        .groupBy("column_no", "value")
        .agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        .orderBy("column_no", "value")
        .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), PARTITION_SHIFT))
    )
    # Sums and places have to see the same partitions.
    stored = written(merged, "thresholds")
    before = W.partitionBy("column_no").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = stored.groupBy("_part", "column_no").agg(F.sum("n").alias("_sum")).select(
        "_part",
        "column_no",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy("column_no")).alias("_all"),
    )
    own = W.partitionBy("_part", "column_no").orderBy("value")
    upto = F.sum("n").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = stored.withColumn("_upto", upto).filter("asked").join(sums, ["_part", "column_no"])
    below = F.col("_offset") + F.col("_upto") - F.col("n")
    return placed.select(
        name_at(names, F.col("column_no")).alias("column"),
        F.col("value").alias("threshold"),
        below.alias("below"),
        F.col("n").alias("equal"),
        (F.col("_all") - below - F.col("n")).alias("above"),
    )
