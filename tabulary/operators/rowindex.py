"""A dense row index over an explicit order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.session import written

PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above 33 row bits
_ROW_MASK = (1 << PARTITION_SHIFT) - 1


def with_row_index(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index", start: int = 0
) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the given order.

    The keys together must be unique. One range sort does the work; the sorted rows are
    written once, because counting and numbering have to see the same partitions. The
    offsets are one number per sort partition.
    """
    ordered = df.orderBy(*order_by).withColumn("_seq", F.monotonically_increasing_id())
    stored = written(ordered, "ordered")
    part = F.shiftright("_seq", PARTITION_SHIFT).alias("_part")
    counts = sorted(
        (row["_part"], row["_rows"])
        for row in stored.groupBy(part).agg(F.count(F.lit(1)).alias("_rows")).collect()
    )
    offsets, total = [], start
    for number, rows in counts:
        offsets.append((number, total))
        total += rows
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    position = F.col("_offset") + F.col("_seq").bitwiseAND(F.lit(_ROW_MASK))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, position)
        .select(*df.columns, name)
    )


def with_number_in_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], name: str
) -> DataFrame:
    """``df`` with consecutive numbers from 1 within each key, in the given order.

    One range sort by key and order, so the rows of a hot key lie in as many partitions as they
    fill. A row per key and partition says how many rows of the key come before; rows meet it by
    both, so no task has to take in a whole key. Rows alike in key and order may be numbered
    either way.
    """
    ordered = df.orderBy(*keys, *order_by).withColumn("_seq", F.monotonically_increasing_id())
    # Counting and numbering have to see the same partitions.
    stored = written(ordered, "ordered").withColumn(
        "_part", F.shiftright("_seq", PARTITION_SHIFT)
    )
    pieces = stored.groupBy(*keys, "_part").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        *[F.col(key).alias(f"_key{i}") for i, key in enumerate(keys)],
        F.col("_part").alias("_piece"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    met = F.col("_part") == F.col("_piece")
    for i, key in enumerate(keys):
        met = met & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return stored.join(pieces, met).select(*df.columns, (F.col("_seq") + F.col("_shift")).alias(name))
