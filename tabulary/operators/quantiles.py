"""Exact interpolated quantiles with constant state per task and group.

``percentile`` keeps every distinct value of a group in one hash map, and a sketch that must
bracket a quantile ever more closely grows with the rows. Here histograms narrow down where a
rank lies: the first one by power of two and eight bits below it, the next by equal widths inside
the bin that holds the rank. A bin carries its count, minimum and maximum, so a rank is known as
soon as its bin holds one value or the rank is at its edge. Histograms have a fixed size and are
combined before the shuffle; at most six passes are needed, mostly two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.columns import name_at, quoted, small_side, stacked
from tabulary.session import written

#: Bits below the power of two in the first histogram, and bins of the following ones.
FINE = 256
BINS = 4096
#: More than any exponent of a double, so that shifted ones are above zero.
EXPONENTS = 1100
INFINITE = 1 << 40


def first_bin(value: Column) -> Column:
    """The bin of a number: rises with the number, as logarithm and floor never fall."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    fine = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * FINE)
    place = (exponent + EXPONENTS) * (2 * FINE) + F.greatest(F.lit(-1), F.least(F.lit(FINE), fine))
    place = F.when(size == float("inf"), F.lit(INFINITE)).otherwise(place)
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * (place + 2))


def _histogram(values: DataFrame, group: Sequence[Column], place: Column) -> DataFrame:
    return values.groupBy(*group, place.cast("long").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_least"),
        F.max("value").alias("_most"),
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(by..., column, probability, value)``; missing values are skipped."""
    by = list(by)
    groups = [quoted(name) for name in by]
    values = stacked(df, columns, by).filter(F.col("value").isNotNull())
    group = [*groups, F.col("column_no")]
    counted = _histogram(values, group, first_bin(F.col("value")))
    ordered = W.partitionBy(*group).orderBy("_bin").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    counted = counted.withColumn("_end", F.sum("_n").over(ordered)).withColumn(
        "_all", F.sum("_n").over(W.partitionBy(*group))
    )
    chances = F.array(*[F.lit(float(p)) for p in probabilities])
    position = (F.col("_all") - 1) * F.get(chances, F.col("_p"))
    wanted = F.explode(F.array(F.floor(position), F.ceil(position))).alias("_rank")
    ranks = (
        counted.select("*", F.posexplode(chances).alias("_p", "_chance"))
        .select("*", wanted)
        .filter((F.col("_end") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
        .select(
            *group,
            "_p",
            "_rank",
            (position - F.floor(position)).alias("_share"),
            (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_at"),
            "_n",
            "_least",
            "_most",
        )
        .distinct()
    )
    ranks = _kept(ranks, by)
    passes = 0
    while not ranks.filter(_known().isNull()).isEmpty():
        passes += 1
        if passes == 2:
            # From here on only what lies in an open bin is read, and the input no more.
            values = written(_inside(values, ranks, by).select(*group, "value"), "open")
        ranks = _kept(_narrowed(values, ranks, by), by)
    known = F.struct("_rank", _known().alias("_value"))
    found = ranks.groupBy(*group, "_p").agg(
        F.min(known)["_value"].alias("_lower"),
        F.max(known)["_value"].alias("_upper"),
        F.first("_share").alias("_share"),
    )
    lower, upper = F.col("_lower"), F.col("_upper")
    # Of two equal values, infinite ones too, the value itself.
    value = F.when(lower == upper, lower).otherwise(lower + (upper - lower) * F.col("_share"))
    return found.select(
        *groups,
        name_at(columns, F.col("column_no")).alias("column"),
        F.get(chances, F.col("_p")).alias("probability"),
        value.cast("double").alias("value"),
    )


def _kept(ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranks as they stand: a few rows per column, or a written table where there are groups."""
    if by:
        return written(ranks, "ranks")
    return ranks.sparkSession.createDataFrame(ranks.collect(), ranks.schema)


def _known() -> Column:
    """The value at a rank if its bin tells: one value in it, or the rank at an edge."""
    return F.when(
        (F.col("_least") == F.col("_most")) | (F.col("_at") == 0), F.col("_least")
    ).when(F.col("_at") == F.col("_n") - 1, F.col("_most"))


def _inside(values: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values that lie in a bin that doesn't tell yet, with the bin's bounds."""
    keys = [f"_k{j}" for j in range(len(by))]
    bins = ranks.filter(_known().isNull()).select(
        *[quoted(name).alias(key) for name, key in zip(by, keys, strict=True)],
        F.col("column_no").alias("_c"),
        F.col("_least").alias("_low"),
        F.col("_most").alias("_high"),
    ).distinct()
    bins = small_side(bins, store=True) if by else F.broadcast(bins)
    inside = (
        (F.col("column_no") == F.col("_c"))
        & (F.col("value") >= F.col("_low"))
        & (F.col("value") <= F.col("_high"))
    )
    for name, key in zip(by, keys, strict=True):
        inside = inside & quoted(name).eqNullSafe(F.col(key))
    return values.join(bins, inside)


def _narrowed(values: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranks with the bin of the next histogram, drawn inside the bins that don't tell yet."""
    keys = [f"_k{j}" for j in range(len(by))]
    open_ = ranks.filter(_known().isNull())
    step = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS
    place = F.least(F.floor(step), F.lit(BINS - 1))
    group = [*[quoted(name) for name in by], F.col("column_no"), F.col("_low")]
    counted = _histogram(_inside(values, ranks, by), group, place)
    ordered = W.partitionBy(*group).orderBy("_bin").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    counted = counted.withColumn("_end", F.sum("_n").over(ordered)).select(
        *[quoted(name).alias(key) for name, key in zip(by, keys, strict=True)],
        F.col("column_no").alias("_c"),
        "_low",
        "_end",
        F.col("_n").alias("_new_n"),
        F.col("_least").alias("_new_least"),
        F.col("_most").alias("_new_most"),
    )
    held = (
        (F.col("column_no") == F.col("_c"))
        & (F.col("_least") == F.col("_low"))
        & (F.col("_at") >= F.col("_end") - F.col("_new_n"))
        & (F.col("_at") < F.col("_end"))
    )
    for name, key in zip(by, keys, strict=True):
        held = held & quoted(name).eqNullSafe(F.col(key))
    groups = [*[quoted(name) for name in by], F.col("column_no")]
    moved = open_.join(counted, held).select(
        *groups,
        "_p",
        "_rank",
        "_share",
        (F.col("_at") - F.col("_end") + F.col("_new_n")).alias("_at"),
        F.col("_new_n").alias("_n"),
        F.col("_new_least").alias("_least"),
        F.col("_new_most").alias("_most"),
    )
    return ranks.filter(_known().isNotNull()).unionByName(moved)


def quantile_struct(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles in wide form: ``(by..., column, q1, median, q3)``."""
    long = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
    keys = [*[quoted(n) for n in by], F.col("column")]

    def pick(p: float) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("value")))

    return long.groupBy(*keys).agg(
        pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")
    )


