"""How quality filters interact: what each removes in every order in which they may run.

A document is told by the set of filters it fails, so the table shrinks to one cell per part and
set of failures, the mask. The orders are one array. Each cell folds over every order with
``aggregate``, which carries whether its documents are still there, and yields one struct a step;
the cells of a part, at most 2 ** filters, are merged by sums element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.llm.common import picked
from tabulary.session import written

# What separates words, and the characters counted as marks.
SPACE = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP = f"struct<{','.join(f'{name}:bigint' for name in MEASURES)}>"


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")


def shouting(text: Column, words: Column) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return 100 * capitals > 5 * F.length(text).cast("long")


def marked(text: Column, words: Column) -> Column:
    return text.rlike(MARKS)


Condition = Callable[[Column, Column], Column]
#: When a text fails a filter, by letter. Copies of an earlier document have the letter after.
CONDITIONS: dict[str, Condition] = {
    "A": few_words,
    "B": repetitive,
    "C": shouting,
    "D": marked,
}
COPY = "E"


def failures(
    df: DataFrame,
    id_col: str,
    text_col: str,
    part_col: str,
    conditions: dict[str, Condition],
) -> DataFrame:
    """``doc_id, part, fails, digest``: bit n of ``fails`` is set if condition n is met."""
    docs = picked(df, doc_id=id_col, text=text_col, part=part_col).select(
        "doc_id",
        F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    words = F.filter(F.split("text", SPACE), lambda word: word != "")
    worded = docs.withColumn("words", words)
    fails = F.lit(0)
    for number, fail in enumerate(conditions.values()):
        bit = F.when(fail(F.col("text"), F.col("words")), 1 << number).otherwise(0)
        fails = fails.bitwiseOR(bit)
    return worded.select(
        "doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")
    )


def cells(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """``part, fails, n, good, toxic``: documents of each mask, and how many have the labels."""
    one = rows.groupBy("doc_id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("n"))
    named = one.filter(F.col("doc_id").isNotNull())
    # The first of equal texts is found by digest and id together, so no text is a hot key.
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    seen = named.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    labelled = seen.join(known, "doc_id", "left").select(
        "part",
        F.when(F.col("first"), F.col("fails"))
        .otherwise(F.col("fails").bitwiseOR(F.lit(1 << copy_bit)))
        .alias("fails"),
        "n",
        F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"),
    )
    none = F.lit(0).cast("long")
    nameless = one.filter(F.col("doc_id").isNull()).select(
        "part", "fails", "n", none.alias("good"), none.alias("toxic")
    )
    sums = (F.sum(name).alias(name) for name in ("n", "good", "toxic"))
    return labelled.unionByName(nameless).groupBy("part", "fails").agg(*sums)


def step_of(cell: Column, there: Column, fails: Column, alone: Column) -> Column:
    """The struct of one step: the cell's documents counted under what happens to them."""
    removed = there & fails
    counts = {
        "kept": (there & ~fails, "n"),
        "removed": (removed, "n"),
        "redundant": (~there & fails, "n"),
        "unique_fails": (alone, "n"),
        "good_lost": (removed, "good"),
        "toxic_lost": (removed, "toxic"),
    }
    return F.struct(
        *(F.when(case, cell[n]).otherwise(0).alias(name) for name, (case, n) in counts.items())
    )


def folded(cell: Column, orders: Column) -> Column:
    """A struct for every step of every order, in that order."""

    def follow(state: Column, number: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), number)
        fails = cell["fails"].bitwiseAND(bit) != 0
        step = step_of(cell, state["there"], fails, cell["fails"] == bit)
        return F.struct(
            (state["there"] & ~fails).alias("there"),
            F.concat(state["steps"], F.array(step)).alias("steps"),
        )

    start = F.struct(
        F.lit(True).alias("there"), F.array().cast(f"array<{STEP}>").alias("steps")
    )
    walked = F.transform(
        orders, lambda order: F.aggregate(order, start, follow, lambda state: state["steps"])
    )
    return F.flatten(walked)


def added(one: Column, two: Column) -> Column:
    return F.struct(*((one[name] + two[name]).alias(name) for name in MEASURES))


def audit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    conditions: dict[str, Condition] | None = None,
) -> DataFrame:
    """What each filter does at every step of every order, counted per part of ``df``.

    One row per ``part, filter_order, step`` with ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing the filter, removed earlier), ``unique_fails`` (failing it alone),
    ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``: all the filter removes,
    over all orders. The last filter finds copies: texts equal to that of a smaller id.

    Null texts are empty, null parts are the empty string. Of rows with one id and text none is
    a copy of the other; a row without an id is no copy, makes no copy and has no label. A
    document is good or toxic if any of its labels says so; null labels say nothing. An empty
    table has no part and gives no row. Extra columns are not looked at.
    """
    conditions = CONDITIONS if conditions is None else conditions
    letters: Sequence[str] = [*conditions, COPY]
    marks = picked(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    rows = written(failures(df, id_col, text_col, part_col, conditions), "failures")
    parts = cells(rows, marks, len(conditions)).groupBy("part").agg(
        F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells")
    )
    every = list(permutations(range(len(letters))))
    orders = F.array(*(F.array(*map(F.lit, order)) for order in every))
    names = F.array(*(F.lit("".join(letters[n] for n in order)) for order in every))
    steps = len(every) * len(letters)
    zero = F.struct(*(F.lit(0).cast("long").alias(name) for name in MEASURES))
    merged = F.aggregate(
        "cells",
        F.array_repeat(zero, steps),
        lambda sums, cell: F.zip_with(sums, folded(cell, orders), added),
    )
    whole = parts.select("part", merged.alias("merged"), F.flatten(orders).alias("filters"))
    shapley = F.transform(
        F.sequence(F.lit(0), F.lit(len(letters) - 1)),
        lambda number: F.aggregate(
            F.zip_with(
                "merged",
                "filters",
                lambda step, own: F.when(own == number, step["removed"]).otherwise(0),
            ),
            F.lit(0).cast("long"),
            lambda total, removed: total + removed,
        ),
    )
    rows = whole.select("part", "filters", shapley.alias("shapley"), F.posexplode("merged"))
    order = F.floor(F.col("pos") / len(letters)).cast("int")
    return rows.select(
        "part",
        F.get(names, order).alias("filter_order"),
        (F.col("pos") % len(letters) + 1).cast("int").alias("step"),
        *(F.col(f"col.{name}").alias(name) for name in MEASURES),
        F.get("shapley", F.get("filters", F.col("pos"))).alias("shapley"),
    )
