"""Profiles and summaries kept current while files keep arriving.

Every micro-batch overwrites a folder of its own number, so a repeated batch changes nothing.
Increments are compacted: ten batches make a folder of the next level, ten of those one of the
level after it. Reading takes the fewest folders that cover all batches, at most nine a level.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.operators.chunks import build_chunks
from tabulary.operators.conversations import conversation_topics
from tabulary.operators.profile import column_measures


#: Folders of one level that are compacted into one of the next.
FAN = 10
Merge = Callable[[DataFrame], DataFrame]


def arriving_files(
    spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", 1000)
        .parquet(folder)
    )


def arriving_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files of a table that is one file or a folder of part files."""
    # Spark streams from folders only, but a pattern may match either; this one matches the path itself.
    return arriving_files(spark, f"{path[:-1]}[{path[-1]}]", schema)


def run_available(
    stream: DataFrame,
    build: Callable[[DataFrame, int], DataFrame],
    output: str,
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process what has arrived: ``build(batch, n)`` goes to ``output/batch_no=<n>``."""

    def store(batch: DataFrame, number: int) -> None:
        build(batch, number).write.mode("overwrite").parquet(f"{output}/batch_no={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()


def _folder(output: str, level: int, part: int) -> str:
    return f"{output}/level={level}/part={part}"


def cover(batches: int) -> list[tuple[int, int]]:
    """The fewest ``(level, part)`` that hold the increments of so many batches."""
    found, done, level = [], 0, 0
    while FAN ** (level + 1) <= batches:
        level += 1
    for level in range(level, -1, -1):
        size = FAN**level
        while done + size <= batches:
            found.append((level, done // size))
            done += size
    return found


def run_compacted(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], merge: Merge, output: str, checkpoint: str
) -> DataFrame:
    """The merged increments ``build(batch)`` of everything that has arrived, now and before.

    ``merge`` adds up increments; what it returns can be merged again. Compacting reads folders
    that no later batch changes, so a batch that is repeated writes the same folders again.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        build(batch).write.mode("overwrite").parquet(_folder(output, 0, number))
        level = 1
        while (number + 1) % FAN**level == 0:
            part = number // FAN**level
            parts = [_folder(output, level - 1, part * FAN + place) for place in range(FAN)]
            merged = merge(spark.read.parquet(*parts))
            merged.write.mode("overwrite").parquet(_folder(output, level, part))
            level += 1

    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    files = spark.read.parquet(f"{output}/level=0").inputFiles()
    batches = 1 + max(int(re.search(r"/part=(\d+)/", file)[1]) for file in files)
    return merge(spark.read.parquet(*[_folder(output, *place) for place in cover(batches)]))


def ingest_profile(stream: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Column measures of everything ingested so far, added up over the batches."""

    def measures(batch: DataFrame) -> DataFrame:
        found = column_measures(batch)
        return found.withColumn("total_length", F.col("avg_length") * F.col("non_null"))

    def added(increments: DataFrame) -> DataFrame:
        return increments.groupBy("position", "column", "data_type").agg(
            F.sum("row_count").alias("row_count"),
            F.sum("non_null").alias("non_null"),
            F.sum("total_length").alias("total_length"),
            F.max("max_length").alias("max_length"),
        )

    found = run_compacted(stream, measures, added, output, checkpoint)
    average = F.try_divide(F.col("total_length"), F.col("non_null"))
    return found.select(
        "position", "column", "data_type", "row_count", "non_null", average.alias("avg_length"), "max_length"
    )


def ingest_chunks(
    stream: DataFrame, source: str, order_by: Sequence[str], output: str, checkpoint: str
) -> DataFrame:
    """All chunks of everything ingested so far; the chunks of a batch name it in their source."""
    run_available(
        stream,
        lambda batch, number: build_chunks(batch, f"{source}-{number}", order_by),
        output,
        checkpoint,
    )
    return stream.sparkSession.read.parquet(output)


def session_increments(batch: DataFrame) -> DataFrame:
    """What a batch adds to each session: messages, user queries, and topics it names."""
    counts = batch.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_queries"),
    )
    counts = counts.select(
        "session_id",
        *(F.lit(None).cast("string").alias(name) for name in ("kind", "name")),
        "total_messages",
        "user_queries",
    )
    if "analysis_context" not in batch.columns:
        return counts
    none = F.lit(0).cast("long")
    topics = conversation_topics(batch).select(
        "session_id", "kind", "name", none.alias("total_messages"), none.alias("user_queries")
    )
    return counts.unionByName(topics)


def session_summary(messages: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Current totals per session: the increments of all batches added up.

    A message counts whenever it arrives, however old it is; what is kept are a few numbers per
    session and the names of its topics.
    """

    def added(increments: DataFrame) -> DataFrame:
        return increments.groupBy("session_id", "kind", "name").agg(
            F.sum("total_messages").alias("total_messages"),
            F.sum("user_queries").alias("user_queries"),
        )

    found = run_compacted(messages, session_increments, added, output, checkpoint)
    # One row for each session, kind and name is left.
    return found.groupBy("session_id").agg(
        F.sum("total_messages").alias("total_messages"),
        F.sum("user_queries").alias("user_queries"),
        F.count_if(F.col("kind") == "dataset").alias("n_datasets"),
        F.count_if(F.col("kind") == "query_type").alias("n_query_types"),
    )
