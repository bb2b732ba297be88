"""Conversation memory and query-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.operators.rowindex import with_number_in_key

# Defaults of a remembered message, and how much a list of queries shows.
UNKNOWN_SESSION = "unknown"
DEFAULT_ROLE = "user"
RECENT_QUERIES = 5
QUERY_LENGTH = 50
ANSWER_LENGTH = 100

CONTEXT_SCHEMA = "type string, dataset_name string, query_type string"


def memory_rows(messages: DataFrame) -> DataFrame:
    """Messages as they are remembered: defaults filled in, the context as JSON text.

    ``messages`` has ``session_id, ts, role, text, context`` with ``context`` a struct or map.
    """
    return messages.select(
        F.coalesce("session_id", F.lit(UNKNOWN_SESSION)).alias("session_id"),
        F.coalesce("ts", F.current_timestamp().cast("string")).alias("ts"),
        F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.to_json("context"), F.lit("{}")).alias("analysis_context"),
    )


def memory_write(messages: DataFrame, path: str) -> None:
    memory_rows(messages).write.mode("append").parquet(path)


def with_context(memory: DataFrame) -> DataFrame:
    """Memory with its context parsed; text that is no JSON gives null."""
    return memory.withColumn("context", F.from_json("analysis_context", CONTEXT_SCHEMA))


def session_history(memory: DataFrame, limit: int | None = None) -> DataFrame:
    """The messages of every session in time order, those without a time first.

    With ``limit`` only so many of the first messages of each session. A session may hold any
    share of all messages: its numbers are put together from several tasks.
    """
    order = [F.col("ts").asc_nulls_first(), F.col("text"), F.col("role"), F.col("analysis_context")]
    numbered = with_number_in_key(memory, ["session_id"], order, "message_no")
    return with_context(
        numbered if limit is None else numbered.filter(F.col("message_no") <= limit)
    )


def conversation_topics(memory: DataFrame) -> DataFrame:
    """Datasets analysed and kinds of queries asked, one row each per session."""
    context = with_context(memory).select(
        "session_id",
        F.when(F.col("context.type") == "dataset_analysis", "dataset")
        .when(F.col("context.type") == "query", "query_type")
        .alias("kind"),
        F.when(F.col("context.type") == "dataset_analysis", F.col("context.dataset_name"))
        .when(F.col("context.type") == "query", F.col("context.query_type"))
        .alias("name"),
    )
    return context.filter(F.col("name").isNotNull()).distinct()


def conversation_summary(memory: DataFrame) -> DataFrame:
    """Messages, user queries and the number of datasets and kinds of queries per session."""
    counts = memory.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_queries"),
    )
    topics = (
        conversation_topics(memory)
        .groupBy("session_id")
        .agg(
            F.count_if(F.col("kind") == "dataset").alias("n_datasets"),
            F.count_if(F.col("kind") == "query_type").alias("n_query_types"),
        )
    )
    return counts.join(topics, "session_id", "left").select(
        "session_id",
        "total_messages",
        "user_queries",
        F.coalesce("n_datasets", F.lit(0)).alias("n_datasets"),
        F.coalesce("n_query_types", F.lit(0)).alias("n_query_types"),
    )


def query_success_rate(log: DataFrame) -> DataFrame:
    return log.agg(
        (F.avg(F.col("success").cast("double")) * 100).alias("success_rate"),
        F.count(F.lit(1)).alias("total_queries"),
    )


def recent_queries(log: DataFrame, limit: int = RECENT_QUERIES) -> DataFrame:
    """The newest queries with shortened text and answer."""
    query = F.col("query")
    shortened = F.concat(F.substring(query, 1, QUERY_LENGTH), F.lit("..."))
    return (
        log.orderBy(F.col("ts").desc(), F.col("query"))
        .limit(limit)
        .select(
            "ts",
            F.when(F.length(query) > QUERY_LENGTH, shortened).otherwise(query).alias("query"),
            F.when(
                F.col("success"),
                F.concat(F.substring("answer", 1, ANSWER_LENGTH), F.lit("...")),
            )
            .otherwise(F.col("message"))
            .alias("result"),
        )
    )


def search_perf_stats(log: DataFrame) -> DataFrame:
    """Searches that were run, their mean time, and answers from the cache per search run."""
    run = ~F.col("cache_hit")
    searched = F.count_if(run)
    return log.agg(
        searched.alias("total_queries"),
        F.avg(F.when(run, F.col("response_time"))).alias("avg_response_time"),
        (F.count_if(F.col("cache_hit")) / F.greatest(searched, F.lit(1))).alias("cache_hit_rate"),
    )
