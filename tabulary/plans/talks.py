"""Conversation, query-log and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators import conversations
from tabulary.operators.questions import search_type
from tabulary.plans.catalogue import TABLES, query, rounded, table, union_all
from tabulary.plans.questions import QUESTIONS_SQL, event_question, search_type_sql
from tabulary.session import scratch_path
from tabulary.streaming import streams


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages: system turns carry no session name and no time."""
    system = F.col("role") == "system"
    user = F.col("role") == "user"
    return table(spark, folder, "conversations").select(
        F.when(~system, F.col("conv_id").cast("string")).alias("session_id"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("ts"),
        F.when(~user, F.col("role")).alias("role"),
        "text",
        F.when(
            user,
            F.struct(
                F.lit("query").alias("type"),
                F.lit(None).cast("string").alias("dataset_name"),
                search_type(F.col("text")).alias("query_type"),
            ),
        ).alias("context"),
    )


@query(
    "memory_write",
    f"""
    SELECT CASE WHEN role = 'system' THEN 'unknown' ELSE CAST(conv_id AS VARCHAR) END AS session_id,
           lpad(CAST(turn AS VARCHAR), 6, '0') AS ts, role, text,
           CASE WHEN role = 'user' THEN '{{"type":"query","query_type":"' ||
                {search_type_sql("text")} || '"}}' ELSE '{{}}' END AS analysis_context
    FROM conversations
    """,
)
def memory_write(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "memory")
    conversations.memory_write(messages(spark, folder), path)
    return spark.read.parquet(path)


def memory(spark: SparkSession, folder: str) -> DataFrame:
    return remembered(table(spark, folder, "conversations"))


def remembered(conversations: DataFrame) -> DataFrame:
    """Remembered conversations: answers hold broken context, system turns a dataset."""
    dataset = F.concat(
        F.lit('{"type":"dataset_analysis","dataset_name":"set'),
        (F.col("conv_id") % 7).cast("string"),
        F.lit('"}'),
    )
    asked = F.concat(
        F.lit('{"type":"query","query_type":"'), search_type(F.col("text")), F.lit('"}')
    )
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("role") != "system", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("ts"),
        "role",
        "text",
        F.when(F.col("role") == "system", dataset)
        .when(F.col("role") == "user", asked)
        .otherwise("not json")
        .alias("analysis_context"),
    )


MEMORY_SQL = (
    "(SELECT CAST(conv_id AS VARCHAR) AS session_id, "
    "CASE WHEN role <> 'system' THEN lpad(CAST(turn AS VARCHAR), 6, '0') END AS ts, role, text, "
    "CASE role WHEN 'system' THEN 'dataset_analysis' WHEN 'user' THEN 'query' END AS context_type, "
    "CASE WHEN role = 'system' THEN 'set' || (conv_id % 7) END AS dataset_name, "
    f"CASE WHEN role = 'user' THEN {search_type_sql('text')} END AS query_type FROM conversations)"
)


@query(
    "session_history",
    f"""
    SELECT session_id, ts, role, text, context_type, dataset_name, query_type,
           row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, text) AS message_no
    FROM {MEMORY_SQL}
    """,
)
def session_history(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.session_history(memory(spark, folder)).select(
        "session_id",
        "ts",
        "role",
        "text",
        F.col("context.type").alias("context_type"),
        F.col("context.dataset_name").alias("dataset_name"),
        F.col("context.query_type").alias("query_type"),
        "message_no",
    )


@query(
    "conversation_summary",
    f"""
    SELECT session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_queries,
           count(DISTINCT dataset_name) AS n_datasets, count(DISTINCT query_type) AS n_query_types
    FROM {MEMORY_SQL} GROUP BY session_id
    """,
)
def conversation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversation_summary(memory(spark, folder))


@query(
    "conversation_topics",
    f"""
    SELECT DISTINCT session_id, 'dataset' AS kind, dataset_name AS name FROM {MEMORY_SQL}
    WHERE dataset_name IS NOT NULL
    UNION ALL
    SELECT DISTINCT session_id, 'query_type', query_type FROM {MEMORY_SQL}
    WHERE query_type IS NOT NULL
    """,
)
def conversation_topics(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversation_topics(memory(spark, folder))


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """The questions events ask, with how each one went."""
    return table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (F.col("value") / 100).alias("response_time"),
        F.concat(F.lit("answer "), F.col("props")).alias("answer"),
        F.lit("no answer").alias("message"),
        event_question().alias("query"),
    )


LOG_SQL = (
    "(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type <> 'error' AS success, "
    "event_type = 'view' AS cache_hit, value / 100 AS response_time, 'answer ' || props AS answer, "
    f"question AS query FROM events JOIN {QUESTIONS_SQL} ON qid = 'e' || event_id)"
)


@query(
    "query_success_rate",
    f"SELECT round(avg(success::INT) * 100, 4) AS success_rate, count(*) AS total_queries FROM {LOG_SQL}",
)
def query_success_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(conversations.query_success_rate(query_log(spark, folder)), "success_rate")


@query(
    "recent_queries",
    f"""
    SELECT ts, CASE WHEN length(query) > 50 THEN substring(query, 1, 50) || '...' ELSE query END AS query,
           CASE WHEN success THEN substring(answer, 1, 100) || '...' ELSE 'no answer' END AS result
    FROM (SELECT * FROM {LOG_SQL} ORDER BY ts DESC, query LIMIT 5)
    """,
)
def recent_queries(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.recent_queries(query_log(spark, folder))


@query(
    "search_perf_stats",
    f"""
    SELECT count(*) FILTER (WHERE NOT cache_hit) AS total_queries,
           round(avg(response_time) FILTER (WHERE NOT cache_hit), 6) AS avg_response_time,
           round(CAST(count(*) FILTER (WHERE cache_hit) AS DOUBLE)
                 / greatest(count(*) FILTER (WHERE NOT cache_hit), 1), 6) AS cache_hit_rate
    FROM {LOG_SQL}
    """,
)
def search_perf_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        conversations.search_perf_stats(query_log(spark, folder)),
        "avg_response_time",
        "cache_hit_rate",
        places=6,
    )


@query(
    "stream_ingest_profile",
    union_all(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count(*) AS row_count, "
            f"count({c}) AS non_null, "
            + (f"round(avg(length({c})), 4)" if k == "s" else "NULL")
            + " AS avg_length, "
            + (f"CAST(max(length({c})) AS INTEGER)" if k == "s" else "NULL")
            + " AS max_length FROM events"
            for i, (c, k) in enumerate(TABLES["events"].items())
        ]
    ),
)
def stream_ingest_profile(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = streams.arriving_table(spark, f"{folder}/events.parquet", schema)
    profile = streams.ingest_profile(
        stream, scratch_path(spark, "stream-profile"), scratch_path(spark, "stream-progress")
    )
    return rounded(profile.drop("data_type"), "avg_length")


@query(
    "stream_ingest_chunks",
    """
    SELECT 'rows' AS chunk_type, CAST(ceil(count(*) / 500.0) AS BIGINT) AS n_chunks,
           CAST(count(*) AS DOUBLE) AS n_rows FROM part
    UNION ALL SELECT 'column', 6, NULL
    UNION ALL SELECT 'summary', 1, NULL
    """,
)
def stream_ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "part").schema
    stream = streams.arriving_table(spark, f"{folder}/part.parquet", schema)
    made = streams.ingest_chunks(
        stream,
        "part",
        ["p_partkey"],
        scratch_path(spark, "stream-chunks"),
        scratch_path(spark, "stream-progress"),
    )
    return made.groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.col("meta")["chunk_size"].cast("double")).alias("n_rows"),
    )


@query(
    "stream_session_summary",
    f"""
    SELECT session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_queries,
           count(DISTINCT dataset_name) AS n_datasets, count(DISTINCT query_type) AS n_query_types
    FROM {MEMORY_SQL} GROUP BY session_id
    """,
)
def stream_session_summary(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "conversations").schema
    stream = streams.arriving_table(spark, f"{folder}/conversations.parquet", schema)
    return streams.session_summary(
        remembered(stream),
        scratch_path(spark, "stream-sessions"),
        scratch_path(spark, "stream-progress"),
    )
