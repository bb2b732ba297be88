"""Cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.text import STOPWORDS
from tabulary.operators import profile
from tabulary.plans.catalogue import (
    LABELLED_COLUMNS,
    LABELLED_SQL,
    TABLES,
    all_tables,
    labelled_documents,
    query,
    rounded,
    table,
    union_all,
)
from tabulary.plans.tables import _bytes_sql, _type_of, profile_sql

DATE_RE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
NUMBER_RE = r"^\s*-?\d+\.?\d*\s*$"


def text_of(name: str) -> str:
    return f"CAST({name} AS VARCHAR)"


@query(
    "prepare",
    "SELECT " + ", ".join(
        f"coalesce({text_of(c)}, '') AS {c}" for c in LABELLED_COLUMNS
    ) + f" FROM {LABELLED_SQL}",
)
def prepare(spark: SparkSession, folder: str) -> DataFrame:
    frame = labelled_documents(spark, folder).withColumn("empty", F.lit(None).cast("double"))
    return profile.prepare(frame)


@query("table_profile", profile_sql(LABELLED_SQL, LABELLED_COLUMNS))
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        profile.table_profile(labelled_documents(spark, folder)),
        "memory_mb",
        "data_density",
        places=6,
    )


def _nulls_sql() -> str:
    cells = union_all(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS n "
            f"FROM {LABELLED_SQL}"
            for c in LABELLED_COLUMNS
        ]
    )
    return (
        f"WITH cells AS ({cells}) SELECT \"column\", null_count, "
        "round(null_count * 100.0 / n, 4) AS null_pct, "
        "round((SELECT sum(null_count) * 100.0 / sum(n) FROM cells), 4) AS total_null_pct, "
        "round((SELECT avg(null_count * 100.0 / n) FROM cells), 4) AS avg_null_pct FROM cells"
    )


@query("null_profile", _nulls_sql())
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        profile.null_profile(labelled_documents(spark, folder)),
        "null_pct",
        "total_null_pct",
        "avg_null_pct",
    )


@query(
    "unique_ratio",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
            f"count({c}) AS non_null, "
            f"round(coalesce(CAST(count(DISTINCT {c}) AS DOUBLE) / nullif(count({c}), 0), 0), 4) "
            f"AS unique_ratio FROM {LABELLED_SQL}"
            for c in LABELLED_COLUMNS
        ]
    ),
)
def unique_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.unique_ratio(labelled_documents(spark, folder)), "unique_ratio")


@query(
    "column_info",
    union_all(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", "
            f"'{_type_of(c, k)}' AS data_type, count({c}) AS non_null, "
            f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count "
            "FROM lineitem"
            for i, (c, k) in enumerate(TABLES["lineitem"].items())
        ]
    ),
)
def column_info(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_info(table(spark, folder, "lineitem"))


def class_sql(source: str, name: str, kind: str) -> str:
    if kind in "id":
        decided = "'numeric'"
    elif kind == "t":
        decided = "'date'"
    else:
        length = f"avg(length({name}))" if kind == "s" else "0"
        dates = f"avg(regexp_matches({name}, '{DATE_RE}')::INT)" if kind == "s" else "0"
        numbers = f"avg(regexp_matches({name}, '{NUMBER_RE}')::INT)" if kind == "s" else "0"
        decided = (
            f"CASE WHEN {dates} > 0.7 THEN 'date' WHEN {numbers} > 0.8 THEN 'numeric' "
            f"WHEN {length} > 50 OR CAST(count(DISTINCT {name}) AS DOUBLE) / count({name}) > 0.9 "
            "THEN 'text' ELSE 'categorical' END"
        )
    return f"CASE WHEN count({name}) = 0 THEN 'unknown' ELSE {decided} END"


def classes_sql(tables: dict[str, dict[str, str]]) -> str:
    return union_all(
        [
            f"SELECT '{t}' AS dataset, CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", "
            f"{class_sql(t, c, k)} AS column_class FROM {t}"
            for t, columns in tables.items()
            for i, (c, k) in enumerate(columns.items())
        ]
    )


def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date and price as text, so that classes have to be found."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("order_name"),
        "o_orderpriority",
    )


DATED_ORDERS_SQL = (
    "(SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day_text, "
    "CAST(o_totalprice AS VARCHAR) AS price_text, 'order ' || o_orderkey AS order_name, "
    "o_orderpriority FROM orders)"
)
DATED_ORDERS_COLUMNS = {
    "o_orderkey": "i",
    "day_text": "s",
    "price_text": "s",
    "order_name": "s",
    "o_orderpriority": "s",
}


@query(
    "column_type_class",
    classes_sql(TABLES)
    + "\nUNION ALL\n"
    + union_all(
        [
            f"SELECT 'dated_orders' AS dataset, CAST({i} AS INTEGER) AS position, "
            f"'{c}' AS \"column\", {class_sql('', c, k)} AS column_class FROM {DATED_ORDERS_SQL}"
            for i, (c, k) in enumerate(DATED_ORDERS_COLUMNS.items())
        ]
    ),
)
def column_type_class(spark: SparkSession, folder: str) -> DataFrame:
    datasets = all_tables(spark, folder) | {"dated_orders": dated_orders(spark, folder)}
    return profile.classes_of(datasets).select(
        "dataset", "position", "column", "column_class"
    )


BASE_TABLES = tuple(TABLES)
BASE_COLUMNS = {name: TABLES[name] for name in BASE_TABLES}


@query(
    "column_type_counts",
    f"SELECT dataset, column_class, count(*) AS n_columns FROM ({classes_sql(BASE_COLUMNS)}) "
    "GROUP BY dataset, column_class",
)
def column_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    profiles = profile.classes_of({name: table(spark, folder, name) for name in BASE_TABLES})
    return profile.column_type_counts(profiles, ["dataset"])


@query(
    "text_column_deep",
    f"""
    WITH words AS (
        SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
    top AS (
        SELECT word, count(*) AS n FROM words
        WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})
        GROUP BY word ORDER BY n DESC, word LIMIT 5)
    SELECT 'text' AS "column", round(avg(length(text)), 4) AS avg_length,
           max(length(text)) AS max_length,
           (SELECT string_agg(word, ', ' ORDER BY n DESC, word) FROM top) AS common_words
    FROM documents
    """,
)
def text_column_deep(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return rounded(profile.text_column_deep(documents, ["text"]), "avg_length")


@query(
    "common_words",
    f"""
    SELECT 'text' AS "column", word, count(*) AS n,
           CAST(row_number() OVER (ORDER BY count(*) DESC, word) AS INTEGER) AS rank
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word
          FROM documents)
    WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})
    GROUP BY word ORDER BY n DESC, word LIMIT 5
    """,
)
def common_words(spark: SparkSession, folder: str) -> DataFrame:
    return profile.common_words(table(spark, folder, "documents"), ["text"])


@query(
    "avg_text_length",
    "SELECT round(CAST("
    + " + ".join(f"sum(coalesce(length({text_of(c)}), 0))" for c in LABELLED_COLUMNS)
    + f" AS DOUBLE) / (count(*) * {len(LABELLED_COLUMNS)}), 4) AS avg_text_length "
    f"FROM {LABELLED_SQL}",
)
def avg_text_length(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        profile.avg_text_length(labelled_documents(spark, folder)), "avg_text_length"
    )


_SAMPLED = TABLES["customer"]


@query(
    "sample_values",
    union_all(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", "
            f"CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS rank, "
            f"{text_of(c)} AS value, count(*) AS n FROM customer WHERE {c} IS NOT NULL "
            f"GROUP BY {c} QUALIFY rank <= 10)"
            for c in _SAMPLED
        ]
    ),
)
def sample_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.sample_values(table(spark, folder, "customer"))


def overview_sql(name: str, source: str, columns: dict[str, str]) -> str:
    """One row like ``dataset_overview``; missing shares from the cells of ``source``."""
    memory = " + ".join(f"sum({_bytes_sql(c, k)})" for c, k in columns.items())
    filled = " + ".join(f"count({c})" for c in columns)
    n = len(columns)
    counts = ", ".join(
        "("
        + " + ".join(
            f"({class_sql(source, c, k)} = '{wanted}')::BIGINT" for c, k in columns.items()
        )
        + f") AS {wanted}_columns"
        for wanted in ("numeric", "text", "categorical", "date")
    )
    missing = " + ".join(f"(count(*) - count({c})) * 100.0 / count(*)" for c in columns)
    return (
        f"SELECT '{name}' AS dataset, count(*) AS row_count, CAST({n} AS BIGINT) AS column_count, "
        f"CAST({memory} AS DOUBLE) / (1024.0 * 1024.0) AS memory_mb, "
        f"CAST({filled} AS DOUBLE) / (count(*) * {n}) AS data_density, {counts}, "
        f"({missing}) / {n} AS avg_null_pct, "
        f"(1 - CAST({filled} AS DOUBLE) / (count(*) * {n})) * 100.0 AS total_null_pct "
        f"FROM {source}"
    )


OVERVIEWS_SQL = union_all(
    [overview_sql(t, t, c) for t, c in BASE_COLUMNS.items()]
    + [overview_sql("labelled_documents", LABELLED_SQL, LABELLED_COLUMNS)]
)


def overviews(spark: SparkSession, folder: str) -> DataFrame:
    datasets = {name: table(spark, folder, name) for name in BASE_TABLES}
    datasets["labelled_documents"] = labelled_documents(spark, folder)
    return profile.for_each_dataset(datasets, profile.dataset_overview)


def strategy_sql(columns: str = "*") -> str:
    sizes = {
        "max_chunk_size": (500, 200, 1000),
        "min_chunk_size": (100, 50, 200),
        "overlap_size": (25, 20, 50),
        "strategy_type": ("'adaptive'", "'content_aware'", "'adaptive'"),
    }
    chosen = ", ".join(
        f"CASE WHEN memory_mb > 100 OR row_count > 10000 THEN {a} "
        f"WHEN text_columns > 2 THEN {b} ELSE {c} END AS {name}"
        for name, (a, b, c) in sizes.items()
    )
    return f"SELECT dataset, {chosen} FROM ({OVERVIEWS_SQL})"


@query("chunk_strategy", strategy_sql())
def chunk_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return profile.chunk_strategy(overviews(spark, folder))


def notes_sql(notes: list[str], name: str) -> str:
    return (
        f"WITH listed AS (SELECT dataset, list_filter([{', '.join(notes)}], lambda x: x IS NOT NULL) AS l "
        f"FROM ({OVERVIEWS_SQL})) "
        f"SELECT dataset, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS note_no, "
        f"unnest(l) AS {name} FROM listed"
    )


@query(
    "data_insights",
    notes_sql(
        [
            "'Dataset contains ' || row_count || ' rows and ' || column_count || ' columns'",
            "CASE WHEN data_density > 0.8 THEN 'High data density detected - minimal missing values' "
            "WHEN data_density < 0.5 THEN "
            "'Low data density - significant missing values may require attention' END",
            "CASE WHEN numeric_columns > 0 THEN 'Found ' || numeric_columns || "
            "' numeric columns suitable for statistical analysis' END",
            "CASE WHEN text_columns > 0 THEN 'Found ' || text_columns || "
            "' text columns suitable for semantic search' END",
            "CASE WHEN total_null_pct > 10 THEN 'Data has ' || printf('%.1f', total_null_pct) || "
            "'% missing values - consider data cleaning' ELSE 'Good data quality - only ' || "
            "printf('%.1f', abs(total_null_pct)) || '% missing values' END",
        ],
        "insight",
    ),
)
def data_insights(spark: SparkSession, folder: str) -> DataFrame:
    return profile.data_insights(overviews(spark, folder))


@query(
    "stat_recommendations",
    notes_sql(
        [
            "CASE WHEN numeric_columns >= 2 THEN "
            "'Consider correlation analysis between numeric columns' END",
            "CASE WHEN numeric_columns > 0 THEN "
            "'Visualize distributions with histograms or box plots' END",
            "CASE WHEN numeric_columns > 0 THEN 'Check for outliers in numeric data' END",
            "CASE WHEN text_columns + categorical_columns > 0 THEN "
            "'Analyze categorical distributions with bar charts' END",
            "CASE WHEN numeric_columns > 0 AND text_columns + categorical_columns > 0 THEN "
            "'Explore relationships between categorical and numeric variables' END",
        ],
        "recommendation",
    ),
)
def stat_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return profile.stat_recommendations(overviews(spark, folder))
