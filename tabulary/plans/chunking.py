"""Chunk-building queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.text import preprocess_text
from tabulary.operators import chunks
from tabulary.plans.catalogue import (
    LABELLED_COLUMNS,
    LABELLED_SQL,
    TABLES,
    labelled_documents,
    query,
    rounded,
    table,
)
from tabulary.plans.profiles import class_sql, overview_sql, text_of
from tabulary.session import scratch_path


def lines_sql(columns: list[str], joiner: str) -> str:
    return " || ".join(
        f"CASE WHEN length(trim({text_of(c)})) > 0 THEN ' {c}{joiner}' || {text_of(c)} || ';' "
        "ELSE '' END"
        for c in columns
    )


_ORDERS = list(TABLES["orders"])


@query(
    "row_chunks",
    f"""
    WITH i AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, * FROM orders),
    l AS (SELECT row_index, row_index // 1000 AS chunk_no,
                 'Row ' || row_index || ':' || {lines_sql(_ORDERS, ": ")} AS line FROM i)
    SELECT 'orders' AS source, chunk_no, CAST(0 AS INTEGER) AS chunk_part, min(row_index) AS chunk_start_row,
           max(row_index) AS chunk_end_row, count(*) AS chunk_size,
           'Data Table:' || chr(10) || 'Columns: {", ".join(_ORDERS)}' || chr(10) || chr(10)
           || string_agg(line, chr(10) ORDER BY row_index) AS text
    FROM l GROUP BY chunk_no
    """,
)
def row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.row_chunks(table(spark, folder, "orders"), ["o_orderkey"], "orders")


def adaptive_sql(source: str, key: str, size: int) -> str:
    """Blocks of ``size`` rows of a table in the order of its key."""
    columns = list(TABLES[source])
    return f"""
    WITH n AS (SELECT count(*) AS total, {size} AS size FROM {source}),
    i AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS row_index, * FROM {source}, n),
    p AS (SELECT *, row_index // size AS chunk_no, row_index % size AS place,
                 least(size, total - (row_index // size) * size) AS rows FROM i),
    l AS (SELECT *, 'Record ' || row_index || ':' || {lines_sql(columns, "=")} AS line FROM p)
    SELECT '{source}' AS source, chunk_no, CAST(0 AS INTEGER) AS chunk_part, min(row_index) AS chunk_start_row,
           max(row_index) AS chunk_end_row, any_value(rows) AS chunk_size,
           CAST(any_value(size) AS INTEGER) AS adaptive_chunk_size,
           'Data segment with ' || any_value(rows) || ' rows and {len(columns)} columns' || chr(10)
           || 'Columns: {", ".join(columns)}' || chr(10) || chr(10)
           || string_agg(line, chr(10) ORDER BY row_index) AS text
    FROM l GROUP BY chunk_no
    """


@query("adaptive_row_chunks", adaptive_sql("customer", "c_custkey", 500))
def adaptive_row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.adaptive_row_chunks(table(spark, folder, "customer"), ["c_custkey"], "customer")


def _column_chunk_sql(source: str, relation: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, k) in enumerate(columns.items()):
        kind = class_sql(relation, c, k)
        number = f"TRY_CAST({text_of(c)} AS DOUBLE)"
        numeric = (
            f"printf('Statistics: mean=%.2f, median=%.2f', avg({number}), median({number})) || chr(10) "
            f"|| printf('Range: %.2f to %.2f', min({number}), max({number})) || chr(10)"
        )
        text = (
            f"printf('Text length: average=%.1f, max=%d', avg(length({text_of(c)})), "
            f"max(length({text_of(c)}))) || chr(10)"
        )
        parts.append(
            f"SELECT '{source}' AS source, '{c}' AS column_name, CAST({i} AS INTEGER) AS position, "
            f"{kind} AS data_type, count(DISTINCT {c}) AS unique_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_percentage, "
            f"'Column ''{c}'' analysis:' || chr(10) || 'Type: ' || {kind} || chr(10) || "
            f"'Unique values: ' || count(DISTINCT {c}) || chr(10) || "
            f"'Missing data: ' || printf('%.1f', (count(*) - count({c})) * 100.0 / count(*)) || '%' "
            f"|| chr(10) || CASE {kind} WHEN 'numeric' THEN {numeric} WHEN 'text' THEN {text} "
            f"ELSE '' END || 'Sample values: ' || (SELECT string_agg({text_of(c)}, ', ' ORDER BY {c}) "
            f"FROM (SELECT DISTINCT {c} FROM {relation} WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 10)) "
            f"AS text FROM {relation}"
        )
    return "\nUNION ALL\n".join(parts)


@query("column_chunks", _column_chunk_sql("labelled_documents", LABELLED_SQL, LABELLED_COLUMNS))
def column_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = chunks.column_chunks(labelled_documents(spark, folder), "labelled_documents")
    return rounded(found, "null_percentage")


def summary_sql(name: str, source: str, columns: dict[str, str]) -> str:
    classes = ", ".join(f"(SELECT {class_sql(source, c, k)} FROM {source})" for c, k in columns.items())
    return f"""
    WITH o AS ({overview_sql(name, source, columns)}),
    c AS (SELECT unnest([{classes}]) AS k, generate_subscripts([{classes}], 1) AS i),
    t AS (SELECT string_agg(k || ': ' || n, ', ' ORDER BY f) AS types
          FROM (SELECT k, count(*) AS n, min(i) AS f FROM c GROUP BY k))
    SELECT dataset AS source, 'Comprehensive Dataset Analysis:' || chr(10)
           || 'Shape: ' || row_count || ' rows × ' || column_count || ' columns' || chr(10)
           || printf('Memory usage: %.2f MB', memory_mb) || chr(10)
           || printf('Data density: %.1f', data_density * 100) || '%' || chr(10)
           || 'Column types: ' || types || chr(10)
           || printf('Average missing data: %.1f', avg_null_pct) || '%' AS text
    FROM o, t
    """


@query("summary_chunk", summary_sql("labelled_documents", LABELLED_SQL, LABELLED_COLUMNS))
def summary_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.summary_chunk(labelled_documents(spark, folder), "labelled_documents")


@query(
    "chunk_prefix",
    """
    SELECT doc_id, CASE lang
        WHEN 'en' THEN 'Column analysis for ''' || source || ''' (type: ' || lang || '): ' || text
        WHEN 'de' THEN 'Dataset summary for ''' || source || ''': ' || text
        WHEN 'fr' THEN 'Data rows ' || doc_id || '-' || n_chars || ': ' || text
        ELSE text END AS text
    FROM documents
    """,
)
def chunk_prefix(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.col("lang") == "en", "column")
        .when(F.col("lang") == "de", "summary")
        .when(F.col("lang") == "fr", "rows")
        .otherwise("other")
    )
    return table(spark, folder, "documents").select(
        "doc_id",
        chunks.chunk_prefix(
            kind,
            F.col("text"),
            source=F.col("source"),
            column_name=F.col("source"),
            data_type=F.col("lang"),
            start=F.col("doc_id"),
            end=F.col("n_chars"),
        ).alias("text"),
    )


def preprocess_sql(text: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace({text}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'),
        '\b(nan|null|none|n/a)\b', '[MISSING]', 'gi'),
        '\b\d+\.\d+\b', '[NUMBER]', 'g'), '\b\d+\b', '[INTEGER]', 'g'))"""


@query("preprocess_text", f"SELECT doc_id, {preprocess_sql('text')} AS text FROM documents")
def preprocess(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", preprocess_text(F.col("text")).alias("text")
    )


@query(
    "chunk_metrics",
    """
    SELECT lang AS chunk_type, count(*) AS n_chunks, round(avg(length(text)), 4) AS avg_chunk_size,
           round(CAST(count(vec_id) AS DOUBLE) / count(*), 4) AS stored_ratio
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang
    """,
)
def chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.lit(True).alias("stored")
    )
    made = (
        table(spark, folder, "documents")
        .join(stored, "doc_id", "left")
        .select(F.col("lang").alias("chunk_type"), "text", F.coalesce("stored", F.lit(False)).alias("stored"))
    )
    return rounded(chunks.chunk_metrics(made), "avg_chunk_size", "stored_ratio")


@query(
    "flatten_metadata",
    """
    SELECT o_orderkey, o_orderstatus AS info_status, CAST(o_custkey AS BIGINT) AS info_customer,
           o_orderstatus || ', ' || o_orderpriority AS info_tags,
           CAST(o_orderdate AS VARCHAR) AS info_day, o_orderpriority || ', ' || o_orderstatus AS tags
    FROM orders
    """,
)
def flatten_metadata(spark: SparkSession, folder: str) -> DataFrame:
    nested = table(spark, folder, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("customer"),
            F.array("o_orderstatus", "o_orderpriority").alias("tags"),
            F.col("o_orderdate").alias("day"),
        ).alias("info"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
    )
    return chunks.flatten_metadata(nested)


def json_sql(cells: dict[str, str]) -> str:
    """A JSON object of texts."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in cells.items()) + " || '}'"


_BLOCK_META = json_sql({c: c for c in ("chunk_start_row", "chunk_end_row", "chunk_size")})
_COLUMN_META = json_sql(
    {c: f"CAST({c} AS VARCHAR)" for c in ("column_name", "data_type", "unique_count", "null_percentage")}
)
_SUMMARY_META = json_sql({"summary_type": "'comprehensive_overview'"})


CHUNKS_OF_PART_SQL = f"""
WITH r AS ({adaptive_sql("part", "p_partkey", 500)}),
c AS ({_column_chunk_sql("part", "part", TABLES["part"])}),
s AS ({summary_sql("part", "part", TABLES["part"])}),
every AS (
SELECT 'part-rows-' || chunk_no AS chunk_id, 'rows' AS chunk_type, source, text,
       'Data rows ' || chunk_start_row || '-' || chunk_end_row || ': ' || text AS prefixed,
       {_BLOCK_META} AS meta FROM r
UNION ALL
SELECT 'part-column-' || column_name, 'column', source, text,
       'Column analysis for ''' || column_name || ''' (type: ' || data_type || '): ' || text,
       {_COLUMN_META} FROM c
UNION ALL
SELECT 'part-summary-overview', 'summary', source, text,
       'Dataset summary for ''' || source || ''': ' || text, {_SUMMARY_META} FROM s)
SELECT chunk_id, chunk_type, source, text, {preprocess_sql("prefixed")} AS embed_text, meta FROM every
"""


@query("build_chunks", CHUNKS_OF_PART_SQL)
def build_chunks(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    built = chunks.build_chunks(table(spark, folder, "part"), "part", ["p_partkey"])
    chunks.write_chunks(built, path)
    return spark.read.parquet(path).withColumn("meta", F.to_json("meta"))
