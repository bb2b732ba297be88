"""Sources, sinks and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.plans.catalogue import TABLES, all_tables, query, rounded, table, union_all
from tabulary.session import scratch_path
from tabulary.sources import catalog, readers, sinks


@query(
    "read_csv",
    """
    SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS part_name_1, p_size AS size_in,
           p_retailprice AS retail_price
    FROM part
    """,
)
def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "part-csv")
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias(" Part Key "),
        F.col("p_name").alias("Part Name"),
        F.col("p_brand").alias("Part-Name"),
        F.col("p_size").alias("SIZE (in"),
        F.col("p_retailprice").alias("Retail  Price"),
    )
    part.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path, clean_names=True).select(
        "part_key", "part_name", "part_name_1", F.col("size__in").alias("size_in"), "retail_price"
    )


@query("encoding_fallback", "SELECT conv_id, turn, role, text FROM conversations")
def encoding_fallback(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "conversations-latin1")
    talk = table(spark, folder, "conversations")
    talk.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(
        path
    )
    return readers.read_csv(spark, path, schema=talk.schema, multi_line=True)


@query("read_table", "SELECT * FROM nation")
def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_table(spark, f"{folder}/nation.parquet")


_INT_COLUMNS = {
    "r_regionkey",
    "n_nationkey",
    "n_regionkey",
    "c_nationkey",
    "s_nationkey",
    "p_size",
    "l_linenumber",
    "label",
    "quality",
    "toxic",
}


def _bytes_sql(name: str, kind: str) -> str:
    if kind == "s":
        return f"coalesce(octet_length(encode({name})), 0)"
    if kind == "a":
        return f"coalesce(len({name}) * 4, 0)"
    width = 4 if name in _INT_COLUMNS else 8
    return f"CASE WHEN {name} IS NULL THEN 0 ELSE {width} END"


def profile_sql(source: str, columns: dict[str, str]) -> str:
    filled = " + ".join(f"count({c})" for c in columns)
    memory = " + ".join(f"sum({_bytes_sql(c, k)})" for c, k in columns.items())
    n = len(columns)
    return (
        f"SELECT count(*) AS row_count, CAST({n} AS BIGINT) AS column_count, "
        f"round(CAST({memory} AS DOUBLE) / (1024.0 * 1024.0), 6) AS memory_mb, "
        f"round(CAST({filled} AS DOUBLE) / (count(*) * {n}), 6) AS data_density FROM {source}"
    )


@query(
    "list_datasets",
    union_all(
        [f"SELECT '{t}' AS dataset, * FROM ({profile_sql(t, c)})" for t, c in TABLES.items()]
    ),
)
def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    for name, df in all_tables(spark, folder).items():
        catalog.register(spark, f"{folder}/{name}.parquet", df)
    named = {name: df for name, df in catalog.registered(spark).items() if name in TABLES}
    return rounded(catalog.list_datasets(named), "memory_mb", "data_density", places=6)


def _type_of(name: str, kind: str) -> str:
    if kind == "i":
        return "int" if name in _INT_COLUMNS else "bigint"
    return {"d": "double", "s": "string", "t": "timestamp_ntz", "a": "array<float>"}[kind]


_SCHEMA_TABLES = tuple(TABLES)


def _schema_sql(name: str) -> str:
    entries = " || ',' || ".join(
        f"""'{{"name":"{c}","type":"{_type_of(c, k)}","unique_count":' """
        f"|| count(DISTINCT {c}) || '}}'"
        for c, k in TABLES[name].items()
    )
    return f"SELECT '{name}' AS dataset, '[' || {entries} || ']' AS schema_json FROM {name}"


@query("dataset_schema", union_all([_schema_sql(name) for name in _SCHEMA_TABLES]))
def dataset_schema(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.dataset_schema({n: table(spark, folder, n) for n in _SCHEMA_TABLES})


def _info_sql(name: str) -> str:
    columns = TABLES[name]
    return (
        f"SELECT '{name}' AS dataset, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS n_columns, "
        f"'{', '.join(columns)}' AS columns, "
        f"'{', '.join(f'{c}: {_type_of(c, k)}' for c, k in columns.items())}' AS dtypes, "
        f"'{', '.join(c for c, k in columns.items() if k in 'id')}' AS numeric_columns, "
        f"'{', '.join(c for c, k in columns.items() if k == 's')}' AS categorical_columns "
        f"FROM {name}"
    )


@query("dataset_info", union_all([_info_sql(name) for name in TABLES]))
def dataset_info(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.dataset_info(all_tables(spark, folder))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return readers.preview(table(spark, folder, "orders"), ["o_orderkey"])


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return readers.row_count(table(spark, folder, "lineitem"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Search results made of documents: some hold data rows, some a chart."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "data_row").otherwise("text").alias("type"),
        F.col("text").alias("content"),
        F.when(F.col("n_chars") > 1000, F.sha2("text", 256)).alias("chart_data"),
        "lang",
        "source",
    )


@query("write_csv", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def write_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "results-csv")
    sinks.write_csv(_results(spark, folder), path, ["doc_id", "lang", "source"])
    return readers.read_csv(spark, path, schema="doc_id long, lang string, source string")


@query(
    "write_json",
    """
    SELECT doc_id, CASE WHEN lang = 'en' THEN 'data_row' ELSE 'text' END AS type, text AS content,
           CASE WHEN n_chars > 1000 THEN '<base64_image_data_removed>' END AS chart_data,
           (SELECT count(*) FROM documents) AS total_results
    FROM documents
    """,
)
def write_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "results-json")
    results = _results(spark, folder).drop("lang", "source")
    sinks.write_json(results, path)
    envelope = spark.read.schema("timestamp string, total_results long").json(f"{path}/envelope")
    total = envelope.select("total_results").scalar()
    return spark.read.schema(results.schema).json(f"{path}/results").withColumn(
        "total_results", total
    )


@query(
    "result_summary",
    """
    SELECT row_number() OVER (ORDER BY doc_id) AS result_no,
           CASE WHEN lang = 'en' THEN 'data_row' ELSE 'text' END AS type,
           CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS content,
           CASE WHEN n_chars > 1000 THEN 'Yes' ELSE 'No' END AS has_chart
    FROM documents
    """,
)
def result_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.result_summary(_results(spark, folder), ["doc_id"])
