"""The registry of named queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Columns of the test tables and what kind each one is
# (i whole number, d fraction, s text, t time, a list of floats).
TABLES = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {
        "c_custkey": "i",
        "c_name": "s",
        "c_nationkey": "i",
        "c_acctbal": "d",
        "c_mktsegment": "s",
    },
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"},
    "part": {
        "p_partkey": "i",
        "p_name": "s",
        "p_brand": "s",
        "p_type": "s",
        "p_size": "i",
        "p_retailprice": "d",
    },
    "orders": {
        "o_orderkey": "i",
        "o_custkey": "i",
        "o_orderstatus": "s",
        "o_totalprice": "d",
        "o_orderdate": "t",
        "o_orderpriority": "s",
    },
    "lineitem": {
        "l_orderkey": "i",
        "l_partkey": "i",
        "l_suppkey": "i",
        "l_linenumber": "i",
        "l_quantity": "d",
        "l_extendedprice": "d",
        "l_discount": "d",
        "l_tax": "d",
        "l_returnflag": "s",
        "l_linestatus": "s",
        "l_shipdate": "t",
    },
    "events": {
        "event_id": "i",
        "ts": "t",
        "user_id": "i",
        "event_type": "s",
        "value": "d",
        "props": "s",
    },
    "documents": {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i"},
    "embeddings": {"vec_id": "i", "embedding": "a", "label": "i"},
    "pages": {"page_id": "i", "url": "s", "html": "s"},
    "benchmark": {"item_id": "i", "text": "s"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "s", "text": "s"},
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; without SQL only its rows can be checked."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Doubles cut to the digits on which two engines agree."""
    return df.withColumns({name: F.round(F.col(name), places) for name in columns})


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most have none, so this table holds nulls."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


LABELLED_SQL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
LABELLED_COLUMNS = {
    "doc_id": "i",
    "text": "s",
    "lang": "s",
    "source": "s",
    "n_chars": "i",
    "quality": "i",
    "toxic": "i",
}


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
