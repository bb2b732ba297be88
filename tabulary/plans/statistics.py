"""Column statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators import stats
from tabulary.plans.catalogue import (
    LABELLED_SQL,
    TABLES,
    labelled_documents,
    query,
    rounded,
    table,
    union_all,
)

NUMERIC = [c for c, k in TABLES["lineitem"].items() if k in "id"]

STAT_SQL = {
    "mean": "avg({c})",
    "median": "median({c})",
    "sum": "coalesce(sum({c}), 0)",
    "min": "min({c})",
    "max": "max({c})",
    "count": "count({c})",
    "std": "stddev_samp({c})",
    "var": "var_samp({c})",
}


def stat_sql(source: str, column: str, stat: str) -> str:
    value = STAT_SQL[stat].format(c=column)
    return (
        f"SELECT '{column}' AS \"column\", '{stat}' AS stat, "
        f"round(CAST({value} AS DOUBLE), 4) AS value FROM {source}"
    )


def exact_stat_sql(source: str, column: str, stat: str) -> str:
    """With the digits of sums and extremes of whole numbers."""
    whole = TABLES[source][column] == "i" and stat in ("sum", "min", "max")
    exact = f"CAST({stat}({column}) AS VARCHAR)" if whole else "CAST(NULL AS VARCHAR)"
    return stat_sql(source, column, stat).replace(" AS value FROM", f" AS value, {exact} AS exact FROM")


def _add_stat(name: str, stat: str, source: str, column: str) -> None:
    @query(name, stat_sql(source, column, stats.STAT_ALIASES[stat]))
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(stats.column_stat(table(spark, folder, source), column, stat), "value")


_add_stat("stat_mean", "average", "lineitem", "l_extendedprice")
_add_stat("stat_median", "median", "lineitem", "l_extendedprice")
_add_stat("stat_sum", "total", "lineitem", "l_quantity")
_add_stat("stat_min", "minimum", "orders", "o_totalprice")
_add_stat("stat_max", "maximum", "orders", "o_totalprice")
_add_stat("stat_std", "std", "lineitem", "l_extendedprice")
_add_stat("stat_var", "variance", "events", "value")


@query("stat_count", stat_sql(LABELLED_SQL, "quality", "count"))
def stat_count(spark: SparkSession, folder: str) -> DataFrame:
    return stats.column_stat(labelled_documents(spark, folder), "quality", "count")


@query(
    "stats_table",
    union_all([exact_stat_sql("lineitem", c, s) for c in NUMERIC for s in STAT_SQL]),
)
def stats_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.stats_table(table(spark, folder, "lineitem")), "value")


@query("row_count_answer", "SELECT count(*) AS row_count FROM orders")
def row_count_answer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "conditional_count",
    "SELECT count(*) FILTER (WHERE l_quantity > 30) AS matching, count(*) AS total FROM lineitem",
)
def conditional_count(spark: SparkSession, folder: str) -> DataFrame:
    return stats.conditional_count(table(spark, folder, "lineitem"), "l_quantity", ">", 30)


@query(
    "value_range",
    "SELECT min(o_totalprice) AS min_value, max(o_totalprice) AS max_value FROM orders",
)
def value_range(spark: SparkSession, folder: str) -> DataFrame:
    return stats.value_range(table(spark, folder, "orders"), "o_totalprice")


@query(
    "superlative_row",
    "(SELECT 'highest' AS superlative, * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) "
    "UNION ALL "
    "(SELECT 'lowest' AS superlative, * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1)",
)
def superlative_row(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    highest = stats.superlative_row(customers, "c_acctbal", "c_custkey")
    lowest = stats.superlative_row(customers, "c_acctbal", "c_custkey", largest=False)
    return highest.select(F.lit("highest").alias("superlative"), "*").unionByName(
        lowest.select(F.lit("lowest").alias("superlative"), "*")
    )


@query(
    "unique_count",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM orders"
            for c in TABLES["orders"]
        ]
    ),
)
def unique_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return stats.unique_count(orders, orders.columns)


@query(
    "avg_by_group",
    "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_totalprice "
    "FROM orders GROUP BY o_orderpriority",
)
def avg_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        stats.aggregate_by(
            table(spark, folder, "orders"),
            ["o_orderpriority"],
            n=F.count(F.lit(1)),
            avg_totalprice=F.avg("o_totalprice"),
        ),
        "avg_totalprice",
    )


@query(
    "correlation_pair",
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem",
)
def correlation_pair(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return rounded(
        stats.correlation_pair(lineitem, "l_quantity", "l_extendedprice"), "correlation", places=6
    )


@query(
    "describe_numeric",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, "
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
            f"round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, "
            f"round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem"
            for c in NUMERIC
        ]
    ),
)
def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        stats.describe_numeric(table(spark, folder, "lineitem")),
        *("mean", "std", "q1", "median", "q3"),
    )


_COERCED = {
    "props": "regexp_extract(props, '[0-9]+$|[0-9]+', 0)",
    "event_type": "event_type",
    "value": "CAST(value AS VARCHAR)",
}


@query(
    "numeric_column_deep",
    union_all(
        [
            f"SELECT '{name}' AS \"column\", "
            + ", ".join(
                f"round(coalesce({f}, 0.0), 4) AS {alias}"
                for alias, f in {
                    "mean": "avg(x)",
                    "median": "median(x)",
                    "std": "stddev_samp(x)",
                    "min": "min(x)",
                    "max": "max(x)",
                }.items()
            )
            + f" FROM (SELECT TRY_CAST({text} AS DOUBLE) AS x FROM events)"
            for name, text in _COERCED.items()
        ]
    ),
)
def numeric_column_deep(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "events").select(
        F.regexp_extract("props", "[0-9]+", 0).alias("props"),
        "event_type",
        F.col("value").cast("string").alias("value"),
    )
    return rounded(
        stats.coerced_stats(texts, texts.columns), *("mean", "median", "std", "min", "max")
    )


FENCES_SQL = (
    "SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) "
    "AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) "
    "AS hi FROM {t}"
)


@query(
    "outliers",
    "SELECT * FROM events WHERE value < (SELECT lo FROM ({f})) OR value > (SELECT hi FROM ({f}))".format(
        f=FENCES_SQL.format(c="value", t="events")
    ),
)
def outliers(spark: SparkSession, folder: str) -> DataFrame:
    return stats.outliers(table(spark, folder, "events"), "value")


_ANALYZED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _analysis_sql() -> str:
    parts = []
    described = {
        "count": "count({c})",
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "min({c})",
        "q1": "quantile_cont({c}, 0.25)",
        "median": "median({c})",
        "q3": "quantile_cont({c}, 0.75)",
        "max": "max({c})",
    }
    for c in _ANALYZED:
        for item, f in described.items():
            parts.append(
                f"SELECT 'descriptive' AS analysis_type, '{c}' AS \"column\", '{item}' AS item, "
                f"round(CAST({f.format(c=c)} AS DOUBLE), 4) AS value FROM lineitem"
            )
        for other in _ANALYZED:
            if c < other:
                parts.append(
                    f"SELECT 'correlation', '{c}', '{other}', "
                    f"round(corr({c}, {other}), 4) FROM lineitem"
                )
        parts.append(
            f"SELECT 'distribution', '{c}', 'bin ' || b.bin, CAST(count(x.bin) AS DOUBLE) "
            f"FROM range(20) b(bin) LEFT JOIN (SELECT least(floor(({c} - lo) / ((hi - lo) / 20.0)), 19) "
            f"AS bin FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)) x "
            "ON x.bin = b.bin GROUP BY b.bin"
        )
        fences = FENCES_SQL.format(c=c, t="lineitem")
        parts.append(
            f"SELECT 'outliers', '{c}', 'outlier_count', CAST(count(*) AS DOUBLE) FROM lineitem, "
            f"({fences}) WHERE {c} < lo OR {c} > hi"
        )
    return union_all(parts)


@query("analyze_statistics", _analysis_sql())
def analyze_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        stats.analyze_statistics(
            table(spark, folder, "lineitem"),
            _ANALYZED,
            ("descriptive", "correlation", "distribution", "outliers"),
        ),
        "value",
    )
