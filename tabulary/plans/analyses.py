"""Grouped and joined analyses users are promised, as plain DataFrame queries.

Measures are added up before each join, so that what a join shuffles has one row per key
and a hot key is combined where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.columns import small_side
from tabulary.operators.charts import histogram
from tabulary.operators.quantiles import exact_quantiles
from tabulary.plans.catalogue import query, rounded, table
from tabulary.plans.charts import histogram_sql

def sold() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def customer_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the number, sum and last day of their orders."""
    orders = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("o_totalprice").alias("total_spent"),
            F.max("o_orderdate").alias("last_order"),
        )
    )
    return table(spark, folder, "customer").join(orders, "c_custkey", "left")


CUSTOMER_MEASURES_SQL = (
    "(SELECT c.*, n_orders, total_spent, last_order FROM customer c LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spent, "
    "max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"
)


@query(
    "revenue_by_region",
    """
    SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           count(*) AS n_items
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name
    """,
)
def revenue_by_region(spark: SparkSession, folder: str) -> DataFrame:
    def add_up(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n"))

    by_order = add_up(
        table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), sold().alias("revenue"), F.lit(1).alias("n")
        ),
        "o_orderkey",
    )
    by_customer = add_up(
        by_order.join(
            table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")),
            "o_orderkey",
        ),
        "c_custkey",
    )
    by_nation = add_up(
        by_customer.join(
            table(spark, folder, "customer").select(
                "c_custkey", F.col("c_nationkey").alias("n_nationkey")
            ),
            "c_custkey",
        ),
        "n_nationkey",
    )
    by_region = add_up(
        by_nation.join(
            table(spark, folder, "nation").select(
                "n_nationkey", F.col("n_regionkey").alias("r_regionkey")
            ),
            "n_nationkey",
        ),
        "r_regionkey",
    )
    return (
        by_region.join(table(spark, folder, "region"), "r_regionkey")
        .select("r_name", F.round("revenue", 2).alias("revenue"), F.col("n").alias("n_items"))
        .orderBy(F.col("revenue").desc())
    )


def season(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when(month.isin(11, 12), "holiday")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(1, 2), "winter")
        .otherwise("regular")
    )


@query(
    "sales_by_season",
    """
    SELECT CASE WHEN month(l_shipdate) IN (11, 12) THEN 'holiday'
                WHEN month(l_shipdate) IN (6, 7, 8) THEN 'summer'
                WHEN month(l_shipdate) IN (1, 2) THEN 'winter' ELSE 'regular' END AS season,
           CAST(year(l_shipdate) AS INTEGER) AS year,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           sum(l_quantity) AS quantity
    FROM lineitem GROUP BY 1, 2
    """,
)
def sales_by_season(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("l_shipdate")
    return (
        table(spark, folder, "lineitem")
        .groupBy(season(day).alias("season"), F.year(day).alias("year"))
        .agg(F.round(F.sum(sold()), 2).alias("revenue"), F.sum("l_quantity").alias("quantity"))
    )


@query(
    "top_sellers",
    """
    SELECT s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY s_suppkey, s_name ORDER BY revenue DESC, s_suppkey LIMIT 10
    """,
)
def top_sellers(spark: SparkSession, folder: str) -> DataFrame:
    totals = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.round(F.sum(sold()), 2).alias("revenue"))
    )
    return (
        totals.join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
        .orderBy(F.col("revenue").desc(), "s_suppkey")
        .limit(10)
    )


@query(
    "avg_margin_by_product",
    """
    SELECT p_type, count(*) AS n_items, round(avg(1 - l_discount), 6) AS avg_margin
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
    """,
)
def avg_margin_by_product(spark: SparkSession, folder: str) -> DataFrame:
    per_part = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum(1 - F.col("l_discount")).alias("_margin"), F.count(F.lit(1)).alias("_n"))
    )
    return (
        per_part.join(table(spark, folder, "part").select("p_partkey", "p_type"), "p_partkey")
        .groupBy("p_type")
        .agg(
            F.sum("_n").alias("n_items"),
            F.round(F.sum("_margin") / F.sum("_n"), 6).alias("avg_margin"),
        )
    )


@query("distribution_of_measure", histogram_sql("customer", "c_acctbal"))
def distribution_of_measure(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        histogram(table(spark, folder, "customer"), "c_acctbal"), "bin_start", "bin_end"
    )


@query(
    "measure_correlation",
    f"SELECT count(*) AS n, round(corr(c_acctbal, total_spent), 6) AS correlation "
    f"FROM {CUSTOMER_MEASURES_SQL} WHERE total_spent IS NOT NULL",
)
def measure_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return (
        customer_measures(spark, folder)
        .filter(F.col("total_spent").isNotNull())
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.corr("c_acctbal", "total_spent"), 6).alias("correlation"),
        )
    )


@query(
    "segment_ranking",
    """
    SELECT c_mktsegment, round(avg(c_acctbal), 4) AS avg_acctbal,
           CAST(rank() OVER (ORDER BY avg(c_acctbal) DESC) AS INTEGER) AS rank
    FROM customer GROUP BY c_mktsegment
    """,
)
def segment_ranking(spark: SparkSession, folder: str) -> DataFrame:
    averages = (
        table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("_avg"))
    )
    return averages.select(
        "c_mktsegment",
        F.round("_avg", 4).alias("avg_acctbal"),
        F.rank().over(W.orderBy(F.col("_avg").desc())).alias("rank"),
    )


@query("count_by_type", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "budget_exceed_count",
    """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > budget) AS n_exceeded,
           count(*) AS n
    FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS budget FROM orders GROUP BY 1)
    USING (o_orderpriority) GROUP BY o_orderpriority
    """,
)
def budget_exceed_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    budgets = small_side(
        orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("budget")), store=True
    )
    return (
        orders.join(budgets, "o_orderpriority")
        .groupBy("o_orderpriority")
        .agg(
            F.count_if(F.col("o_totalprice") > F.col("budget")).alias("n_exceeded"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query(
    "variance_by_year",
    """
    WITH y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) AS budgeted,
                      sum(l_extendedprice * (1 - l_discount)) AS actual FROM lineitem GROUP BY 1)
    SELECT year, round(budgeted, 2) AS budgeted, round(actual, 2) AS actual,
           round(actual - budgeted, 2) AS variance,
           round((actual - budgeted) - lag(actual - budgeted) OVER (ORDER BY year), 2) AS change
    FROM y
    """,
)
def variance_by_year(spark: SparkSession, folder: str) -> DataFrame:
    years = (
        table(spark, folder, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_extendedprice").alias("_b"), F.sum(sold()).alias("_a"))
    )
    variance = F.col("_a") - F.col("_b")
    return years.select(
        "year",
        F.round("_b", 2).alias("budgeted"),
        F.round("_a", 2).alias("actual"),
        F.round(variance, 2).alias("variance"),
        F.round(variance - F.lag(variance).over(W.orderBy("year")), 2).alias("change"),
    )


@query(
    "conversion_by_page",
    """
    SELECT json_extract_string(props, '$.k') AS page,
           count(*) FILTER (WHERE event_type = 'view') AS n_views,
           count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
           round(CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE)
                 / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS conversion
    FROM events GROUP BY 1
    """,
)
def conversion_by_page(spark: SparkSession, folder: str) -> DataFrame:
    views = F.count_if(F.col("event_type") == "view")
    purchases = F.count_if(F.col("event_type") == "purchase")
    return (
        table(spark, folder, "events")
        .groupBy(F.get_json_object("props", "$.k").alias("page"))
        .agg(
            views.alias("n_views"),
            purchases.alias("n_purchases"),
            F.round(F.try_divide(purchases, views), 4).alias("conversion"),
        )
    )


@query(
    "traffic_by_weekday",
    "SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, count(*) AS n, "
    "count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
)
def traffic_by_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy(F.dayofweek("ts").alias("weekday"), "user_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("weekday")
        .agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_users"))
    )


@query(
    "rate_by_source",
    "SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_value, "
    "round(avg((value < 10)::INT), 4) AS bounce_rate FROM events GROUP BY event_type",
)
def rate_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("value"), 4).alias("avg_value"),
            F.round(F.avg((F.col("value") < 10).cast("int")), 4).alias("bounce_rate"),
        )
    )


@query(
    "views_over_time",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_views FROM events "
    "WHERE event_type = 'view' GROUP BY 1",
)
def views_over_time(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "view")
        .groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_views"))
    )


@query(
    "top_customers",
    """
    SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 10
    """,
)
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        customer_measures(spark, folder)
        .filter(F.col("n_orders").isNotNull())
        .select("c_custkey", "c_name", F.round("total_spent", 2).alias("revenue"), "n_orders")
        .orderBy(F.col("revenue").desc(), "c_custkey")
        .limit(10)
    )


@query(
    "retention_rate",
    """
    WITH w AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS week FROM events)
    SELECT strftime(a.week, '%Y-%m-%d') AS week, count(*) AS n_users, count(b.user_id) AS n_retained,
           round(CAST(count(b.user_id) AS DOUBLE) / count(*), 4) AS retention
    FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.week = a.week + INTERVAL 7 DAY
    GROUP BY a.week
    """,
)
def retention_rate(spark: SparkSession, folder: str) -> DataFrame:
    weeks = (
        table(spark, folder, "events")
        .select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"))
        .distinct()
    )
    following = F.lead("week").over(W.partitionBy("user_id").orderBy("week"))
    seen = weeks.withColumn("_kept", F.coalesce(following == F.date_add("week", 7), F.lit(False)))
    return seen.groupBy(F.date_format("week", "yyyy-MM-dd").alias("week")).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if("_kept").alias("n_retained"),
        F.round(F.count_if("_kept") / F.count(F.lit(1)), 4).alias("retention"),
    )


@query(
    "median_by_group",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
           round(median(o_totalprice), 4) AS median_price, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY 1, 2
    """,
)
def median_by_group(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), "o_totalprice"
    )
    medians = exact_quantiles(orders, ["o_totalprice"], [0.5], ["year", "quarter"])
    totals = orders.groupBy("year", "quarter").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return totals.join(
        medians.select("year", "quarter", F.round("value", 4).alias("median_price")),
        ["year", "quarter"],
    )


@query(
    "filter_sort_rows",
    """
    SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part
    WHERE p_retailprice > 950 AND p_type = 'ECONOMY' ORDER BY p_size DESC, p_partkey
    """,
)
def filter_sort_rows(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "part")
        .filter((F.col("p_retailprice") > 950) & (F.col("p_type") == "ECONOMY"))
        .select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
        .orderBy(F.col("p_size").desc(), "p_partkey")
    )


@query(
    "cross_dataset_lookup",
    """
    SELECT c_mktsegment, count(*) AS n_customers,
           count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders,
           count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders
    FROM customer GROUP BY c_mktsegment
    """,
)
def cross_dataset_lookup(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    ordered = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("found")
    )
    known = customers.join(ordered.distinct(), "c_custkey", "left")
    return known.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.count("found").alias("with_orders"),
        F.count_if(F.col("found").isNull()).alias("without_orders"),
    )


@query(
    "roi_by_group",
    """
    SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))
           / sum(l_extendedprice * (1 - l_discount)) - 1, 6) AS roi
    FROM lineitem GROUP BY l_returnflag
    """,
)
def roi_by_group(spark: SparkSession, folder: str) -> DataFrame:
    returned = F.sum(sold() * (1 + F.col("l_tax")))
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.round(returned / F.sum(sold()) - 1, 6).alias("roi"))
    )


@query(
    "score_by_department",
    """
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
           round(avg(o_totalprice), 4) AS avg_score FROM orders GROUP BY 1, 2
    """,
)
def score_by_department(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy("o_orderpriority", F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_score"))
    )


_FACTORS = ("c_acctbal", "c_nationkey", "n_orders", "total_spent")


@query(
    "churn_factors",
    f"""
    WITH m AS (SELECT c_acctbal, c_nationkey, coalesce(n_orders, 0) AS n_orders,
                      coalesce(total_spent, 0) AS total_spent,
                      CASE WHEN last_order >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
                           THEN 0 ELSE 1 END AS churned
               FROM {CUSTOMER_MEASURES_SQL})
    """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, round(corr({c}, churned), 6) AS correlation FROM m" for c in _FACTORS
    ),
)
def churn_factors(spark: SparkSession, folder: str) -> DataFrame:
    newest = table(spark, folder, "orders").agg(F.max("o_orderdate")).scalar()
    recent = F.col("last_order") >= newest - F.expr("INTERVAL 365 DAY")
    measured = customer_measures(spark, folder).select(
        "c_acctbal",
        "c_nationkey",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"),
        F.when(recent, 0).otherwise(1).alias("churned"),
    )
    row = measured.agg(*[F.round(F.corr(c, "churned"), 6).alias(c) for c in _FACTORS])
    cells = [F.struct(F.lit(c).alias("factor"), F.col(c).alias("correlation")) for c in _FACTORS]
    return (
        row.select(F.explode(F.array(*cells)).alias("_f"))
        .select("_f.*")
        .orderBy(F.abs("correlation").desc(), "factor")
    )


@query(
    "traffic_by_source_weekday",
    "SELECT event_type, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, count(*) AS n "
    "FROM events GROUP BY 1, 2",
)
def traffic_by_source_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy("event_type", F.dayofweek("ts").alias("weekday"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
