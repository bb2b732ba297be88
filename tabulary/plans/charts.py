"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators import charts, profile, stats
from tabulary.plans.catalogue import TABLES, query, rounded, table, union_all
from tabulary.plans.profiles import (
    BASE_COLUMNS,
    BASE_TABLES,
    classes_sql,
)


def histogram_sql(source: str, column: str) -> str:
    return f"""
    WITH b AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / 20.0 AS w FROM {source}),
    x AS (SELECT CAST(least(floor(({column} - lo) / w), 19) AS INTEGER) AS bin FROM {source}, b)
    SELECT r.bin::INTEGER AS bin, round(lo + r.bin * w, 4) AS bin_start,
           round(lo + (r.bin + 1) * w, 4) AS bin_end,
           (SELECT count(*) FROM x WHERE x.bin = r.bin) AS n
    FROM range(20) r(bin), b
    """


@query("histogram", histogram_sql("lineitem", "l_extendedprice"))
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice"),
        "bin_start",
        "bin_end",
    )


@query(
    "bar_counts",
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand "
    "ORDER BY n DESC, value LIMIT 10",
)
def bar_counts(spark: SparkSession, folder: str) -> DataFrame:
    return charts.bar_counts(table(spark, folder, "part"), "p_brand")


@query(
    "pie_shares",
    """
    WITH shown AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY source
                   ORDER BY n DESC, value LIMIT 8)
    SELECT value, n, round(n * 100.0 / (SELECT sum(n) FROM shown), 1) AS share_pct,
           round(n * 100.0 / (SELECT count(*) FROM documents), 1) AS share_of_total_pct
    FROM shown
    """,
)
def pie_shares(spark: SparkSession, folder: str) -> DataFrame:
    return charts.pie_shares(table(spark, folder, "documents"), "source")


@query(
    "scatter_trend",
    """
    WITH l AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s,
                      regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
    SELECT l_quantity AS x, l_extendedprice AS y, round(s * l_quantity + i, 4) AS trend
    FROM lineitem, l
    """,
)
def scatter_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        charts.scatter_trend(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"),
        "trend",
    )


@query(
    "scatter_hue",
    """
    WITH l AS (SELECT l_returnflag AS h, regr_slope(l_extendedprice, l_quantity) AS s,
                      regr_intercept(l_extendedprice, l_quantity) AS i
               FROM lineitem GROUP BY l_returnflag)
    SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS hue,
           round(s * l_quantity + i, 4) AS trend
    FROM lineitem JOIN l ON l_returnflag = h
    """,
)
def scatter_hue(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        charts.scatter_hue(
            table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"
        ),
        "trend",
    )


@query(
    "line_series",
    """
    WITH i AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, value,
                      CAST(user_id AS DOUBLE) AS user_id FROM events)
    SELECT row_index, 'value' AS series, value FROM i
    UNION ALL SELECT row_index, 'user_id', user_id FROM i
    """,
)
def line_series(spark: SparkSession, folder: str) -> DataFrame:
    return charts.line_series(table(spark, folder, "events"), ["event_id"], ["value", "user_id"])


@query(
    "correlation_matrix",
    union_all(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation "
            "FROM lineitem"
            for a in TABLES["lineitem"]
            for b in TABLES["lineitem"]
            if TABLES["lineitem"][a] in "id" and TABLES["lineitem"][b] in "id"
        ]
    ),
)
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        stats.correlation_matrix(table(spark, folder, "lineitem")), "correlation", places=6
    )


def box_sql(source: str, column: str, by: str = "") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    matched = f"USING ({by})" if by else "ON true"
    again = f"GROUP BY {by}, q1, median, q3" if by else "GROUP BY q1, median, q3"
    return f"""
    WITH f AS (SELECT {keys} quantile_cont({column}, 0.25) AS q1, median({column}) AS median,
                      quantile_cont({column}, 0.75) AS q3 FROM {source} {group}),
    p AS (SELECT {keys} {column} AS v, q1, median, q3,
                 {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM {source} JOIN f {matched})
    SELECT {keys} count(*) AS n, round(q1, 4) AS q1, round(median, 4) AS median,
           round(q3, 4) AS q3, least(min(v) FILTER (WHERE inside), q1) AS whisker_low,
           greatest(max(v) FILTER (WHERE inside), q3) AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS n_fliers
    FROM p {again}
    """


@query("box_stats", box_sql("events", "value"))
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(charts.box_stats(table(spark, folder, "events"), "value"), "q1", "median", "q3")


@query(
    "box_by_category",
    box_sql(
        "(SELECT * FROM documents WHERE source IN "
        "(SELECT DISTINCT source FROM documents ORDER BY source LIMIT 10))",
        "n_chars",
        "source",
    ),
)
def box_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        charts.box_by_category(table(spark, folder, "documents"), "n_chars", "source"),
        "q1",
        "median",
        "q3",
    )


@query(
    "kde_density",
    """
    WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 199 AS step,
                      stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n FROM events),
    g AS (SELECT r.point::INTEGER AS point, lo + r.point * step AS x, h, n FROM range(200) r(point), b)
    SELECT point, round(x, 4) AS x,
           round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
    FROM g, events GROUP BY point, x, h, n
    """,
)
def kde_density(spark: SparkSession, folder: str) -> DataFrame:
    density = charts.kde_density(table(spark, folder, "events"), "value")
    return rounded(rounded(density, "x"), "density", places=6)


@query(
    "chart_suggestions",
    f"""
    WITH c AS ({classes_sql(BASE_COLUMNS)}),
    s AS (
        SELECT dataset, 0 AS section, position AS a, 0 AS b, 'histogram' AS chart_type,
               "column" AS columns, 'Distribution of ' || "column" AS title
        FROM c WHERE column_class = 'numeric'
        UNION ALL SELECT dataset, 0, position, 1, 'box', "column", 'Box Plot of ' || "column"
        FROM c WHERE column_class = 'numeric'
        UNION ALL SELECT dataset, 0, position, 0, 'bar', "column", 'Count of ' || "column" || ' Categories'
        FROM c WHERE column_class IN ('categorical', 'text')
        UNION ALL SELECT dataset, 0, position, 1, 'pie', "column",
               'Proportion of ' || "column" || ' Categories'
        FROM c WHERE column_class IN ('categorical', 'text')
        UNION ALL SELECT l.dataset, 1, l.position, r.position, 'scatter',
               l."column" || ', ' || r."column", l."column" || ' vs ' || r."column"
        FROM c l JOIN c r ON l.dataset = r.dataset AND l.position < r.position
        WHERE l.column_class = 'numeric' AND r.column_class = 'numeric'
        UNION ALL SELECT l.dataset, 2, l.position, r.position, 'box',
               l."column" || ', ' || r."column", r."column" || ' by ' || l."column"
        FROM c l JOIN c r ON l.dataset = r.dataset
        WHERE l.column_class IN ('categorical', 'text') AND r.column_class = 'numeric')
    SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY section, a, b) AS INTEGER)
           AS rank, chart_type, columns, title
    FROM s QUALIFY rank <= 8
    """,
)
def chart_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    profiles = profile.classes_of({name: table(spark, folder, name) for name in BASE_TABLES})
    return charts.chart_suggestions(profiles)


@query(
    "grouped_bar",
    "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS avg_extendedprice "
    "FROM lineitem GROUP BY ALL",
)
def grouped_bar(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        stats.aggregate_by(
            table(spark, folder, "lineitem"),
            ["l_returnflag", "l_linestatus"],
            avg_extendedprice=F.avg("l_extendedprice"),
        ),
        "avg_extendedprice",
    )
