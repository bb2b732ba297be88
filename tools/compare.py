"""Run named queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabulary.plans import load  # noqa: E402
from tabulary.session import build_session  # noqa: E402


CROSS_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def duck(folder, tables):
    connection = duckdb.connect()
    for name in tables:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def compare(spark, connection, catalogue, name, folder):
    """``(ok, message, seconds)`` for one query."""
    begun = time.time()
    try:
        df = catalogue.QUERIES[name](spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
        crossed = [word for word in CROSS_JOINS if word in plan]
        if crossed:
            return False, f"plan has {crossed}", time.time() - begun
        got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    except Exception as error:  # noqa: BLE001 - report and go on
        return False, f"spark failed: {str(error)[:1500]}", time.time() - begun
    seconds = time.time() - begun
    if name not in catalogue.ORACLE:
        return True, f"rows only: {sum(got.values())}", seconds
    try:
        result = connection.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in result.description]
        wanted = rows_of(columns, result.fetchall())
    except Exception as error:  # noqa: BLE001
        return False, f"sql failed: {str(error)[:1500]}", seconds
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(columns)}", seconds
    if got != wanted:
        extra, missing = list((got - wanted).items()), list((wanted - got).items())
        return (
            False,
            f"{sum(got.values())} / {sum(wanted.values())} rows\n"
            f"    columns {sorted(columns)}\n"
            + "".join(f"    spark only {str(r)[:400]}\n" for r in sorted(extra, key=str)[:3])
            + "".join(f"    sql only   {str(r)[:400]}\n" for r in sorted(missing, key=str)[:3]),
            seconds,
        )
    return True, f"{sum(got.values())} rows", seconds


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    catalogue = load()
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder, catalogue.TABLES)
    bad = 0
    for name in wanted or catalogue.QUERIES:
        ok, message, seconds = compare(spark, connection, catalogue, name, folder)
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {seconds:6.2f}s {name}: {message}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
