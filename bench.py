"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs after one warm-up (the median counts). Results go to a sink that reads every
row and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulary.plans import load  # noqa: E402
from tabulary.session import build_session  # noqa: E402

HEADLINE = (
    "stats_table",
    "describe_numeric",
    "column_info",
    "column_type_counts",
    "common_words",
    "histogram",
    "bar_counts",
    "scatter_trend",
    "correlation_matrix",
    "box_by_category",
    "kde_density",
    "outliers",
    "classify_question",
    "answer_questions",
    "vector_topk",
    "hybrid_search",
    "optimized_search",
    "embed_text",
    "row_chunks",
    "adaptive_row_chunks",
    "preprocess_text",
    "conversation_summary",
    "revenue_by_region",
    "top_sellers",
    "churn_factors",
    "median_by_group",
    "stream_session_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
