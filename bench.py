"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs per query (the median counts; one more run warms up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from tiffin.plans.queries import QUERIES
from tiffin.session import local_session

HEADLINE = [
    "menu_catalog",
    "menu_search_all",
    "top_selling",
    "item_order_counts",
    "preparation_ranking",
    "daily_sales",
    "overview_kpis_all",
    "order_history_page",
    "admin_order_feed_p2",
    "order_pages",
    "recent_orders",
    "order_lines_flat",
    "customer_order_lines",
    "price_orders_valid",
    "price_orders_rejects",
    "apply_order_updates",
    "category_cascade",
    "constraint_report",
    "total_reconciliation",
    "status_anomalies",
    "resolve_users",
    "cart_state_batch",
    "menu_view_customer",
    "rate_violations_batch",
    "request_metrics_batch",
    "connection_sessions",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="tiffin-bench-")
    settings = {"spark.checkpoint.dir": shared}
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tiffin-bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 4)
    line = {
        "metric": "headline queries, sum of median seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
