"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8): one warm-up, then the median of
$BENCH_REPS (default 3) timed runs. A run executes the whole plan into the
``noop`` sink (nothing is collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlake.plans.registry import QUERIES, load_all  # noqa: E402
from ledgerlake.session import local_session  # noqa: E402

HEADLINE = [
    "monthly_metrics", "basic_kpis", "order_value_distribution", "revenue_over_time", "order_state_breakdown",
    "revenue_concentration", "country_stats", "rfm", "customer_value_segments", "cohort_retention",
    "net_revenue_retention", "churn_monthly", "repeat_purchase_interval", "product_profitability",
    "abc_classes", "stock_recommendations", "product_movement", "inventory_metrics", "monthly_product_sales",
    "cross_sell_pairs", "dedup_by_keys", "chunk_overlap", "vector_topk", "kpi_summary",
]


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8))
    results = {}
    for name in names:
        run_once(spark, name, sf)
        results[name] = round(statistics.median(run_once(spark, name, sf) for _ in range(reps)), 3)
    total = round(sum(results.values()), 3)
    print(json.dumps({"metric": "headline_total_median_sec", "value": total, "unit": "sec",
                      "queries": results, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": cpus, "reps": reps, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
