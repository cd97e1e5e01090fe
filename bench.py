"""Times the headline queries and prints one JSON line.

One warm-up, then the median of three runs per query; every run builds the plan
anew from the test tables and reads all result rows into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from funnelspark.plans.registry import REGISTRY
from funnelspark.session import local_session

HEADLINE = (
    "stg_events", "stg_event_params", "sessionized", "funnel_steps", "fct_funnel", "fct_daily_funnel", "weekly_funnel", "fct_orders", "fct_order_items",
    "funnel_by_dim", "metric_funnel", "metric_conversion", "traffic_share", "metric_traffic", "metric_revenue", "metric_retention", "metric_product", "attribution_models",
    "items_scd2", "rfm_scores", "decompose_week_pairs", "anomaly_weekly", "diagnosis_weeks", "critic_verdict", "suppression",
    "experiment_design", "benchmark_accuracy", "check_relationships", "streaming_daily_funnel",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "funnelspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
