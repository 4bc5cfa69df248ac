"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully materialised (written to a no-op sink) so timings cover
the whole plan, not a sample.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_demand", "pos_daily_demand", "model_features", "short_history_features", "order_plan",
    "fefo_deduction", "fefo_expected_waste", "sales_report_top_products", "dashboard_kpis",
    "weather_pivot", "forecast_accuracy", "stream_daily_demand", "keyed_forecasts",
    # the first fits and stores the models, the second loads them
    "quantile_model_predict", "recursive_forecast",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tillcast.plans.registry import load_all
    from tillcast.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    qs, _ = load_all()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in qs]
    # warm-up (JIT, codegen paths) on the smallest tables, so the first measured queries
    # are not charged for JVM start-up; every measured query still runs once, in full
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("daily_demand", "model_features", "fefo_deduction", "dashboard_kpis", "order_plan"):
        qs[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)  # what is measured, should the run be ended
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
