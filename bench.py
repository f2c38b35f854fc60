"""Headline queries after two warm-up runs, median of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from telemetra.plans.queries import queries  # noqa: E402
from telemetra.session import build_session  # noqa: E402

HEADLINE = ["endpoint_stats", "feature_vector", "predictions_upsert", "threshold_sweep", "contract_verdict"]
WARM_UPS, RUNS = 2, 3


def timed(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            # the tables are small: let a few kilobytes keep their own task
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    known, out = queries(), {}
    for name in HEADLINE:
        for _ in range(WARM_UPS):
            timed(spark, known[name], sf_dir)
        out[name] = round(statistics.median(timed(spark, known[name], sf_dir) for _ in range(RUNS)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "events": events,
        "feature_events_per_sec": round(events / out["feature_vector"]),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
