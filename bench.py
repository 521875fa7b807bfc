"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=... BENCH_CPUS=... python bench.py [query ...]

Inputs shared by several queries are derived and written first. Each query then
runs once to warm up and three times for the median, into a sink that reads
every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cabinlift.plans import registry
from cabinlift.session import build_session
from cabinlift.sources import demo

HEADLINE = [
    "offers_enriched", "unique_ids", "snapshot_instants", "alive_offers", "auction_snapshots",
    "group_stats", "loo_quantiles", "model_features", "roc_points", "roc_auc", "pr_points",
    "score_histogram",
]


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(int(cpus), 8)),
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare = seconds(lambda: (demo.enriched(spark, folder), demo.unique_offers(spark, folder)))
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        build = registry.QUERIES[name]
        run = lambda: build(spark, folder).write.format("noop").mode("overwrite").save()
        run()
        times[name] = round(statistics.median(seconds(run) for _ in range(3)), 3)
        print(f"{name:20s} {times[name]}", file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        # The fit is cached per session, so it is timed once; scoring follows.
        times["gbt_scored"] = round(seconds(
            lambda: registry.QUERIES["gbt_scored"](spark, folder).write.format("noop").mode("overwrite").save()
        ), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "prepare_inputs_sec": round(prepare, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
