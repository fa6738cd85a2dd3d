"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``. Each query is run
to a sink that discards rows, so that nothing can be pruned, once to warm up and then three
times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import all_queries  # noqa: E402

HEADLINE = [
    "canonical_tracking", "velocity", "speed", "distance_to_ball", "team_shape",
    "team_shape_attached", "nearest_players", "all_features", "average_speed_and_ball_distance",
    "frame_monotonicity", "impossible_speeds", "missingness", "quality_summary",
    "resample_interpolated", "resample_filled", "agent_slots", "window_meta", "window_tensors",
    "constant_velocity_rollout", "clip_frames", "agent_trails", "metrica_dedupe",
    "skillcorner_frames", "statsbomb_events",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries = all_queries()
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of headline queries, each the median of three warm runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
