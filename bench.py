"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up, then BENCH_RUNS times; the median counts. The noop sink
makes Spark compute every column of every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import REGISTRY, sizes  # noqa: E402
from sensorloom.operators.features import common_features  # noqa: E402
from sensorloom.settings import build_session  # noqa: E402
from sensorloom.sources.tables import PANEL, panel  # noqa: E402

HEADLINE = (
    "validation_counts",
    "clean_keep_last",
    "interpolate_gaps",
    "split_manifest",
    "split_joined",
    "future_label",
    "lag_change",
    "rolling_statistics",
    "feature_set",
    "feature_set_unrounded",
    "sampling_interval",
    "sensor_statistics",
    "outlier_analysis",
    "sensor_histogram",
    "sensor_correlation",
    "entity_coverage",
    "monthly_pattern",
    "label_effects",
    "label_cooccurrence",
    "relationship_sample",
    "data_quality",
    "resample_hourly",
)


def feature_set(spark, folder):
    """The whole feature set as a user runs it (the checked query also rounds 40 columns)."""
    return common_features(panel(spark, folder), PANEL, skew=sizes(spark, folder))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    calls = {**REGISTRY, "feature_set_unrounded": feature_set}
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            calls[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
