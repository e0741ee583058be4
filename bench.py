"""Time the queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

``queries`` holds seconds per query, from building it to its last row; rows are
computed in full and not kept. ``point_counts`` are single counts, one after the
other, on each view form; ``point_counts_from_summary`` are the same from a summary of
the parts that is checked against their files each time; ``sweep_seconds_per_count`` is
the cost of one count within a sweep. These compare with the published seconds per query.
"""

from __future__ import annotations

import json
import os
import sys

from opsframe import get_session
from opsframe.operators.partitions import count_where
from opsframe.plans.catalog import POINTS, QUERIES, point_summary, point_view, summary_count, view_sweep
from opsframe.timing import time_query, timeit

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
COUNTS_PER_SWEEP = 10_001
POINT_RUNS = 20
WARM_UP = ("recap_by_app", "long_runners")


def best(build) -> float:
    return round(min(timeit(lambda: time_query(build())) for _ in range(RUNS)) / 1e6, 3)


def count_seconds(view, fixed: dict) -> float:
    """Seconds per count over a run of counts for different values."""

    def run() -> None:
        for i in range(POINT_RUNS):
            count_where(view, **{**fixed, "dtanbr": i % 255}).collect()

    return round(timeit(run) / 1e6 / POINT_RUNS, 4)


def summary_seconds(summary, name: str) -> float:
    """The same from the counts kept beside the data, each after a check of the files."""
    summary_count(summary, name)
    return round(timeit(lambda: [summary_count(summary, name) for _ in range(POINT_RUNS)]) / 1e6 / POINT_RUNS, 6)


def main() -> None:
    names = sys.argv[1:] or list(QUERIES)
    spark = get_session(
        "opsframe-bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        time_query(QUERIES[name](spark, FOLDER))
    seconds = {name: best(lambda: QUERIES[name](spark, FOLDER)) for name in names}
    points = {name: count_seconds(point_view(spark, FOLDER, name), POINTS[name]) for name in POINTS}
    summary = point_summary(spark, FOLDER)
    summary_points = {name: summary_seconds(summary, name) for name in POINTS}
    sweeps = {name: best(lambda: view_sweep(spark, FOLDER, name)) / COUNTS_PER_SWEEP for name in POINTS}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "point_counts": points,
                "point_counts_from_summary": summary_points,
                "sweep_seconds_per_count": {name: float(f"{value:.3g}") for name, value in sweeps.items()},
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
