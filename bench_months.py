"""Time counts and sweeps on generated monthly tables of $BENCH_MONTH_ROWS rows each.

The tables are written once to $BENCH_MONTH_DIR (a new temporary folder when it is
not set), then each view form is counted for one value after the other, and for
all runs of a sweep in one job. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile

from bench import COUNTS_PER_SWEEP, CPUS, POINT_RUNS
from opsframe import get_session
from opsframe.operators.generators import month_rows, row_ids
from opsframe.operators.partitions import count_sweep, count_where, partition_view, sweep_params
from opsframe.timing import time_query, timeit

ROWS = int(os.environ.get("BENCH_MONTH_ROWS", "8000000"))
MONTHS = {"JANUARY": 1, "FEBRUARY": 2}


def main() -> None:
    spark = get_session(
        "opsframe-months",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("BENCH_MONTH_DIR") or tempfile.mkdtemp(prefix="run-")
    for name, month in MONTHS.items():
        # Sorted within files, so that row-group statistics can rule value ranges out.
        rows = month_rows(row_ids(spark, ROWS), month, "2024-01-01")
        rows.sortWithinPartitions("dtanbr").write.mode("overwrite").parquet(f"{folder}/{name}")
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in MONTHS}
    views = {
        "data_only": (partition_view(parts), {}),
        "with_key": (partition_view(parts, key="mo"), {"mo": 2}),
        "bounded": (partition_view(parts, key="mo", bounds=MONTHS), {"mo": 2}),
        "labelled": (partition_view(parts, key="mo", label="month_name"), {"month_name": "FEBRUARY", "mo": 2}),
    }
    result = {"rows_per_month": ROWS, "cpus": CPUS, "spark": spark.version, "count_sec": {}, "sweep_sec": {}, "sweep_sec_per_count": {}}
    for name, (view, fixed) in views.items():

        def counts(n: int) -> None:
            for i in range(n):
                count_where(view, **fixed, dtanbr=i % 255).collect()

        counts(3)
        result["count_sec"][name] = round(timeit(lambda: counts(POINT_RUNS)) / 1e6 / POINT_RUNS, 4)
        sweep = count_sweep(view, sweep_params(0, COUNTS_PER_SWEEP - 1, spark), "dtanbr", **fixed)
        seconds = time_query(sweep) / 1e6
        result["sweep_sec"][name] = round(seconds, 3)
        result["sweep_sec_per_count"][name] = float(f"{seconds / COUNTS_PER_SWEEP:.3g}")
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
