"""Time an action."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def timeit(action: Callable[[], object]) -> int:
    """Microseconds the action takes."""
    started = time.perf_counter_ns()
    action()
    return (time.perf_counter_ns() - started) // 1000


def time_query(df: DataFrame) -> int:
    """Microseconds to compute every row of ``df`` without keeping it."""
    return timeit(lambda: df.write.format("noop").mode("overwrite").save())
