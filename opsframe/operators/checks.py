"""Assertions and before / after comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_no_rows(df: DataFrame, message: str = "Expected 0 rows") -> DataFrame:
    """One row 'ok', or an error when ``df`` has any row; stops at the first one."""
    return df.limit(1).agg(F.when(F.count("*") > 0, F.raise_error(F.lit(message))).otherwise("ok").alias("result"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where(F.col("cnt") > 1)


def compare_snapshots(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two snapshots side by side with their difference, for the keys
    of either. A key must be unique within a snapshot; a second row is an error.

    The snapshots are stacked and grouped instead of joined: one exchange on the
    keys with map-side aggregation, and null keys compare as equal.
    """
    stacked = before.select(F.lit("before").alias("_side"), *keys, *metrics).unionByName(
        after.select(F.lit("after").alias("_side"), *keys, *metrics)
    )

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    def rows(side: str) -> Column:
        return F.count_if(F.col("_side") == side)

    grouped = stacked.groupBy(*keys).agg(
        rows("before").alias("_before"),
        rows("after").alias("_after"),
        *[of(side, m).alias(f"{m}_{side}") for m in metrics for side in ("before", "after")],
    )
    twice = F.raise_error(F.lit("a key occurs more than once in a snapshot")).cast("boolean")
    unique = F.when(F.greatest("_before", "_after") > 1, twice).otherwise(F.lit(True))
    return grouped.where(unique).select(
        *keys,
        (F.col("_before") > 0).alias("in_before"),
        (F.col("_after") > 0).alias("in_after"),
        *[
            column
            for m in metrics
            for column in (
                F.col(f"{m}_before"),
                F.col(f"{m}_after"),
                (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta"),
            )
        ],
    )
