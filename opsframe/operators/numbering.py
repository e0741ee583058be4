"""Consecutive row numbers over a whole table without one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.sources.durable import settle

_PART = "_part"
_POSITION = "_position"
_BEFORE = "_before"


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Add 1, 2, 3 … in ``order``, which should be a total order.

    A window without partition key would sort the whole table in one task. Here
    Spark's own distributed sort places the rows; each row's partition and place
    in it are settled with it as columns, so counting the partitions reads one
    column. A row's number is its place plus the rows of the partitions before.
    Only the partition counts, one small row per sort partition, are broadcast.
    """
    placed = settle(
        df.orderBy(*order).select(
            "*",
            F.spark_partition_id().alias(_PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(_POSITION),
        )
    )
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_PART)
        .agg(F.count("*").alias("_rows"))
        .select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(_BEFORE))
    )
    numbered = placed.join(F.broadcast(offsets), _PART)
    return numbered.select(*df.columns, (F.col(_BEFORE) + F.col(_POSITION) + 1).alias(name))
