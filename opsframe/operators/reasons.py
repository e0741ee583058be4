"""Why access plans were rebuilt, or not saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record ids, reason columns and the reason class counted.
REBUILD_RECORD, REBUILD_REASON = 3006, "qqrcod"
STATEMENT_RECORD, SAVE_REASON, SAVE_CLASS = 1000, "qvc24", "A"


def reason_counts(monitor: DataFrame, where: Column, reason: str, name: str) -> DataFrame:
    """Rows per reason code, most frequent first."""
    return (
        monitor.where(where)
        .groupBy(F.col(reason).alias(name))
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), name)
    )


def rebuild_reasons(monitor: DataFrame) -> DataFrame:
    return reason_counts(monitor, F.col("qqrid") == REBUILD_RECORD, REBUILD_REASON, "rebuild_rsn")


def save_reasons(monitor: DataFrame) -> DataFrame:
    chosen = (F.col("qqrid") == STATEMENT_RECORD) & F.col(SAVE_REASON).startswith(SAVE_CLASS)
    return reason_counts(monitor, chosen, SAVE_REASON, "save_reason")
