"""Bind table names to the active member of each sample table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators.collections import SAMPLE_TABLES, active_collections

MEMBER_COLUMN = "collection_id"


def member_scan(samples: DataFrame, member: str | DataFrame, column: str = MEMBER_COLUMN) -> DataFrame:
    """Rows of one member. ``member`` is a name or a one-cell DataFrame.

    With the samples partitioned by ``column`` both forms prune partitions: the
    name when the query is planned, the one-cell frame when it runs.
    """
    wanted = member.scalar() if isinstance(member, DataFrame) else F.lit(member)
    return samples.where(F.col(column) == wanted)


def bind_members(resolved: DataFrame, read_table: Callable[[str], DataFrame], prefix: str = "") -> list[str]:
    """Register a temp view per (table, member) row; returns the view names.

    Only the lookup result comes to the driver: one row per sample table name.
    """
    spark = resolved.sparkSession
    names = []
    for row in resolved.select("tbl", "mbr").collect():
        name = f"{prefix}{row.tbl}".lower()
        member_scan(read_table(row.tbl), row.mbr).createOrReplaceTempView(name)
        names.append(name)
    return names


def bound_samples(
    resolved: DataFrame, tables: Mapping[str, DataFrame], column: str = MEMBER_COLUMN
) -> dict[str, DataFrame]:
    """Each sample table reduced to its member in ``resolved`` (tbl, mbr), as plans.

    A join instead of a look at the driver: nothing runs until the tables are used, and
    a plan over several of them reads of each the partition its row names, which Spark
    finds when it runs. The lookup has one row per sample table, so it is broadcast. A
    table without a row has no rows.
    """
    return {
        name: df.join(F.broadcast(resolved.where(F.col("tbl") == name).select(F.col("mbr").alias(column))), column, "left_semi")
        for name, df in tables.items()
    }


def bind_active(
    spark: SparkSession,
    collections: DataFrame,
    table_members: DataFrame,
    read_table: Callable[[str], DataFrame],
    at=None,
    prefix: str = "",
    **lookup,
) -> list[str]:
    """Look up the collections active at ``at`` (now when left out) and bind them."""
    when = at if at is not None else datetime.now(timezone.utc).replace(tzinfo=None)
    lookup.setdefault("tables", SAMPLE_TABLES)
    resolved = active_collections(collections, table_members, when, **lookup)
    return bind_members(resolved, read_table, prefix)


def partitioned_reader(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """Reader for sample tables kept as ``root/TABLE/collection_id=MEMBER/``."""

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{table}")

    return read
