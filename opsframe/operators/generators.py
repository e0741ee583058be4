"""Test data: skewed tenants, tenant schedules, monthly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.scalars import at, div, draw, spell_digits
from opsframe.operators.numbering import number_rows
from opsframe.sources.durable import folder_exists

VALUES_PER_COLUMN = 255
NUMBER_BOUND = 10_000_000_000
TEXT_LENGTH = 10
ALPHABET = "abcdefghij"
PAUSE_BOUND = 100_000


def row_ids(spark: SparkSession, n: int) -> DataFrame:
    """1 … n in a column ``id``, split over the cluster; the base of the generators."""
    return spark.range(1, n + 1)


def skewed_rows(ids: DataFrame, dominant: int, singles: Sequence[int]) -> DataFrame:
    """A row of the dominant value per id, and one further row per single value.

    Single rows get the ids after the greatest one, found by a scalar subquery.
    """
    last = ids.agg(F.max("id")).scalar()
    many = ids.select(F.col("id").alias("myid"), F.lit(dominant).alias("mycol"))
    one = ids.sparkSession.range(1)
    extra = [
        one.select((F.coalesce(last, F.lit(0)) + i).alias("myid"), F.lit(value).alias("mycol"))
        for i, value in enumerate(singles, start=1)
    ]
    return reduce(DataFrame.unionByName, extra, many)


def tenant_schedule(
    runs: DataFrame,
    block: int = 10,
    queues: tuple[str, str] = ("interactive", "batch"),
    seed: int = 1,
) -> DataFrame:
    """Which of two tenants each numbered run uses: they change every ``block`` runs.

    Half of the runs, drawn at random, go to either queue, after a random pause.
    """
    run = F.col("run")
    tenant = div(run, F.lit(block)) % 2 + 1
    coin = draw(run, f"{seed}:queue", 4)
    return runs.select(
        "run",
        tenant.alias("tenant"),
        (3 - tenant).alias("other_tenant"),
        draw(run, f"{seed}:pause", PAUSE_BOUND).alias("pause_us"),
        F.when(coin < 2, queues[0]).otherwise(queues[1]).alias("queue"),
    )


def month_rows(ids: DataFrame, month: int, written_at, seed: int = 1, alphabet: str = ALPHABET) -> DataFrame:
    """Rows of a monthly table: id, month, a small number, a short text, change time.

    Values are drawn from a digest of id, month and seed: a retried task and any
    number of partitions give the same rows.
    """
    key = F.col("id")
    digits = draw(key, f"{seed}:{month}:text", NUMBER_BOUND)
    return ids.select(
        key.alias("rid"),
        F.lit(month).cast("smallint").alias("mo"),
        draw(key, f"{seed}:{month}:number", VALUES_PER_COLUMN).cast("smallint").alias("dtanbr"),
        F.left(spell_digits(digits, alphabet), F.lit(TEXT_LENGTH)).alias("dtachr"),
        at(written_at).alias("chgtsp"),
    )


def write_months(ids: DataFrame, months: Mapping[str, int], root: str, written_at, overwrite: bool = False, **options) -> list[str]:
    """Write the monthly tables under ``root``; the names of those written.

    Tables that are there are left alone, so a second run costs a look at the folders;
    with ``overwrite`` they are built anew. A table counts as there when its write was
    committed.
    """
    spark, written = ids.sparkSession, []
    for name, month in months.items():
        path = f"{root}/{name}"
        if overwrite or not folder_exists(spark, f"{path}/_SUCCESS"):
            month_rows(ids, month, written_at, **options).write.mode("overwrite").parquet(path)
            written.append(name)
    return written


def double_rows(df: DataFrame, written_at, renumber: bool = False) -> DataFrame:
    """The table plus a copy of every row with a new id and change time.

    New ids follow the greatest one in the order of the old ids. Shifting by the
    id span does that without moving a row and is consecutive when the old ids
    are; ``renumber`` makes the new ids consecutive in any case, by a sort.
    """
    if renumber:
        last = df.agg(F.max("rid")).scalar()
        numbered = number_rows(df, ["rid"], "_place")
        copy = numbered.withColumn("rid", last + F.col("_place")).drop("_place")
    else:
        span = df.agg(F.max("rid") - F.min("rid") + 1).scalar()
        copy = df.withColumn("rid", F.col("rid") + span)
    return df.unionByName(copy.withColumn("chgtsp", at(written_at)))
