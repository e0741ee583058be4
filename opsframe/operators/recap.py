"""Error-log recaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import ago

APPLICATION_KEYS = ("failrsn", "dbgroup", "applib", "appname", "apptype")


def error_recap(
    errors: DataFrame,
    as_of,
    window: str = "1 month",
    keys: Sequence[str] = APPLICATION_KEYS,
    hidden_keys: Sequence[str] = (),
    message: str | None = None,
    prefix: int = 200,
) -> DataFrame:
    """Errors newer than ``as_of - window``, per day and key, newest day first.

    Gives the row count, the first and last job name and the number of jobs.
    ``message`` adds the first ``prefix`` characters of that column as a key.
    ``hidden_keys`` split the groups but are not in the output.

    Rows are first counted per (group, job): that pass hash-aggregates on the map
    side, so a group with a third of all rows shrinks before anything is
    shuffled, and text min / max run over distinct jobs only.
    """
    day = F.to_date("failtime").alias("faildate")
    extra = [F.left(message, F.lit(prefix)).alias(message)] if message else []
    shown = ["faildate", *keys, *([message] if message else [])]
    groups = [*shown, *hidden_keys]

    per_job = (
        errors.where(F.col("failtime") > ago(as_of, window))
        .select(day, *keys, *hidden_keys, *extra, "jobname")
        .groupBy(*groups, "jobname")
        .agg(F.count("*").alias("rows"))
    )
    recap = per_job.groupBy(*groups).agg(
        F.sum("rows").alias("cnt"),
        F.min("jobname").alias("first_job"),
        F.max("jobname").alias("last_job"),
        F.count("jobname").alias("nbr_jobs"),
    )
    # The keys break ties, so that one day does not sort in one task.
    order = [F.desc("faildate"), *[F.asc(c) for c in groups if c != "faildate"]]
    return recap.orderBy(*order).select(*shown, "cnt", "first_job", "last_job", "nbr_jobs")
