"""Find jobs in a job snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NORMAL_COMPLETION = "NORMAL"


def find_jobs(
    jobs: DataFrame,
    status: str | None = None,
    job_type: str | None = None,
    user: str | None = None,
    subsystem: str | None = None,
    submitter: str | None = None,
    name_like: str | None = None,
) -> DataFrame:
    """Names of the jobs that pass every filter given; ``name_like`` is contained in the name."""
    equal = {
        "status": status,
        "job_type": job_type,
        "job_user": user,
        "subsystem": subsystem,
        "submitter": submitter,
    }
    for column, wanted in equal.items():
        if wanted is not None:
            jobs = jobs.where(F.col(column) == wanted)
    if name_like is not None:
        jobs = jobs.where(F.col("job_name").contains(name_like))
    return jobs.select("job_name")


def only_value(df: DataFrame, column: str) -> DataFrame:
    """One row with the value of ``column``: null when there is no row, an error
    when there are several. Two rows are enough to know."""
    several = F.raise_error(F.lit(f"more than one row for {column}"))
    return df.select(column).limit(2).agg(F.when(F.count("*") > 1, several).otherwise(F.max(column)).alias(column))


def unfinished_jobs(jobs: DataFrame) -> DataFrame:
    """How many jobs have completed other than normally; unknown states do not count."""
    return jobs.where(F.col("completion_status") != NORMAL_COMPLETION).agg(F.count("*").alias("unfinished"))
