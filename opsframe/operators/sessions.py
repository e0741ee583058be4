"""Idle interactive sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import ago, at, job_id, parse_stamp12, time_of_day
from opsframe.operators.numbering import number_rows

# Session status by its code, and the code of a skipped session.
STATUS = {0: "rollover", 1: "started", 2: "ended", 3: "start & end"}
OPEN_STATUS = ("rollover", "started")
INTERACTIVE_TYPE = "I"
CHOSEN_CODE, SKIPPED_CODE = 0, 9999999

SESSION = ("job_name", "job_user", "job_number")


def session_activity(samples: DataFrame, as_of, age: str = "2 hours", idle: str = "60 minutes") -> DataFrame:
    """Per interactive session its status, first and last time, flags and CPU.

    Stamps are parsed before they are aggregated: min and max over timestamps
    keep the aggregation hash based, over text they would sort all samples.
    """
    stamp = F.col("_stamp")
    # Stamps are whole seconds, so "from the second of as_of - age on" is "later
    # than one second before it".
    cutoff = ago(ago(as_of, age), "1 second")
    grouped = (
        samples.where(F.col("jbtype") == INTERACTIVE_TYPE)
        .select(
            F.rtrim("jbname").alias("job_name"),
            F.rtrim("jbuser").alias("job_user"),
            F.col("jbnbr").alias("job_number"),
            "jbstsf",
            "jbtcpu",
            parse_stamp12(F.col("dtetim")).alias("_stamp"),
        )
        .groupBy(*SESSION)
        .agg(
            F.max("jbstsf").alias("_code"),
            F.min(stamp).alias("_first"),
            F.max(stamp).alias("_last"),
            F.sum("jbtcpu").alias("total_cpu"),
            F.sum(F.when(stamp > cutoff, F.col("jbtcpu")).otherwise(0)).alias("recent_cpu"),
        )
    )
    first, last = F.col("_first"), F.col("_last")
    # Carried over from yesterday: first seen in the ten minutes after midnight.
    carried = (F.hour(first) == 0) & (F.minute(first) < 10)
    return grouped.select(
        *SESSION,
        _status(F.col("_code")).alias("sts"),
        time_of_day(first).alias("str_time"),
        time_of_day(last).alias("last_time"),
        _flag(carried).alias("yesterday"),
        _flag(first <= cutoff).alias("been_around"),
        _flag(last < ago(as_of, idle)).alias("totally_idle"),
        "total_cpu",
        "recent_cpu",
        last.alias("last_stamp"),
    )


def idle_sessions(
    samples: DataFrame,
    as_of,
    age: str = "2 hours",
    idle: str = "60 minutes",
    cpu_ms: int = 20,
    cap: int = 1000,
    order_by: str = "time",
) -> DataFrame:
    """Old, open, idle sessions that used little CPU lately, in order of last use.

    All of them are listed; the code is 0 for the first ``cap - 1`` only.
    ``order_by="time"`` compares the time of day, ``"timestamp"`` the full stamp;
    the job id breaks ties.
    """
    candidates = (
        session_activity(samples, as_of, age, idle)
        .where(
            (F.col("been_around") == "Y")
            & (F.col("totally_idle") == "Y")
            & (F.col("recent_cpu") < cpu_ms)
            & F.col("sts").isin(*OPEN_STATUS)
        )
        .withColumn("jobid", job_id(F.col("job_number"), F.col("job_user"), F.col("job_name")))
    )
    key = {"time": "last_time", "timestamp": "last_stamp"}[order_by]
    numbered = number_rows(candidates, [key, "jobid"])
    return numbered.select(
        F.when(F.col("seq") < cap, CHOSEN_CODE).otherwise(SKIPPED_CODE).alias("end_sqlcode"),
        at(as_of).alias("retrieval_time"),
        "jobid",
        "seq",
        *SESSION,
        "sts",
        "str_time",
        "last_time",
        "yesterday",
        "been_around",
        "totally_idle",
        "total_cpu",
        "recent_cpu",
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, "Y").otherwise("N")


def _status(code: Column) -> Column:
    word = F
    for value, name in STATUS.items():
        word = word.when(code == value, name)
    return word
