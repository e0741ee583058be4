"""Running statements over their client's limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import ago, at, whole_minutes
from opsframe.sources.archive import CAPTURE_TIME
from opsframe.sources.durable import settle
from opsframe.sources.tables import rtrim_text, with_defaults

# Codes and verdicts, in the spelling callers compare with.
SYSTEM_JOB = "SYS"
ACTIVE = "ACTIVE"
HARD_LIMIT_DEFAULT = "N"
UNLISTED_SHORT, UNLISTED_LONG = "No", "Ask DBA"
OVER_HARD, OVER_SOFT, WITHIN = "YES", "Probably", "NO"

# Suggested action texts, around job name and profile. Text only.
CANCEL_TEXT, CANCEL_LENGTH = ("CALL QSYS2.CANCEL_SQL('", "');  /* ", " */"), 128
END_TEXT, END_LENGTH = ("CL: ENDJOB (", ");"), 40

ALLOWLIST_KEY = ("profile", "ip_address")
_CLIENT_COLUMNS = (
    "v_sql_statement_text",
    "v_sql_stmt_start_timestamp",
    "v_client_wrkstnname",
    "v_client_ip_address",
    "v_client_applname",
    "v_client_programid",
    "v_client_userid",
    "v_query_options_lib_name",
)


def load_allowlist(rows: DataFrame) -> DataFrame:
    """Allowlist with one row per (profile, ip): defaults applied, padding and
    duplicates removed. Of differing duplicates the smallest allowance stays
    (then the smaller limit flag), whatever order the rows came in. A row without
    profile or ip is refused: loading raises, ``allowlist_rejects`` lists such rows.
    The table is settled, as loading it is what this job is for, and hot clients
    can be split next to it."""
    loaded = with_defaults(rtrim_text(rows), {"hard_limit": HARD_LIMIT_DEFAULT})
    entry = F.struct("allowed_query_min", "hard_limit")
    refused = F.raise_error("Allowlist row without profile or ip_address").cast("boolean")
    return settle(
        loaded.where(F.when(_has_key(), True).otherwise(refused))
        .groupBy(*ALLOWLIST_KEY)
        .agg(F.min(entry).alias("_entry"))
        .select(*ALLOWLIST_KEY, "_entry.allowed_query_min", "_entry.hard_limit")
    )


def _has_key() -> Column:
    return F.col("profile").isNotNull() & F.col("ip_address").isNotNull()


def allowlist_rejects(rows: DataFrame) -> DataFrame:
    """Allowlist rows that ``load_allowlist`` refuses."""
    return rows.where(~_has_key())


def long_runners(
    active_jobs: DataFrame,
    job_statements: DataFrame,
    allowlist: DataFrame,
    as_of,
    running: str = "2 minutes",
    unlisted_minutes: int = 5,
) -> DataFrame:
    """Active statements of user jobs that run longer than ``running``, judged
    against the allowlist (one row per key, see ``load_allowlist``).

    A null ip never matches. Neither join is hinted: adaptive execution
    broadcasts the job list and the allowlist while their measured size allows
    it, and otherwise splits hot jobs or clients of the statement side.
    """
    jobs = active_jobs.where(F.col("job_type") != SYSTEM_JOB).select(
        "job_name", "cpu_time", "run_priority", F.rtrim("authorization_name").alias("profile")
    )
    statements = job_statements.where(
        (F.col("v_sql_stmt_status") == ACTIVE) & (F.col("v_sql_stmt_start_timestamp") < ago(as_of, running))
    ).select("job_name", *_CLIENT_COLUMNS)
    limits = allowlist.select(
        F.col("profile").alias("_profile"),
        F.col("ip_address").alias("_ip"),
        F.col("allowed_query_min").alias("allowed_min"),
        "hard_limit",
    )
    listed = (F.col("profile") == F.col("_profile")) & (F.col("v_client_ip_address") == F.col("_ip"))
    minutes = whole_minutes(F.col("v_sql_stmt_start_timestamp"), at(as_of))
    judged = statements.join(jobs, "job_name").join(limits, listed, "left").withColumn("run_mins", minutes)
    return judged.select(
        _verdict(unlisted_minutes).alias("kill_safe"),
        F.when(F.col("allowed_min").isNull(), "N").otherwise("Y").alias("known_address"),
        F.col("v_client_ip_address").alias("ip_address"),
        "run_mins",
        "allowed_min",
        "profile",
        "hard_limit",
        _around(CANCEL_TEXT, CANCEL_LENGTH, "job_name", "profile").alias("kill_stmt"),
        _around(END_TEXT, END_LENGTH, "job_name").alias("end_stmt"),
        F.col("cpu_time").alias("job_cpu_ms"),
        "run_priority",
        *_CLIENT_COLUMNS,
        "job_name",
    )


def _verdict(unlisted_minutes: int) -> Column:
    minutes, allowed = F.col("run_mins"), F.col("allowed_min")
    unlisted = F.when(minutes < unlisted_minutes, UNLISTED_SHORT).otherwise(UNLISTED_LONG)
    over = F.when(F.col("hard_limit") == "Y", OVER_HARD).otherwise(OVER_SOFT)
    return F.when(allowed.isNull(), unlisted).when(minutes >= allowed, over).otherwise(WITHIN)


def _around(texts: tuple[str, ...], length: int, *columns: str) -> Column:
    """Fixed texts with columns between them, cut to a length."""
    parts = [F.lit(texts[0])]
    for column, text in zip(columns, texts[1:]):
        parts += [F.col(column), F.lit(text)]
    return F.left(F.concat(*parts), F.lit(length))


def kill_list(runners: DataFrame) -> DataFrame:
    """Statements over a hard limit, longest first."""
    return runners.where(F.col("kill_safe") == OVER_HARD).orderBy(F.desc("run_mins"), "job_name")


def capture_history(runners: DataFrame, captured_at) -> DataFrame:
    """Long runners stamped with the time they were captured."""
    return runners.select(at(captured_at).alias(CAPTURE_TIME), "*")
