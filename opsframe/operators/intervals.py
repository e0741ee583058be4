"""Performance interval summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import clock_label, div, exact_avg, job_id, trunc_decimal

# The breakdown dimension of the job samples.
INTERACTIVE, BATCH = 1, 2

RATIO_SCALE = 512

# The raw counters of the system-wide samples.
SYSTEM_COUNTERS = (
    "sysizc", "sysezc", "syszwt", "shcpu", "smupl", "smxdu", "smmmt", "smme", "syfopn", "syhfts",
    "syhfth", "sysdtet", "sysdpfd", "sybtapp", "syifus", "syifte", "syifta", "sydpch", "sypthv",
    "syptint", "syptws", "syptwait", "sysqlcpu", "sypslpu", "sytrunic", "sytrunvtb", "sytituic",
    "sytfrmic",
)

_JOB_COLUMNS = ("smmtcpup", "smmnum", "smmmcnbr", "smmmcuser", "smmmcname")


def interval_summary(
    job_samples: DataFrame,
    os_samples: DataFrame,
    pool_samples: DataFrame,
    system_samples: DataFrame,
    unique_breakdown: bool = False,
) -> DataFrame:
    """One row per interval from job, operating-system, pool and system samples.

    An interval missing from any of the sample tables is left out. All joins are
    on the interval number, so one exchange per table serves all of them.

    ``unique_breakdown`` states that an interval has one row per job type; the
    two job types are then folded in one pass instead of a self join, and a
    second row for the same interval and type raises an error.
    """
    jobs = _fold_breakdown(job_samples) if unique_breakdown else _join_breakdown(job_samples)
    joined = jobs.join(os_samples, "intnum").join(pool_samples, "intnum").join(system_samples, "intnum")
    c = F.col
    return joined.select(
        "intnum",
        "datetime",
        c("smscpucpu").alias("cpu_pct"),
        c("smscpuqpu").alias("cpu_sql"),
        c("i_smmtcpup").alias("cpu_pct_inter"),
        c("b_smmtcpup").alias("cpu_pct_batch"),
        _seconds(c("smoarspt")).alias("irt"),
        _seconds(c("smomrspt")).alias("max_irt"),
        c("i_smmnum").alias("job_count_inter"),
        c("b_smmnum").alias("job_count_batch"),
        c("smoitrnr").alias("trans_rate_inter"),
        c("smoblior").alias("logical_io_batch"),
        c("smpmfltr").alias("fault_rate_machine_pool"),
        c("smpuafltr").alias("fault_rate_user_pool"),
        c("smpumfltr").alias("fault_rate_max"),
        c("smpumfltp").alias("fault_rate_max_pool"),
        div(c("smsctstgu"), F.lit(1024)).alias("temp_storage_gb"),
        c("smosplfr").alias("spoolf_rate"),
        job_id(c("i_smmmcnbr"), c("i_smmmcuser"), c("i_smmmcname")).alias("max_cpu_inter"),
        job_id(c("b_smmmcnbr"), c("b_smmmcuser"), c("b_smmmcname")).alias("max_cpu_batch"),
        job_id(c("smomrnbr"), c("smomruser"), c("smomrname")).alias("max_irt_job"),
    ).orderBy(F.desc("intnum"))


def _seconds(milliseconds: Column) -> Column:
    """Milliseconds as seconds, rounded half up to two digits."""
    exact = milliseconds.cast("decimal(18,0)") * F.lit("0.001").cast("decimal(4,3)")
    return F.round(exact, 2).cast("decimal(18,2)")


def _join_breakdown(job_samples: DataFrame) -> DataFrame:
    def side(kind: int, mark: str, *extra: str) -> DataFrame:
        return job_samples.where(F.col("smmbdd") == kind).select(
            "intnum", *extra, *[F.col(c).alias(f"{mark}_{c}") for c in _JOB_COLUMNS]
        )

    return side(INTERACTIVE, "i", "datetime").join(side(BATCH, "b"), "intnum")


def _fold_breakdown(job_samples: DataFrame) -> DataFrame:
    def rows_of(kind: int) -> Column:
        return F.count_if(F.col("smmbdd") == kind)

    def sides(kind: int, mark: str) -> list[Column]:
        return [F.max(F.when(F.col("smmbdd") == kind, F.col(c))).alias(f"{mark}_{c}") for c in _JOB_COLUMNS]

    folded = (
        job_samples.where(F.col("smmbdd").isin(INTERACTIVE, BATCH))
        .groupBy("intnum")
        .agg(
            F.max(F.when(F.col("smmbdd") == INTERACTIVE, F.col("datetime"))).alias("datetime"),
            rows_of(INTERACTIVE).alias("_inter"),
            rows_of(BATCH).alias("_batch"),
            *sides(INTERACTIVE, "i"),
            *sides(BATCH, "b"),
        )
    )
    twice = F.raise_error(F.concat(F.lit("more than one row per job type in interval "), F.col("intnum").cast("string")))
    checked = F.when(F.greatest("_inter", "_batch") > 1, twice.cast("boolean")).otherwise(
        F.least("_inter", "_batch") == 1
    )
    return folded.where(checked).drop("_inter", "_batch")


def ratio_metric(
    samples: DataFrame,
    numerator: str = "sidata02",
    divisor: str = "sidata01",
    scale: int = RATIO_SCALE,
    where: Column | None = None,
    name: str = "average_time",
) -> DataFrame:
    """numerator / scale / divisor per sample, two digits, newest first; a zero
    divisor gives null. ``where`` selects the counter."""
    chosen = samples if where is None else samples.where(where)
    whole = F.col(divisor).cast("decimal(18,0)") * F.lit(scale)
    value = F.try_divide(F.col(numerator).cast("decimal(18,0)"), whole.cast("decimal(20,0)"))
    return chosen.select(
        "intnum",
        "datetime",
        F.round(value, 2).cast("decimal(13,2)").alias(name),
    ).orderBy(F.desc("datetime"), F.desc("intnum"))


def system_metrics(samples: DataFrame, counters: Sequence[str] = SYSTEM_COUNTERS) -> DataFrame:
    """Raw counters per interval, newest first."""
    return samples.select("intnum", "dtetim", *counters).orderBy(F.desc("intnum"))


def response_histogram(
    summary: DataFrame, hours: tuple[int, int] = (11, 16), integer_avg: bool = False
) -> DataFrame:
    """Intervals of the peak hours per response time, with averaged metrics.

    First and last occurrence are clock texts of the first and last timestamp.
    ``integer_avg`` cuts the averages of whole-number columns to whole numbers.
    """

    def average(column: str) -> Column:
        value = F.avg(column)
        return (value.cast("bigint") if integer_avg else value).alias(column)

    # As wide as the sums behind them: counters grow with the samples of an interval.
    def rounded(column: str, digits: int = 2) -> Column:
        return exact_avg(F.col(column), digits, 18 + digits).alias(column)

    return (
        summary.where(F.hour("datetime").between(*hours))
        .groupBy("irt")
        .agg(
            F.count("*").alias("intervals_with_irt"),
            clock_label(F.min("datetime")).alias("first_occurance"),
            clock_label(F.max("datetime")).alias("last_occurance"),
            rounded("cpu_pct"),
            rounded("cpu_sql"),
            rounded("cpu_pct_inter"),
            rounded("cpu_pct_batch"),
            trunc_decimal(F.avg("max_irt"), 18, 1).alias("max_irt"),
            average("job_count_inter"),
            average("job_count_batch"),
            rounded("trans_rate_inter"),
            rounded("logical_io_batch", 0),
            F.avg("fault_rate_machine_pool").alias("fault_rate_machine_pool"),
            F.avg("fault_rate_user_pool").alias("fault_rate_user_pool"),
            F.avg("fault_rate_max").alias("fault_rate_max"),
            average("temp_storage_gb"),
            rounded("spoolf_rate"),
        )
    )
