from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from opsframe.operators import intervals

JMI = "intnum bigint, datetime timestamp_ntz, smmbdd int, smmtcpup double, smmnum bigint, smmmcnbr string, smmmcuser string, smmmcname string"
OS = "intnum bigint, smoarspt bigint, smomrspt bigint, smoitrnr double, smoblior double, smosplfr double, smomrnbr string, smomruser string, smomrname string"
POOL = "intnum bigint, smpmfltr double, smpuafltr double, smpumfltr double, smpumfltp bigint"
SYS = "intnum bigint, smscpucpu double, smscpuqpu double, smsctstgu bigint"


def tables(spark, jobs, os=None):
    import datetime as dt

    stamp = dt.datetime(2024, 1, 1, 12)
    rows = [(n, stamp + dt.timedelta(minutes=n), kind, 1.5, 10 * kind, "1", "U  ", "J") for n, kind in jobs]
    numbers = sorted({n for n, _ in jobs})
    os = os or {n: 1005 for n in numbers}
    return (
        spark.createDataFrame(rows, JMI),
        spark.createDataFrame([(n, ms, ms * 2, 1.0, 2.0, 3.0, "2", "V ", "K") for n, ms in os.items()], OS),
        spark.createDataFrame([(n, 1.0, 2.0, 3.0, 4) for n in numbers], POOL),
        spark.createDataFrame([(n, 1.0, 2.0, 2047) for n in numbers], SYS),
    )


@pytest.mark.parametrize("one_pass", [False, True])
def test_summary(spark, one_pass):
    jobs = [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3)]
    rows = intervals.interval_summary(*tables(spark, jobs), unique_breakdown=one_pass).collect()
    assert [r.intnum for r in rows] == [3, 1]
    row = rows[0]
    assert (row.irt, row.max_irt, row.temp_storage_gb) == (Decimal("1.01"), Decimal("2.01"), 1)
    assert (row.job_count_inter, row.job_count_batch, row.max_cpu_inter) == (10, 20, "1/U/J")


def test_second_row_per_type(spark):
    jobs = [(1, 1), (1, 1), (1, 2)]
    assert intervals.interval_summary(*tables(spark, jobs)).count() == 2
    with pytest.raises(PySparkException, match="more than one row per job type in interval 1"):
        intervals.interval_summary(*tables(spark, jobs), unique_breakdown=True).collect()


def test_missing_sample_drops_the_interval(spark):
    jobs = [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert intervals.interval_summary(*tables(spark, jobs, os={1: 5})).count() == 1


def test_histogram(spark):
    jobs = [(n, kind) for n in (1, 2, 300) for kind in (1, 2)]
    summary = intervals.interval_summary(*tables(spark, jobs, os={1: 1000, 2: 1000, 300: 1000}))
    row = intervals.response_histogram(summary).first()
    assert (row.irt, row.intervals_with_irt) == (Decimal("1.00"), 2)
    assert (row.first_occurance, row.last_occurance) == ("12:01", "12:02")
    assert (row.cpu_pct_inter, row.max_irt, row.job_count_batch) == (Decimal("1.50"), Decimal("2.0"), 20.0)
    uneven = summary.withColumn("job_count_inter", F.col("intnum"))
    assert intervals.response_histogram(uneven).first().job_count_inter == 1.5
    assert intervals.response_histogram(uneven, integer_avg=True).first().job_count_inter == 1
    assert intervals.response_histogram(summary, hours=(17, 17)).first().intervals_with_irt == 1


def test_histogram_of_large_counters(spark):
    summary = intervals.interval_summary(*tables(spark, [(1, 1), (1, 2)], os={1: 3_000_000_000}))
    rates = ("cpu_pct", "cpu_sql", "cpu_pct_inter", "cpu_pct_batch", "trans_rate_inter", "logical_io_batch", "spoolf_rate")
    row = intervals.response_histogram(summary.withColumns({c: F.lit(5_118_500_000_000.125) for c in rates})).first()
    assert (row.irt, row.max_irt) == (Decimal("3000000.00"), Decimal("6000000.0"))
    assert {row[c] for c in rates} == {Decimal("5118500000000.13"), Decimal("5118500000000")}


def test_ratio(spark):
    df = spark.createDataFrame(
        [(1, 3, 1, 0, 5), (2, 3, 1, 2, 5120), (3, 4, 1, 1, 1), (4, 3, 1, 512, 655)],
        "intnum bigint, sitype int, sidid int, sidata01 bigint, sidata02 bigint",
    ).withColumn("datetime", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = intervals.ratio_metric(df, where=F.col("sitype") == 3).collect()
    assert [(r.intnum, r.average_time) for r in rows] == [(4, Decimal("0.00")), (2, Decimal("5.00")), (1, None)]


def test_system_metrics_columns(spark):
    df = spark.range(3).select(
        F.col("id").alias("intnum"), F.lit("x").alias("dtetim"), *[F.lit(1).alias(c) for c in intervals.SYSTEM_COUNTERS]
    )
    out = intervals.system_metrics(df)
    assert len(out.columns) == 30 and [r.intnum for r in out.collect()] == [2, 1, 0]
