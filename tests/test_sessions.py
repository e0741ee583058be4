from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe.operators.numbering import number_rows
from opsframe.operators.sessions import idle_sessions, session_activity

AS_OF = "2024-01-10 12:00:00"
SCHEMA = "jbname string, jbuser string, jbnbr string, jbtype string, jbstsf int, dtetim string, jbtcpu bigint"


def samples(spark, *rows):
    return spark.createDataFrame([("DEV ", "U ", n, kind, code, stamp, cpu) for n, kind, code, stamp, cpu in rows], SCHEMA)


def test_edges(spark):
    df = samples(
        spark,
        ("1", "I", 1, "240110000900", 5),  # carried over: 00:09
        ("2", "I", 1, "240110001000", 5),  # 00:10 is no carry-over
        ("3", "I", None, "240110010000", 5),  # no status
        ("4", "I", 1, "240110100000", 5),  # exactly two hours old
        ("5", "I", 1, "240110095959", 19), ("5", "I", 1, "240110100000", 20),  # CPU of exactly 20
        ("6", "I", 1, "240110090000", 500), ("6", "I", 1, "240110101000", 19),  # earlier CPU does not count
        ("7", "I", 1, "240110090000", 1), ("7", "I", 1, "240110110000", 1),  # idle for exactly 60 minutes
        ("8", "B", 1, "240110010000", 1),  # batch
        ("9", "I", 2, "240110010000", 1), ("9", "I", 1, "240110020000", 1),  # ended
    )
    activity = {r.job_number: r for r in session_activity(df, AS_OF).collect()}
    assert [activity[n].yesterday for n in "12"] == ["Y", "N"]
    assert activity["3"].sts is None and activity["9"].sts == "ended"
    assert [activity[n].been_around for n in "45"] == ["N", "Y"]
    assert (activity["6"].total_cpu, activity["6"].recent_cpu) == (519, 19)
    assert activity["7"].totally_idle == "N"
    listed = [(r.seq, r.jobid) for r in idle_sessions(df, AS_OF).orderBy("seq").collect()]
    assert listed == [(1, "1/U/DEV"), (2, "2/U/DEV"), (3, "6/U/DEV")]


def test_order_by_time_of_day_or_timestamp(spark):
    df = samples(spark, ("1", "I", 1, "240109235000", 0), ("2", "I", 1, "240110001000", 0))
    order = lambda key: [r.jobid[0] for r in idle_sessions(df, AS_OF, order_by=key).orderBy("seq").collect()]
    assert order("time") == ["2", "1"]
    assert order("timestamp") == ["1", "2"]


def test_cap_marks_but_keeps_all(spark):
    df = samples(spark, *[(f"{i:04}", "I", 1, "240110010000", 0) for i in range(50)])
    rows = idle_sessions(df, AS_OF, cap=10).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 51))
    assert [r.end_sqlcode for r in rows] == [0] * 9 + [9999999] * 41
    assert rows[0].retrieval_time == dt.datetime(2024, 1, 10, 12)


def test_empty(spark):
    assert idle_sessions(spark.createDataFrame([], SCHEMA), AS_OF).count() == 0


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_number_rows_with_a_hot_value(spark, partitions):
    # A third of the rows share one value of the first sort column.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), (F.col("id") * 7919 % 3000).alias("id")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = number_rows(df, ["k", "id"]).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.seq for r in rows] == list(range(1, 3001))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in df.collect())
