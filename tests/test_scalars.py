from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsframe.functions import scalars as s
from tests.plans import planned


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text, expected", [("1.27", "1.2"), ("-1.27", "-1.2"), ("0.09", "0.0"), ("-0.09", "0.0")])
def test_trunc_decimal_cuts(spark, text, expected):
    cut = s.trunc_decimal(F.lit(text).cast("decimal(9,4)"), 9, 1)
    assert value(spark, cut) == Decimal(expected)


def test_ratio_cut(spark):
    assert value(spark, s.ratio_cut(F.lit(2), F.lit(3), 17, 6)) == Decimal("0.666666")
    assert value(spark, s.ratio_cut(F.lit(-2), F.lit(3), 17, 6)) == Decimal("-0.666666")
    assert value(spark, s.ratio_cut(F.lit(2), F.lit(0), 17, 6)) is None
    assert value(spark, s.from_units(F.lit(1234567), 15, 6)) == Decimal("1.234567")


def test_div_cuts_toward_zero(spark):
    assert value(spark, s.div(F.lit(7), F.lit(2))) == 3
    assert value(spark, s.div(F.lit(-7), F.lit(2))) == -3
    assert value(spark, s.div(F.lit(7), F.lit(0))) is None


def test_clock_and_ids(spark):
    stamp = s.at("2024-01-05 09:07:59")
    assert value(spark, s.clock_label(stamp)) == "9:07"
    assert value(spark, s.time_of_day(stamp)) == "09:07:59"
    assert value(spark, s.job_id(F.lit("1"), F.lit("U  "), F.lit("J"))) == "1/U/J"
    assert value(spark, s.job_id(F.lit("1"), F.lit(None).cast("string"), F.lit("J"))) is None
    assert str(value(spark, s.parse_stamp12(F.lit("240229235959")))) == "2024-02-29 23:59:59"
    assert str(value(spark, s.ago("2017-03-31", "1 month"))) == "2017-02-28 00:00:00"


def test_draw_repeats_and_spreads(spark):
    ids = spark.range(5000)
    one = [r.d for r in ids.select(s.draw(F.col("id"), 7, 255).alias("d")).collect()]
    two = [r.d for r in ids.repartition(7).select("id", s.draw(F.col("id"), 7, 255).alias("d")).orderBy("id").collect()]
    assert one == two
    assert min(one) == 0 and max(one) == 254 and len(set(one)) == 255


def test_time_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert "GreaterThan(ts" in planned(events.where(F.col("ts") > s.ago("2024-01-31", "14 days")))


def test_whole_minutes(spark):
    minutes = lambda a, b: value(spark, s.whole_minutes(s.at(a), s.at(b)))
    assert minutes("2024-01-01 00:00:00", "2024-01-01 00:02:59") == 2
    assert minutes("2024-01-01 00:00:00.9", "2024-01-01 00:02:00.5") == 1
    assert minutes("2023-12-31 23:59:00", "2024-01-01 00:00:00") == 1
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The clocks went forward in between.
        assert minutes("2024-03-10 01:00:00", "2024-03-10 04:00:00") == 180
        assert value(spark, s.time_of_day(s.at("2024-03-10 02:30:00"))) == "02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
