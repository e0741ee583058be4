from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe.operators.collections import active_collections, active_collections_at
from opsframe.sources.members import bind_active, bind_members, bound_samples, member_scan, partitioned_reader
from tests.plans import final_plan, planned

DAY = "2024-01-10 "


def collections(spark, *rows):
    return spark.createDataFrame(rows, "ccclrid string, cccnname string, start string, end string").select(
        "ccclrid", "cccnname", F.expr("cast(start as timestamp_ntz) ccstrdt"), F.expr("cast(end as timestamp_ntz) ccenddt")
    )


@pytest.fixture()
def table_members(spark):
    rows = [("QMPGDATA", t, m) for t in ("QAPMSMJMI", "QAPMSMSYS") for m in ("Q1", "Q2", "Q3", "Q4")]
    rows += [("OTHER", "QAPMSMPOL", "Q1"), ("QMPGDATA", "ELSE", "Q1"), ("QMPGDATA", "QAPMSMDSK", "Q9")]
    return spark.createDataFrame(rows, "system_table_schema string, system_table_name string, system_table_member string")


@pytest.fixture()
def day(spark):
    return collections(
        spark,
        ("*CS", "Q1", DAY + "00:00:00", DAY + "08:00:00"),
        ("*CS", "Q2", DAY + "08:00:00", DAY + "16:00:00"),
        ("*CS", "Q3", DAY + "16:00:00", None),
        ("*PFR", "Q4", DAY + "00:00:00", None),
    )


def at(day, members, when, **options):
    return {r.tbl: r.mbr for r in active_collections(day, members, when, **options).collect()}


def test_start_excluded_end_included(day, table_members):
    both = lambda m: {"QAPMSMJMI": m, "QAPMSMSYS": m}
    assert at(day, table_members, DAY + "08:00:00") == both("Q1")
    assert at(day, table_members, DAY + "08:00:01") == both("Q2")
    assert at(day, table_members, DAY + "23:00:00") == both("Q3")
    assert at(day, table_members, DAY + "00:00:00") == {}
    assert at(day, table_members, DAY + "10:00:00", fixed_offset_hours=2) == both("Q1")
    assert at(day, table_members, DAY + "06:00:00", fixed_offset_hours=-5) == both("Q2")
    assert at(day, table_members, DAY + "10:00:00", tz="Europe/Paris") == both("Q2")
    assert at(day, table_members, DAY + "09:00:00", tz="Europe/Paris") == both("Q1")


def test_open_end_marked_by_year_one(spark, table_members):
    rows = collections(spark, ("*CS", "Q2", DAY + "00:00:00", "0001-01-01 00:00:00"))
    assert at(rows, table_members, DAY + "10:00:00")["QAPMSMJMI"] == "Q2"


def test_greatest_of_overlapping(spark, table_members):
    rows = collections(spark, ("*CS", "Q1", DAY + "00:00:00", None), ("*CS", "Q3", DAY + "01:00:00", None))
    assert at(rows, table_members, DAY + "10:00:00")["QAPMSMSYS"] == "Q3"


def test_bind_and_prune(spark, day, table_members, tmp_path):
    samples = spark.createDataFrame([("Q1", 1), ("Q2", 2), ("Q2", 3)], "collection_id string, intnum bigint")
    for table in ("QAPMSMJMI", "QAPMSMSYS"):
        samples.write.partitionBy("collection_id").parquet(str(tmp_path / table))
    reader = partitioned_reader(spark, str(tmp_path))
    names = bind_active(spark, day, table_members, reader, DAY + "12:00:00", prefix="t_")
    assert sorted(names) == ["t_qapmsmjmi", "t_qapmsmsys"]
    assert spark.table("t_qapmsmjmi").count() == 2
    assert "PartitionFilters: [isnotnull(collection_id" in planned(spark.table("t_qapmsmjmi"))
    # Now, without a time: the open collection, which has no rows here.
    assert bind_active(spark, day, table_members, reader, prefix="n_") and spark.table("n_qapmsmsys").count() == 0
    assert bind_members(active_collections(day, table_members, DAY + "00:00:00"), reader) == []


def test_member_from_a_query_prunes_when_run(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("Q1", 1), ("Q2", 2)], "collection_id string, intnum bigint").write.partitionBy(
        "collection_id"
    ).parquet(path)
    samples = spark.read.parquet(path)
    bound = member_scan(samples, samples.agg(F.max("collection_id")))
    assert [r.intnum for r in bound.collect()] == [2]
    assert "PartitionFilters: [isnotnull(collection_id" in final_plan(bound)


@pytest.mark.parametrize("bin_seconds", [1, 3600, 10**9])
def test_many_times_equal_one_time_each(spark, bin_seconds):
    import random

    rnd = random.Random(2)
    stamp = lambda h: str(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h))
    rows = []
    for i in range(30):
        start = rnd.randrange(40)
        end = rnd.choice([None, stamp(start + rnd.randrange(12)), stamp(start), "0001-01-01 00:00:00"])
        rows.append((rnd.choice(["*CS", "*CS", "*PFR"]), f"Q{i:02}", stamp(start), end))
    days = collections(spark, *rows)
    members = spark.createDataFrame(
        [("QMPGDATA", t, f"Q{i:02}") for i in range(30) for t in ("QAPMSMJMI", "QAPMSMSYS", "ELSE") if rnd.random() < 0.7],
        "system_table_schema string, system_table_name string, system_table_member string",
    )
    asked = [stamp(h) for h in range(-2, 60)] + [stamp(5), None]
    times = spark.createDataFrame([(t,) for t in asked], "t string").select(F.expr("cast(t as timestamp_ntz) asked_at"))
    got = {}
    for r in active_collections_at(days, members, times, bin_seconds=bin_seconds).collect():
        assert (r.asked_at, r.tbl) not in got
        got[r.asked_at, r.tbl] = r.mbr
    intervals = {n: (dt.datetime.fromisoformat(s), e and dt.datetime.fromisoformat(e)) for k, n, s, e in rows if k == "*CS"}
    want = {}
    for t in {dt.datetime.fromisoformat(t) for t in asked if t}:
        for _, tbl, mbr in members.collect():
            if tbl != "ELSE" and mbr in intervals:
                start, end = intervals[mbr]
                if start < t and (end is None or end.year == 1 or end >= t):
                    want[t, tbl] = max(want.get((t, tbl), ""), mbr)
    assert got == want


def test_many_times_need_no_nested_loop(spark, day, table_members):
    times = spark.createDataFrame([(DAY + "10:00:00",)], "t string").select(F.expr("cast(t as timestamp_ntz) asked_at"))
    found = active_collections_at(day, table_members, times)
    assert {r.mbr for r in found.collect()} == {"Q2"}
    assert "NestedLoop" not in planned(found) and "Cartesian" not in planned(found)
    assert active_collections_at(day, table_members, times.limit(0)).count() == 0


def test_spans_over_bins_are_not_paired_with_times(spark):
    stamp = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spans = [(f"Q{i:03}", 30 * i, 30 * i + 40_000 + 7 * i) for i in range(200)]
    days = collections(spark, *[("*CS", n, str(stamp(a)), str(stamp(b))) for n, a, b in spans])
    members = spark.createDataFrame([("QMPGDATA", "QAPMSMJMI", n) for n, _, _ in spans], "system_table_schema string, system_table_name string, system_table_member string")
    asked = [a + d for _, a, b in spans for a in (a, b) for d in (0, 0.5)]
    times = spark.createDataFrame([(stamp(a),) for a in asked], "asked_at timestamp_ntz")
    found = active_collections_at(days, members, times)
    want = {stamp(t): max((n for n, a, b in spans if a < t <= b), default=None) for t in asked}
    assert {r.asked_at: r.mbr for r in found.collect()} == {t: n for t, n in want.items() if n}
    assert not [line for line in planned(found).splitlines() if "Join" in line and "_start" in line]


def test_several_tables_are_bound_in_one_plan(spark, day, table_members, tmp_path):
    samples = spark.createDataFrame([("Q1", 1), ("Q2", 2), ("Q2", 3), ("Q3", 4)], "collection_id string, intnum bigint")
    for table in ("QAPMSMJMI", "QAPMSMSYS", "QAPMSMPOL"):
        samples.write.partitionBy("collection_id").parquet(str(tmp_path / table))
    read = partitioned_reader(spark, str(tmp_path))
    resolved = active_collections(day, table_members, DAY + "12:00:00")
    bound = bound_samples(resolved, {t: read(t) for t in ("QAPMSMJMI", "QAPMSMSYS", "QAPMSMPOL")})
    both = bound["QAPMSMJMI"].select("intnum").unionByName(bound["QAPMSMSYS"].select("intnum"))
    assert sorted(r.intnum for r in both.collect()) == [2, 2, 3, 3]
    assert bound["QAPMSMPOL"].count() == 0  # no row in the lookup
    plan = final_plan(both)
    assert plan.count("dynamicpruning") >= 2
    assert "NestedLoop" not in plan
