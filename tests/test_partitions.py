from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from opsframe.operators import partitions
from opsframe.operators.generators import double_rows, month_rows, row_ids, skewed_rows, tenant_schedule, write_months
from opsframe.operators.partitions import count_sweep, count_where, out_of_bounds, partition_view, sweep_params
from tests.plans import planned

MONTHS = {"JANUARY": 1, "FEBRUARY": 2}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("months")
    for name, month in MONTHS.items():
        month_rows(row_ids(spark, 2000), month, "2024-01-01").write.parquet(str(root / name))
    return {name: spark.read.parquet(str(root / name)) for name in MONTHS}


def scans(df) -> int:
    return planned(df).count("FileScan parquet")


def test_branches_are_dropped(parts):
    mo2 = F.col("mo") == 2
    bare = partition_view(parts, key="mo").where(mo2)
    assert scans(bare) == 2 and planned(bare).count("EqualTo(mo,2)") == 2
    assert scans(partition_view(parts, key="mo", bounds=MONTHS).where(mo2)) == 1
    labelled = partition_view(parts, key="mo", label="month_name")
    assert scans(labelled.where(F.col("month_name") == "FEBRUARY")) == 1
    assert scans(partition_view(parts)) == 2


def test_scan_reads_only_needed_columns(parts):
    plan = planned(count_where(partition_view(parts, key="mo"), mo=2, dtanbr=5))
    assert plan.count("ReadSchema: struct<mo:smallint,dtanbr:smallint>") == 2


def test_views_and_counts_agree(parts):
    views = {
        "key": partition_view(parts, key="mo"),
        "bounded": partition_view(parts, key="mo", bounds=MONTHS),
        "labelled": partition_view(parts, key="mo", label="month_name"),
    }
    counts = {n: count_where(v, mo=2, dtanbr=5).first().n for n, v in views.items()}
    assert len(set(counts.values())) == 1 and counts["key"] > 0
    assert all(v.count() == 4000 for v in views.values())
    assert views["bounded"].schema["mo"].dataType == views["key"].schema["mo"].dataType


@pytest.mark.parametrize("stray", [3, None])
def test_rows_outside_their_bound_are_refused(spark, parts, stray):
    key = F.lit(stray).cast(parts["JANUARY"].schema["mo"].dataType)
    strays = parts["JANUARY"].limit(1).withColumn("mo", key)
    mixed = parts | {"JANUARY": parts["JANUARY"].unionByName(strays)}
    view = partition_view(mixed, key="mo", bounds=MONTHS)
    for read in (view.count, view.where("mo = 1").collect):
        with pytest.raises(PySparkException, match="outside its bound"):
            read()
    assert view.where("mo = 2").count() == 2000  # the other branch is not read
    assert [(r.part, r.mo) for r in out_of_bounds(mixed, "mo", MONTHS).collect()] == [("JANUARY", stray)]
    assert out_of_bounds(parts, "mo", MONTHS).count() == 0


def test_sweep_equals_single_counts(spark, parts):
    view = partition_view(parts, key="mo")
    rows = count_sweep(view, sweep_params(0, 600, spark), "dtanbr", mo=2).collect()
    assert sorted(r.run for r in rows) == list(range(601))
    single = {}
    for r in view.where("mo = 2").collect():
        single[r.dtanbr] = single.get(r.dtanbr, 0) + 1
    assert all(r.n == single.get(r.dtanbr, 0) and r.dtanbr == r.run % 255 for r in rows)


def test_sweep_counts_values_that_do_not_occur(spark, parts):
    params = sweep_params(0, 299, spark, modulus=300)
    assert count_sweep(partition_view(parts), params, "dtanbr").where("dtanbr >= 255").agg(F.sum("n")).first()[0] == 0


def test_month_rows(spark):
    rows = month_rows(row_ids(spark, 500), 1, "2024-01-01").collect()
    assert [r.rid for r in rows] == list(range(1, 501))
    assert all(0 <= r.dtanbr < 255 and r.dtachr.isalpha() and len(r.dtachr) <= 10 for r in rows)
    again = month_rows(row_ids(spark, 500).repartition(3), 1, "2024-01-01").orderBy("rid").collect()
    assert rows == again
    assert month_rows(row_ids(spark, 500), 1, "2024-01-01", seed=2).collect() != rows


@pytest.mark.parametrize("renumber", [True, False])
def test_doubling(spark, renumber):
    january = month_rows(row_ids(spark, 100), 1, "2024-01-01")
    twice = double_rows(double_rows(january, "2024-01-02", renumber), "2024-01-03", renumber).orderBy("rid").collect()
    assert [r.rid for r in twice] == list(range(1, 401))
    assert [r.dtachr for r in twice] == [r.dtachr for r in january.collect()] * 4


def test_skewed_rows_and_schedule(spark):
    rows = skewed_rows(row_ids(spark, 1000), 1, (2, 3)).orderBy("myid").collect()
    assert [r.mycol for r in rows] == [1] * 1000 + [2, 3]
    assert [r.myid for r in rows] == list(range(1, 1003))
    runs = tenant_schedule(row_ids(spark, 100).withColumnRenamed("id", "run")).orderBy("run").collect()
    assert [r.tenant for r in runs] == [i // 10 % 2 + 1 for i in range(1, 101)]
    assert all(r.tenant + r.other_tenant == 3 and 0 <= r.pause_us < 100_000 for r in runs)
    assert 30 <= sum(r.queue == "batch" for r in runs) <= 70


def test_summary_equals_the_scan_after_an_append(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id % 7 as smallint) as dtanbr", "cast(id % 2 as string) as mo")
    paths = {name: str(tmp_path / name) for name in ("JANUARY", "FEBRUARY")}
    for path in paths.values():
        rows.write.parquet(path)
    opened = {name: ([path], lambda p=path: spark.read.parquet(p)) for name, path in paths.items()}
    summary = partitions.CountSummary(spark, opened, "dtanbr", key="mo")

    def scans(value, **where):
        total = 0
        for name, path in paths.items():
            if where.get("label", name) == name:
                df = spark.read.parquet(path).where(F.col("dtanbr") == value)
                total += (df.where(F.col("mo") == where["key"]) if "key" in where else df).count()
        return total

    asked = [(v, w) for v in (0, 5, 99) for w in ({}, {"label": "JANUARY"}, {"label": "FEBRUARY", "key": "1"}, {"key": "0"})]
    assert all(summary.count(v, **w) == scans(v, **w) for v, w in asked)
    assert summary.refresh() == []
    rows.limit(300).write.mode("append").parquet(paths["JANUARY"])
    assert all(summary.count(v, **w) == scans(v, **w) for v, w in asked)
    rows.limit(10).write.mode("append").parquet(paths["JANUARY"])
    assert summary.refresh() == ["JANUARY"]
    small = partitions.CountSummary(spark, opened, "dtanbr", most_values=3)  # scans
    assert small.count(5) == scans(5) and summary.count(None) == 0
    assert summary.count_table(5, label="JANUARY").first().n == scans(5, label="JANUARY")


def test_months_are_built_once_unless_asked(spark, tmp_path):
    ids, months = row_ids(spark, 50), {"JANUARY": 1, "FEBRUARY": 2}
    assert write_months(ids, months, str(tmp_path), "2024-01-01") == ["JANUARY", "FEBRUARY"]
    assert write_months(ids, months | {"MARCH": 3}, str(tmp_path), "2024-01-02") == ["MARCH"]
    stamps = lambda: {str(r.chgtsp)[:10] for r in spark.read.parquet(str(tmp_path / "JANUARY")).collect()}
    assert stamps() == {"2024-01-01"}
    assert write_months(ids, months, str(tmp_path), "2024-01-02", overwrite=True) == ["JANUARY", "FEBRUARY"]
    assert stamps() == {"2024-01-02"} and spark.read.parquet(str(tmp_path / "JANUARY")).count() == 50
