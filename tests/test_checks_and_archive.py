from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from opsframe.operators import checks, jobs, monitor, reasons
from opsframe.sources import archive, durable
from opsframe.sources.tables import rtrim_text, with_defaults
from opsframe.timing import time_query, timeit
from tests.plans import final_plan


def test_assert_no_rows(spark):
    assert checks.assert_no_rows(spark.range(0)).first().result == "ok"
    with pytest.raises(PySparkException, match="Expected 0 rows"):
        checks.assert_no_rows(spark.range(5)).collect()


def test_only_value(spark):
    df = spark.createDataFrame([("a",), ("b",)], "job_name string")
    assert jobs.only_value(df.where("job_name = 'a'"), "job_name").first().job_name == "a"
    assert jobs.only_value(df.limit(0), "job_name").first().job_name is None
    with pytest.raises(PySparkException, match="more than one row"):
        jobs.only_value(df, "job_name").collect()


def test_find_jobs(spark):
    rows = [
        ("1/A/THEBADJOB", "*ACTIVE", "*BATCH", "A", "S1", None, "NORMAL"),
        ("2/A/BADJOB2", "*JOBQ", "*BATCH", "A", None, "*JOB", None),
        ("3/B/OTHER", "*ACTIVE", "*SYS", "B", "S1", "*JOB", "ABNORMAL"),
    ]
    schema = "job_name string, status string, job_type string, job_user string, subsystem string, submitter string, completion_status string"
    df = spark.createDataFrame(rows, schema)
    names = lambda **filters: sorted(r.job_name[0] for r in jobs.find_jobs(df, **filters).collect())
    assert names() == ["1", "2", "3"]
    assert names(name_like="BADJOB") == ["1", "2"]
    assert names(status="*ACTIVE", job_type="*BATCH", user="A", subsystem="S1", name_like="BADJOB") == ["1"]
    assert names(submitter="*JOB", user="B") == ["3"]
    # An unknown completion state is not counted: the comparison is not true.
    assert jobs.unfinished_jobs(df).first().unfinished == 1


def test_compare_snapshots(spark):
    before = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, m bigint")
    after = spark.createDataFrame([("a", 5), (None, 2), ("c", 3)], "k string, m bigint")
    rows = {r.k: tuple(r)[1:] for r in checks.compare_snapshots(before, after, ["k"], ["m"]).collect()}
    assert rows == {
        "a": (True, True, 1, 5, 4),
        None: (True, True, 2, 2, 0),
        "b": (True, False, None, None, None),
        "c": (False, True, None, 3, None),
    }
    with pytest.raises(PySparkException, match="more than once"):
        checks.compare_snapshots(before.union(before), after, ["k"], ["m"]).collect()


def test_archive(spark, tmp_path):
    path = str(tmp_path / "plans")
    day = spark.createDataFrame([(1, "select SYS"), (2, "select x")], "statement_number bigint, statement_text string")
    archive.archive_snapshot(day, "2024-01-01", path)
    archive.archive_snapshot(day.where("statement_number = 1"), "2024-01-02", path)
    archive.archive_snapshot(day, "2024-01-02", path)
    kept = spark.read.parquet(path)
    assert kept.count() == 4
    assert checks.duplicate_keys(kept, [archive.CAPTURE_DATE, "statement_number"]).count() == 0
    latest = archive.latest_snapshot(kept)
    assert {str(r.capture_date) for r in latest.collect()} == {"2024-01-02"} and latest.count() == 2
    assert "PartitionFilters: [isnotnull(capture_date" in final_plan(latest)
    assert [r.statement_number for r in monitor.search_statements(latest, "sys").collect()] == [1]
    archive.save_table(latest, str(tmp_path / "saved"))
    archive.save_table(latest.limit(1), str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 1


def test_append_keeps_the_key_of_a_day_unique(spark, tmp_path):
    path = str(tmp_path / "plans")
    schema = "statement_number bigint, statement_text string"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (3, "same"), (3, "same")], schema)
    again = spark.createDataFrame([(2, "later"), (4, "d"), (None, "m")], schema)

    def told(df, day):
        return sorted((r.statement_number or 0, r.status) for r in archive.append_snapshot(df, day, path).collect())

    want = [(0, "accepted"), (1, "accepted"), (2, "accepted"), (2, "repeated"), (3, "accepted"), (3, "repeated")]
    assert told(first, "2024-01-01") == want
    assert {status for _, status in told(first, "2024-01-01")} == {"present"}  # a job that runs twice adds nothing
    assert told(again, "2024-01-01") == [(0, "present"), (2, "present"), (4, "accepted")]
    assert told(again, "2024-01-02") == [(0, "accepted"), (2, "accepted"), (4, "accepted")]
    assert told(first.limit(0), "2024-01-03") == []
    held = archive.read_archive(spark, path)
    assert held.columns == ["statement_number", "statement_text", "capture_date"]
    assert checks.duplicate_keys(held, [archive.CAPTURE_DATE, "statement_number"]).count() == 0
    assert held.count() == 8 and held.where("statement_text = 'later'").count() == 1
    day = held.where("capture_date = date '2024-01-02'")
    assert day.count() == 3 and "PartitionFilters: [isnotnull(capture_date" in final_plan(day)
    scan = day._jdf.queryExecution().executedPlan().toString()
    assert "capture_date" in scan and len(day.inputFiles()) >= 1
    assert archive.latest_snapshot(held).count() == 3
    # What a lost job left in staging is not read.
    first.write.parquet(f"{path}/_staging/lost")
    assert archive.read_archive(spark, path).count() == 8


def test_discard_deletes_settled_files_only(spark, tmp_path):
    settled = durable.settle(spark.range(10))
    files = settled.inputFiles()
    durable.discard(settled)
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
    spark.range(3).write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    durable.discard(table)
    assert table.count() == 3


def test_indexed_search_equals_the_scan(spark):
    texts = ["select SYS", "selectsys", "", None, "sy", "Größe ÄÖ", "a\nb\tc", "aaaa", "👍👍x", "SELECT 1 FROM sysibm.t", "straße"]
    day = spark.createDataFrame(list(enumerate(texts)), "statement_number bigint, statement_text string")
    postings = monitor.trigram_postings(day).cache()
    for needle in ("sys", "S", "", "öß", "größe", "äö", "aaaaa", "aaa", "absent", "\nb\t", "👍👍x", "t s", "STRASSE", "raße"):
        want = sorted(r.statement_number for r in monitor.search_statements(day, needle).collect())
        got = sorted(r.statement_number for r in monitor.search_indexed(day, postings, needle).collect())
        assert got == want, needle
    postings.unpersist()


def test_reasons(spark):
    rows = [(3006, "AB", None)] * 3 + [(3006, "A1", None), (1000, "AB", "AB"), (1000, None, "B1"), (1000, None, None)]
    df = spark.createDataFrame(rows, "qqrid bigint, qqrcod string, qvc24 string")
    assert [tuple(r) for r in reasons.rebuild_reasons(df).collect()] == [("AB", 3), ("A1", 1)]
    assert [tuple(r) for r in reasons.save_reasons(df).collect()] == [("AB", 1)]


def test_loading_helpers(spark):
    df = spark.createDataFrame([("a  ", None)], "k string, flag string")
    assert rtrim_text(df).first().k == "a"
    assert with_defaults(df, {"flag": "N"}).first().flag == "N"


def test_settled_frames_do_not_recompute(spark):
    settled = durable.settle(spark.range(100).select(F.uuid().alias("u")))
    assert settled.collect() == settled.collect()
    assert durable.ensure_checkpoint_dir(spark)


def test_timing(spark):
    assert timeit(lambda: None) >= 0
    assert time_query(spark.range(10)) > 0


def test_rename_table_is_complete():
    raw = [c[0] for c in monitor.STATEMENT_COLUMNS]
    names = [c[1] for c in monitor.STATEMENT_COLUMNS]
    assert len(raw) == len(set(raw)) == len(set(names)) == 127
    assert len(monitor.ROLLUP_KEYS) == 28 and len(monitor.ROLLUP_SUMS) + len(monitor.ROLLUP_MAXIMA) + 2 == 16
    used = {*monitor.ROLLUP_KEYS, *monitor.ROLLUP_SUMS, *monitor.ROLLUP_MAXIMA}
    assert used <= set(names)


def test_captures_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.range(40).selectExpr("id % 30 as statement_number", "id as other")
    for before in ({"accepted": 30, "repeated": 10}, {"present": 40}):
        judged = archive.judge_rows(rows, "2024-02-01", path, "statement_number")
        assert "Broadcast" not in final_plan(judged)
        told = archive.append_snapshot(rows, "2024-02-01", path)
        assert {r.status: r["count"] for r in told.groupBy("status").count().collect()} == before


def test_whole_rows_of_a_capture_stay_where_they_are(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 300 as statement_number", "md5(string(id)) as statement_text")
    scratch = Path(durable.ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(scratch.iterdir())
    told = archive.append_snapshot(rows, "2024-02-01", str(tmp_path / "archive"))
    # No copy of the rows is left but those of the archive and the refused ones.
    assert not [f for folder in set(scratch.iterdir()) - before for f in folder.glob("*.parquet")]
    assert {r.status: r["count"] for r in told.groupBy("status").count().collect()} == {"accepted": 300, "repeated": 100}
    with durable.settings(spark, durable.IN_PLACE):
        plan = final_plan(archive.judge_rows(rows, "2024-02-01", str(tmp_path / "archive"), "statement_number"))
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert "statement_text" in plan and "statement_text" not in plan[plan.index("Exchange") :]
    assert not spark.catalog.listTables() and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("hashed", [0, 1_000_000])
def test_captures_in_many_chunks(spark, tmp_path, monkeypatch, hashed):
    monkeypatch.setattr(durable, "CHUNK_BITS", 2)
    monkeypatch.setattr(archive, "MOST_HASHED", hashed)
    path = str(tmp_path / "archive")
    # One key has a third of the rows, one is null; some rows are the same.
    rows = spark.range(0, 600, 1, 7).selectExpr("if(id % 3 = 0, 7, if(id % 11 = 0, null, id % 250)) as statement_number", "id % 400 as other", "null as empty")
    rows = rows.withColumn("empty", F.col("empty").cast("string"))
    keys = [r.statement_number for r in rows.collect()]
    count = lambda df: {r.status: r["count"] for r in df.groupBy("status").count().collect()}
    told = archive.append_snapshot(rows, "2024-02-01", path)
    assert told.columns == [*rows.columns, "status"] and count(told) == {"accepted": len(set(keys)), "repeated": len(keys) - len(set(keys))}
    assert told.drop("status").exceptAll(rows).count() == 0 and rows.exceptAll(told.drop("status")).count() == 0
    least = rows.groupBy("statement_number").agg(F.min(F.xxhash64(*rows.columns)).alias("d"))
    kept = told.where("status = 'accepted'").select("statement_number", F.xxhash64(*rows.columns).alias("d"))
    assert kept.exceptAll(least).count() == 0
    more = rows.unionByName(spark.range(1000, 1100).selectExpr("id as statement_number", "id as other", "'x' as empty"))
    assert count(archive.append_snapshot(more, "2024-02-01", path)) == {"accepted": 100, "present": 600}
    assert archive.read_archive(spark, path).count() == len(set(keys)) + 100
