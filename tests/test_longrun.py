from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from opsframe.operators.longrun import allowlist_rejects, capture_history, kill_list, load_allowlist, long_runners
from opsframe.operators.checks import duplicate_keys
from opsframe.sources.archive import append_history
from opsframe.sources.tables import like_table

AS_OF = "2024-01-10 12:00:00"
NOW = dt.datetime(2024, 1, 10, 12)
ALLOWED = "profile string, ip_address string, allowed_query_min decimal(5,0), hard_limit string"
JOBS = "job_name string, cpu_time bigint, run_priority int, authorization_name string, job_type string"
TEXTS = (
    "job_name string, v_sql_stmt_status string, v_sql_stmt_start_timestamp timestamp_ntz, v_sql_statement_text string, "
    "v_client_ip_address string, v_client_wrkstnname string, v_client_applname string, v_client_programid string, "
    "v_client_userid string, v_query_options_lib_name string"
)


@pytest.fixture()
def allowlist(spark):
    rows = [
        ("HARD  ", "10.0.0.1", Decimal(5), "Y"),
        ("HARD  ", "10.0.0.1", Decimal(5), "Y"),
        ("SOFT", "10.0.0.2", Decimal(20), None),
        ("TWICE", "10.0.0.3", Decimal(9), "N"),
        ("TWICE", "10.0.0.3", Decimal(7), "Y"),
    ]
    return spark.createDataFrame(rows, ALLOWED)


def run(spark, allowlist, *cases):
    """cases: (profile, ip, minutes running, job type, status)"""
    jobs = [(f"{i}/U/J", 1, 50, p, t) for i, (p, _, _, t, _) in enumerate(cases)]
    texts = [
        (f"{i}/U/J", s, NOW - dt.timedelta(minutes=m), "select 1", ip, None, None, None, None, None)
        for i, (_, ip, m, _, s) in enumerate(cases)
    ]
    return long_runners(
        spark.createDataFrame(jobs, JOBS), spark.createDataFrame(texts, TEXTS), load_allowlist(allowlist), AS_OF
    )


def test_allowlist(spark, allowlist):
    rows = {r.profile: (int(r.allowed_query_min), r.hard_limit) for r in load_allowlist(allowlist).collect()}
    assert rows == {"HARD": (5, "Y"), "SOFT": (20, "N"), "TWICE": (7, "Y")}
    assert duplicate_keys(allowlist, ["profile", "ip_address"]).count() == 2
    assert like_table(allowlist).schema == allowlist.schema


@pytest.mark.parametrize("profile, ip", [(None, "10.0.0.1"), ("HARD", None), (None, None)])
def test_clients_without_a_key_are_refused(spark, allowlist, profile, ip):
    rows = allowlist.union(spark.createDataFrame([(profile, ip, Decimal(1), "Y")], ALLOWED))
    assert [(r.profile, r.ip_address) for r in allowlist_rejects(rows).collect()] == [(profile, ip)]
    with pytest.raises(PySparkException, match="without profile or ip_address"):
        load_allowlist(rows).collect()


@pytest.mark.parametrize(
    "profile, ip, minutes, verdict, known",
    [
        ("OTHER", "10.0.0.9", 4, "No", "N"),
        ("OTHER", "10.0.0.9", 5, "Ask DBA", "N"),
        ("HARD", "10.0.0.1", 4, "NO", "Y"),
        ("HARD", "10.0.0.1", 5, "YES", "Y"),
        ("SOFT ", "10.0.0.2", 19, "NO", "Y"),
        ("SOFT ", "10.0.0.2", 20, "Probably", "Y"),
        ("HARD", None, 90, "Ask DBA", "N"),
    ],
)
def test_verdicts(spark, allowlist, profile, ip, minutes, verdict, known):
    row = run(spark, allowlist, (profile, ip, minutes, "BCH", "ACTIVE")).first()
    assert (row.kill_safe, row.known_address, row.run_mins) == (verdict, known, minutes)


def test_filters_and_kill_list(spark, allowlist, tmp_path):
    runners = run(
        spark,
        allowlist,
        ("HARD", "10.0.0.1", 30, "BCH", "ACTIVE"),
        ("HARD", "10.0.0.1", 60, "INT", "ACTIVE"),
        ("HARD", "10.0.0.1", 60, "SYS", "ACTIVE"),
        ("HARD", "10.0.0.1", 60, "BCH", "COMPLETE"),
        ("HARD", "10.0.0.1", 2, "BCH", "ACTIVE"),
        ("SOFT", "10.0.0.2", 90, "BCH", "ACTIVE"),
    )
    assert runners.count() == 3
    listed = kill_list(runners).collect()
    assert [r.run_mins for r in listed] == [60, 30]
    assert listed[0].kill_stmt == "CALL QSYS2.CANCEL_SQL('1/U/J');  /* HARD */"
    assert listed[0].end_stmt == "CL: ENDJOB (1/U/J);"
    path = str(tmp_path / "history")
    append_history(capture_history(runners, AS_OF), path)
    append_history(capture_history(runners, "2024-01-11 00:00:00"), path)
    kept = spark.read.parquet(path)
    assert kept.count() == 6
    assert kept.where("capture_date = date'2024-01-11'").count() == 3
