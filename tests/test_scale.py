"""What must hold on large and skewed data, shown on small data."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from opsframe.operators import drilldown, longrun, recap, statements
from opsframe.operators.drilldown import plan_drilldown, records_with_statement
from opsframe.operators.perflist import performance_list
from opsframe.operators.lookup import MOST_HEAVY, weighted_lookup
from opsframe.plans.bindings import derived
from opsframe.plans.catalog import QUERIES
from opsframe.sources.durable import settle
from tests.plans import final_plan, planned

FOLDER = "/root/testdata/sf0.001"


SMALL_SKEW = {
    "spark.sql.shuffle.partitions": "60",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def skew_settings(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SKEW}
    for k, v in SMALL_SKEW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_fingerprint_is_not_shuffled(spark):
    # A third of all statements share one text, which is more than one in 10,000.
    df = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("statement_number"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("statement_text_parsed"),
    )
    with skew_settings(spark):
        xref = statements.statement_xref(df)
        plan = final_plan(xref)
        # The only broadcasts are those of the heavy keys; the rest is shuffled.
        assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" in plan
        rows = {r.related_statement_number: r.statement_number for r in xref.collect()}
    assert rows == {i: 59_997 if i % 3 == 0 else i for i in range(60_000)}


def test_weighted_lookup_bounds_the_broadcast(spark):
    rows = spark.range(0, 50_000, 1, 4).select((F.col("id") % 25_000).alias("k"), "id")
    facts = settle(rows.groupBy("k").agg(F.max("id").alias("m"), F.count("*").alias("n")))
    found = weighted_lookup(rows, facts, ["k"], "n")
    assert found.count() == 50_000
    # No key holds one in 10,000 rows here, so nothing is heavy.
    total = facts.agg(F.sum("n")).first()[0]
    assert facts.where(F.col("n") * MOST_HEAVY > total).count() == 0
    assert weighted_lookup(rows.limit(0), settle(facts.limit(0)), ["k"], "n").count() == 0


def hot_monitor(spark):
    """Monitor rows of which a third belong to one key."""
    blank = derived(spark, FOLDER, "monitor").schema
    ids = spark.range(0, 30_000, 1, 8)
    given = {
        "qqrid": F.when(F.col("id") % 10 == 1, 1000).when(F.col("id") % 10 == 2, 3014).otherwise(3010).cast("bigint"),
        "qqjfld": F.when(F.col("id") % 3 == 0, "KHOT").otherwise(F.concat(F.lit("K"), F.col("id") % 5000)),
        "qqi5": F.lit(0).cast("bigint"),
        "qvrcnt": F.lit(0).cast("bigint"),
        "qqc21": F.lit("OP"),
        "qqstn": F.col("id"),
        "qq1000l": F.sha2(F.col("id").cast("string"), 512),
    }
    return ids.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in blank])


def test_hot_monitor_key_is_split(spark):
    monitor = hot_monitor(spark)
    with skew_settings(spark):
        matched = records_with_statement(monitor)
        assert "skew=true" in final_plan(matched)
        plan = plan_drilldown(monitor, "", "", "", 0, statement=F.lit(True))
        assert "skew=true" in final_plan(plan)
    keys = {r.qqjfld for r in monitor.where("qqrid = 1000").select("qqjfld").distinct().collect()}
    assert matched.count() == monitor.where(F.col("qqrid") == 3010).where(F.col("qqjfld").isin(*keys)).count()


def test_hot_client_is_split(spark):
    jobs = spark.range(3000).select(
        F.concat("id", F.lit("/U/J")).alias("job_name"), F.lit(1).alias("cpu_time"), F.lit(1).alias("run_priority"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), "id")).alias("authorization_name"),
        F.lit("BCH").alias("job_type"),
    )
    texts = spark.range(0, 30_000, 1, 8).select(
        # One job holds a third of the statements.
        F.concat(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3000), F.lit("/U/J")).alias("job_name"),
        F.lit("ACTIVE").alias("v_sql_stmt_status"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("v_sql_stmt_start_timestamp"),
        F.lit("10.0.0.1").alias("v_client_ip_address"),
        *[F.concat(F.lit("x"), "id").alias(c) for c in (
            "v_sql_statement_text", "v_client_wrkstnname", "v_client_applname", "v_client_programid", "v_client_userid",
            "v_query_options_lib_name")],
    )
    allowed = spark.createDataFrame(
        [("HOT", "10.0.0.1", 5, "Y")], "profile string, ip_address string, allowed_query_min int, hard_limit string"
    )
    with skew_settings(spark):
        runners = longrun.long_runners(jobs, texts, longrun.load_allowlist(allowed), "2024-01-02")
        assert "skew=true" in final_plan(runners)
        assert runners.count() == 30_000
        hot = texts.join(jobs, "job_name").where("authorization_name = 'HOT'").count()
        assert runners.where("kill_safe = 'YES'").count() == hot


def test_hot_groups_shrink_before_the_exchange(spark):
    plan = planned(recap.error_recap(derived(spark, FOLDER, "errors"), "2024-01-31"))
    first_exchange = plan.rindex("Exchange")
    assert "partial_count(1)" in plan[first_exchange:]
    # No expanded distinct aggregate over the raw rows.
    assert "Expand" not in plan and "distinct" not in plan


def test_in_row_jobs_need_no_exchange(spark):
    texts = derived(spark, FOLDER, "statements").coalesce(1)
    texts = spark.createDataFrame(texts.limit(10).collect(), texts.schema)
    assert "Exchange" not in planned(statements.strip_statements(texts))
    assert "Exchange" not in planned(statements.table_references(texts))


def test_texts_of_one_row_group_are_dealt_to_many_tasks(spark):
    texts = derived(spark, FOLDER, "statements")
    assert texts.rdd.getNumPartitions() == 1
    dealt = derived(spark, FOLDER, "statements", even=True)
    assert dealt.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, texts.collect()))
    # The keys move, not the texts made of them.
    plan = planned(QUERIES["strip_all_in_row"](spark, FOLDER))
    assert "o_totalprice" not in plan[plan.rindex("Exchange") :] and "NOTES" not in plan[plan.rindex("Exchange") :]


def test_performance_list_scans_each_record_stream_once(spark, tmp_path):
    path = str(tmp_path / "monitor")
    derived(spark, FOLDER, "monitor").write.parquet(path)
    listed = performance_list(spark.read.parquet(path))
    plan = planned(listed)
    # Statement records are settled before; of the monitor only the plan records are scanned here.
    scans = [part.split("ReadSchema")[0] for part in plan.split("FileScan parquet")[1:]]
    assert sum("qqrid" in scan for scan in scans) == 1
    assert "In(qqrid, [3014,3015,3019,3020])" in plan


def test_performance_list_with_a_hot_key(spark):
    monitor = derived(spark, FOLDER, "monitor").withColumn(
        "qqjfld", F.when(F.col("qqstn") % 3 == 0, "KHOT").otherwise(F.col("qqjfld"))
    )
    rows = performance_list(monitor).where("qqjfld = 'KHOT'").collect()
    threads = {r.refresh_count for r in rows}
    assert rows and threads
    total = sum(float(r.qqi6_total) for r in rows)
    # The same total straight from the records.
    taken = monitor.where(
        "qqrid = 1000 and qqjfld = 'KHOT' and qqstim is not null and qqetim is not null and qq1000 is not null "
        "and (qvc1c = 'Y' or qqc21 in ('OP', 'FE', 'CL', 'UP', 'DL', 'IN', 'SV'))"
    )
    assert total == pytest.approx(taken.agg(F.sum("qqi6")).first()[0] / 1e6)


def test_any_record_stops_early_and_is_exact(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "monitor")
    derived(spark, FOLDER, "monitor").repartition(16).write.parquet(path)
    monitor = spark.read.parquet(path)
    with monkeypatch.context() as patched:  # the whole join is not needed
        patched.setattr(drilldown, "records_with_statement", None)
        assert drilldown.any_record_with_statement(monitor).count() == 1
    apart = monitor.withColumn("qqjfld", F.when(F.col("qqrid") == 3010, F.concat(F.lit("x"), "qqjfld")).otherwise(F.col("qqjfld")))
    for tries in ((), (1,), (5, 10), (10**6,)):
        assert drilldown.any_record_with_statement(monitor, tries).count() == 1
        assert drilldown.any_record_with_statement(apart, tries).count() == 0
    # The only match is none of those looked at first.
    key = records_with_statement(monitor).first()
    only = apart.unionByName(monitor.where((F.col("qqrid") == 3010) & (F.col("qqjfld") == key.qqjfld) & (F.col("qqi5") == key.qqi5)))
    assert drilldown.any_record_with_statement(only, (1,)).count() == 1
    nulls = monitor.withColumn("qqi5", F.lit(None).cast("bigint"))
    assert drilldown.any_record_with_statement(nulls).count() == 0


def test_empty_monitor(spark):
    empty = spark.createDataFrame([], derived(spark, FOLDER, "monitor").schema)
    assert performance_list(empty).count() == 0
    assert records_with_statement(empty).count() == 0
    assert plan_drilldown(empty, "J", "U", "1", 1).count() == 0


def test_no_python_in_any_plan(spark):
    for name, query in QUERIES.items():
        plan = planned(query(spark, FOLDER))
        assert "Python" not in plan and "Pandas" not in plan, name


ORDER_FREE = (
    "recap_by_app", "interval_summary", "response_histogram", "idle_sessions", "long_runners", "plan_rollup",
    "strip_guarded", "statement_xref", "performance_list", "plan_drilldown_every_statement", "doubled_rows_renumbered",
)


@pytest.mark.parametrize("name", ORDER_FREE)
def test_result_does_not_depend_on_partitions(spark, name):
    def rows(partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return sorted(map(str, QUERIES[name](spark, FOLDER).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert rows("1") == rows("8")
