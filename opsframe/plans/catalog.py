"""One query per job, bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.statement_text import remove_first
from opsframe.operators import (
    checks,
    drilldown,
    generators,
    intervals,
    jobs,
    longrun,
    monitor,
    partitions,
    perflist,
    reasons,
    recap,
    sessions,
    statements,
)
from opsframe.operators.collections import active_collections, active_collections_at
from opsframe.plans.bindings import derived
from opsframe.sources import archive, members
from opsframe.sources.durable import scratch_folder, settle
from opsframe.sources.tables import read_tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the proofs; the SQL counterparts use the same.
AS_OF_EVENTS = "2024-01-31 00:30:00"
AS_OF_COLLECTIONS = "1998-06-15 12:00:00"
WRITTEN_AT = "2024-02-01 00:00:00"
COMPARED_WEEKS = ("2024-01-08", "2024-01-15", "2024-01-22")
STATIC_PROOF = ("QSYS2", "LIB0")
SWEEP_RUNS = (0, 10_000)
SWEEP_RUNS_BOUNDED = (1, 10_000)
DRILLED = {"job": "QZDASOINIT", "user": "QUSER", "number": "000042", "unique_count": 42}

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rendered(df: DataFrame) -> DataFrame:
    """Decimals as doubles: the two engines give quotients different decimal types."""
    kinds = df.schema
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in kinds]
    )


# Error recaps ---------------------------------------------------------------


@query
def recap_by_app(spark, folder):
    return recap.error_recap(derived(spark, folder, "errors"), AS_OF_EVENTS)


@query
def recap_by_message(spark, folder):
    keys = ("failrsn", "dbgroup", "applib", "apptype")
    return recap.error_recap(
        derived(spark, folder, "errors"), AS_OF_EVENTS, "14 days", keys, hidden_keys=("appname",), message="msgs"
    )


# Sample collections ---------------------------------------------------------


@query
def active_collection(spark, folder):
    return active_collections(
        derived(spark, folder, "collections"), derived(spark, folder, "table_members"), AS_OF_COLLECTIONS
    )


@query
def active_collections_at_times(spark, folder):
    tables = [derived(spark, folder, name) for name in ("collections", "table_members", "times")]
    return active_collections_at(*tables)


@query
def bound_member_scan(spark, folder):
    samples = derived(spark, folder, "samples")
    return members.member_scan(samples, samples.agg(F.max(members.MEMBER_COLUMN)))


@query
def bound_samples_one_plan(spark, folder):
    """Two sample tables, kept by member, each bound to a member of its own in one plan."""
    samples, root = derived(spark, folder, "samples"), scratch_folder(spark, "samples")
    tables = {}
    for name in ("QAPMSMJMI", "QAPMSMSYS"):
        samples.write.partitionBy(members.MEMBER_COLUMN).parquet(f"{root}/{name}")
        tables[name] = spark.read.schema(samples.schema).parquet(f"{root}/{name}")
    ids = samples.agg(F.max(members.MEMBER_COLUMN).alias("QAPMSMJMI"), F.min(members.MEMBER_COLUMN).alias("QAPMSMSYS"))
    resolved = ids.unpivot([], ["QAPMSMJMI", "QAPMSMSYS"], "tbl", "mbr")
    bound = members.bound_samples(resolved, tables)
    parts = [df.select(F.lit(name).alias("tbl"), *samples.columns) for name, df in bound.items()]
    return parts[0].unionByName(parts[1])


# Interval performance -------------------------------------------------------


def _summary(spark, folder, **options):
    names = ("job_samples", "os_samples", "pool_samples", "system_samples")
    return intervals.interval_summary(*[derived(spark, folder, n) for n in names], **options)


@query
def interval_summary(spark, folder):
    return rendered(_summary(spark, folder))


@query
def interval_summary_one_pass(spark, folder):
    return rendered(_summary(spark, folder, unique_breakdown=True))


@query
def ratio_metric(spark, folder):
    chosen = (F.col("sitype") == 3) & (F.col("sidid") == 1)
    return rendered(intervals.ratio_metric(derived(spark, folder, "interval_counters"), where=chosen))


@query
def metric_projection(spark, folder):
    return intervals.system_metrics(derived(spark, folder, "supplier_metrics"))


@query
def response_histogram(spark, folder):
    return rendered(intervals.response_histogram(_summary(spark, folder)))


# Sessions and long runners --------------------------------------------------


@query
def idle_sessions(spark, folder):
    return sessions.idle_sessions(derived(spark, folder, "session_samples"), AS_OF_EVENTS)


@query
def idle_sessions_by_timestamp(spark, folder):
    samples = derived(spark, folder, "session_samples")
    return sessions.idle_sessions(samples, AS_OF_EVENTS, cap=20, order_by="timestamp")


@query
def allowlist_load(spark, folder):
    return rendered(longrun.load_allowlist(derived(spark, folder, "allowlist")))


@query
def allowlist_duplicates(spark, folder):
    return checks.duplicate_keys(derived(spark, folder, "allowlist"), longrun.ALLOWLIST_KEY)


def _runners(spark, folder):
    names = ("active_jobs", "job_statements", "allowlist")
    running, texts, allowed = [derived(spark, folder, n) for n in names]
    return longrun.long_runners(running, texts, longrun.load_allowlist(allowed), "2024-01-30 12:00:00")


@query
def long_runners(spark, folder):
    return rendered(_runners(spark, folder))


@query
def kill_list(spark, folder):
    return rendered(longrun.kill_list(_runners(spark, folder)))


@query
def capture_history(spark, folder):
    return rendered(longrun.capture_history(_runners(spark, folder), WRITTEN_AT))


@query
def find_jobs(spark, folder):
    snapshot = derived(spark, folder, "job_snapshot")
    return jobs.find_jobs(
        snapshot, status="*ACTIVE", job_type="*BATCH", user="BUILDING", subsystem="SBS1", name_like="Customer#"
    )


@query
def find_one_job(spark, folder):
    found = jobs.find_jobs(derived(spark, folder, "job_snapshot"), name_like="000007/")
    return jobs.only_value(found, "job_name")


@query
def unfinished_jobs(spark, folder):
    return jobs.unfinished_jobs(derived(spark, folder, "job_snapshot"))


# Plan cache -----------------------------------------------------------------


def _decoded(spark, folder):
    return monitor.decode_statements(derived(spark, folder, "monitor"))


@query
def decode_statements(spark, folder):
    return _decoded(spark, folder)


@query
def plan_rollup(spark, folder):
    return monitor.plan_rollup(_decoded(spark, folder))


@query
def snapshot_latest(spark, folder):
    events = read_tables(spark, folder, "events")["events"]
    return archive.latest_snapshot(events.withColumn(archive.CAPTURE_DATE, F.to_date("ts")))


@query
def snapshot_capture(spark, folder):
    return archive.with_capture_date(_decoded(spark, folder), "2024-02-01")


@query
def snapshot_append(spark, folder):
    """Two captures of one day, which share statements, and one of the next; what the
    archive then holds of both days, and what was refused."""
    numbered = _decoded(spark, folder)
    one, two = numbered.where("statement_number % 3 <> 0"), numbered.where("statement_number % 3 <> 1")
    path = scratch_folder(spark, "archive")
    captures = (("2024-02-01", one), ("2024-02-01", two), ("2024-02-02", one))
    told = [
        archive.append_snapshot(df, day, path).select(F.lit(i).alias("capture"), "status", "statement_number")
        for i, (day, df) in enumerate(captures, 1)
    ]
    refused = told[0].unionByName(told[1]).unionByName(told[2]).where(F.col("status") != archive.ACCEPTED)
    held = archive.read_archive(spark, path).select(
        F.dayofmonth(archive.CAPTURE_DATE).alias("capture"), F.lit("held").alias("status"), "statement_number"
    )
    return held.unionByName(refused)


@query
def snapshot_counts(spark, folder):
    decoded = _decoded(spark, folder)
    return monitor.snapshot_counts(decoded, monitor.plan_rollup(decoded))


@query
def statement_search(spark, folder):
    documents = read_tables(spark, folder, "documents")["documents"]
    return monitor.search_statements(documents, "the", "text").select("doc_id", "lang", "text")


@query
def statement_search_indexed(spark, folder):
    documents = read_tables(spark, folder, "documents")["documents"]
    postings = settle(monitor.trigram_postings(documents, "doc_id", "text").sortWithinPartitions("trigram"))
    return monitor.search_indexed(documents, postings, "the", "doc_id", "text").select("doc_id", "lang", "text")


# Statement texts ------------------------------------------------------------

@query
def table_references(spark, folder):
    return statements.table_references(derived(spark, folder, "statements", even=True))


@query
def table_references_in_prose(spark, folder):
    found = statements.table_references(derived(spark, folder, "document_statements"))
    return found.drop("statement_text")


def _references(spark, folder):
    return statements.table_references(derived(spark, folder, "statements", even=True))


@query
def strip_all(spark, folder):
    texts = derived(spark, folder, "statements", even=True)
    return statements.strip_references(_references(spark, folder), guarded=False, mode="null", statements=texts)


@query
def strip_all_in_row(spark, folder):
    return statements.strip_statements(derived(spark, folder, "statements", even=True), guarded=False, mode="null")


@query
def strip_guarded(spark, folder):
    return statements.strip_references(_references(spark, folder), mode="stop", static=STATIC_PROOF)


@query
def strip_guarded_by_table(spark, folder):
    static, texts = derived(spark, folder, "static_libraries"), derived(spark, folder, "statements", even=True)
    return statements.strip_statements(texts, mode="stop", static=static)


@query
def strip_audit_by_table(spark, folder):
    static, texts = derived(spark, folder, "static_libraries"), derived(spark, folder, "statements", even=True)
    return statements.audit_statements(texts, static)


@query
def strip_audit_null_library(spark, folder):
    static = derived(spark, folder, "static_libraries")
    static = static.union(static.limit(1).select(F.lit(None).cast("string")))
    return statements.strip_audit(_references(spark, folder), dirty=True, static=static)


@query
def strip_guarded_in_row(spark, folder):
    return statements.strip_statements(derived(spark, folder, "statements", even=True), mode="stop", static=STATIC_PROOF)


@query
def strip_guarded_skipping(spark, folder):
    return statements.strip_statements(
        derived(spark, folder, "statements", even=True), mode="skip", static=STATIC_PROOF, keep_static=True
    )


@query
def strip_regex_cases(spark, folder):
    cases = derived(spark, folder, "regex_cases")
    text = F.upper(remove_first(F.col("statement_text"), F.col("schema"))).alias("statement_text")
    forms = [cases.where(F.col("form") == form).select(text) for form in (1, 2, 3, 4)]
    return forms[0].union(forms[1]).union(forms[2]).union(forms[3]).distinct()


@query
def strip_audit_clean(spark, folder):
    return statements.strip_audit(_references(spark, folder), dirty=False, static=STATIC_PROOF)


@query
def strip_audit_dirty(spark, folder):
    return statements.strip_audit(_references(spark, folder), dirty=True, static=STATIC_PROOF)


@query
def strip_audit_in_row(spark, folder):
    return statements.audit_statements(derived(spark, folder, "statements", even=True), STATIC_PROOF)


@query
def strip_sizes(spark, folder):
    texts = derived(spark, folder, "statements", even=True)
    stripped = statements.strip_statements(texts, mode="stop", static=STATIC_PROOF)
    sizes = [
        statements.table_sizes(df).select(F.lit(name).alias("level"), "*")
        for name, df in (("input", texts), ("stripped", stripped))
    ]
    return sizes[0].unionByName(sizes[1])


def _fingerprinted(spark, folder):
    return statements.strip_statements(derived(spark, folder, "statements", even=True), mode="stop", static=STATIC_PROOF)


@query
def fingerprint_counts(spark, folder):
    return statements.fingerprint_counts(_fingerprinted(spark, folder))


@query
def statement_xref(spark, folder):
    return statements.statement_xref(_fingerprinted(spark, folder))


@query
def statement_xref_sizes(spark, folder):
    return statements.table_sizes(statements.statement_xref(_fingerprinted(spark, folder)))


# Checks and comparisons -----------------------------------------------------


@query
def assert_no_rows(spark, folder):
    orders = read_tables(spark, folder, "orders")["orders"]
    return checks.assert_no_rows(orders.where(F.col("o_totalprice") < 0))


@query
def snapshot_compare(spark, folder):
    events = read_tables(spark, folder, "events")["events"]
    first, second, end = [F.lit(day).cast("timestamp_ntz") for day in COMPARED_WEEKS]
    ts, cents = F.col("ts"), F.round(F.col("value") * 100).cast("bigint")

    def week(start, stop):
        return events.where((ts >= start) & (ts < stop)).groupBy("user_id").agg(
            F.sum(cents).alias("access_plan_length"), F.count("*").alias("number_rebuilds")
        )

    return checks.compare_snapshots(
        week(first, second), week(second, end), ["user_id"], ["access_plan_length", "number_rebuilds"]
    )


@query
def rebuild_reasons(spark, folder):
    return reasons.rebuild_reasons(derived(spark, folder, "monitor"))


@query
def save_reasons(spark, folder):
    return reasons.save_reasons(derived(spark, folder, "monitor"))


# Generated data -------------------------------------------------------------


def _order_ids(spark, folder):
    orders = read_tables(spark, folder, "orders")["orders"]
    return orders.select((F.col("o_orderkey") + 1).alias("id"))


@query
def skewed_counts(spark, folder):
    ids = _order_ids(spark, folder)
    tenants = [
        generators.skewed_rows(ids, dominant, singles).select(F.lit(tenant).alias("tenant"), "*")
        for tenant, dominant, singles in ((1, 1, (2, 3)), (2, 2, (1, 3)))
    ]
    rows = tenants[0].unionByName(tenants[1])
    return rows.groupBy("tenant", "mycol").agg(
        F.count("*").alias("cnt"), F.min("myid").alias("first_id"), F.max("myid").alias("last_id")
    )


@query
def month_rows(spark, folder):
    return generators.month_rows(_order_ids(spark, folder), 1, WRITTEN_AT)


@query
def doubled_rows(spark, folder):
    january = generators.month_rows(_order_ids(spark, folder), 1, WRITTEN_AT)
    return generators.double_rows(january, "2024-02-02 00:00:00")


@query
def doubled_rows_renumbered(spark, folder):
    orders = read_tables(spark, folder, "orders")["orders"]
    gaps = orders.select((F.col("o_orderkey") * 3).alias("id"))
    january = generators.month_rows(gaps, 1, WRITTEN_AT)
    return generators.double_rows(january, "2024-02-02 00:00:00", renumber=True)


# Partition views ------------------------------------------------------------

PARTS = {"JANUARY": "F", "FEBRUARY": "O"}
DATA = partitions.DATA_COLUMNS


def _parts(spark, folder):
    months = derived(spark, folder, "months")
    return {name: months.where(F.col("mo") == value) for name, value in PARTS.items()}


def _views(spark, folder):
    parts = _parts(spark, folder)
    return {
        "data_only": partitions.partition_view(parts),
        "with_key": partitions.partition_view(parts, key="mo"),
        "bounded": partitions.partition_view(parts, key="mo", bounds=PARTS),
        "labelled": partitions.partition_view(parts, ("dtanbr", "dtachr", "rid", "chgtsp"), key="mo", label="month_name"),
    }


@query
def pv_data_only(spark, folder):
    return _views(spark, folder)["data_only"]


@query
def pv_with_key(spark, folder):
    return _views(spark, folder)["with_key"]


@query
def pv_bounded(spark, folder):
    return _views(spark, folder)["bounded"].where(F.col("mo") == "O")


@query
def pv_labelled(spark, folder):
    return _views(spark, folder)["labelled"].where((F.col("month_name") == "FEBRUARY") & (F.col("mo") == "O"))


POINTS = {
    "data_only": {"dtanbr": 5},
    "with_key": {"mo": "O", "dtanbr": 5},
    "bounded": {"mo": "O", "dtanbr": 5},
    "labelled": {"month_name": "FEBRUARY", "mo": "O", "dtanbr": 5},
}


def point_view(spark, folder, name):
    return _views(spark, folder)[name]


@query
def pv_point_counts(spark, folder):
    views = _views(spark, folder)
    counts = [
        partitions.count_where(views[name], **fixed).select(F.lit(name).alias("view"), "n") for name, fixed in POINTS.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def point_summary(spark, folder):
    """The counts by value of both parts; a part is opened anew at each check."""
    def part(value):
        return [f"{folder}/lineitem.parquet"], lambda: derived(spark, folder, "months").where(F.col("mo") == value)

    return partitions.CountSummary(spark, {name: part(value) for name, value in PARTS.items()}, "dtanbr", key="mo")


def summary_count(summary, name):
    fixed = dict(POINTS[name])
    return summary.count(fixed.pop("dtanbr"), label=fixed.get("month_name"), key=fixed.get("mo"))


@query
def pv_summary_counts(spark, folder):
    summary = point_summary(spark, folder)
    return spark.createDataFrame([(name, summary_count(summary, name)) for name in POINTS], "view string, n long")


def view_sweep(spark, folder, name):
    first, last = SWEEP_RUNS_BOUNDED if name == "bounded" else SWEEP_RUNS
    fixed = {k: v for k, v in POINTS[name].items() if k != "dtanbr"}
    params = partitions.sweep_params(first, last, spark)
    return partitions.count_sweep(_views(spark, folder)[name], params, "dtanbr", **fixed)


@query
def param_sweep(spark, folder):
    sweeps = [view_sweep(spark, folder, name).select(F.lit(name).alias("view"), "run", "dtanbr", "n") for name in POINTS]
    return sweeps[0].unionByName(sweeps[1]).unionByName(sweeps[2]).unionByName(sweeps[3])


# Monitor analysis -----------------------------------------------------------


@query
def performance_list(spark, folder):
    return rendered(perflist.performance_list(derived(spark, folder, "monitor")))


@query
def performance_top(spark, folder):
    listed = perflist.performance_list(derived(spark, folder, "monitor"))
    return rendered(perflist.by_total_time(listed)).select(
        "qqi6_total", "total_times_run", "qqi6_average", "sql_statement", "qqjfld", "refresh_count"
    )


@query
def records_exist(spark, folder):
    return drilldown.any_record_with_statement(derived(spark, folder, "monitor"))


RECORD_COLUMNS = ("qqrid", "qqjfld", "qqi5", "qqstn", "qqc21", "qqtime")


@query
def records_with_statement(spark, folder):
    return drilldown.records_with_statement(derived(spark, folder, "monitor")).select(*RECORD_COLUMNS)


@query
def referenced_tables(spark, folder):
    return drilldown.referenced_tables(derived(spark, folder, "monitor")).select(
        "qqrid", *drilldown.FILE_NAMES, "qqjfld", "qqstn"
    )


DRILL_COLUMNS = ("sortqqrid", "qqrid", "qqjfld", "qvrcnt", "qqsmintf", "qqstn", "qqjob", "qquser", "qqjnum", "qqucnt")


@query
def plan_drilldown(spark, folder):
    return drilldown.plan_drilldown(derived(spark, folder, "monitor"), **DRILLED).select(*DRILL_COLUMNS)


@query
def plan_drilldown_every_statement(spark, folder):
    return drilldown.plan_drilldown(
        derived(spark, folder, "monitor"), **DRILLED, statement=F.col("qqjob").isNotNull()
    ).select(*DRILL_COLUMNS)
