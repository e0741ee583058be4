"""Performance list of explainable statements from query-monitor records.

Maxima of text make Spark aggregate by sorting; a digest in front of the group
keys lets those sorts compare one long, as keys tend to share their first bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import div, from_units, ratio_cut
from opsframe.sources.durable import settle

# Record ids and operation codes of the monitor.
STATEMENT, OPTIMIZER, STATISTICS, RETRIEVAL, INDEX = 1000, 3014, 3015, 3019, 3020
LISTED_OPERATIONS = (
    "DC", "OP", "FE", "CL", "HC", "UP", "DL", "IN", "SI", "SK", "SV", "VI", "QF", "QM", "QQ", "QR",
)
CURSOR_OPERATIONS = ("FE", "CL", "HC")
POSITIONED_OPERATIONS = ("UP", "DL")
THREADED = "1"
UNKNOWN = "UNKNOWN"

_KEY, _REFRESH, _THREAD = "qqjfld", "refresh_count", "_thread"
# Output name and 3019 column of what a retrieval record counts.
_RETRIEVED = {
    "rows_returned_3019": "qqi7",
    "row_retrieval_cpu_time": "qqi1",
    "row_retrieval_clock_time": "qqi2",
    "synchronous_db_reads": "qqi3",
    "synchronous_db_writes": "qqi4",
    "asynchronous_db_reads": "qqi5",
    "asynchronous_db_writes": "qqi6",
    "page_faults": "qvp151",
    "calls_to_retrieve_rows": "qqi8",
}
_AVERAGES = {
    "avg_rows_returned_to_db": "rows_returned_3019",
    "average_row_retrieval_cpu_time": "row_retrieval_cpu_time",
    "average_row_retrieval_clock_time": "row_retrieval_clock_time",
    "average_synchronous_db_reads": "synchronous_db_reads",
    "average_synchronous_db_writes": "synchronous_db_writes",
    "average_asynchronous_db_reads": "asynchronous_db_reads",
    "average_asynchronous_db_writes": "asynchronous_db_writes",
    "average_page_faults": "page_faults",
    "average_calls_to_retrieve_rows": "calls_to_retrieve_rows",
}
_MILLISECONDS = ("qqi1", "qqi2")


def performance_list(monitor: DataFrame) -> DataFrame:
    """Per statement key and thread: times, runs and rows, with what the optimizer
    and the retrieval records of the same refresh say about the key.

    Statement records and plan records are each scanned once and aggregated on
    their key before they meet, so a key with a third of all records shrinks on
    the map side. The statement aggregates, one row per key and thread, decide
    three things (which keys count, which refreshes, the list itself) and are
    settled first, or each use would scan the monitor again.
    """
    threads = settle(_statement_threads(monitor))
    explainable = threads.where("_explainable").select(_KEY).distinct()
    runs = threads.where(F.col("total_times_run") > 0).join(explainable, _KEY, "left_semi")
    details = _plan_details(monitor, runs.select(_KEY, _REFRESH).distinct())
    joined = runs.join(details, _KEY, "left")
    times = F.col("total_times_run")
    return joined.select(
        "qqstim",
        _seconds("_worst").alias("qqi6_worst"),
        _seconds("_total").alias("qqi6_total"),
        times.cast("decimal(15,0)").alias("total_times_run"),
        from_units(div(F.col("_total"), times), 15, 6).alias("qqi6_average"),
        F.coalesce("_text", F.lit(UNKNOWN)).alias("sql_statement"),
        "current_user",
        "qqjob",
        "qquser",
        "qqjnum",
        F.col("_optimization").cast("decimal(19,6)").alias("optimization_time"),
        from_units(F.col("_adjusted"), 19, 6).alias("adjusted_average_time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("index_advised", "statistics_advised", "temp_storage")],
        ratio_cut(F.col("_rows"), times, 17, 6).alias("result_rows"),
        *[ratio_cut(F.col(total), times, 19, 6).alias(name) for name, total in _AVERAGES.items()],
        "qqsys",
        "qqrdbn",
        "qqudef",
        "qro_hash",
        _REFRESH,
        "qqucnt",
        _KEY,
    ).orderBy(F.desc("qqstim"), _KEY)


def by_total_time(listed: DataFrame) -> DataFrame:
    """The list with the statements that took most time in total first."""
    return listed.orderBy(F.desc("qqi6_total"), _KEY)


def _statement_threads(monitor: DataFrame) -> DataFrame:
    """Aggregates of the complete, listed statement records per key and thread,
    and whether any statement record of the group makes the key explainable."""
    c = F.col
    listed = (c("qvc1c") == "Y") | c("qqc21").isin(*LISTED_OPERATIONS)
    complete = c("qqstim").isNotNull() & c("qqetim").isNotNull() & c("qq1000").isNotNull()
    explainable = c("qq1000l").isNotNull() & (c("qqucnt") > 0) & ((c("qvc1c") == "Y") | (c("qqi8") >= 0))
    taken = F.coalesce(complete & listed, F.lit(False))
    marks = F.coalesce(explainable, F.lit(False))
    measures = {
        "qqucnt": c("qqucnt"),
        _REFRESH: c("qvrcnt"),
        "_worst": F.coalesce("qvp15d", "qqi6"),
        "_total": c("qqi6"),
        "_runs": F.coalesce("qvp15f", _is_query()),
        "_rows": F.coalesce("qqi3", F.when(c("qqi2") < 0, 0).otherwise(c("qqi2"))),
        "_text": F.when(_is_query() == 1, c("qq1000l")),
        "qqstim": c("qqstim"),
        "current_user": c("qvc102"),
        **{name: c(name) for name in ("qqjob", "qquser", "qqjnum", "qqsys", "qqrdbn", "qqudef")},
    }
    records = monitor.where(c("qqrid") == STATEMENT).select(
        _KEY,
        F.when(c("qxc16") == THREADED, c("qqsmintf")).alias(_THREAD),
        taken.alias("_taken"),
        marks.alias("_explainable"),
        *[value.alias(name) for name, value in measures.items()],
    )
    folds = {_REFRESH: F.min, "qqstim": F.min, "_total": F.sum, "_rows": F.sum, "_runs": F.sum}
    names = {"_runs": "total_times_run"}
    return (
        records.where("_taken OR _explainable")
        .groupBy(F.xxhash64(_KEY).alias("_digest"), _KEY, _THREAD)
        .agg(
            F.bool_or("_explainable").alias("_explainable"),
            *[folds.get(n, F.max)(F.when(c("_taken"), c(n))).alias(names.get(n, n)) for n in measures],
        )
        .drop("_digest")
    )


def _is_query() -> Column:
    """1 for records that ran a statement of their own, 0 for parts of another one."""
    operation, cursor = F.col("qqc21"), F.col("qqc181")
    own = ~operation.isin(*CURSOR_OPERATIONS, *POSITIONED_OPERATIONS)
    searched = operation.isin(*POSITIONED_OPERATIONS) & ((F.rtrim(cursor) == "") | F.col("qvp15d").isNotNull())
    return F.when((own | searched) & (F.rtrim("qq1000l") != ""), 1).otherwise(0)


def _plan_details(monitor: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per key, over the refreshes that were listed: advice, times, I/O, plan hash.

    The sums per (key, refresh) are formed before the semi join: being listed
    depends on these two columns only. The plan hash, a text, is a group key of
    that first pass, which leaves it hash based; its maximum is taken afterwards.
    """

    def of(record: int, value: Column) -> Column:
        return F.when(F.col("qqrid") == record, value)

    def retrieved(column: str) -> Column:
        value = F.col(column)
        return of(RETRIEVAL, div(value, F.lit(1000)) if column in _MILLISECONDS else value)

    sums = {
        "index_advised": of(INDEX, F.lit(1)),
        "statistics_advised": of(STATISTICS, F.lit(1)),
        "_optimization": of(OPTIMIZER, div(F.col("qqi5"), F.lit(1000))),
        "_adjusted": of(OPTIMIZER, F.col("qqf1").cast("bigint")),
        **{name: retrieved(column) for name, column in _RETRIEVED.items()},
    }
    plan_hash = of(OPTIMIZER, F.col("qqc83")).alias("qro_hash")
    per_refresh = (
        monitor.where(F.col("qqrid").isin(OPTIMIZER, STATISTICS, RETRIEVAL, INDEX))
        .groupBy(_KEY, F.col("qvrcnt").alias(_REFRESH), plan_hash)
        .agg(*[F.sum(v).alias(n) for n, v in sums.items()], F.max("qqint03").alias("temp_storage"))
    )
    return (
        per_refresh.join(wanted, [_KEY, _REFRESH], "left_semi")
        .groupBy(_KEY)
        .agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in ("temp_storage", "qro_hash")])
    )


def _seconds(micros: str) -> Column:
    return from_units(F.col(micros), 15, 6)
