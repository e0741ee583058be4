"""Look into monitor records: one statement's plan, its files, its matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.sources.durable import settle

# Record ids, operation codes, file-name columns, display order.
STATEMENT, ACCESS_CHECK, OPTIMIZER, HEADER = 1000, 3010, 3014, 3018
PLAN_RECORDS = (1000, 3004, 3007, 3010, 3014, 3015, 3019, 3023, 5002)
UNMATCHED_OPERATIONS = ("FE", "CL", "CH", "HC")
POSITIONED_OPERATIONS = ("DL", "UP")
_MATCH = ("qqjfld", "qqi5")
#: How many records the search for any match looks at before it joins them all.
KEYS_PER_TRY = (200, 5_000)
FILE_NAMES = ("qqtfn", "qvqtbl", "qvptbl", "qqptfn")
DISPLAY_ORDER = {1000: 9000, 3014: 2914, 5002: 2902, 3018: 1}


def _can_match(monitor: DataFrame) -> DataFrame:
    """The statement records that a record of id 3010 can belong to."""
    c = F.col
    positioned = c("qqc21").isin(*POSITIONED_OPERATIONS) & (F.rtrim(c("qqc181")) > "")
    return monitor.where(
        (c("qqrid") == STATEMENT) & c("qqdbclob1").isNull() & ~c("qqc21").isin(*UNMATCHED_OPERATIONS) & ~positioned
    )


def records_with_statement(monitor: DataFrame) -> DataFrame:
    """Records of id 3010 with a statement record of the same key and refresh.

    Not matched are statements with a long-text object, cursor operations, and
    updates or deletes positioned on a cursor. The statements' keys are settled:
    adaptive execution splits a hot key only next to a side it reads as it is, not
    next to one that is still being aggregated.
    """
    statements = settle(_can_match(monitor).select(*_MATCH).distinct())
    return monitor.where(F.col("qqrid") == ACCESS_CHECK).join(statements, list(_MATCH), "left_semi")


def any_record_with_statement(monitor: DataFrame, keys_per_try: Sequence[int] = KEYS_PER_TRY) -> DataFrame:
    """A single row 1 when there is such a record, no row otherwise. Runs Spark jobs at once.

    The keys of some records of id 3010, as many as the first number, are taken from
    the partitions read first; statements are then searched for one of them, partition
    by partition, with the keys pushed to the scan. A hit ends the search. The last
    numbers are larger; where all of them fail, the whole join decides, so a table
    without a match gives no row. Tables where matches are frequent are read in part.
    """
    spark = monitor.sparkSession
    found = spark.range(1).select(F.lit(1).alias("found"))
    checks = monitor.where((F.col("qqrid") == ACCESS_CHECK) & F.col("qqjfld").isNotNull() & F.col("qqi5").isNotNull())
    for wanted in keys_per_try:
        # A limit reads partition after partition, and stops.
        rows = checks.select(*_MATCH).limit(wanted).collect()
        if rows and _hit(monitor, {tuple(row) for row in rows}, checks.select(*_MATCH).schema):
            return found
        if len(rows) < wanted:  # these were all
            return found.where(F.lit(False))
    return records_with_statement(monitor).select(F.lit(1).alias("found")).limit(1)


def _hit(monitor: DataFrame, keys: set[tuple], schema) -> bool:
    """Whether a statement record has one of the keys, a bounded set."""
    table = F.broadcast(monitor.sparkSession.createDataFrame(sorted(keys), schema))
    near = _can_match(monitor).where(F.col("qqjfld").isin(sorted({key for key, _ in keys})))
    return bool(near.select(*_MATCH).join(table, list(_MATCH), "left_semi").take(1))


def referenced_tables(monitor: DataFrame) -> DataFrame:
    """Records that name a file, ordered by record id and name; file names first."""
    rest = [c for c in monitor.columns if c not in ("qqrid", *FILE_NAMES)]
    named = monitor.where(F.col("qqtfn").isNotNull()).select("qqrid", *FILE_NAMES, *rest)
    return named.orderBy("qqrid", "qqtfn", *_row_keys(monitor))


def _row_keys(monitor: DataFrame) -> list[str]:
    """Last sort keys, by which a range sort can split the rows of a hot key."""
    return [c for c in ("qqjfld", "qvrcnt", "qqsmintf", "qqstn", "qqtime") if c in monitor.columns]


def plan_drilldown(
    monitor: DataFrame, job: str, user: str, number: str, unique_count: int, statement: Column | None = None
) -> DataFrame:
    """Records of one statement's plan, with the monitor header, in display order.

    Of each record type the latest refresh (at most 0, as of its optimizer
    record) and the greatest thread remain; records without a thread stay.
    ``statement`` replaces the condition that picks the statement.

    Both maxima come from one aggregate per key, refresh and record type, which
    also looks at records of other statements with the same key. It shrinks on the
    map side and is settled, so that the monitor is read once for it. For a single
    statement only the keys it uses are read: a semi join whose small side adaptive
    execution broadcasts when its measured size allows.
    """
    c = F.col
    chosen = statement if statement is not None else (
        (F.rtrim(c("qqjob")) == job)
        & (F.rtrim(c("qquser")) == user)
        & (c("qqjnum") == number)
        & (c("qqucnt") == unique_count)
    )
    plan_records = monitor.where(c("qqrid").isin(*PLAN_RECORDS))
    records = plan_records.where(chosen)
    considered = plan_records
    if statement is None:
        considered = plan_records.join(records.select("qqjfld").distinct(), "qqjfld", "left_semi")
    groups = settle(considered.groupBy("qqjfld", "qvrcnt", "qqrid").agg(F.max("qqsmintf").alias("_last_thread")))
    refresh = (
        groups.where((c("qqrid") == OPTIMIZER) & (c("qvrcnt") <= 0))
        .groupBy("qqjfld")
        .agg(F.max("qvrcnt").alias("qvrcnt"))
    )
    latest = groups.join(refresh, ["qqjfld", "qvrcnt"], "left_semi")
    matched = records.join(latest, ["qqjfld", "qvrcnt", "qqrid"])
    plan = matched.where(c("qqsmintf").isNull() | (c("qqsmintf") == c("_last_thread"))).select(*monitor.columns)
    header = monitor.where(c("qqrid") == HEADER)
    shown = plan.unionByName(header).withColumn("sortqqrid", _display_order())
    return shown.orderBy("sortqqrid", *_row_keys(monitor))


def _display_order() -> Column:
    order = F
    for record, place in DISPLAY_ORDER.items():
        order = order.when(F.col("qqrid") == record, place)
    return order.otherwise(F.col("qqrid"))
