"""Which sample collection was active at a time, per sample table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import at as moment
from opsframe.sources.durable import settle

# The schema, collection type and tables of the sample sets.
SAMPLE_SCHEMA = "QMPGDATA"
COLLECTION_TYPE = "*CS"
SAMPLE_TABLES = (
    "QAPMSMCMN",
    "QAPMSMDSK",
    "QAPMSMJMI",
    "QAPMSMJOS",
    "QAPMSMPOL",
    "QAPMSMSYS",
    "QAPMJOBOS",
    "QAPMJOBMI",
)
OPEN_END_YEAR = 1
BIN_SECONDS = 6 * 3600
# How many times smaller the next bins are.
FINER = 60
_ZONE_FREE = "timestamp_ntz"
# In this order at one time: it is before a start and not after an end.
_ASKED, _START, _END = range(3)


def active_collections(
    collections: DataFrame,
    table_members: DataFrame,
    at,
    tz: str | None = None,
    fixed_offset_hours: int = 0,
    schema: str = SAMPLE_SCHEMA,
    tables: Sequence[str] = SAMPLE_TABLES,
    collection_type: str = COLLECTION_TYPE,
) -> DataFrame:
    """Per sample table the greatest member of the collections active at ``at``.

    Collection times are UTC and ``at`` is local: active means local start < at
    and local end >= at, where a null end or an end in year 1 is open. ``tz``
    applies zone rules; otherwise ``fixed_offset_hours`` moves ``at`` instead of
    the columns, so the bounds reach the scan. A table without match is left out.
    """
    when = moment(at)
    start, end = F.col("ccstrdt"), F.col("ccenddt")
    if tz:
        start, end = _local(start, tz), _local(end, tz)
    elif fixed_offset_hours:
        when = when - F.expr(f"INTERVAL {fixed_offset_hours} hours")
    still_open = F.col("ccenddt").isNull() | (F.year("ccenddt") == OPEN_END_YEAR)
    active = collections.where((F.col("ccclrid") == collection_type) & (start < when) & (still_open | (end >= when)))
    # Only the member is wanted, so being active is a semi join.
    return (
        table_members.where((F.col("system_table_schema") == schema) & F.col("system_table_name").isin(list(tables)))
        .join(active, F.col("system_table_member") == F.col("cccnname"), "left_semi")
        .groupBy(F.col("system_table_name").alias("tbl"))
        .agg(F.max("system_table_member").alias("mbr"))
    )


def active_collections_at(
    collections: DataFrame,
    table_members: DataFrame,
    times: DataFrame,
    column: str = "asked_at",
    schema: str = SAMPLE_SCHEMA,
    tables: Sequence[str] = SAMPLE_TABLES,
    collection_type: str = COLLECTION_TYPE,
    bin_seconds: int = BIN_SECONDS,
) -> DataFrame:
    """``active_collections`` for every different time of a table: its column, tbl and mbr.

    An interval join by bins of time. A bin that an interval covers whole needs no
    single time: the greatest such member is one number for bin and table, and for open
    ends a running maximum over the bins. In the bin where an interval starts, and in
    the one where it ends, the member is a running maximum over that bin's times, forward
    and backward. Only intervals inside one bin are compared with its times, in ever
    smaller bins. All joins are on table and bin; bins outside the times are not made.
    Null times have no collection.
    """
    when = F.col(column)
    asked = settle(times.select(column).where(when.isNotNull()).distinct())
    least, most = asked.select(_bin(when, 1).alias("_at")).agg(F.min("_at"), F.max("_at")).first()
    if least is None:
        least = most = 0
    open_end = F.col("ccenddt").isNull() | (F.year("ccenddt") == OPEN_END_YEAR)
    start, end = F.col("ccstrdt").cast(_ZONE_FREE), F.when(~open_end, F.col("ccenddt").cast(_ZONE_FREE))
    # Only what can be active at one of the times meets the members.
    kept = collections.where((F.col("ccclrid") == collection_type) & (_bin(start, 1) <= most) & (open_end | (_bin(end, 1) >= least)))
    kept = kept.select(F.col("cccnname").alias("mbr"), start.alias("_start"), end.alias("_end"), open_end.alias("_open"))
    members = table_members.where((F.col("system_table_schema") == schema) & F.col("system_table_name").isin(list(tables)))
    members = members.select(F.col("system_table_name").alias("tbl"), F.col("system_table_member").alias("mbr"))
    spans = settle(members.join(kept, "mbr").distinct())
    found, seconds = None, bin_seconds
    while spans is not None:
        some, spans = _by_bins(asked, spans, column, tables, seconds, (least, most))
        found = some if found is None else found.unionByName(some).groupBy(column).agg(*[F.max(t).alias(t) for t in tables])
        seconds = max(1, seconds // FINER)
    listed = F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), F.col(t).alias("mbr")) for t in tables])).alias("_found")
    return found.select(column, listed).select(column, "_found.tbl", "_found.mbr").where(F.col("mbr").isNotNull())


def _by_bins(
    asked: DataFrame, spans: DataFrame, column: str, tables: Sequence[str], seconds: int, within: tuple[int, int]
) -> tuple[DataFrame, DataFrame | None]:
    """Each time with a column for each table, the greatest member of the spans that reach
    over bins of so many seconds, and the spans that do not, for smaller bins; none are
    left where a bin is a second."""
    when, at = F.col(column), F.col(column).cast(_ZONE_FREE)
    low, high = (F.lit(n // seconds).cast("long") for n in within)
    asked = asked.withColumn("_bin", _bin(when, seconds))
    spans = spans.withColumns({"_first": _bin(F.col("_start"), seconds), "_last": _bin(F.col("_end"), seconds)})
    reach = spans.where(F.col("_open") | (F.col("_last") > F.col("_first")))
    # Whole bins, from the one after the start.
    begin = F.greatest(F.col("_first") + 1, low)
    until = F.least(F.col("_last") - 1, high)
    closed = reach.where(~F.col("_open") & (until >= begin))
    closed = closed.select("tbl", F.explode(F.sequence(begin, until)).alias("_bin"), "mbr")
    opened = reach.where("_open").select("tbl", begin.alias("_bin"), "mbr").groupBy("tbl", "_bin").agg(F.max("mbr").alias("mbr"))
    # One row for each table and bin; running on to the bins that are asked for.
    names = F.explode(F.array(*[F.lit(t) for t in tables])).alias("tbl")
    wanted = asked.select("_bin").distinct().select(names, "_bin", F.lit(None).cast("string").alias("mbr"))
    so_far = Window.partitionBy("tbl").orderBy("_bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = opened.unionByName(wanted).select("tbl", "_bin", F.max("mbr").over(so_far).alias("mbr")).where("mbr is not null")
    greatest = [F.max(F.when(F.col("tbl") == t, F.col("mbr"))) for t in tables]
    whole = closed.unionByName(running).groupBy("_bin").agg(*[m.alias(t) for m, t in zip(greatest, tables, strict=True)])
    # The bins of the ends: a time is before a start at it and not after an end at it.
    none = F.lit(None).cast("string")
    points = asked.select("_bin", at.alias("_at"), F.lit(_ASKED).alias("_kind"), none.alias("tbl"), none.alias("mbr"), when)
    for bin_, stamp, kind in (("_first", "_start", _START), ("_last", "_end", _END)):
        edges = reach.where(F.col(bin_).between(low, high)).groupBy("tbl", F.col(bin_).alias("_bin"), F.col(stamp).alias("_at"))
        points = points.unionByName(
            edges.agg(F.max("mbr").alias("mbr")).withColumn("_kind", F.lit(kind)), allowMissingColumns=True
        )
    by_bin = Window.partitionBy("_bin")
    forward, backward = by_bin.orderBy("_at", "_kind"), by_bin.orderBy(F.desc("_at"), F.desc("_kind"))
    for kind, order in ((_START, forward), (_END, backward)):
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = {f"_{kind}{t}": F.max(F.when((F.col("_kind") == kind) & (F.col("tbl") == t), F.col("mbr"))).over(so_far) for t in tables}
        points = points.withColumns(passed)
    found = points.where(F.col("_kind") == _ASKED).join(whole, "_bin", "left")
    found = found.select(when, *[F.greatest(t, f"_{_START}{t}", f"_{_END}{t}").alias(t) for t in tables])
    inside = spans.where(~F.col("_open") & (F.col("_last") == F.col("_first")))
    if not inside.limit(1).count():
        return found, None
    if seconds > 1:
        return found, inside.drop("_first", "_last")
    active = (F.col("_start") < at) & (F.col("_end") >= at)
    pairs = asked.join(inside.select("tbl", "mbr", "_start", "_end", F.col("_first").alias("_bin")), "_bin").where(active)
    paired = pairs.groupBy(column).agg(*[m.alias(t) for m, t in zip(greatest, tables, strict=True)])
    return found.unionByName(paired).groupBy(column).agg(*[F.max(t).alias(t) for t in tables]), None


def _bin(stamp: Column, seconds: int) -> Column:
    """The number of the bin a time is in, whatever zone the session has."""
    origin = F.lit("1970-01-01").cast(_ZONE_FREE)
    return F.floor(F.timestamp_diff("SECOND", origin, stamp.cast(_ZONE_FREE)) / seconds)


def _local(stamp: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), stamp.cast("timestamp_ntz"))
