"""Filter captures by dated URL lists, as each list stood when a page was fetched.

A list entry is a host or a host with a path, with the day it was listed and the day
it was removed, if it was. Entries of one pattern and category that touch become one
validity interval. A capture asks for the patterns that cover its URL: its host, each
parent domain, and each leading part of its path. Questions are asked once for each
pattern and day, and only for patterns that are listed at all; an as-of join gives
each the interval that began last, which covers the day or does not.

A pattern has as many intervals and questions as there are days at most, so no window
holds more however hot a host is. Answers go back to the captures by a lookup that
does not move the rows of hot patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import numbered
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import settle


def _rest(url: Column) -> Column:
    """A URL without scheme, user, port, query and fragment; the host in lower case."""
    plain = F.regexp_replace(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    plain = F.regexp_replace(plain, r"[?#][\s\S]*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^[^/]*", 0), r"^.*@|:[0-9]*$|\.(?=:[0-9]*$|$)", "")
    return F.concat(F.lower(host), F.regexp_extract(plain, r"/[\s\S]*$", 0))


def canonical(pattern: Column) -> Column:
    """The form in which patterns and URLs are compared; empty ones are null."""
    found = F.regexp_replace(_rest(pattern), "/+$", "")
    return F.when(found != "", found)


def covering(url: Column) -> Column:
    """All patterns that cover a URL: parent domains, the host, leading parts of the path."""
    whole = canonical(url)
    host = F.regexp_extract(whole, r"^[^/]*", 0)
    labels, parts = F.split(host, r"\."), F.split(whole, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.concat(domains, paths))


def validity(entries: DataFrame) -> DataFrame:
    """(category, pattern, valid_from, valid_to) of list entries (category, pattern,
    listed_on, removed_on): disjoint intervals, the end exclusive, null where open."""
    open_end = F.lit("9999-12-31").cast("date")
    days = (
        entries.select(
            "category", canonical(F.col("pattern")).alias("pattern"), F.col("listed_on").cast("date").alias("day"),
            F.coalesce(F.col("removed_on").cast("date"), open_end).alias("end"),
        )
        .where("category is not null and pattern is not null and day is not null and end > day")
        .groupBy("category", "pattern", "day")
        .agg(F.max("end").alias("end"))
    )
    order = Window.partitionBy("category", "pattern").orderBy("day")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (before < F.col("day")), 1).otherwise(0)
    runs = days.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    found = runs.groupBy("category", "pattern", "_run").agg(F.min("day").alias("valid_from"), F.max("end").alias("_end"))
    return found.select("category", "pattern", "valid_from", F.when(F.col("_end") < open_end, F.col("_end")).alias("valid_to"))


def as_of(questions: DataFrame, intervals: DataFrame) -> DataFrame:
    """(pattern, day, category) for every question (pattern, day) and category whose
    last interval to begin until that day still holds."""
    listed = intervals.select("category", "pattern").distinct()
    asked = questions.join(listed, "pattern").select("category", "pattern", "day", F.lit(1).alias("_asks"))
    begun = intervals.select("category", "pattern", F.col("valid_from").alias("day"), F.lit(0).alias("_asks"), F.struct("valid_to").alias("_held"))
    both = asked.withColumn("_held", F.lit(None).cast("struct<valid_to:date>")).unionByName(begun)
    order = Window.partitionBy("category", "pattern").orderBy("day", "_asks")
    held = both.withColumn("_held", F.last("_held", ignorenulls=True).over(order))
    now = F.col("_held").isNotNull() & (F.col("_held.valid_to").isNull() | (F.col("_held.valid_to") > F.col("day")))
    return held.where((F.col("_asks") == 1) & now).select("pattern", "day", "category")


def url_filter(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: ``key``, fetched_on, blocked, categories, evidence.

    ``entries`` are (category, pattern, listed_on, removed_on): an entry counts from
    the day it is listed until the day before its removal; null removal: until now.
    ``categories`` are those that cover the URL on the day of the fetch, ``evidence``
    their "category:pattern", both sorted and joined by commas; empty where nothing
    does. Entries without category, pattern or day, or removed before they count, say
    nothing. Captures whose URL or time is null or empty are not blocked. Repeated
    rows and null keys are captures of their own; an empty table gives an empty result.
    """
    rows = numbered(
        captures.select(F.col(key).alias("_key"), F.col(fetched).cast("date").alias("day"), covering(F.col(url)).alias("_patterns"))
    )
    asks = rows.where("day is not null and _patterns is not null").select("_row", "day", F.explode("_patterns").alias("pattern"))
    questions = asks.groupBy("pattern", "day").agg(F.count("*").alias("n_asks"))
    active = as_of(questions.select("pattern", "day"), validity(entries))
    facts = active.groupBy("pattern", "day").agg(F.collect_set("category").alias("_categories"))
    facts = settle(facts.join(questions, ["pattern", "day"]))
    hits = weighted_lookup(asks, facts, ["pattern", "day"], "n_asks").select("_row", "pattern", F.explode("_categories").alias("category"))
    found = hits.groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "category", "pattern"))), ",").alias("evidence"),
    )
    return rows.join(found, "_row", "left").select(
        F.col("_key").alias(key), F.col("day").alias("fetched_on"), F.col("categories").isNotNull().alias("blocked"),
        F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


# The given tables have neither fetch times nor lists: both follow from the pages, the
# times from the page_id, the entries from a page's host and a first part of its path.
CAPTURES = """
select page_id, url, date_add(date'2024-01-01', cast(page_id * 37 % 365 as int)) as fetched_at from pages
"""
ENTRIES = r"""
select case when page_id % 7 = 0 then 'path' when page_id % 3 = 0 then 'adult' else 'spam' end as category,
       regexp_extract(url, case when page_id % 7 = 0 then '://([^/?#]+/[^/?#]*)' when page_id % 4 = 0 then '://[^/.?#]+[.]([^/?#]+)' else '://([^/?#]+)' end, 1) as pattern,
       date_add(date'2024-01-01', cast(page_id * 53 % 365 as int)) as listed_on,
       case when page_id % 5 > 0 then date_add(date'2024-01-01', cast(page_id * 53 % 365 + 20 + page_id % 40 as int)) end as removed_on
from pages where page_id % 4 < 3 and (url like '%cheap%' or page_id % 11 = 0)
"""
SQL = r"""
with c as (select page_id, url, date '2024-01-01' + cast(page_id * 37 % 365 as int) as day,
         regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as rest from pages),
e as (select case when page_id % 7 = 0 then 'path' when page_id % 3 = 0 then 'adult' else 'spam' end as category,
       rtrim(case when page_id % 7 = 0 then regexp_extract(url, '://([^/?#]+/[^/?#]*)', 1)
         when page_id % 4 = 0 then regexp_extract(url, '://[^/.?#]+[.]([^/?#]+)', 1)
         else regexp_extract(url, '://([^/?#]+)', 1) end, '/') as pattern,
       date '2024-01-01' + cast(page_id * 53 % 365 as int) as listed_on,
       case when page_id % 5 > 0 then date '2024-01-01' + cast(page_id * 53 % 365 + 20 + page_id % 40 as int) end as removed_on
  from pages where page_id % 4 < 3 and (url like '%cheap%' or page_id % 11 = 0)),
u as (select page_id, day, rtrim(rest, '/') as rest, regexp_extract(rest, '^[^/]*') as host from c where rest <> ''),
k as (select page_id, day, unnest(list_distinct(list_concat(
        [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)],
        [array_to_string(string_split(rest, '/')[:i], '/') for i in range(1, len(string_split(rest, '/')) + 1)]))) as pattern from u),
h as (select distinct k.page_id, e.category, e.pattern from k join e on k.pattern = e.pattern
        and e.listed_on <= k.day and (e.removed_on is null or k.day < e.removed_on)),
g as (select page_id, array_to_string(list_sort(list(distinct category)), ',') as categories,
        array_to_string(list_sort(list(category || ':' || pattern)), ',') as evidence from h group by 1)
select c.page_id, cast(c.day as date) as fetched_on, g.page_id is not null as blocked, coalesce(categories, '') as categories,
       coalesce(evidence, '') as evidence from c left join g using (page_id)
"""
