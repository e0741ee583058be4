"""What filters do to each other: every order of five filters, audited step by step.

Each document becomes a mask of the filters it fails, and a part (a source) becomes
cells: how many documents, good ones and toxic ones each of the 32 masks has. That is
all an order needs. A recursive common table expression then extends prefixes of
filters by a letter not used yet, joins each to the cells and carries the bits applied
so far; a level of the recursion emits the metrics of its step. There are 325 prefixes
a part, each computed once, and every order reads its five steps from its prefixes.

DataFrame expressions and SQL only. Texts are reduced to a digest, a mask and a part in
the scan; equal texts meet as digests that are counted before they move, and frequent
digests are looked up without a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import SPACE
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import settle

LEAST_WORDS = 200
LETTERS = "ABCDE"
_CELLS = 1 << len(LETTERS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    failed = (
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        capitals * 100 > F.length(text) * 2,
        F.regexp_like(text, F.lit("[#$%&*|]")),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def failed_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per document: doc_id, part, mask, good, toxic, with a bit for each filter failed.

    Filter E fails where a smaller doc_id has the identical text; a null doc_id is
    larger than all others. A document is good or toxic when any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            failures(text).alias("mask"),
            F.unhex(F.sha2(text, 256)).alias("_digest"),
        )
    )
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(says("quality"), says("toxic"))
    equal = rows.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    found = weighted_lookup(rows, settle(equal), ["_digest"], "_n")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.col("_first").isNotNull())
    own = lambda c: F.coalesce(c, F.lit(False))
    return found.join(marked, "doc_id", "left").select(
        "doc_id",
        "part",
        F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"),
        own("quality").alias("good"),
        own("toxic").alias("toxic"),
    )


def mask_cells(failed: DataFrame) -> DataFrame:
    """One row per part: arrays of documents, good ones and toxic ones by mask."""
    cells = failed.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    # A part has one number for each mask and count: of fixed size.
    by_mask = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(_CELLS)]).alias(c)
    return cells.groupBy("part").agg(by_mask("n"), by_mask("n_good"), by_mask("n_toxic"))


def _total(counts: str, condition: str) -> str:
    return f"aggregate(masks, cast(0 as bigint), (t, m) -> t + if({condition}, w.{counts}[m], 0))"


def _walk_sql(cells: str) -> str:
    """The recursion: a level's rows carry the metrics of the step that their last letter takes."""
    new, bit = "w.applied | f.bit", "f.bit"
    masks = f"sequence(0, {_CELLS - 1})"
    first = f"m & {bit} <> 0 and m & w.applied = 0"
    metrics = {
        "kept": _total("n", f"m & ({new}) = 0"),
        "removed": _total("n", first),
        "redundant": _total("n", f"m & {bit} <> 0 and m & w.applied <> 0"),
        "unique_fails": f"w.n[{bit}]",
        "good_lost": _total("n_good", first),
        "toxic_lost": _total("n_toxic", first),
    }
    zeros = ", ".join(f"cast(0 as bigint) as {name}" for name in metrics)
    emitted = ", ".join(metrics.values()).replace("masks", masks)
    letters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(LETTERS))
    return f"""
with recursive walk as (
  select part, '' as prefix, 0 as step, 0 as applied, n, n_good, n_toxic, {zeros} from {cells}
  union all
  select w.part, concat(w.prefix, f.letter), w.step + 1, {new}, w.n, w.n_good, w.n_toxic, {emitted}
  from walk w join (values {letters}) f(letter, bit) on w.applied & f.bit = 0
)
select part, prefix, step, {", ".join(metrics)} from walk where step > 0"""


def prefix_steps(cells: DataFrame) -> DataFrame:
    """One row per part and ordered choice of filters: prefix, step and the metrics of its last filter.

    The recursion's row limit is lifted while it runs, since rows grow with the parts;
    its depth is the number of filters.
    """
    spark = cells.sparkSession
    name, before = f"cells_{uuid.uuid4().hex}", spark.conf.get(_ROW_LIMIT)
    cells.createOrReplaceTempView(name)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return settle(spark.sql(_walk_sql(name)))
    finally:
        spark.conf.set(_ROW_LIMIT, before)
        spark.catalog.dropTempView(name)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters fail texts of under 200 words (A), with fewer distinct words than half
    of them (B), with over 2% capitals (C), with one of ``#$%&*|`` (D), and texts that
    a smaller doc_id has too, in any part (E). ``kept``, ``removed`` and ``redundant``
    (failing, but removed earlier) are of the step; ``unique_fails`` fail its filter
    only; ``shapley`` sums what its filter removes over all orders. Null texts count as
    empty, null parts as the empty string; null doc_ids have no labels and follow all
    others; repeated rows count each, and are no copies of one another where they share
    the doc_id; labels are joined by doc_id, any 1 among several counts; texts of any
    length are read whole; an empty table gives an empty result, as it has no part;
    other columns are not read.
    """
    steps = prefix_steps(settle(mask_cells(failed_filters(docs, labels, part))))
    size = len(LETTERS)
    letter = F.right("prefix", F.lit(1))
    # A prefix begins as many orders as there are orders of the letters left.
    share = F.col("removed") * F.factorial(F.lit(size) - F.col("step"))
    shapley = steps.groupBy("part", letter.alias("_letter")).agg(F.sum(share).alias("shapley"))
    orders = steps.where(F.col("step") == size).select("part", F.col("prefix").alias("filter_order"))
    places = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    places = places.withColumn("prefix", F.left("filter_order", F.col("step"))).withColumn("_letter", letter)
    joined = places.join(steps.drop("step"), ["part", "prefix"]).join(shapley, ["part", "_letter"])
    return joined.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


SQL = r"""
with l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1
), w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), d as (
  select w.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text),
    regexp_matches(text, '[#$%&*|]'),
    w.doc_id > min(w.doc_id) over (partition by text)
  ] as fails
  from w left join l using (doc_id)
), f as (select unnest(range(1, 6)) as i), o as (
  select [a.i, b.i, c.i, d.i, e.i] as filters from f a, f b, f c, f d, f e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s as (
  select filters, step, array_to_string(list_transform(filters, lambda x: 'ABCDE'[x]), '') as filter_order,
    filters[step] as own, filters[1 : step - 1] as earlier
  from o, (select unnest(range(1, 6))::int as step)
), x as (
  select part, filter_order, step, own,
    count(*) filter (where not fails[own] and not early) as kept,
    count(*) filter (where fails[own] and not early) as removed,
    count(*) filter (where fails[own] and early) as redundant,
    count(*) filter (where fails[own] and len(list_filter(fails, lambda x: x)) = 1) as unique_fails,
    count(*) filter (where good = 1 and fails[own] and not early) as good_lost,
    count(*) filter (where toxic = 1 and fails[own] and not early) as toxic_lost
  from (select *, len(list_filter(earlier, lambda x: fails[x])) > 0 as early from d, s) group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from x
"""
