"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to runs; a run holds each digest once, sorted, with the row that
stays and the number of rows. In every round ``fan_in`` runs whose numbers differ in
one digit exchange parts: an entry goes to the run that has, in this digit, the
digit of its digest, and what meets there is merged. After the last round a digest
is in one run only. Nothing larger than a digest moves; a text is read once.

Where a third of all rows are copies, they are spread over all runs and leave each of
them as one entry, and the way back passes the same two steps: from the merged runs
to the first runs, from those to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import numbered
from opsframe.sources.durable import settle

FAN_IN = 8
ROWS_PER_RUN = 25_000
#: What makes two texts equal: SHA-256, verified by length and a second digest.
KEY = ["_sha", "_length", "_second"]
_STRIPPED = " \t\n\x0b\x0c\r"


def stripped(text: Column) -> Column:
    """The text without blanks, tabs, line and page breaks."""
    return F.translate(text, _STRIPPED, "")


def rounds_for(rows: int, fan_in: int = FAN_IN, rows_per_run: int = ROWS_PER_RUN) -> int:
    """Rounds after which ``fan_in`` runs each time have met, with runs of about this size."""
    rounds = 1
    while rows > rows_per_run * fan_in**rounds:
        rounds += 1
    return rounds


def _digit(number: Column, place: int, fan_in: int) -> Column:
    return F.floor(number / F.lit(fan_in**place)).cast("long") % fan_in


def _merged(entries: DataFrame) -> DataFrame:
    """The runs after an exchange: sorted, each digest once with its smallest entry."""
    return (
        entries.repartition("_run")
        .sortWithinPartitions("_run", *KEY)
        .groupBy("_run", *KEY)
        .agg(F.min("_best").alias("_best"), F.sum("_rows").alias("_rows"))
    )


def tree_merge(runs: DataFrame, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs (``_run``, key, ``_best``, ``_rows``) until each digest is in one of them."""
    target = F.pmod("_second", F.lit(fan_in**rounds))
    for place in range(rounds):
        change = (_digit(target, place, fan_in) - _digit(F.col("_run"), place, fan_in)) * F.lit(fan_in**place)
        runs = _merged(runs.withColumn("_run", F.col("_run") + change))
    return runs


def exact_groups(
    docs: DataFrame, *carry: str, fan_in: int = FAN_IN, rows_per_run: int = ROWS_PER_RUN
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of ``carry``.

    Texts are equal when identical without white space; null counts as empty, and all
    empty texts are equal. Of equal texts the row with the most code points stays,
    then the one with the smallest doc_id, where null comes last. Of repeated rows
    with one doc_id exactly one is kept, though all of them carry the keep_id. An
    empty table gives an empty result. Lengths do not matter: a text is digested
    whole. Carried columns may have any name but those returned.
    """
    own = {c: f"_carry{i}" for i, c in enumerate(carry)}
    text = F.coalesce("text", F.lit(""))
    plain = stripped(text)
    rows = numbered(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *[F.col(c).alias(name) for c, name in own.items()],
            F.length(text).alias("_points"),
            F.unhex(F.sha2(plain, 256)).alias("_sha"),
            F.length(plain).alias("_length"),
            F.xxhash64(plain).alias("_second"),
        )
    )
    rounds = rounds_for(rows.count(), fan_in, rows_per_run)
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(fan_in**rounds)))
    # The smallest of these is the row that stays.
    best = F.struct(
        (-F.col("_points")).alias("points"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id").alias("doc_id"),
        F.col("_row").alias("row"),
    )
    first = settle(_merged(rows.select("_run", *KEY, best.alias("_best"), F.lit(1).cast("long").alias("_rows"))))
    last = tree_merge(first, rounds, fan_in).select(*KEY, F.col("_best").alias("_stays"), F.col("_rows").alias("_all"))
    back = first.select("_run", *KEY).join(last, KEY)
    return rows.join(back, ["_run", *KEY]).select(
        "doc_id",
        F.col("_stays.doc_id").alias("keep_id"),
        F.col("_all").alias("group_size"),
        (F.col("_row") == F.col("_stays.row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        *[F.col(name).alias(c) for c, name in own.items()],
    )


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain
  from documents
), g as (
  select *, count(*) over (partition by plain) as group_size,
         first_value(doc_id) over (partition by plain order by length(t) desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(plain) as text_sha256 from g
"""
