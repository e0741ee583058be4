"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The mix is made of blocks of ``block_words`` words. Sources are parties and their
targets are votes: the blocks go to the highest quotients target / (2k + 1). A source
then deals its blocks to its shards in the same way, by the words of each. In a shard
the documents stand in an order that the seed gives, as one ring of words; its blocks
are taken from a seeded start, round and round, so each word is taken equally often
or once more. A block is thus cut from neighbouring documents and ends anywhere.

A quota is found without listing blocks: two divisors bracket the right one, and only
the seats between the two quotas, less than two per party, are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import WORD, numbered
from opsframe.sources.durable import settle

BLOCK_WORDS = 8
SHARD_WORDS = 1_000_000
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)


def apportion(parties: DataFrame, votes: str, seats: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Add ``quota``: how many of the ``seats`` each party gets for its ``votes``, within each group.

    Sainte-Laguë: the seats go to the highest quotients votes / (2k + 1); equal ones
    in the order of ``order``, which must tell parties apart. ``seats`` holds the same
    number in all rows of a group. Parties without votes get nothing.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    voters = F.count(F.when(F.col(votes) > 0, 1)).over(group)
    share = F.col(votes) / F.nullif(F.sum(votes).over(group), F.lit(0))
    # Rounding moves a party by half a seat at most, so these totals enclose the seats.
    least = F.greatest(F.floor(share * (F.col(seats) - voters / 2 - 1) + 0.5), F.lit(0))
    most = F.floor(share * (F.col(seats) + voters / 2 + 1) + 0.5)
    bracket = parties.withColumns(
        {"_least": F.coalesce(least, F.lit(0)).cast("long"), "_most": F.coalesce(most, F.lit(0)).cast("long")}
    ).withColumn("_open", F.col(seats) - F.sum("_least").over(group))
    contested = bracket.where(F.col("_most") > F.col("_least")).select(
        *within, *[c for c in order if c not in within], "_open", votes,
        F.explode(F.sequence("_least", F.col("_most") - 1)).alias("_seat"),
    )
    ranks = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(
        (F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "_seat"
    )
    names = list(dict.fromkeys([*within, *order]))
    won = (
        contested.withColumn("_rank", F.row_number().over(ranks))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*names)
        .agg(F.count("*").alias("_won"))
        .select(*[F.col(c).alias(f"_of_{c}") for c in names], "_won")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]
    return (
        bracket.join(won, same, "left")
        .withColumn("quota", F.col("_least") + F.coalesce("_won", F.lit(0)))
        .select(*parties.columns, "quota")
    )


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size), a row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the
    size of all; no target exceeds ``most`` times its source, and what is over goes
    to the others by weight until none is above. That level is found in one pass:
    by size per weight, the sources that stop are the first ones.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sources.withColumn("_weight", F.array(*[F.lit(float(w)) for w in weights])[turn])
    weighed = weighed.withColumn("_full", F.col("source_size") * F.lit(float(most)))
    level = Window.partitionBy(F.lit(0)).orderBy(F.col("_full") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    rate = left / F.sum("_weight").over(after)
    # The first source that does not stop sets the rate of all after it.
    marked = weighed.withColumn("_rate", F.when(rate * F.col("_weight") <= F.col("_full"), rate))
    marked = marked.withColumn("_rate", F.first("_rate", ignorenulls=True).over(level))
    return marked.select(
        "source", "source_size", F.coalesce(F.col("_rate") * F.col("_weight"), F.col("_full")).alias("target")
    )


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _times(upto: Column, ring: Column, start: Column, end: Column) -> Column:
    """How many of the first ``upto`` steps around a ring fall into [start, end)."""
    rest = F.pmod(upto, ring)
    turns = ((upto - rest) / ring).cast("long")
    part = F.greatest(F.least(rest, end) - start, F.lit(0))
    return turns * (end - start) + part


def mix(
    docs: DataFrame,
    *carry: str,
    weights: Sequence[float] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and how it is taken.

    ``size`` counts the words, ``taken`` those the mix takes with repeats. Further
    columns: ``passes``, how often the whole document is taken, and ``from_word`` and
    ``to_word``, the words taken once more (where that part wraps around the ring,
    ``from_word`` > ``to_word``: all from one and all up to the other). A null source
    is a source; null and empty texts have size 0 and are not taken; null doc_ids and
    repeated rows are documents of their own. A source's taken words miss its target
    by about half a block; of a document no word is taken more than ``most_repeats``
    times. The same rows give the same mix. An empty table gives an empty result.
    Carried columns may have any name but those returned.
    """
    own = {c: f"_carry{i}" for i, c in enumerate(carry)}
    more = [F.col(c).alias(name) for c, name in own.items()]
    rows = numbered(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *more)
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sources, weights, most_repeats).withColumn("_shards", F.ceil(F.col("source_size") / shard_words))
    blocks = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    wanted = settle(
        apportion(wanted.withColumn("_blocks", blocks), "target", "_blocks", ["source"]).withColumnRenamed("quota", "_quota")
    )
    # One small row per source. Adaptive execution measures it before it broadcasts it.
    plan = wanted.withColumnRenamed("source", "_source")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumns(
        {
            "_shard": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest("_shards", F.lit(1))),
            "_place": F.xxhash64(F.lit(seed + 1), "doc_id"),
        }
    )
    shards = dealt.groupBy("source", "_shard", "_quota").agg(F.sum("size").alias("_ring"))
    shards = apportion(shards, "_ring", "_quota", ["_shard"], ["source"]).select(
        F.col("source").alias("_source"), F.col("_shard").alias("_of_shard"), "_ring", "quota"
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_of_shard"))
    ordered = Window.partitionBy("source", "_shard").orderBy("_place", "doc_id", "size", "_row")
    placed = dealt.withColumn("_end", F.sum("size").over(ordered)).join(shards, same)
    ring = F.greatest("_ring", F.lit(1))
    taken = F.least(F.col("quota") * block_words, ring * most_repeats)
    # The seeded start of the shard's first block.
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "_shard"), ring)
    begin = F.col("_end") - F.col("size")
    placed = placed.withColumns({"_begin": begin, "_from": start, "_to": start + taken})
    count = _times(F.col("_to"), ring, F.col("_begin"), F.col("_end")) - _times(F.col("_from"), ring, F.col("_begin"), F.col("_end"))
    placed = placed.withColumn("taken", count.cast("long"))
    size = F.greatest("size", F.lit(1))
    inside = lambda at: F.least(F.greatest(F.pmod(at, ring) - F.col("_begin"), F.lit(0)), F.col("size"))
    passes = F.floor(F.col("taken") / size)
    partly = F.col("taken") % size > 0
    return placed.select(
        "doc_id", "size", "source_size", "target", "taken",
        passes.cast("long").alias("passes"),
        F.when(partly, F.pmod(inside(F.col("_from")), size)).cast("long").alias("from_word"),
        F.when(partly, F.coalesce(F.nullif(inside(F.col("_to")), F.lit(0)), "size")).cast("long").alias("to_word"),
        *[F.col(name).alias(c) for c, name in own.items()],
    )
