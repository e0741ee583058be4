"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.sources.durable import discard, settle


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least")).withColumn("_least", F.least("a", "_least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a").where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest one.

    Stars of both kinds alternate until nothing changes, which takes a number of
    rounds that is logarithmic in the components' size. Neighbours are never listed:
    a star is a minimum and a join, and each round is settled. Links of a node to
    itself say nothing.
    """
    current = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(current)
    while state[0]:
        older, current = current, settle(_small_star(_large_star(current)))
        discard(older)
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def more_joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found``, as ``components`` gives it, after more links: only the components' roots meet again."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = found.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    return settle(moved.select("node", F.coalesce("_to", "root").alias("root")).unionByName(joined))
