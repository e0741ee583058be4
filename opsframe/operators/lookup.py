"""Join rows with per-key facts when some keys hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HEAVY = 10_000


def weighted_lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row per key that counts the
    key's rows in ``weight``.

    A key is heavy when it holds more than one in MOST_HEAVY of all rows, so there
    are fewer than MOST_HEAVY heavy keys however large the data: their facts are
    broadcast and their rows never shuffled. The rows of all other keys meet in a
    shuffle join, where no key is large. Both inputs are read twice; pass tables or
    settled frames.
    """
    total = facts.agg(F.sum(weight)).scalar()
    heavy = F.coalesce(F.col(weight) * MOST_HEAVY > total, F.lit(False))
    hot, cold = facts.where(heavy).drop(weight), facts.where(~heavy).drop(weight)
    found_hot = rows.join(F.broadcast(hot), list(keys))
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return found_hot.unionByName(rest.join(cold, list(keys)))
