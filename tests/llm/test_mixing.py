"""Sainte-Laguë quotas against the list of all quotients."""

from __future__ import annotations

import random

from opsframe.llm import mixing


def brute_quotas(votes, seats):
    """Seats to the highest quotients, ties to the smaller name."""
    quotients = [(-v / (2 * k + 1), name) for name, v in votes.items() if v > 0 for k in range(seats)]
    quota = dict.fromkeys(votes, 0)
    for _, name in sorted(quotients)[:seats]:
        quota[name] += 1
    return quota


def test_quotas_equal_the_highest_quotients(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for group in range(25):
        seats = rnd.choice([0, 1, 2, 7, 40, 100])
        votes = {f"p{i}": rnd.choice([0, 1, 3, 3, 9, 10, 50, 1000]) for i in range(rnd.randint(1, 9))}
        rows += [(group, name, float(v), seats) for name, v in votes.items()]
        want |= {(group, name): n for name, n in brute_quotas(votes, seats).items()}
    parties = spark.createDataFrame(rows, "g int, name string, votes double, seats long")
    got = {(r.g, r.name): r.quota for r in mixing.apportion(parties, "votes", "seats", ["name"], ["g"]).collect()}
    assert got == want


def test_odd_rows_of_the_mix(spark):
    rows = [
        (None, "a b c", "x"), (None, "a b c", "x"), (1, None, "x"), (2, "", None), (3, "one two", None), (4, "w " * 5000, "y"), (4, "w " * 5000, "y"),
        (5, "", "empty"), (6, None, "empty"),
    ]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, quota int")
    out = mixing.mix(docs, "quota").collect()
    assert len(out) == len(rows) and all(r.quota == 7 for r in out)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    taken, target = {}, {}
    for r in out:
        key = r.source_size, r.target
        taken[key], target[key] = taken.get(key, 0) + r.taken, r.target
    assert all(abs(taken[k] - target[k]) <= mixing.BLOCK_WORDS for k in taken)
    again = mixing.mix(docs.repartition(3), "quota").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0)).count() == 0
