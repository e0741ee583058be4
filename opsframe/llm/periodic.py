"""Runs of a period in the words of a text, by suffix trees and Lyndon roots.

A run is a stretch that repeats with its smallest period and cannot be extended. Every
run holds a Lyndon word of its period's length (in the order of words or in the
opposite one) that is the longest one to start where it starts. So the longest Lyndon
words at all places, in both orders, are the candidates, two a word; the suffix trees
of the words and of their reversal tell in constant time how far each goes on to the
right and to the left. Nothing else is tried, so the work is linear in the text.

A word of a run of exponent e stands in it at least e times. So a word that is rarer
than that within a stretch lies in no run and parts the stretch; what remains after
this is searched. Texts without repetition never come to a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import SPACE, WORD, batch, map_arrow, texts, with_columns
from opsframe.llm.suffix_tree import SuffixTree, next_smaller

LEAST_WORDS = 6
LEAST_EXPONENT = 4
_WORD = re.compile(WORD)


def all_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of two periods or more in whole numbers from 1."""
    m = len(symbols)
    forward = SuffixTree(symbols)
    begin = np.tile(np.arange(m), 2)
    end = np.concatenate([next_smaller(ranks) for ranks in (forward.ranks, forward.ranks_reversed())])
    right = forward.common(begin, end)
    del forward
    left = SuffixTree(symbols[::-1]).common(m - begin, m - end)
    start, stop, period = begin - left, end + right, end - begin
    found = np.unique(np.stack([start, stop - start, period], axis=1)[stop - start >= 2 * period], axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def frequent_stretches(symbols: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of ``least`` symbols or more, cut at all symbols that stand in
    theirs less than ``times``, as often as that finds one."""
    todo = [(0, len(symbols))]
    while todo:
        start, end = todo.pop()
        if end - start < least:
            continue
        _, place, count = np.unique(symbols[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[place] < times)
        if not len(rare):
            yield start, end
            continue
        edges = np.concatenate(([-1], rare, [end - start]))
        long = np.flatnonzero(np.diff(edges) > least)
        todo += [(start + int(edges[i]) + 1, start + int(edges[i + 1])) for i in long]


def runs_of(words: list[str], least_words: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of the runs that are long enough."""
    code: dict[str, int] = {}
    symbols = np.array([code.setdefault(word, len(code)) for word in words], dtype=np.int64)
    found = []
    for low, high in frequent_stretches(symbols, least_exponent, max(least_words, least_exponent)):
        part = np.unique(symbols[low:high], return_inverse=True)[1] + 1
        start, length, period = all_runs(part)
        enough = length >= np.maximum(least_words, least_exponent * period)
        found += zip((start[enough] + low).tolist(), length[enough].tolist(), period[enough].tolist(), strict=True)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    dropped = np.cumsum(steps[:-1]) > 0
    return [word for word, gone in zip(words, dropped.tolist(), strict=True) if not gone]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "doc_id long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
_FOUND_TYPES = {"doc_id": pa.int64(), "runs": pa.list_(_RUN), "best": _RUN, "collapsed": pa.string()}


def _best(run: tuple[int, int, int]) -> tuple:
    start, length, period = run
    return -Fraction(length, period), start, period


def _searched(least_words: int, least_exponent: int, carry: tuple[str, ...]):
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in batches:
            out: dict[str, list] = {"runs": [], "best": [], "collapsed": []}
            for text in docs.column("text").to_pylist():
                words = _WORD.findall(text)
                runs = runs_of(words, least_words, least_exponent)
                out["runs"].append([dict(zip(names, r, strict=True)) for r in runs])
                out["best"].append(dict(zip(names, min(runs, key=_best), strict=True)) if runs else None)
                out["collapsed"].append(" ".join(collapsed(words, runs)))
            yield with_columns(batch({"doc_id": docs.column("doc_id"), **out}, _FOUND_TYPES), docs, carry)

    return run


def periodic_runs(
    docs: DataFrame, *carry: str, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """One row per document: doc_id, runs, best, collapsed, and the columns of ``carry``.

    Words are what white space parts, numbered from 0. ``runs`` are all runs of
    ``least_words`` words and ``least_exponent`` (2 or more) periods at least, as structs
    of start, length and period, by start, then period. ``best`` is the one with the
    greatest length by period, ties to the smaller start, then period; null without
    runs. ``collapsed`` is the text without the words that repeat a run's first period,
    joined by single blanks. Null and empty texts have no word and no run; null doc_ids
    and repeated rows are documents of their own; a text of any length is one document,
    and its trees take some 500 bytes for each word that is left to search; an empty
    table gives an empty result. Carried columns may have any name but those returned.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    own = {c: f"_carry{i}" for i, c in enumerate(carry)}
    extra = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for c, name in own.items())
    rows = texts(docs, *[F.col(c).alias(name) for c, name in own.items()])
    found = map_arrow(rows, _searched(least_words, least_exponent, tuple(own.values())), _FOUND + extra)
    return found.select("doc_id", "runs", "best", "collapsed", *[F.col(name).alias(c) for c, name in own.items()])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents with a run planted in those whose id says so: where the checksum h of
    the id is a multiple of 10, word i >= a becomes word a + (i - a) % p."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - F.col("_a")) / (3 + g % 8))
    place = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    rows = docs.select("doc_id", "text", h.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    rows = rows.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the best run, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[name].alias(name) for name in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
      string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, case when xor(a, b) & 1 = 1 then 3988292384 else 0 end))) as h
  from documents
), a as (
  select *, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from d
), p as (select *, 1 + (n - a) // (3 + g % 8) as p from a
), w as (
  select doc_id, n, unnest(range(n)) as i,
    unnest(list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end])) as word
  from p
), e as (
  select x.doc_id, x.n, x.i, y.i - x.i as q from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i
    and 4 * (y.i - x.i) <= x.n
), g as (select *, i - row_number() over (partition by doc_id, q order by i) as island from e
), s as (
  select doc_id, min(i) as start, count(*) + q as length, q from g group by doc_id, q, island
  having count(*) + q >= greatest(6, 4 * q)
), r as (select doc_id, start, length, min(q) as period from s group by all
), b as (
  select *, row_number() over (partition by doc_id order by length / period desc, start, period) as place from r
), t as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs
  from r group by doc_id
), gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r
), c as (
  select w.doc_id, string_agg(word, ' ' order by w.i) as kept from w anti join gone on gone.doc_id = w.doc_id and gone.i = w.i
  group by 1
)
select d.doc_id, coalesce(t.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length,
  b.period::bigint as period, (1000 * b.length // b.period)::bigint as exponent_milli, sha256(coalesce(t.runs, '')) as runs_sha256,
  sha256(coalesce(c.kept, '')) as collapsed_sha256
from d left join t on t.doc_id = d.doc_id left join b on b.doc_id = d.doc_id and b.place = 1
  left join c on c.doc_id = d.doc_id
"""
