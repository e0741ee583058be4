"""Nearest neighbours by inner product with cross-polytope hashing.

A vector is rotated at random - three rounds of random signs and a fast Hadamard
transform - and falls to the signed axis it is nearest to. A table's bucket is made of
one or more such axes. Queries also probe the buckets of their next nearest axes.
For inner products of vectors of different length, indexed vectors get one more
component that brings them to the length of the longest, and queries a zero there.

Equal vectors are indexed once, with the smallest ids they can be reported by. The
buckets of a table are dealt to a few bins, and bins to slices of bounded size, so a
query travels once to each slice with the list of buckets it probes there. A task
gives each query its best in the slice under the exact measure, so what moves is a few
rows per query and slice, and all that share a probed bucket are compared.

A query that has found fewer than asked for is compared with all indexed vectors, in
the same slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import batch, map_arrow, numbered, random_longs
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import settle

NEIGHBOURS = 20
EVERY = 20  # ids divisible by this are the queries
TABLES = 5
PROBES = 48
AXES = 1
BINS = 8
SLICE = 65_536
_BLOCK = 256


def _signs(tables: int, hashes: int, width: int, seed: int) -> np.ndarray:
    bits = random_longs(tables * hashes * 3 * width, seed) >> np.uint64(40)
    return np.where(bits & np.uint64(1), 1.0, -1.0).reshape(tables, hashes, 3, width)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, of a width that is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x


class CrossPolytope:
    """Bucket numbers of unit vectors, and the buckets a query should look into."""

    def __init__(self, dimensions: int, tables: int, hashes: int, seed: int = 7):
        self.width = 1 << max(dimensions - 1, 1).bit_length()
        self.tables, self.hashes = tables, hashes
        self._signs = _signs(tables, hashes, self.width, seed)

    def _axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """For each row and hash the pull of all signed axes."""
        padded = np.zeros((len(x), self.width))
        padded[:, : x.shape[1]] = x
        out = []
        for signs in self._signs[table]:
            turned = padded
            for sign in signs:
                turned = hadamard(turned * sign)
            out.append(np.concatenate((turned, -turned), axis=1) / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-300))
        return np.stack(out, axis=1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        number = np.zeros(len(x), dtype=np.int64)
        for axis in self._axes(x, table).argmax(axis=2).T:
            number = number * 2 * self.width + axis
        return number

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` buckets of each row whose axes it leans to most, best first."""
        pull = self._axes(x, table)
        order = np.argsort(-pull, axis=2, kind="stable")[:, :, :most]
        number, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for h in range(self.hashes):
            top = np.take_along_axis(pull[:, h], order[:, h], axis=1)
            cost = (cost[:, :, None] + (top[:, :1] - top)[:, None, :]).reshape(len(x), -1)
            number = (number[:, :, None] * 2 * self.width + order[:, h][:, None, :]).reshape(len(x), -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :most]
            cost, number = np.take_along_axis(cost, keep, axis=1), np.take_along_axis(number, keep, axis=1)
        return number


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), width)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed over the components in order, so that a pair
    has one score wherever it is computed."""
    total = np.zeros(len(queries))
    for component in range(queries.shape[1]):
        total += queries[:, component] * vectors[:, component]
    return total


def _hashed(width: int, longest: float, tables: int, hashes: int, most: int, every_cell: bool):
    """A row for each table and bin: an indexed vector's bucket, or those a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = CrossPolytope(width + 1, tables, hashes)
        for rows in batches:
            if not rows.num_rows:
                continue
            query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
            x = _matrix(rows.column("vector"), width)
            norms = np.linalg.norm(x, axis=1)
            unit = x / np.where(query, norms, longest)[:, None]
            last = np.where(query, 0.0, np.sqrt(np.maximum(0.0, 1 - (norms / longest) ** 2)))
            unit = np.column_stack((unit, last))
            stored, asking = np.flatnonzero(~query), np.flatnonzero(query)
            places, groups, cells = [], [], []
            for table in range(tables):
                if len(stored):
                    found = family.buckets(unit[stored], table)
                    places += stored.tolist()
                    groups += (table * BINS + found % BINS).tolist()
                    cells += found[:, None].tolist()
                if len(asking) and every_cell:
                    for b in range(BINS):
                        places += asking.tolist()
                        groups += [table * BINS + b] * len(asking)
                        cells += [[]] * len(asking)
                elif len(asking):
                    for place, own in zip(asking.tolist(), family.probes(unit[asking], table, most), strict=True):
                        for b in np.unique(own % BINS).tolist():
                            places.append(place)
                            groups.append(table * BINS + b)
                            cells.append(own[own % BINS == b].tolist())
            take = pa.array(places, type=pa.int64())
            columns = [rows.column(c).take(take) for c in ("id", "vector", "copies", "query")]
            columns += [pa.array(groups, type=pa.int64()), pa.array(cells, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "copies", "query", "bin", "cells"])

    return run


_FOUND = {"asked": pa.int64(), "id": pa.int64(), "score": pa.float64(), "copies": pa.list_(pa.int64())}


def _best(scores: np.ndarray, first_ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k best are; ties go to the smaller id."""
    return np.lexsort((first_ids, -scores))[:k]


def _searched(width: int, k: int):
    """The best of each slice for each query that comes to it. Rows come sorted by
    slice, the indexed vectors first and by bucket."""

    def answers(stored: dict[str, np.ndarray], rows: pa.RecordBatch) -> pa.RecordBatch:
        vectors, ids, first, copies, cell = (stored[c] for c in ("vector", "id", "first", "copies", "cell"))
        asked, probed = rows.column("id").to_numpy(), rows.column("cells").to_pylist()
        x = _matrix(rows.column("vector"), width)
        seen, starts = np.unique(cell, return_index=True)
        ends = np.append(starts[1:], len(cell))
        wanted: dict[int, list[int]] = {}
        for i, cells in enumerate(probed):
            for c in cells or seen.tolist():
                wanted.setdefault(c, []).append(i)
        best: list[list[np.ndarray]] = [[] for _ in probed]
        for c, start, end in zip(seen.tolist(), starts.tolist(), ends.tolist(), strict=True):
            who = wanted.get(c)
            if not who:
                continue
            rough = x[who] @ vectors[start:end].T
            if rough.shape[1] > k:
                slack = 1e-9 * (1 + np.abs(rough).max(axis=1, keepdims=True))
                near = rough >= -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k] - slack
            else:
                near = np.ones(rough.shape, dtype=bool)
            for i, row in zip(who, near, strict=True):
                best[i].append(np.flatnonzero(row) + start)
        out: dict[str, list] = {name: [] for name in _FOUND}
        for i, parts in enumerate(best):
            if not parts:
                continue
            at = np.concatenate(parts)
            scores = exact_scores(np.broadcast_to(x[i], (len(at), width)), vectors[at])
            top = _best(scores, first[at], k)
            out["asked"] += [int(asked[i])] * len(top)
            out["id"] += ids[at[top]].tolist()
            out["score"] += scores[top].tolist()
            out["copies"] += [copies[j] for j in at[top].tolist()]
        return batch(out, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, ready = None, [], None
        for rows in batches:
            if not rows.num_rows:
                continue
            marks = rows.column("bin").to_numpy(), rows.column("slice").to_numpy(), rows.column("query").to_numpy(zero_copy_only=False)
            change = np.zeros(rows.num_rows - 1, dtype=bool)
            for mark in marks:
                change |= mark[1:] != mark[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), rows.num_rows]
            for start, end in zip(edges, edges[1:]):
                part = rows.slice(start, end - start)
                group = int(marks[0][start]), int(marks[1][start])
                if group != current:
                    current, parts, ready = group, [], None
                if not marks[2][start]:
                    parts.append(part)
                    continue
                if ready is None and parts:
                    copies = [c for p in parts for c in p.column("copies").to_pylist()]
                    ready = {
                        "vector": np.concatenate([_matrix(p.column("vector"), width) for p in parts]),
                        "id": np.concatenate([p.column("id").to_numpy() for p in parts]),
                        "cell": np.concatenate([p.column("cells").flatten().to_numpy() for p in parts]),
                        "copies": copies,
                        "first": np.array([c[0] for c in copies]),
                    }
                    parts = []
                for at in range(0, part.num_rows if ready else 0, _BLOCK):
                    yield answers(ready, part.slice(at, _BLOCK))

    return run


def _matches(index: DataFrame, asking: DataFrame, width: int, longest: float, k: int, slice_rows: int, **how) -> DataFrame:
    """(asked, id, score, copies): the k best, ties included, of what each query meets."""
    rows = index.select("id", "vector", "copies", F.lit(False).alias("query")).unionByName(
        asking.select("id", "vector", F.lit(None).cast("array<long>").alias("copies"), F.lit(True).alias("query"))
    )
    schema = f"id long, vector {index.schema['vector'].dataType.simpleString()}, copies array<long>, query boolean, bin long, cells array<long>"
    hashed = map_arrow(rows, _hashed(width, longest, **how), schema)
    # However many rows fall into one bin, a slice of it holds about ``slice_rows`` at most.
    slices = max(1, -(-index.count() // slice_rows))
    one = F.array(F.pmod(F.xxhash64("id"), F.lit(slices)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))
    placed = hashed.withColumn("slice", F.explode(F.when(F.col("query"), every).otherwise(one))).repartition("bin", "slice")
    placed = placed.sortWithinPartitions("bin", "slice", "query", F.when(~F.col("query"), F.col("cells")[0]), "id")
    found = map_arrow(placed, _searched(width, k), "asked long, id long, score double, copies array<long>")
    # An entry met in several tables has the same score and ids each time.
    best = Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("copies")[0], "id")
    return found.withColumn("_rank", F.dense_rank().over(best)).where(F.col("_rank") <= k).drop("_rank")


def valid_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector that is not zero and whose
    components are all finite numbers."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    every: int = EVERY,
    tables: int = TABLES,
    hashes: int = AXES,
    probes: int = PROBES,
    slice_rows: int = SLICE,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row whose id ``every`` divides:
    query_id, rank, vec_id, score.

    Nearest first, ties to the smaller vec_id; a query's own id is no candidate. Rows
    with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component take no part; of vectors of different width those of the
    most frequent one do (ties: the larger). Repeated rows count once. Scores are in
    double precision on the vectors as given. A query gets fewer than ``k`` rows only
    where there are fewer candidates. An empty table gives an empty result.
    """
    rows = valid_vectors(vectors, vec_id, vector)
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0].width if widths else 1
    rows = rows.where(F.size("vector") == width).withColumn("key", F.unhex(F.sha2(F.col("vector").cast("string"), 256)))
    asks = (F.col("vec_id") % every == 0).alias("asks")
    queries = settle(rows.where(asks).select(F.col("vec_id").alias("query_id"), "key").distinct())
    # Of a vector's rows only the first ids leave the task that reads them.
    least = Window.partitionBy("key").orderBy("vec_id")
    entries = rows.withColumn("_rank", F.dense_rank().over(least)).where(F.col("_rank") <= k + 1).groupBy("key").agg(
        F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("copies")
    )
    asked = queries.groupBy("key").agg(F.count("*").alias("n_queries"))
    index = numbered(entries.join(asked, "key", "left")).withColumnRenamed("_row", "id")
    longest = index.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)))).first()[0] or 1.0
    asking = index.where("n_queries > 0")
    search = lambda who, **how: settle(_matches(index, who, width, longest, k + 1, slice_rows, hashes=hashes, **how))
    found = search(asking, tables=tables, most=probes, every_cell=False)
    enough = found.select("asked", "id", "copies").distinct().groupBy("asked").agg(F.sum(F.size("copies")).alias("n"))
    short = settle(asking.join(enough.where(F.col("n") > k).select(F.col("asked").alias("id")), "id", "left_anti"))
    if short.head(1):
        whole = search(short, tables=1, most=0, every_cell=True)
        found = found.join(short.select(F.col("id").alias("asked")), "asked", "left_anti").unionByName(whole)
    # At most k + 1 entries with k + 1 ids each.
    lists = found.select("asked", F.explode("copies").alias("vec_id"), "score").groupBy("asked").agg(
        F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near")
    )
    facts = settle(lists.join(asking.select(F.col("id").alias("asked"), "key", "n_queries"), "asked").select("key", F.slice("near", 1, k + 1).alias("near"), "n_queries"))
    answers = weighted_lookup(queries, facts, ["key"], "n_queries")
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(near).alias("rank", "_near")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("_near.vec_id").alias("vec_id"), (-F.col("_near.far")).alias("score")
    )
