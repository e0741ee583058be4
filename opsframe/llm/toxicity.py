"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labels come as a bounded sample of examples for each class. From them the terms are
chosen whose presence goes with the label: words, and the beginnings of words, so
that inflected forms count together. Document frequencies of these terms are taken
over all documents. The examples' vectors form an inverted index whose posting lists
are cut into blocks with the largest weight of each; a query visits blocks by the
bound these maxima give and stops when no block can still hold a nearer example, so
the neighbours found are the true ones. Votes are weighted by distance and calibrated
on the examples, each judged without itself.

What all tasks get - terms, frequencies and index - is bounded by the parameters; what
all documents yield is a short vector each, which is settled once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import batch, map_arrow, texts, with_columns
from opsframe.sources.durable import settle

THRESHOLD = 0.7
EXAMPLES_PER_CLASS = 10_000
TERMS = 2048
LEAST_DOCS = 4
LEAST_LIFT = 4.0
LEAST_CHI_SQUARE = 40.0  # so that of millions of terms none passes by chance
BEGINNING = 5
NEIGHBOURS = 15
PRIOR_EXAMPLES = 4.0  # at cosine 0, they vote as all examples would
BLOCK = 64
_LETTERS = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from; a null id has no label either way."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(text: str) -> Counter[str]:
    """How often each word, and each beginning of a longer word, stands in a text."""
    words = Counter(_LETTERS.findall(text.lower()))
    found = Counter(words)
    for word, n in words.items():
        if len(word) > BEGINNING:
            found[word[:BEGINNING] + "*"] += n
    return found


def _term_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"term": pa.string(), "toxic": pa.int64(), "n": pa.int64()}
    seen: Counter[tuple[str, int]] = Counter()

    def flush() -> pa.RecordBatch:
        out = {"term": [t for t, _ in seen], "toxic": [y for _, y in seen], "n": list(seen.values())}
        seen.clear()
        return batch(out, types)

    for rows in batches:
        for text, toxic in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
            seen.update((term, toxic) for term in terms_of(text))
            if len(seen) > _FLUSH:
                yield flush()
    yield flush()


def examples_of(labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic) of at most ``per_class`` examples of each class, by hash; a
    document with labels that differ is toxic."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    once = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    draw = lambda y: once.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return settle(draw(1).unionByName(draw(0)))


def choose_terms(found: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """The terms that go with the label, by chi square; at most ``most``."""
    total = max(n_toxic + n_clean, 1)
    counts = found.groupBy("term").agg(
        F.sum(F.col("n") * F.col("toxic")).cast("double").alias("p"), F.sum(F.col("n") * (1 - F.col("toxic"))).cast("double").alias("q")
    )
    cross = F.col("p") * (n_clean - F.col("q")) - F.col("q") * (n_toxic - F.col("p"))
    below = (F.col("p") + F.col("q")) * (total - F.col("p") - F.col("q")) * float(max(n_toxic * n_clean, 1))
    chi = cross * cross * float(total) / F.greatest(below, F.lit(1e-9))
    lift = (F.col("p") / max(n_toxic, 1)) / ((F.col("q") + 0.5) / max(n_clean, 1))
    chosen = (
        counts.where((F.col("p") >= LEAST_DOCS) & (lift >= LEAST_LIFT))
        .withColumn("chi", chi)
        .where(F.col("chi") >= LEAST_CHI_SQUARE)
        .orderBy(F.col("chi").desc(), "term")
        .limit(most)
    )
    return [row.term for row in chosen.select("term").collect()]


def _vectors(terms: list[str], carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: i for i, term in enumerate(terms)}
        types = {"doc_id": pa.int64(), "term": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
        for rows in batches:
            out = []
            for text in rows.column("text").to_pylist():
                found = terms_of(text)
                out.append(sorted((place[t], found[t]) for t in found.keys() & place.keys()))
            made = batch(
                {"doc_id": rows.column("doc_id"), "term": [[t for t, _ in x] for x in out], "n": [[n for _, n in x] for x in out]},
                types,
            )
            yield with_columns(made, rows, carry)

    return run


def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length."""
    weights = (1 + np.log(counts)) * idf[terms]
    return weights / math.sqrt(float(weights @ weights)) if len(weights) else weights


class BlockMaxIndex:
    """Exact search for the entries with the largest inner product with a query."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        self._block, self.size = block, len(vectors)
        lists: dict[int, list[tuple[int, float]]] = {}
        for entry, (terms, weights) in enumerate(vectors):
            for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
                lists.setdefault(term, []).append((entry, weight))
        self._lists = {}
        for term, postings in lists.items():
            entries = np.array([e for e, _ in postings])
            weights = np.array([w for _, w in postings])
            blocks, starts = np.unique(entries // block, return_index=True)
            self._lists[term] = (entries, weights, blocks, np.append(starts, len(entries)), np.maximum.reduceat(weights, starts))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (score, entry) with a positive score, best first, ties to the
        smaller entry; ``without`` is left out."""
        lists = [(w, self._lists[t]) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self._lists]
        bound = np.zeros(-(-self.size // self._block))
        for weight, (_, _, blocks, _, most) in lists:
            bound[blocks] += weight * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            # A bound and a score add the same products in the same order, up to rounding.
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-9):
                break
            score = np.zeros(self._block)
            for weight, (entries, values, blocks, starts, _) in lists:
                i = int(np.searchsorted(blocks, b))
                if i < len(blocks) and blocks[i] == b:
                    part = slice(starts[i], starts[i + 1])
                    score[entries[part] - b * self._block] += weight * values[part]
            found = np.flatnonzero(score > 0)
            best += [(float(score[i]), b * self._block + int(i)) for i in found if b * self._block + i != without]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing function of x nearest to y (pooled adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, weight, smallest and largest x
    for i in order.tolist():
        pools.append([float(y[i] * weight[i]), float(weight[i]), float(x[i]), float(x[i])])
        while len(pools) > 1 and (
            pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]
        ):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at = np.array([v for p in pools for v in (p[2], p[3])])
    return at, np.array([v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1)] * 2])


@dataclass
class Judge:
    """Scores vectors by their neighbours among the examples."""

    idf: np.ndarray
    k: int
    unmarked: float  # the score where no term stands
    base: float  # share of toxic labels
    vectors: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    members: list[list[int]] = field(default_factory=list)  # doc_ids of each entry
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        self._index = BlockMaxIndex(self.vectors)

    def neighbours(self, terms: np.ndarray, counts: np.ndarray) -> list[tuple[float, int]]:
        return self._index.search(terms, weigh(terms, counts, self.idf), self.k)

    def vote(self, found: list[tuple[float, int]], toxic: np.ndarray, clean: np.ndarray) -> float:
        """Share of toxic examples; each counts by the inverse of its distance."""
        prior = PRIOR_EXAMPLES / 1.05
        up, down = prior * self.base, prior * (1 - self.base)
        for cosine, entry in found:
            near = 1 / (0.05 + max(0.0, 1 - cosine))
            up, down = up + near * float(toxic[entry]), down + near * float(clean[entry])
        return up / (up + down)

    def calibrate(self) -> None:
        """Learn the curve from votes that leave one example of an entry out."""
        x, y, weight = [], [], []
        for entry, (terms, weights) in enumerate(self.vectors):
            found = self._index.search(terms, weights, self.k + 1)
            for label, own in ((1, self.toxic), (0, self.clean)):
                if own[entry]:
                    less = own.copy()
                    less[entry] -= 1
                    sides = (less, self.clean) if label else (self.toxic, less)
                    x.append(self.vote(found, *sides))
                    y.append(label)
                    weight.append(own[entry])
        if x:
            self.curve = monotone(np.array(x), np.array(y, dtype=float), np.array(weight, dtype=float))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int], list[float]]:
        if not len(terms):
            return self.unmarked, [], []
        found = self.neighbours(terms, counts)
        raw = self.vote(found, self.toxic, self.clean)
        score = float(np.interp(raw, *self.curve)) if found and self.curve else self.unmarked
        return score, [self.members[entry][0] for _, entry in found], [cosine for cosine, _ in found]


def _judge(rows: list, idf: np.ndarray, k: int, toxic_weight: float, clean_weight: float) -> Judge:
    """Equal vectors form one entry; entries with the same leading terms stand together."""
    groups: dict[tuple, list] = {}
    for row in sorted(rows, key=lambda r: r.doc_id):
        groups.setdefault((tuple(row.term), tuple(row.n)), []).append(row)
    empty = groups.pop(((), ()), [])
    up = toxic_weight * sum(r.toxic for r in empty)
    down = clean_weight * sum(1 - r.toxic for r in empty)
    unmarked = (up + 0.5) / (up + down + 1) if rows else 0.0
    vectors, members, toxic, clean = [], [], [], []
    lead = lambda key: sorted(key[0], key=lambda t: (-idf[t], t))
    for terms, counts in sorted(groups, key=lambda key: (lead(key), key)):
        same = groups[terms, counts]
        ids = np.array(terms, dtype=np.int64)
        vectors.append((ids, weigh(ids, np.array(counts, dtype=float), idf)))
        members.append([r.doc_id for r in same])
        toxic.append(sum(r.toxic for r in same))
        clean.append(sum(1 - r.toxic for r in same))
    up = toxic_weight * sum(r.toxic for r in rows)
    down = clean_weight * sum(1 - r.toxic for r in rows)
    judge = Judge(idf, k, unmarked, up / max(up + down, 1), vectors, members, np.array(toxic, dtype=float), np.array(clean, dtype=float))
    judge.calibrate()
    return judge


_SCORES = "doc_id long, score double, evidence array<long>, cosines array<double>"


def _scored(judge: Judge, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "score": pa.float64(), "evidence": pa.list_(pa.int64()), "cosines": pa.list_(pa.float64())}
        known: dict[tuple, tuple] = {}
        for rows in batches:
            out = []
            for terms, counts in zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True):
                key = (tuple(terms), tuple(counts))
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = judge.score(np.array(terms, dtype=np.int64), np.array(counts, dtype=float))
                out.append(known[key])
            score, evidence, cosines = zip(*out, strict=True) if out else ((), (), ())
            made = batch({"doc_id": rows.column("doc_id"), "score": score, "evidence": evidence, "cosines": cosines}, types)
            yield with_columns(made, rows, carry)

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *carry: str,
    per_class: int = EXAMPLES_PER_CLASS,
    most_terms: int = TERMS,
    neighbours: int = NEIGHBOURS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence, cosines, and the columns of
    ``carry``.

    ``score`` grows with the likelihood of label 1 and depends on the text only;
    ``evidence`` are the doc_ids of the nearest examples and ``cosines`` their
    nearness. Learned from are at most ``per_class`` labelled rows of either class
    that are not held out. A text without any chosen term - so every null or empty one
    - gets the share of toxic ones among such examples, and without labels every score is 0.
    Null doc_ids are scored but have no label; repeated rows get the same score each;
    labels other than 0 and 1 are ignored; texts of any length are read whole; an
    empty table gives an empty result.
    """
    examples = examples_of(labels, per_class)
    own = {c: f"_carry{i}" for i, c in enumerate(carry)}
    more = [F.col(c).alias(name) for c, name in own.items()]
    extra = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for c, name in own.items())
    rows = texts(docs, *more)
    chosen = rows.join(F.broadcast(examples), "doc_id")  # at most two classes of ``per_class``
    by_label = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    found = map_arrow(chosen.select("text", "toxic"), _term_docs, "term string, toxic long, n long")
    terms = choose_terms(found, n_toxic, n_clean, most_terms) if n_toxic and n_clean else []
    vectors = settle(map_arrow(rows, _vectors(terms, tuple(own.values())), "doc_id long, term array<int>, n array<int>" + extra))
    size = vectors.count()
    frequency = np.zeros(len(terms))
    for row in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        frequency[row.term] = row["count"]
    idf = np.log((1 + size) / (1 + frequency)) + 1
    usable = vectors.select("doc_id", "term", "n").join(F.broadcast(examples), "doc_id").dropDuplicates(["doc_id"]).collect()
    # How many labelled rows an example of either class stands for.
    totals = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    stand = {r.toxic: r["count"] / max(by_label.get(r.toxic, 0), 1) for r in totals}
    judge = _judge(usable, idf, neighbours, stand.get(1, 1.0), stand.get(0, 1.0))
    scored = map_arrow(vectors, _scored(judge, tuple(own.values())), _SCORES + extra)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
        "cosines",
        *[F.col(name).alias(c) for c, name in own.items()],
    )
