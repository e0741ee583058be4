"""Pack documents into windows of tokens by lexical retrieval.

The terms are token ids, so document frequencies over all documents are one number
per entry of the vocabulary: a table of bounded size that every task gets. Documents
are put in the order of weighted minima over their terms, where a term is drawn in
proportion to its saturated frequency and its idf squared, so that telling terms decide:
two documents share a minimum about as often as they share such terms. The order is cut into shards, and each shard has
its own inverted index. A window starts with a seed document; the shard's index returns
the unused neighbours by BM25, and they fill the window greedily. The one that does not
fit is cut, and its rest is the seed of the next window, so only the last window of a
task is padded.

Shards hold a bounded number of documents at every size of the input, and a seed meets
those of its own shard only. A document longer than that bound in tokens is handled
alone, as one of its shard.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import batch, map_arrow, random_longs, texts
from opsframe.llm.token_count import byte_symbols
from opsframe.sources.durable import settle

WINDOW = 1024
END = 0
SHARD_DOCS = 1024
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
KEPT_PIECES = 900_000
_LATIN = "\u024f"
_PLAIN = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUNS = ("  ", " \n", "\n ")


class Encoder:
    """Token ids of whole texts as the library ``tokenizers`` gives them.

    A byte-level vocabulary never joins across a blank between two visible
    characters, so texts are cut there and the parts, which repeat, are encoded once.
    Where the file's merges stand in the order of their ids, plain Latin parts go to
    ``tiktoken``, which gives the same ids faster; all other parts, and those with a
    special string, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self._library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._quick = _ranked(path)
        with open(path, encoding="utf-8") as file:
            self._marks = [t["content"] for t in json.load(file)["added_tokens"]]
        self._known = _Parts(self._after_blank)  # what follows a blank, without the blank
        self._kept = kept

    def _after_blank(self, part: str) -> bytes:
        return next(self._encode([" " + part]))

    def _encode(self, parts: list[str]) -> Iterator[bytes]:
        slow = {}
        for i, part in enumerate(parts):
            if not self._quick or (part and max(part) > _LATIN) or any(mark in part for mark in self._marks):
                slow[i] = part
        found = self._library.encode_batch_fast(list(slow.values()), add_special_tokens=False) if slow else []
        ids = dict(zip(slow, (made.ids for made in found), strict=True))
        code, quick = self.kind.char, self._quick.encode_ordinary if self._quick else None
        for i, part in enumerate(parts):
            yield array(code, ids[i] if i in ids else quick(part)).tobytes()

    def encode(self, found: list[str]) -> list[np.ndarray]:
        if len(self._known) > self._kept:
            self._known.clear()
        cuts = [text.split(" ") if _single_blanks(text) else _PLAIN.split(text) for text in found]
        first = self._encode([cut.pop(0) for cut in cuts])
        of = self._known.__getitem__
        return [
            np.frombuffer(start + b"".join(map(of, cut)), dtype=self.kind) for start, cut in zip(first, cuts, strict=True)
        ]


class _Parts(dict):
    """Parts of texts and what they are encoded as, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self._encode = encode

    def __missing__(self, part: str) -> bytes:
        self[part] = made = self._encode(part)
        return made


def _single_blanks(text: str) -> bool:
    """Whether every blank stands between two visible characters."""
    return not (
        any(run in text for run in _RUNS) or text.startswith(" ") or text.endswith(" ") or _OTHER_SPACE.search(text)
    )


def _ranked(path: str):
    """The vocabulary for ``tiktoken``, or None where ids do not follow the merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    numbers = {symbol: value for value, symbol in enumerate(byte_symbols())}
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    singles = [model["vocab"].get(symbol, -1) for symbol in numbers]
    if sorted(singles) != list(range(256)) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(numbers[c] for c in t): i for t, i in model["vocab"].items() if all(c in numbers for c in t) and i < 256 + len(pairs)}
    return tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_TOKENS = "doc_id long, ids binary, doc_tokens long"


def _encoded(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        last = library.kind.type(end).tobytes()
        types = {"doc_id": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64()}
        for rows in batches:
            found = library.encode(rows.column("text").to_pylist())
            whole = [ids.tobytes() + last for ids in found]
            counts = [len(ids) + 1 for ids in found]
            yield batch({"doc_id": rows.column("doc_id"), "ids": whole, "doc_tokens": counts}, types)

    return run


def draws(n_terms: int, n: int, seed: int = 5) -> np.ndarray:
    """n rows of an exponential variable for each term. Divided by a term's weight in a document,
    the minimum over the document falls on a term in proportion to its weight."""
    uniform = ((random_longs(n * n_terms, seed) >> np.uint64(11)).astype(float) + 0.5) / 2**53
    return -np.log(uniform).reshape(n, n_terms)


def saturated(counts: np.ndarray, length: float, mean_length: float) -> np.ndarray:
    """BM25's weight of a term that stands so often in a document, without its idf."""
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / max(mean_length, 1e-9)))


def _placed(kind: str, idf: np.ndarray, mean_length: float, end: int):
    """Adds the terms of two weighted minima, which bring documents with the same telling terms together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "ids": pa.binary(), "near": pa.int64(), "next_near": pa.int64()}
        order, weight = draws(len(idf), 2), np.maximum(idf.astype(float), 1e-6) ** 2
        for rows in batches:
            near: list[list[int]] = [[], []]
            for raw in rows.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype=kind)
                terms, counts = np.unique(ids[:-1], return_counts=True)
                own = weight[terms] * saturated(counts, len(ids), mean_length)
                for found, numbers in zip(near, order, strict=True):
                    found.append(int(terms[(numbers[terms] / own).argmin()]) if len(terms) else end)
            yield batch({"doc_id": rows.column("doc_id"), "ids": rows.column("ids"), "near": near[0], "next_near": near[1]}, types)

    return run


def _frequencies(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for rows in batches:
            for raw in rows.column("ids"):
                terms = np.unique(np.frombuffer(raw.as_buffer(), dtype=kind))
                if terms[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(int(terms[-1]) + 1 - len(total), dtype=np.int64)))
                total[terms] += 1
        terms = np.flatnonzero(total)
        yield batch({"term": terms, "n_docs": total[terms]}, {"term": pa.int64(), "n_docs": pa.int64()})

    return run


class Shard:
    """BM25 over the documents of one shard: an inverted index with a posting list of
    (document, weight) for each term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, end: int):
        terms, owners, counts = [], [], []
        for i, ids in enumerate(docs):
            own, times = np.unique(ids, return_counts=True)
            inside = own != end
            own, times = own[inside], times[inside]
            terms.append(own)
            counts.append(times)
            owners.append(np.full(len(own), i))
        term, owner = np.concatenate(terms), np.concatenate(owners)
        count = np.concatenate(counts).astype(np.float64)
        length = np.array([len(ids) for ids in docs], dtype=np.float64)
        order = np.argsort(term, kind="stable")
        self._owners = owner[order]
        self._weights = (idf[term] * saturated(count, length[owner], mean_length))[order]
        vocabulary, starts = np.unique(term[order], return_index=True)
        self._bounds = np.append(starts, len(term))
        self._terms = [np.searchsorted(vocabulary, own) for own in terms]
        self._unused = np.ones(len(docs), dtype=bool)

    def use(self, doc: int) -> None:
        self._unused[doc] = False

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms: its posting lists added up."""
        starts, ends = self._bounds[self._terms[seed]], self._bounds[self._terms[seed] + 1]
        sizes = ends - starts
        shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(sizes) else sizes
        places = shift + np.arange(len(shift))
        return np.bincount(self._owners[places], self._weights[places], len(self._unused))

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused documents, best first; equal scores in shard order."""
        scores = self.scores(seed)
        left = np.flatnonzero(self._unused)
        return left[np.argsort(-scores[left], kind="stable")]


def pack_shard(shard: Shard, lengths: list[int], window: int, room: int) -> Iterator[tuple[int, int, int, bool]]:
    """Pieces (document, start, length, whether it opens a new window), greedily.

    ``room`` is what the window open so far can still take.
    """
    waiting: list[int] = []
    seed, asked = 0, None
    for _ in range(len(lengths)):
        if asked is not None:  # the index is asked when another document is needed
            waiting, asked = shard.neighbours(asked)[::-1].tolist(), None
        doc = waiting.pop() if waiting else int(np.flatnonzero(shard._unused)[0])
        shard.use(doc)
        start, fresh = 0, False
        while start < lengths[doc]:
            if fresh := room == 0:
                room, seed = window, doc
            size = min(room, lengths[doc] - start)
            yield doc, start, size, fresh
            start, room = start + size, room - size
        if fresh or not waiting:  # another seed, or its list is at an end
            asked = seed if fresh else doc


_PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, seed_doc_id long"
)
_PIECE_TYPES = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(), "seed_doc_id": pa.int64(),
}


def _packed(kind: str, idf: np.ndarray, mean: float, window: int, end: int, most_docs: int, most_tokens: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
        names, docs, tokens = [], [], 0
        for rows in batches:
            for name, raw in zip(rows.column("doc_id").to_pylist(), rows.column("ids"), strict=True):
                names.append(name)
                docs.append(np.frombuffer(raw.as_buffer(), dtype=kind).copy())
                tokens += len(docs[-1])
                if len(docs) >= most_docs or tokens >= most_tokens:
                    yield names, docs
                    names, docs, tokens = [], [], 0
        if docs:
            yield names, docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() << 32) - 1
        room, seed = 0, None
        for names, docs in shards(batches):
            index = Shard(docs, idf, mean, end)
            out: dict[str, list] = {name: [] for name in _PIECE_TYPES}
            lengths = [len(ids) for ids in docs]
            for doc, start, size, fresh in pack_shard(index, lengths, window, room):
                if fresh:
                    sequence, room, seed = sequence + 1, window, names[doc]
                piece = docs[doc][start : start + size].astype("<u4").tobytes()
                for name, value in zip(
                    _PIECE_TYPES, (names[doc], start, size, piece, lengths[doc], sequence, window - room, seed), strict=True
                ):
                    out[name].append(value)
                room -= size
            yield batch(out, _PIECE_TYPES)

    return run


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    end: int = END,
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, seed_doc_id.

    A document's ids, by the vocabulary file at ``path`` without added special
    tokens, are followed by ``end``; its pieces cover them once. The pieces of a
    sequence stand one after the other from offset 0 and fill ``window`` ids, but for
    the last sequence of a task. Null and empty texts are the end id alone; null
    doc_ids and repeated rows are documents of their own; texts of any length are
    packed whole, over as many windows as they fill; an empty table gives no piece.
    """
    encoded = settle(map_arrow(texts(docs), _encoded(path, end), _TOKENS))
    kind = Encoder(path).kind.str
    size, tokens = encoded.agg(F.count("*"), F.sum("doc_tokens")).first()
    counts = map_arrow(encoded.select("ids"), _frequencies(kind), "term long, n_docs long")
    # One number per entry of the vocabulary.
    found = counts.groupBy("term").agg(F.sum("n_docs").alias("n_docs")).toPandas()
    idf = np.zeros(max([0, *found["term"]]) + 1, dtype=np.float32)
    idf[found["term"]] = np.log1p((size - found["n_docs"] + 0.5) / (found["n_docs"] + 0.5))
    mean = (tokens or 0) / max(size, 1)
    placed = map_arrow(encoded.select("doc_id", "ids"), _placed(kind, idf, mean, end), "doc_id long, ids binary, near long, next_near long")
    placed = placed.withColumn("tie", F.xxhash64("ids")).repartitionByRange("near", "next_near", "tie", "doc_id")
    placed = placed.sortWithinPartitions("near", "next_near", "tie", "doc_id").select("doc_id", "ids")
    return map_arrow(placed, _packed(kind, idf, mean, window, end, shard_docs, shard_tokens), _PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in the place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "seed_doc_id"
    )
