"""Token counts of a byte-pair vocabulary, without making the tokens.

A piece of text starts as a linked list of symbols. A heap holds the adjacent pairs
that can merge, lowest rank first, leftmost first among equals; each pop joins two
symbols, unless one of them has changed since, and pushes the pairs with the
neighbours. The count is the number of symbols at the start less the merges.

Pieces repeat, so their counts are kept in a table of bounded size in each task. Tasks
need nothing of each other: the input is neither shuffled nor cut.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opsframe.llm.common import batch, map_arrow, texts

LIMIT = 2048
KEPT_PIECES = 600_000
KEPT_LENGTH = 48

#: Fixed values of the format: the piece pattern and white space of the vocabulary's file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: its own character where that is visible, else
    the next free character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merges_needed(symbols: list[int], ranks: dict[int, int], joined: list[int]) -> int:
    """How many merges the symbols undergo.

    ``ranks`` gives the rank of a pair, packed into one number, and ``joined`` the
    symbol that the merge of a rank makes.
    """
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    current = [-1] * n  # rank of the pair that starts here now
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
        if rank is not None:
            current[i] = rank
            heap.append(rank * n + i)
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, left = divmod(heapq.heappop(heap), n)
        if current[left] != rank:
            continue  # one of the two has changed since
        merges += 1
        gone = after[left]
        symbols[left] = joined[rank]
        current[left] = current[gone] = -1
        right = after[left] = after[gone]
        if right < n:
            before[right] = left
            rank = ranks.get(symbols[left] << 20 | symbols[right])
            if rank is not None:
                current[left] = rank
                heapq.heappush(heap, rank * n + left)
        first = before[left]
        if first >= 0:
            rank = ranks.get(symbols[first] << 20 | symbols[left])
            current[first] = -1 if rank is None else rank
            if rank is not None:
                heapq.heappush(heap, rank * n + first)
    return merges


class TokenCounter:
    """Counts the tokens of whole texts for a vocabulary file with word ends.

    Lower case, composed characters and white space are handled as the file says:
    pieces never hold white space, so what stands between blanks is counted alone.
    The strings of its special tokens count as one token wherever they stand.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        pairs = [tuple(p if isinstance(p, list) else p.split(" ")) for p in found["model"]["merges"]]
        numbers: dict[str, int] = {}
        number = lambda symbol: numbers.setdefault(symbol, len(numbers))
        self._ranks = {number(a) << 20 | number(b): rank for rank, (a, b) in enumerate(pairs)}
        self._joined = [number(a + b) for a, b in pairs]
        self._inner = [number(s) for s in byte_symbols()]
        self._last = [number(s + WORD_END) for s in byte_symbols()]
        special = [t["content"] for t in found["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._marks = special
        self._piece = regex.compile(PIECE)
        self._kept = kept
        self._known: dict[str, int] = {}
        self._pieces: dict[str, int] = {}

    def _keep(self, known: dict[str, int], text: str, count: int) -> int:
        """Remember a short text's count; a full table starts anew."""
        if len(text) <= KEPT_LENGTH:
            if len(known) >= self._kept:
                known.clear()
            known[text] = count
        return count

    def _count_piece(self, piece: str) -> int:
        count = self._pieces.get(piece)
        return self._keep(self._pieces, piece, self._merge(piece)) if count is None else count

    def _merge(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        symbols = [self._inner[b] for b in raw]
        symbols[-1] = self._last[raw[-1]]
        return len(symbols) - merges_needed(symbols, self._ranks, self._joined)

    def _count_between(self, chunk: str) -> int:
        """Tokens of what stands between two blanks; other white space may be inside."""
        plain = unicodedata.normalize("NFC", chunk)
        plain = plain.lower() if plain.isascii() else "".join(c.lower() for c in plain)
        return sum(self._count_piece(piece) for piece in self._piece.findall(plain))

    def _count_plain(self, text: str) -> int:
        known, total = self._known, 0
        for chunk in text.replace("\n", " ").split(" "):
            count = known.get(chunk)
            if count is None:
                count = self._keep(known, chunk, self._count_between(chunk))
            total += count
        return total

    def count(self, text: str) -> int:
        if self._special and any(mark in text for mark in self._marks):
            parts = self._special.split(text)
            return len(parts) - 1 + sum(map(self._count_plain, parts))
        return self._count_plain(text)


@functools.cache
def counter(path: str) -> TokenCounter:
    """One counter per Python worker."""
    return TokenCounter(path)


_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counts(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for rows in batches:
            found = rows.column("text").to_pylist()
            tokens = [count(text) for text in found]
            yield batch(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_bytes": [len(text.encode("utf-8", "surrogatepass")) for text in found],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                },
                {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()},
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path`` is the vocabulary file, which every executor must have. Null and empty
    texts have 0 tokens; null doc_ids and repeated rows give a row each; texts of any
    length are counted whole; an empty table gives an empty result.
    """
    return map_arrow(texts(docs), _counts(path, limit), _SCHEMA)
