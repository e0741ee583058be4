"""Suffix trees of whole-number sequences and constant-time longest common extensions."""

from __future__ import annotations

from array import array

import numpy as np

_BLOCK = 16


class RangeMinimum:
    """Smallest value of a range in constant time: minima of blocks in a sparse table,
    and running minima inside each block from both ends."""

    def __init__(self, values: np.ndarray):
        self._n = len(values)
        blocks = -(-self._n // _BLOCK)
        top = np.iinfo(np.int32).max
        self._rows = np.full((blocks, _BLOCK), top, dtype=np.int32)
        self._rows.reshape(-1)[: self._n] = values
        self._up_to = np.minimum.accumulate(self._rows, axis=1).reshape(-1)
        self._from = np.minimum.accumulate(self._rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self._table = [self._rows.min(axis=1)]
        while 2 << (len(self._table) - 1) <= blocks:
            last, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over the ranges low..high, both ends included."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self._from[low], self._up_to[high])
        same = np.flatnonzero(first == last)
        if len(same):
            cells = self._rows[first[same]].copy()
            place = np.arange(_BLOCK)
            outside = (place < (low[same] % _BLOCK)[:, None]) | (place > (high[same] % _BLOCK)[:, None])
            cells[outside] = np.iinfo(np.int32).max
            out[same] = cells.min(axis=1)
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            a, b = first[inner] + 1, last[inner]
            level = np.frexp((b - a).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                here = inner[at]
                between = np.minimum(self._table[k][a[at]], self._table[k][b[at] - (1 << k)])
                out[here] = np.minimum(out[here], between)
        return out


class SuffixTree:
    """Ukkonen's tree of ``symbols``, whole numbers from 1, closed by the end mark 0.

    Built in one pass from left to right; edges are kept in one table under node and
    first symbol. An Euler tour lists the string depth of every node it comes by. The
    smallest depth between two leaves is that of their lowest common ancestor, which
    is how far the two suffixes agree.
    """

    def __init__(self, symbols: np.ndarray):
        s = symbols.tolist()
        s.append(0)
        self.size = n = len(s)
        self._sigma = sigma = max(s) + 1
        start, stop, link = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(s):
            waiting += 1
            made = 0  # the inner node that waits for its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    begin = start[to]
                    size = stop[to] - begin
                    if length >= size:
                        edge += size
                        length -= size
                        node = to
                        continue
                    if s[begin + length] == symbol:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    child[middle * sigma + symbol] = middle + 1
                    child[middle * sigma + s[begin + length]] = to
                    start.extend((begin, i))
                    stop.extend((begin + length, n))
                    link.extend((0, 0))
                    start[to] = begin + length
                    if made:
                        link[made] = middle
                    made = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        del child, link
        order = np.argsort(keys)
        self._bounds = np.searchsorted(keys[order] // sigma, np.arange(len(start) + 1)).tolist()
        self._kids = nodes[order].tolist()  # of each node by first symbol
        self._length = (np.frombuffer(stop, dtype=np.int64) - np.frombuffer(start, dtype=np.int64)).tolist()
        self._tour()

    def _tour(self) -> None:
        kids, length, n = self._kids, self._length, self.size
        at, bounds = self._bounds[:], self._bounds
        tour, place, ranks = array("i", [0]), array("q", bytes(8 * n)), array("q", bytes(8 * n))
        path, depths, leaves = [0], [0], 0
        while path:
            node, depth = path[-1], depths[-1]
            if at[node] < bounds[node + 1]:
                to = kids[at[node]]
                at[node] += 1
                deep = depth + length[to]
                if bounds[to] == bounds[to + 1]:
                    place[n - deep] = len(tour)
                    ranks[n - deep] = leaves
                    leaves += 1
                    tour.extend((deep, depth))
                else:
                    tour.append(deep)
                    path.append(to)
                    depths.append(deep)
            else:
                path.pop()
                depths.pop()
                if path:
                    tour.append(depths[-1])
        self._place = np.frombuffer(place, dtype=np.int64)
        self.ranks = np.frombuffer(ranks, dtype=np.int64)  # of the suffixes; an end is smallest
        self._least = RangeMinimum(np.frombuffer(tour, dtype=np.int32))

    def ranks_reversed(self) -> np.ndarray:
        """Ranks of the suffixes where larger symbols come first, but an end is still smallest."""
        kids, length, bounds, n = self._kids, self._length, self._bounds, self.size
        ranks = array("q", bytes(8 * n))
        todo, depths, seen = [0], [0], 0
        while todo:
            node, depth = todo.pop(), depths.pop()
            low, high = bounds[node], bounds[node + 1]
            if low == high:
                ranks[n - depth] = seen
                seen += 1
                continue
            own = kids[low:high]
            if length[own[0]] == 1 and bounds[own[0]] == bounds[own[0] + 1]:
                own.append(own.pop(0))  # the edge of the end mark alone is taken first
            todo.extend(own)
            depths.extend([depth + length[to] for to in own])
        return np.frombuffer(ranks, dtype=np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j, all different, have in common."""
        a, b = self._place[i], self._place[j]
        return self._least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix the next one to the right that ranks lower; the last one is the end mark's.

    The symbols from a suffix to there are the longest Lyndon word that starts at it.
    """
    r = ranks.tolist()
    out = [0] * (len(r) - 1)
    for i in range(len(out) - 1, -1, -1):
        j, own = i + 1, r[i]
        while r[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, dtype=np.int64)
