"""Suffix tree of a sequence of small integers, and its longest common extensions in constant time each."""

from __future__ import annotations

import numpy as np

_BLOCK = 32


def ukkonen(symbols: list[int]) -> tuple[dict[int, int], list[int], list[int], list[int], int]:
    """The tree of ``symbols`` (1 and more) and an end mark 0, built from left to right in linear time.

    Returns children by ``node * width + first symbol``, start and end of the label of the edge
    into each node, the suffix of each leaf (-1 for inner nodes), and ``width``.
    """
    text = [*symbols, 0]
    size, width = len(text), max(text) + 1
    children: dict[int, int] = {}
    start, end, link, suffix = [0], [0], [0], [-1]
    node = edge = length = waiting = 0
    for i, symbol in enumerate(text):
        fresh = 0  # inner node that still lacks its suffix link
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * width + text[edge]
            below = children.get(key)
            if below is None:
                children[key] = len(start)
                start.append(i)
                end.append(size)
                link.append(0)
                suffix.append(i - waiting + 1)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = start[below]
                held = end[below] - first
                if length >= held:
                    edge += held
                    length -= held
                    node = below
                    continue
                if text[first + length] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                start += (first, i)
                end += (first + length, size)
                link += (0, 0)
                suffix += (-1, i - waiting + 1)
                children[key] = inner
                children[inner * width + symbol] = inner + 1
                start[below] = first + length
                children[inner * width + text[first + length]] = below
                if fresh:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return children, start, end, suffix, width


class Extensions:
    """Ranks of all suffixes, and how far any two agree.

    An Euler tour lists the length of the string at each node it passes; the lowest common
    ancestor of two leaves is the least entry between them. Blocks of the tour hold their
    least entries from either end, a sparse table those of runs of blocks.
    """

    def __init__(self, symbols: list[int]):
        children, start, end, suffix, width = ukkonen(symbols)
        self.size = len(symbols)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        order = np.argsort(keys)
        below = np.fromiter(children.values(), np.int64, len(children))[order].tolist()
        opens = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        reach = (np.array(end) - np.array(start)).tolist()
        depth, at = [0] * len(start), opens[:-1]
        tour: list[int] = []
        place, leaves = [0] * (self.size + 1), []
        path = [0]
        while path:
            node = path[-1]
            here = depth[node]
            tour.append(here)
            k = at[node]
            last = opens[node + 1]
            while k < last:
                child = below[k]
                k += 1
                own = suffix[child]
                if own < 0:
                    depth[child] = here + reach[child]
                    path.append(child)
                    break
                place[own] = len(tour)
                leaves.append(own)
                tour += (here + reach[child], here)
            else:
                path.pop()
            at[node] = k
        self.order = np.array(leaves[1:], np.int64)  # the end mark alone comes first
        self._place = np.array(place, np.int64)
        self._prepare(np.array(tour, np.int32))

    def _prepare(self, tour: np.ndarray) -> None:
        blocks = -(-len(tour) // _BLOCK)
        grid = np.full((blocks, _BLOCK), np.iinfo(np.int32).max, np.int32)
        grid.reshape(-1)[: len(tour)] = tour
        self._tour = grid.reshape(-1)
        self._ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self._back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self._table = [grid.min(axis=1)]
        while 2 << (len(self._table) - 1) <= blocks:
            half = 1 << (len(self._table) - 1)
            level = self._table[-1]
            self._table.append(np.minimum(level[:-half], level[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ; none is past the end."""
        low, high = self._place[i], self._place[j]
        low, high = np.minimum(low, high), np.maximum(low, high)
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self._back[low], self._ahead[high])
        inner = np.flatnonzero(last - first > 1)
        count = last[inner] - first[inner] - 1
        level = np.frexp(count)[1] - 1
        for k in np.unique(level).tolist():
            at = inner[level == k]
            table = self._table[k]
            out[at] = np.minimum(out[at], np.minimum(table[first[at] + 1], table[last[at] - (1 << k)]))
        same = np.flatnonzero(first == last)
        for s in range(0, len(same), 1 << 14):
            at = same[s : s + (1 << 14)]
            place = np.minimum(low[at][:, None] + np.arange(_BLOCK), high[at][:, None])
            out[at] = self._tour[place].min(axis=1)
        return out.astype(np.int64)
