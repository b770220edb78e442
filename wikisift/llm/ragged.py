"""Texts of an Arrow batch as one byte array: pieces, words and hashes without a Python loop over characters.

Null texts count as empty. Words are ``[^\\x20\\x09-\\x0D]+``. All hashes are 64 bits, the
same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Lower-cased ASCII letters and all bytes of longer characters; the rest is blank.
LETTERS_ONLY = np.full(256, 0x20, np.uint8)
LETTERS_ONLY[65:91] = LETTERS_ONLY[97:123] = np.arange(97, 123)
LETTERS_ONLY[128:] = np.arange(128, 256)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(2024)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Piece:
    """Some whole documents: ``data`` are their bytes, ``offsets`` has one entry more than ``rows``."""

    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.rows)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string or binary column into runs of documents of about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    count = len(column)
    if not count:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + count + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), count)
        part = offsets[first : last + 1]
        yield Piece(np.arange(first, last), data[part[0] : part[-1]], part - part[0])
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document (one entry more)."""
    size = len(data)
    if not size:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < size]
    opens[cuts] = solid[cuts]
    closes = np.zeros(size + 1, bool)
    closes[1:-1] = solid[:-1] & (~solid[1:] | opens[1:])
    closes[-1] = solid[-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < count:
        size = (count | 0xFFFF) + (1 << 16)  # what a worker keeps follows the longest stretch it has hashed
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:count]


class Hasher:
    """Hashes of any substrings of ``data``, each in constant time."""

    def __init__(self, data: np.ndarray):
        size = len(data)
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers(_BASE, size), out=self._sums[1:])
        self._back = powers(_INVERSE, size + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts])


def blocks(starts: np.ndarray, ends: np.ndarray, limit: int = _BLOCK_BYTES) -> Iterator[slice]:
    """Cut spans into runs of about ``limit`` bytes each, so that arrays with numbers for each byte stay small."""
    sums = np.cumsum(ends - starts)
    first = 0
    while first < len(sums):
        done = sums[first - 1] if first else 0
        last = max(int(np.searchsorted(sums, done + limit, side="right")), first + 1)
        yield slice(first, last)
        first = last


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, as by a :class:`Hasher` of all of ``data``: a hash does not depend on the place."""
    keys = np.zeros(len(starts), np.uint64)
    for block in blocks(starts, ends):
        begin = starts[block.start]
        keys[block] = Hasher(data[begin : ends[block.stop - 1]]).spans(starts[block] - begin, ends[block] - begin)
    return keys


def ngrams(units: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` units inside a document, and the document of each.

    A document with fewer units, but at least one, gives its whole sequence as one.
    """
    counts = np.diff(before)
    grams, owners = [], []
    total = len(units)
    if total >= n:
        run = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            run = run * np.uint64(_BASE) + units[k : total - n + 1 + k]
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[: total - n + 1] == owner[n - 1 :]
        grams.append(mix(run[inside]))
        owners.append(owner[: total - n + 1][inside])
    for doc in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.zeros(1, np.uint64)
        for unit in units[before[doc] : before[doc + 1]]:
            h = h * np.uint64(_BASE) + unit
        grams.append(mix(h + np.uint64(counts[doc])))
        owners.append(np.array([doc]))
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
