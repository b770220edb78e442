"""Elias-Fano codes of non-decreasing numbers, with a select structure.

A number is split into ``low`` bits, stored as they are, and the rest, stored in unary: bit
``rest + i`` is set for number ``i``. That takes about ``2 + log2(largest / count)`` bits a
number. The place of every 512th set bit is kept too, so one number is found by a look at
a few bytes. Nothing grows with 64 bits a number.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<QqQBB6x")  # count, first value, bytes of the unary part, low bits, bytes of a sample
_EVERY = 512


def encode(values: np.ndarray) -> bytes:
    """Code of ``values`` (int64, non-decreasing)."""
    count = len(values)
    if not count:
        return _HEADER.pack(0, 0, 0, 0, 4)
    first = int(values[0])
    rest = (np.asarray(values, np.int64) - first).astype(np.uint64)
    low = max(int(rest[-1]) // count, 1).bit_length() - 1
    ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(count)
    unary = np.zeros(int(ones[-1]) // 8 * 8 + 8, np.uint8)
    unary[ones] = 1
    unary = np.packbits(unary, bitorder="little")
    planes = (rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
    width = 4 if ones[-1] < 2**32 else 8
    samples = ones[::_EVERY].astype(f"<u{width}")
    return _HEADER.pack(count, first, len(unary), low, width) + unary.tobytes() + lows.tobytes() + samples.tobytes()


class EliasFano:
    """Reader of a code that begins at ``at`` of ``data``."""

    def __init__(self, data, at: int = 0):
        self.count, self.first, size, self.low, width = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        self._unary = np.frombuffer(data, np.uint8, size, at)
        at += size
        self._lows = np.frombuffer(data, np.uint8, (self.count * self.low + 7) // 8, at)
        at += len(self._lows)
        self._samples = np.frombuffer(data, f"<u{width}", -(-self.count // _EVERY), at)
        self.end = at + self._samples.nbytes

    def _low_bits(self, i: int) -> int:
        bits = range(i * self.low, (i + 1) * self.low)
        return sum(int(self._lows[b >> 3] >> (b & 7) & 1) << k for k, b in enumerate(bits))

    def select(self, i: int) -> int:
        """Number ``i``: from the nearest sample before it, on to set bit ``i``."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, missing = int(self._samples[i // _EVERY]), i % _EVERY
        byte, skip = place >> 3, place & 7
        window = 64
        while True:
            bits = np.unpackbits(self._unary[byte : byte + window], bitorder="little")[skip:]
            ones = np.flatnonzero(bits)
            if len(ones) > missing:
                place += int(ones[missing])
                return ((place - i) << self.low) + self._low_bits(i) + self.first
            window *= 4

    def all(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self._unary, bitorder="little"))[: self.count]
        values = (ones - np.arange(self.count)) << self.low
        if self.low:
            bits = np.unpackbits(self._lows, bitorder="little")[: self.count * self.low].reshape(self.count, self.low)
            values = values + bits @ (1 << np.arange(self.low, dtype=np.int64))
        return values + self.first
