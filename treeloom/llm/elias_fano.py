"""Elias-Fano encoding of nondecreasing integers."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBQ")
#: Bits of a block of the upper part; the directory has the ones before each, in 32 bits.
_BLOCK = 512


class EliasFano:
    """n values up to ``largest`` in about n * (2 + log2(largest / n)) bits.

    The lower bits are packed; the upper ones are in a bit vector with a one for
    each value, at its upper part plus its index.  ``get`` selects the i-th one:
    a search in the directory of blocks, then in a block.
    """

    def __init__(self, n: int, largest: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.largest, self.low_bits, self.low, self.high = n, largest, low_bits, low, high
        block = _BLOCK // 8
        ones = np.unpackbits(high).reshape(-1, _BLOCK).sum(axis=1) if len(high) else np.zeros(0, dtype=np.int64)
        assert len(high) % block == 0
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, largest = len(values), int(values[-1]) if len(values) else 0
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (largest // n).bit_length() - 1) if n else 0
        low = np.zeros(0, dtype=np.uint8)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1 if n else 0) // _BLOCK) * _BLOCK
        marks = np.zeros(size, dtype=np.uint8)
        marks[at] = 1
        return cls(n, largest, low_bits, low, np.packbits(marks, bitorder="little"))

    def _lower(self, i: int) -> int:
        first, value = i * self.low_bits, 0
        if self.low_bits:
            a, b = first // 8, (first + self.low_bits + 7) // 8
            value = int.from_bytes(self.low[a:b].tobytes(), "little") >> (first % 8)
        return value & ((1 << self.low_bits) - 1)

    def get(self, i: int) -> int:
        """The value at i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        at = block * _BLOCK + int(np.flatnonzero(bits)[i - int(self.before[block])])
        return ((at - i) << self.low_bits) | self._lower(i)

    def span(self, i: int, j: int) -> np.ndarray:
        """The values from i to j - 1: one select, then the ones that follow."""
        if not 0 <= i < j <= self.n:
            raise IndexError((i, j))
        first, last = (int(np.searchsorted(self.before, k, side="right")) - 1 for k in (i, j - 1))
        bits = np.unpackbits(self.high[first * _BLOCK // 8 : (last + 1) * _BLOCK // 8], bitorder="little")
        skipped = i - int(self.before[first])
        at = first * _BLOCK + np.flatnonzero(bits)[skipped : skipped + j - i]
        value = (at - np.arange(i, j)) << self.low_bits
        if self.low_bits:
            a = i * self.low_bits
            low = np.unpackbits(self.low[a // 8 : (j * self.low_bits + 7) // 8], bitorder="little")[a % 8 : a % 8 + (j - i) * self.low_bits]
            value |= (low.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)[None, :]).sum(axis=1)
        return value

    def decode(self) -> np.ndarray:
        """All values."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            value |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        return value

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.largest, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, largest, low_bits, n_high = _HEAD.unpack_from(data)
        n_low = -(-n * low_bits // 8)
        low = np.frombuffer(data, np.uint8, n_low, _HEAD.size)
        high = np.frombuffer(data, np.uint8, n_high, _HEAD.size + n_low)
        return cls(n, largest, low_bits, low, high)
