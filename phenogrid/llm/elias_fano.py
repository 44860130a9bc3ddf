"""Elias-Fano code of a non-decreasing sequence, with select structures.

A value is split: its low bits are stored as they are, its high part as a one in a bit array at position high + index.
The i-th value needs the position of the i-th one; sampled positions every ``SAMPLE`` ones bound the search. That is about
2 + log2(last / n) bits a value, and no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 256

_HEAD = struct.Struct("<QQBI")


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of unsigned 64-bit numbers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    last = int(values[-1])
    low = max(0, (last // n).bit_length() - 1)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    raw = np.packbits(high, bitorder="little").tobytes()
    return _HEAD.pack(n, last, low, len(raw)) + ones[::SAMPLE].astype("<u4").tobytes() + raw + _pack(values & np.uint64((1 << low) - 1), low)


@dataclass
class EliasFano:
    """Reader over the bytes; ``select`` reads one value, ``all`` every value."""

    data: bytes

    def __post_init__(self):
        self.n, self.last, self.low, size = _HEAD.unpack_from(self.data)
        at = _HEAD.size
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(self.data, "<u4", count, at)
        at += 4 * count
        self.high = np.frombuffer(self.data, np.uint8, size, at)
        self.lows = np.frombuffer(self.data, np.uint8, -1, at + size) if self.low and self.n else np.zeros(0, np.uint8)
        self.low_at, self.block, self.ones = at + size, -1, []  # positions of the ones of the block that was read last

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.uint64)
        start, stop = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lows[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: count * self.low]
        return (bits.reshape(count, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, index: int) -> int:
        """The value at an index: jump to the sample before it and count ones from there. The block stays at hand for its neighbours."""
        if not 0 <= index < self.n:
            raise IndexError(index)
        block, rest = divmod(index, SAMPLE)
        if block != self.block:
            start = int(self.samples[block])
            stop = int(self.samples[block + 1]) if block + 1 < len(self.samples) else len(self.high) * 8
            bits = np.unpackbits(self.high[start // 8 : -(-(stop + 1) // 8)], bitorder="little")[start % 8 :]
            self.block, self.ones = block, (np.flatnonzero(bits) + start).tolist()
        value = self.ones[rest] - index << self.low
        if self.low:
            at, end = index * self.low, (index + 1) * self.low
            raw = int.from_bytes(self.data[self.low_at + at // 8 : self.low_at - (-end // 8)], "little")
            value |= raw >> at % 8 & (1 << self.low) - 1
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._low(0, self.n)
