"""Elias-Fano coding of an ascending sequence, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: Ones of the high part between two samples of the select structure.
SAMPLE = 64
HEADER = struct.Struct("<IBI")          # n, low bits, bytes of the high part


def _pack(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, one after the other."""
    if width == 0 or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-empty ascending sequence of values >= 0.

    Each value keeps its ``low`` lowest bits as they are; the rest is a unary
    code of about two bits a value.  Samples of every 64th one of the unary code
    (32-bit) let ``select`` start near its place.
    """
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1])
    low = max(0, ((top + 1) // n).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64)
    ones = high + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1, np.uint8)
    bits[ones] = 1
    unary = np.packbits(bits, bitorder="little").tobytes()
    return (HEADER.pack(n, low, len(unary)) + ones[::SAMPLE].astype("<u4").tobytes()
            + unary + _pack(values, low))


class EliasFano:
    """Reader of the bytes ``encode`` gives."""

    def __init__(self, data: bytes) -> None:
        self.n, self.low, size = HEADER.unpack_from(data)
        at, samples = HEADER.size, -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        self.unary = np.frombuffer(data, np.uint8, size, at)
        self.lows = np.frombuffer(data, np.uint8, offset=at + size)

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        held = int.from_bytes(self.lows[first // 8:-(-last // 8)].tobytes(), "little")
        return (held >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, bit = divmod(int(self.samples[i // SAMPLE]), 8)
        left = i % SAMPLE + int(self.unary[byte] & ((1 << bit) - 1)).bit_count()
        while left >= (ones := int(self.unary[byte]).bit_count()):
            left, byte = left - ones, byte + 1
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(self.unary[byte:byte + 1],
                                                            bitorder="little"))[left])
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        """Every value (uint64)."""
        ones = np.flatnonzero(np.unpackbits(self.unary, bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[:self.n * self.low]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return high | (bits.reshape(self.n, self.low) * weights).sum(axis=1, dtype=np.uint64)
