"""SHA-256 whose state can be written down, so that one digest can go on in
another task.  hashlib does not hand out its state.

Full blocks go through the system's libcrypto where it has the plain functions,
else through the rounds below (about 1 MB a second).
"""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import cache

MASK = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(n: int, power: int) -> int:
    """First 32 bits of the fraction of the ``power``-th root of ``n``."""
    whole = n << (32 * power)
    low, high = 0, 1 << 40
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** power <= whole else (low, mid - 1)
    return low & MASK


START = tuple(_root_bits(p, 2) for p in _primes(8))
ROUNDS = tuple(_root_bits(p, 3) for p in _primes(64))


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & MASK


def _compress(words: tuple[int, ...], block: bytes) -> tuple[int, ...]:
    w = list(struct.unpack(">16I", block))
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append((w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> 3) + w[t - 7]
                  + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10)) & MASK)
    a, b, c, d, e, f, g, h = words
    for k, v in zip(ROUNDS, w):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + k + v
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = (one + two) & MASK, a, b, c, (d + one) & MASK, e, f, g
    return tuple((p + q) & MASK for p, q in zip(words, (a, b, c, d, e, f, g, h)))


class _Context(ctypes.Structure):
    """The library's state: eight words, the bits so far, one block, two counts."""

    _fields_ = [("words", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32),
                ("high", ctypes.c_uint32), ("block", ctypes.c_uint32 * 16),
                ("held", ctypes.c_uint), ("size", ctypes.c_uint)]


@cache
def _library():
    name = ctypes.util.find_library("crypto")
    try:
        found = ctypes.CDLL(name) if name else None
        found.SHA256_Init, found.SHA256_Update  # noqa: B018
    except (OSError, AttributeError):
        return None
    # Trusted only if it treats the structure as it is laid out here.
    data = bytes(range(128))
    return found if _by_library(found, START, data) == _by_rounds(START, data) else None


def _by_rounds(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    for at in range(0, len(data), 64):
        words = _compress(words, data[at:at + 64])
    return words


def _by_library(library, words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    context = _Context()
    library.SHA256_Init(ctypes.byref(context))
    context.words[:] = words
    library.SHA256_Update(ctypes.byref(context), data, ctypes.c_size_t(len(data)))
    return tuple(context.words)


def _blocks(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    library = _library()
    return _by_library(library, words, data) if library else _by_rounds(words, data)


class Sha256:
    """A digest that goes on from ``state()``; ``size`` counts the bytes so far."""

    def __init__(self, state: bytes | None = None) -> None:
        if state is None:
            self.words, self.size, self.rest = START, 0, b""
        else:
            self.words = struct.unpack(">8I", state[:32])
            (self.size,) = struct.unpack(">Q", state[32:40])
            self.rest = state[40:]

    def update(self, data: bytes) -> None:
        self.size += len(data)
        data = self.rest + data
        full = len(data) // 64 * 64
        if full:
            self.words = _blocks(self.words, data[:full])
        self.rest = data[full:]

    def state(self) -> bytes:
        """32 bytes of words, 8 of size, the bytes of the block begun."""
        return struct.pack(">8IQ", *self.words, self.size) + self.rest

    def hexdigest(self) -> str:
        end = self.rest + b"\x80"
        end += bytes(-(len(end) + 8) % 64) + struct.pack(">Q", 8 * self.size)
        return struct.pack(">8I", *_by_rounds(self.words, end)).hex()
