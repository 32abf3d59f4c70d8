"""SHA-256 whose state can be handed from task to task."""

from __future__ import annotations

import ctypes
import struct
from functools import cache
from math import isqrt
from typing import NamedTuple

_WORD = 0xFFFFFFFF
_PRIMES = [n for n in range(2, 312) if all(n % k for k in range(2, n))]


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= n else (low, mid - 1)
    return low


_START = struct.pack("=8I", *[isqrt(p << 64) & _WORD for p in _PRIMES[:8]])
_ROUND = [_cube_root(p << 96) & _WORD for p in _PRIMES]


class Sha256(NamedTuple):
    """Chaining words, bytes taken so far and those of them that do not fill a block yet."""

    words: bytes = _START
    size: int = 0
    tail: bytes = b""


class _Context(ctypes.Structure):  # SHA256_CTX of openssl/sha.h
    _fields_ = [("h", ctypes.c_uint32 * 8), ("n", ctypes.c_uint32 * 2), ("data", ctypes.c_ubyte * 64), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


@cache
def _native():
    """`SHA256_Update` of the library behind hashlib, None where it has none."""
    try:
        import _hashlib

        update = ctypes.CDLL(_hashlib.__file__).SHA256_Update
        update.argtypes = [ctypes.POINTER(_Context), ctypes.c_char_p, ctypes.c_size_t]
        return update
    except (ImportError, AttributeError, OSError):
        return None


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & _WORD


def _block(words: list[int], block: bytes) -> list[int]:
    w = list(struct.unpack(">16I", block))
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append((w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> 3) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10)) & _WORD)
    a, b, c, d, e, f, g, h = words
    for k, x in zip(_ROUND, w, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + k + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = (one + two) & _WORD, a, b, c, (d + one) & _WORD, e, f, g
    return [(x + y) & _WORD for x, y in zip(words, (a, b, c, d, e, f, g, h), strict=True)]


def update(state: Sha256, data: bytes) -> Sha256:
    """The state after some more bytes."""
    add, size = _native(), state.size + len(data)
    if add is None:  # slow, but right
        data = state.tail + data
        words, whole = list(struct.unpack("=8I", state.words)), len(data) // 64 * 64
        for at in range(0, whole, 64):
            words = _block(words, data[at : at + 64])
        return Sha256(struct.pack("=8I", *words), size, data[whole:])
    bits, c = state.size * 8, _Context()
    c.h[:], c.n[:], c.num, c.length = struct.unpack("=8I", state.words), (bits & _WORD, bits >> 32 & _WORD), len(state.tail), 32
    c.data[: len(state.tail)] = state.tail
    add(ctypes.byref(c), data, len(data))
    return Sha256(bytes(c.h), size, bytes(c.data[: c.num]))


def hexdigest(state: Sha256) -> str:
    pad = b"\x80" + b"\0" * ((55 - state.size) % 64) + struct.pack(">Q", state.size * 8)
    return struct.pack(">8I", *struct.unpack("=8I", update(state, pad).words)).hex()
