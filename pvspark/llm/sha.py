"""SHA-256 over many inputs at once, with states that can be kept, copied and resumed.

A state is the eight 32-bit words that stand after whole blocks of 64 bytes. hashlib can copy its states inside one process
only; these are plain arrays, so a task can resume what another one has left in a table.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    x = 1 << -(-n.bit_length() // 3)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


# The standard takes its constants from the fractions of the square and cube roots of the first primes.
_FIRST = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
BLOCK = 64
_CHUNK = 4096


def start(rows: int) -> np.ndarray:
    """The state before any input: an array (rows, 8)."""
    return np.tile(_FIRST, (rows, 1))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """`state` (8, rows) after one more block (16, rows) of big-endian words."""
    w = list(words)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        low = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        high = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + low + w[t - 7] + high)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (c & (a ^ b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (rows, 8) after one more block of 64 bytes each (rows, 64)."""
    out = np.empty_like(states)
    for k in range(0, len(states), _CHUNK):
        words = np.ascontiguousarray(blocks[k : k + _CHUNK]).view(">u4").astype(np.uint32)
        out[k : k + _CHUNK] = _compress(np.ascontiguousarray(states[k : k + _CHUNK].T), np.ascontiguousarray(words.T)).T
    return out


def finish(states: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    """Digests (rows, 32) of inputs that were `blocks` whole blocks long."""
    last = np.zeros((len(states), BLOCK), np.uint8)
    last[:, 0] = 0x80
    bits = np.broadcast_to(np.asarray(blocks, np.int64) * 8 * BLOCK, len(states))
    last[:, 56:] = bits.astype(">u8").view(np.uint8).reshape(-1, 8)
    return absorb(states, last).astype(">u4").view(np.uint8)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_text(digests: np.ndarray) -> np.ndarray:
    """Digests (rows, 32) as lower-case hexadecimal text: one block of 64 bytes each."""
    return _HEX[np.stack([digests >> 4, digests & 15], axis=2)].reshape(-1, BLOCK)
