"""Monotone integer sequences after Elias and Fano, and files that hold several arrays.

The low bits of each value are packed one after another; the high bits are unary: value i sets bit (high part + i). That takes about
2 + log2(universe / n) bits a value. All look-ups work on many values at once, on arrays that may be mapped from a file.
"""

from __future__ import annotations

import json
import os

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: For each byte the place of its k-th set bit.
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each 64-bit integer."""
    data = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(data), axis=1, dtype=np.int64)
    byte = (upto <= k[:, None]).sum(axis=1)
    row = np.arange(len(k))
    before = np.where(byte > 0, upto[row, byte - 1], 0)
    return 8 * byte + _NTH[data[row, byte], k - before]


class EliasFano:
    """A sorted sequence of integers from 0 to 2**63 - 1."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.width, self.most = (int(x) for x in arrays["head"])
        self._zeros = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """The arrays for `values`, all of which are below `universe`."""
        values = values.astype(np.int64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        place = np.arange(n) * width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        part = (values & ((1 << width) - 1)).astype(np.uint64)
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        if n and width:
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift.astype(np.int64) + width > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        top = values >> width
        most = int(top[-1]) if n else 0
        bits = np.zeros((n + most + 1 + 63) // 64 * 64, bool)
        bits[top + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.uint32 if n < 1 << 32 else np.int64)
        return {"head": np.array([n, width, most]), "low": low, "high": high, "ones": ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        place = i * self.width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        out = self.low[word] >> shift
        # Shifts of 64 are undefined, so the rest moves in two steps.
        out |= (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (out & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by position."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        bit = (word << 6) + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((bit - i) << self.width) | self._low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th 0 (from 0) of the high bits."""
        if self._zeros is None:
            self._zeros = (np.arange(len(self.ones)) << 6) - self.ones.astype(np.int64)
        word = np.searchsorted(self._zeros, k, "right") - 1
        return (word << 6) + _select(~self.high[word], k - self._zeros[word])

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The position of the first value that is not below x; n if there is none."""
        out = np.full(len(x), self.n, np.int64)
        at = np.flatnonzero((x >> self.width) <= self.most) if self.n else np.zeros(0, np.int64)
        if not len(at):
            return out
        top = x[at] >> self.width
        end = self._zero(top) - top
        start = np.zeros(len(at), np.int64)
        inner = top > 0
        start[inner] = self._zero(top[inner] - 1) + 1 - top[inner]
        rest = x[at] & ((1 << self.width) - 1)
        todo = np.flatnonzero(start < end)
        while len(todo):
            middle = (start[todo] + end[todo]) >> 1
            less = self._low(middle) < rest[todo]
            start[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[start[todo] < end[todo]]
        out[at] = start
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of x, or -1."""
        at = self.successor(x)
        known = np.flatnonzero(at < self.n)
        out = np.full(len(x), -1, np.int64)
        hit = known[self.get(at[known]) == x[known]] if len(known) else known
        out[hit] = at[hit]
        return out


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, whole or not at all."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, at, len(a)]
        at += (a.nbytes + 7) // 8 * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(f"{path}.part", "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            file.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(f"{path}.part", path)


def read(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped."""
    data = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    start = 8 + size
    return {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in head.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("head", "low", "high", "ones")})


def named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}
