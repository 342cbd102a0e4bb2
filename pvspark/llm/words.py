"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

A word is a longest run of bytes that don't end one, after lower-casing A-Z. Two different words share
a hash with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is worked on at once, in bytes; arrays made from it are some dozen times as large.
PART = 3 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: white space, or every byte of ASCII but letters and numbers.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(_LOWER.astype(np.uint64) * _STEP + np.uint64(1))
_RAW = mix(np.arange(256, dtype=np.uint64) * _STEP + np.uint64(2))
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _STEP, np.uint64)])
    return _powers


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, and where each text starts; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hashes(texts: pa.Array, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and len(texts) + 1 offsets of the texts in them."""
    data, offsets = _bytes(texts)
    inner = ~ends[data]
    first = np.empty(len(data) + 1, bool)
    first[:1] = True
    np.logical_not(inner, out=first[1:])
    first[offsets] = True
    first = first[:-1] & inner
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begins = np.flatnonzero(first[inner])
    size = np.diff(np.r_[begins, int(inner.sum())])
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begins, size)
    value = _BYTE[data[inner]] * _power(int(size.max()))[place]
    return mix(np.add.reduceat(value, begins) + size.astype(np.uint64)), np.searchsorted(starts, offsets)


def fingerprints(strings: pa.Array) -> np.ndarray:
    """One hash per string, of its bytes as they are."""
    data, offsets = _bytes(strings)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    sums = np.r_[np.uint64(0), np.cumsum(_RAW[data] * _power(int(size.max(initial=0)))[place])]
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64))


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside one text, in order, and the offsets of the texts in them."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    ends = np.r_[0, np.cumsum(count)]
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value = mix(value * _STEP + words[at + k])
    return value, ends


def parts(batch: pa.RecordBatch, column: str, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow. At its end the worker, which lives on, gives memory that it no longer uses back to the machine."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
        if trim is not None:
            trim(0)

    return whole
