"""How frequent hashed values are over a whole table, in a fixed number of counters.

Values that share a counter look as frequent as both together, which is enough to put frequent values last in an order. A task hands on two
bytes a counter, whatever it has counted; what is broadcast has one byte a counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pvspark.llm.words import task

COUNTERS = 1 << 22
_BLOCK = 1 << 14
_HELD = 1 << 21
_MOST = (1 << 16) - 1


def ranks(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], values: int, size: int = COUNTERS) -> np.ndarray:
    """One byte per counter, growing with the logarithm of its count; 128 is the mean of about `values` values.

    `read` makes unsigned, well mixed values from the batches of a task. A task counts up to 65,535 of one kind.
    """
    mean = values / size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, some = np.zeros(size, np.int32), 0, []
        for values in read(batches):
            some.append(values)
            held += len(values)
            if held >= _HELD:
                total += np.bincount((np.concatenate(some) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.int32)
                held, some = 0, []
        if some:
            total += np.bincount((np.concatenate(some) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.int32)
        total = np.minimum(total, _MOST).astype(np.uint16)
        for k in range(0, size, _BLOCK):
            if total[k : k + _BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // _BLOCK]), "counts": pa.array([total[k : k + _BLOCK].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                mine = np.frombuffer(counts, np.uint16).astype(np.int64)
                sums[k] = sums[k] + mine if k in sums else mine
        for k, total in sums.items():
            rank = np.clip(128 + 16 * np.log2((total + 0.5) / (mean + 0.5)), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([k]), "counts": pa.array([rank.tobytes()], pa.binary())})

    kind = "block long, counts binary"
    out = np.zeros(size, np.uint8)
    blocks = rows.mapInArrow(task(count), kind).repartition("block").mapInArrow(task(add), kind)
    for k, rank in blocks.collect():  # `size` bytes altogether
        out[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(rank, np.uint8)
    return out
