"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents it reads, 2000 at a time. A document gives pieces that fill a sequence on their own, and a
remainder. Remainders are vectors (tokens, 1, loss-bearing tokens). The open sequence takes the remainder whose product with the room
left, both as shares of the limits, is greatest among those that fit; where none fits, or only one segment is left, one
is cut so that it just fits. What is left open at the end of a task is cut into sequences whose lengths are powers of two, which need no
padding. Nothing is shuffled, so sizes of groups don't matter, and memory holds one slice of documents.

A null text is empty and has its end id only. Repeated rows are packed each. Only doc_id, text and the column of `quiet` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import ship
from pvspark.llm.tokens import PART, encoder
from pvspark.llm.words import parts, task

#: So many documents are packed at once.
SLICE = 2000


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Piece(NamedTuple):
    """`length` ids of item `item` from `start` on."""

    item: int
    start: int
    length: int


def loss_of(start: int, length: int, quiet: int) -> int:
    """Loss-bearing tokens of a piece of an item whose first `quiet` tokens bear none."""
    return max(0, start + length - max(start, quiet))


def _fitting(start: int, most: int, loss: int, quiet: int) -> int:
    """The longest piece from `start` with at most `most` tokens and `loss` loss-bearing ones."""
    return min(most, max(0, quiet - start) + loss)


def pack(lengths: np.ndarray, quiet: np.ndarray, limits: Limits) -> Iterator[list[Piece]]:
    """Sequences of pieces; the last one may be a short one, all others are as full as the limits allow."""
    top = np.array(limits, float)
    pool_item, pool_start = [], []
    for i, (n, q) in enumerate(zip(lengths.tolist(), quiet.tolist(), strict=True)):
        at = 0
        while n - at >= (size := _fitting(at, limits.tokens, limits.loss, q)) and size:
            yield [Piece(i, at, size)]
            at += size
        if at < n:
            pool_item.append(i)
            pool_start.append(at)
    item, start = np.array(pool_item, int), np.array(pool_start, int)
    left = lengths[item] - start
    heavy = np.maximum(0, lengths[item] - np.maximum(start, quiet[item]))
    # The heuristic's order hardly ever differs from this one, which makes the first that fits easy to find.
    order = np.argsort(-left, kind="stable")
    item, start, left, heavy = item[order], start[order], left[order], heavy[order]
    alive = np.ones(len(item), bool)
    remaining = len(item)
    while remaining:
        room = np.array(limits)
        sequence: list[Piece] = []
        while remaining and room.min() > 0:
            fits = alive & (left <= room[0]) & (heavy <= room[2])
            k = -1
            if room[1] > 1 and fits.any():
                share = room / top
                value = np.where(fits, left / top[0] * share[0] + share[1] / top[1] + heavy / top[2] * share[2], -1.0)
                k = int(np.argmax(value))
                size = int(left[k])
            else:  # cut the first one that is long enough, else take the longest
                k = int(np.argmax(alive & (left >= room[0]))) if (alive & (left >= room[0])).any() else int(np.argmax(np.where(alive, left, -1)))
                size = min(int(left[k]), _fitting(int(start[k]), int(room[0]), int(room[2]), int(quiet[item[k]])))
                if size <= 0:
                    break
            sequence.append(Piece(int(item[k]), int(start[k]), size))
            room = room - (size, 1, loss_of(int(start[k]), size, int(quiet[item[k]])))
            start[k] += size
            left[k] -= size
            heavy[k] = max(0, int(lengths[item[k]]) - max(int(start[k]), int(quiet[item[k]])))
            if not left[k]:
                alive[k] = False
                remaining -= 1
        yield sequence
        if remaining < len(item) // 2:  # drop what is spent
            item, start, left, heavy, alive = item[alive], start[alive], left[alive], heavy[alive], alive[alive]


def powers(sequence: list[Piece]) -> Iterator[list[Piece]]:
    """The same pieces in sequences whose lengths are powers of two."""
    rest = list(sequence)
    total = sum(p.length for p in rest)
    for bit in range(total.bit_length() - 1, -1, -1):
        want, out = total & (1 << bit), []
        while want:
            p = rest.pop(0)
            size = min(want, p.length)
            out.append(Piece(p.item, p.start, size))
            want -= size
            if size < p.length:
                rest.insert(0, Piece(p.item, p.start + size, p.length - size))
        if out:
            yield out


def _pack(path: str, end: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 40, 0

        def rows(sequences) -> Iterator[tuple]:
            nonlocal number
            for sequence, at in sequences:
                place = 0
                for p in sequence:
                    doc, doc_ids, quiet = at[p.item]
                    ids = doc_ids[p.start : p.start + p.length]
                    yield doc, p.start, p.length, zlib.crc32(ids.tobytes()), len(doc_ids), task + number, place, loss_of(p.start, p.length, quiet)
                    place += p.length
                number += 1

        def batch_of(found) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        carried: list = []  # documents whose remainders are still open: (doc_id, ids, quiet, start)
        for batch in batches:
            for part in parts(batch, "text", PART):
                ids, offsets = encoder(path).encode(part.column("text"), end)
                quiet = [max(0, q or 0) for q in part.column("quiet").to_pylist()]
                docs = [(d, ids[a:b], q) for d, a, b, q in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), quiet, strict=True)]
                for k in range(0, len(docs), SLICE):
                    yield from _slice(docs[k : k + SLICE], carried, limits, rows, batch_of)
        encoder(path).forget()
        if carried:
            last = {k: (d, doc_ids, q) for k, (d, doc_ids, q, *_) in enumerate(carried)}
            pieces = [Piece(k, s, n) for k, (*_, s, n) in enumerate(carried)]
            yield batch_of(rows((s, last) for s in powers(pieces)))

    return task(run)


def _slice(docs: list, carried: list, limits: Limits, rows, batch_of) -> Iterator[pa.RecordBatch]:
    """Pack one slice; its last sequence, if short, is carried into the next slice as so many small documents."""
    items = [(d, x, q, 0, len(x)) for d, x, q in docs]
    items = [*carried, *items]
    starts = np.array([s for *_, s, _ in items], int)
    lengths = np.array([n for *_, n in items], int)
    quiet = np.maximum(0, np.array([q for _, _, q, _, _ in items], int) - starts)
    at = {k: (d, x, q) for k, (d, x, q, _, _) in enumerate(items)}
    moved = ([Piece(p.item, p.start + int(starts[p.item]), p.length) for p in s] for s in pack(lengths, quiet, limits))
    carried.clear()
    last: list[Piece] = []

    def closed():
        nonlocal last
        for sequence in moved:
            if last:
                yield last, at
            last = sequence

    found = list(rows(closed()))
    if last and sum(p.length for p in last) < limits.tokens:
        carried += [(*at[p.item], p.start, p.length) for p in last]
        carried[:] = [(d, x.copy() if x.base is not None else x, q, s, n) for d, x, q, s, n in carried]
    elif last:
        found += rows([(last, at)])
    yield batch_of(found)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def pack_documents(docs: DataFrame, path: str, end: int = 0, limits: Limits = Limits(), quiet: str | None = None) -> DataFrame:  # noqa: B008
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    `quiet` names a column with the number of leading tokens (a prompt) that bear no loss; a null or missing one means 0.
    """
    ship(docs.sparkSession)
    silent = (docs[quiet] if quiet else F.lit(0)).cast("long").alias("quiet")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", silent)
    return rows.mapInArrow(_pack(path, end, limits), ", ".join(f"{n} long" for n in NAMES))
