"""Vectors as short codes: each part of a vector becomes the number of its nearest codebook entry, found by ball k-means.

Components are whole numbers, floor(256 x), so distances are exact and ties are real ties; the lower entry wins. A codebook starts as
the parts of the first vectors by vec_id. The first pass compares every part with all entries. Later passes know the entry each part had:
its members form a ball around the entry as it is now. An entry whose distance is over twice the ball's radius can't be nearer to any member, so
only the others are neighbours. Members nearer than half the way to the closest neighbour are the stable core and keep their
entry; the others lie in rings between half the ways to one neighbour and the next, and are compared with the neighbours inside their ring
only. Nothing is approximate. Balls are those of one batch of one task: any smaller ball rules out as much or more, and no pass is
needed to agree on a radius.

Sums of a round are made per batch and task and then per entry in Spark; the driver holds the entries alone (parts x entries). Vectors
and their codes are written after each pass, so a lost executor repeats one pass.

Vectors that are null, empty, hold a null or a number that isn't finite, or whose length isn't a multiple of the number of parts or
differs from that of the first vector, are dropped. Equal vec_ids (null last) are ordered by their vectors; repeated rows are rows of
their own. With fewer vectors than entries there are fewer entries; an empty table gives no rows. Columns other than vec_id, embedding and
label are not read. Numbers so large that squared distances could leave 64 bits raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import ship, stored
from pvspark.llm.words import task

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Differences that are worked on at once.
_CELLS = 1 << 21


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest_of_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and the squared distance, by looking at all entries."""
    step = max(1, _CELLS // entries.size)
    found = [_squares(x[k : k + step, None, :], entries[None, :, :]) for k in range(0, len(x), step)]
    every = np.concatenate(found) if found else np.zeros((0, len(entries)), np.int64)
    best = every.argmin(axis=1)  # the first of equal ones
    return best, every[np.arange(len(x)), best]


def nearest_by_balls(x: np.ndarray, entries: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same, for rows that had entry `was` before the entries moved; and how many distances to other entries it took."""
    own = _squares(x, entries[was])
    between = _squares(entries[:, None, :], entries[None, :, :])
    order = np.argsort(between, axis=1, kind="stable")
    order = order[order != np.arange(len(entries))[:, None]].reshape(len(entries), -1)
    ways = np.take_along_axis(between, order, axis=1)
    radius = np.full(len(entries), -1, np.int64)
    np.maximum.at(radius, was, own)
    members = np.argsort(was, kind="stable")
    edge = np.searchsorted(was[members], np.arange(len(entries) + 1))
    rings = np.zeros(len(x), np.int64)
    for i in np.flatnonzero(radius >= 0).tolist():
        ball = members[edge[i] : edge[i + 1]]
        neighbours = ways[i, : np.searchsorted(ways[i], 4 * radius[i], "right")]
        if len(neighbours):
            # Half the way to an entry is over the distance: surely farther. The core is in no ring.
            rings[ball] = np.searchsorted(neighbours, 4 * own[ball], "right")
    best, least = was.copy(), own.copy()
    loose = np.flatnonzero(rings)
    ends = np.cumsum(rings[loose])
    start, most = 0, max(1, _CELLS // max(1, x.shape[1]))
    while start < len(loose):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        rows, count = loose[start:stop], rings[loose[start:stop]]
        begin = np.cumsum(count) - count
        row = np.repeat(rows, count)
        entry = order[was[row], np.arange(len(row)) - np.repeat(begin, count)]
        distance = _squares(x[row], entries[entry])
        near = np.minimum(np.minimum.reduceat(distance, begin), own[rows])
        first = np.minimum.reduceat(np.where(distance == np.repeat(near, count), entry, len(entries)), begin)
        best[rows] = np.where(own[rows] == near, np.minimum(first, was[rows]), first)
        least[rows] = near
        start = stop
    return best, least, int(ends[-1]) if len(ends) else 0


def kept(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and v (whole numbers) of the vectors that have codes; only the length is not checked against the first one's."""
    vector = df["embedding"]
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    size = F.coalesce(F.size(vector), F.lit(0))
    rows = df.select(df["vec_id"].cast("long").alias("vec_id"), df["label"].alias("label"), vector.alias("v")).filter(vector.isNotNull() & (size > 0) & (size % parts == 0) & finite)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(rows, parts, width) whole numbers."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _assign(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, len(books))
            codes, error = np.empty(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            old = b"".join(y for y in batch.column("codes").to_pylist() if y is not None)
            was = np.frombuffer(old, np.uint8).reshape(-1, len(books)).astype(np.int64)
            for p, entries in enumerate(books):
                best, least = nearest_of_all(x[:, p], entries) if not len(was) else nearest_by_balls(x[:, p], entries, was[:, p])[:2]
                codes[:, p] = best
                error += least
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"),
                "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error),
            })

    return task(run)


def _sums(parts: int, entries: int, width: int):
    """What a task's vectors add to each entry that they use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, parts).reshape(-1, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            slot = (codes + np.arange(parts) * entries).reshape(-1)
            order = np.argsort(slot, kind="stable")
            used, first, n = np.unique(slot[order], return_index=True, return_counts=True)
            count[used] += n
            total[used] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(some), "n": pa.array(count[some]), "total": pa.array(list(total[some]), pa.list_(pa.int64())),
        })

    return task(run)


def _moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: the floor of their members' mean; one row per used entry reaches the driver."""
    parts, entries, width = books.shape
    rows = coded.select("v", "codes").mapInArrow(_sums(parts, entries, width), "slot long, n long, total array<long>")
    sums = rows.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    flat = books.reshape(-1, width).copy()
    for slot, n, *total in sums.collect():
        flat[slot] = [t // n for t in total]
    return flat.reshape(books.shape)


def _checked(rows: DataFrame, width: int) -> None:
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if 4 * width * (high - low) ** 2 >= 1 << 62:
        raise ValueError(f"components from {low / SCALE} to {high / SCALE}: squared distances don't fit into 64 bits")


def codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes (a byte per part), error) of each kept vector, and the codebooks (parts, entries, width); none for an empty table."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte per part: 1 to 256 entries")
    ship(df.sparkSession)
    rows = stored(kept(df, parts), "vectors")
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v array<long>, codes binary, error long"
    if first is None:
        return df.sparkSession.createDataFrame([], schema).drop("v"), None
    size = len(first["v"])
    rows = rows.filter(F.size("v") == size)
    width = size // parts
    _checked(rows, width)
    # As many rows as there are entries.
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    coded = rows.withColumn("codes", F.lit(None).cast("binary"))
    for _ in range(rounds):
        coded = stored(coded.mapInArrow(_assign(books), schema), "codes")
        books = _moved(coded, books)
    return stored(coded.mapInArrow(_assign(books), schema).drop("v"), "codes"), books


def encode(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (over all rows of the label, nulls together), codebooks_sha256."""
    rows, books = codes(df, parts, entries, rounds)
    name = None if books is None else hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    # One row per label; a label with very many rows is summed up before the shuffle, and its join can be split.
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(name).alias("codebooks_sha256"))
