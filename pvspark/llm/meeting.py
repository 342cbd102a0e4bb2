"""Compares the sets that meet at a key, inside one task, without all pairs of a group of alike ones.

Rows of a task are sorted by key, size and place. A row tells how many elements its set has after the key's, in the order that all sets share. A
linked pair is compared at the first element it shares, if not before: there, what follows in both sets is enough for a link. So pairs whose rest is
too short are left to another key, or aren't linked. A row may also tell the key that comes before this one in its set: two rows with the same one
have met there.

Rows can be packed: a task sorts those of many sets by bucket, a range of keys, and hands on one row per bucket. What is shuffled then has as many
rows as there are buckets, and bytes of one kind lie together, so that they compress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa

from pvspark.llm.graph import Groups
from pvspark.llm.words import mix

#: Pairs that are worked on at once.
PAIRS = 1 << 16
#: Keys are whole numbers below 2 ** BITS where they are packed.
BITS = 40
#: Rows of a bucket, about, and rows that a task packs at once.
BUCKET, HELD = 1 << 16, 1 << 21
#: The key before a row's where there is none.
NONE = -1
_KINDS = {"key": np.int64, "place": np.int64, "n": np.int32, "after": np.int32, "before": np.int64}


class Kind(Protocol):
    """What is compared. Sizes are integers or arrays, m never below n."""

    percent: int  # the smaller of a linked pair has at least this share of the larger one's size

    def need(self, n, m):
        """Elements that a linked pair shares."""

    def heads(self, places: np.ndarray) -> np.ndarray:
        """A row of 64-bit integers per place."""

    def possible(self, differ: np.ndarray, n, m) -> np.ndarray:
        """Whether a pair can be linked; `differ` has the number of different bits of each integer of their heads."""

    def wide(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A longer row of 64-bit integers per place, for keys with many rows."""

    def within(self, differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether pairs can be linked whose long rows differ in so many bits."""

    def surely(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Pairs that a look at all of them at once shows to be linked; of the others nothing is known."""

    def maybe(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Pairs that a closer look at all of them at once can't rule out."""

    def first(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, after_a: np.ndarray, after_b: np.ndarray) -> np.ndarray:
        """Pairs that share nothing before the key at which they meet. The others have been compared there, or will be, maybe by another task."""

    def alike(self, a: int, n: int, b: int, m: int) -> bool:
        """Whether a pair is linked."""


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by `key`, in batches that never end inside a key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if len(keys) and keys[0] != keys[-1] else 0
        if not len(keys):
            continue
        if last == 0 and (not rest or rest[-1].column(key)[-1].as_py() == keys[0]):
            rest.append(batch)
            continue
        yield from _joined([*rest, batch.slice(0, last)])
        rest = [batch.slice(last)]
    yield from _joined(rest)


def _joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if batches and any(b.num_rows for b in batches):
        yield pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def buckets(rows: int) -> int:
    """How many buckets about so many rows make, all of equal range."""
    return min(rows // BUCKET + 1, 1 << 22)


def packed(rows: Iterator[tuple[np.ndarray, ...]], count: int) -> Iterator[pa.RecordBatch]:
    """(bucket, rows, data) from key, place, n, after and before, given as arrays of some rows at a time."""
    held, many = [], 0
    for some in chain(rows, [None]):
        if some is not None:
            held.append([x.astype(kind, copy=False) for x, kind in zip(some, _KINDS.values(), strict=True)])
            many += len(some[0])
        if many and (some is None or many >= HELD):
            # Column by column, so that little more than the rows themselves is in memory.
            columns = [list(x) for x in zip(*held, strict=True)]
            held, many = [], 0
            key = np.concatenate(columns[0])
            order = np.argsort(key)
            bucket = (key[order] * count) >> BITS
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            bucket, ranges, planes = bucket[edge[:-1]], list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)), []
            del key
            for k in range(len(columns)):
                column, columns[k] = np.concatenate(columns[k])[order], None
                planes.append([_planes(column[a:b]) for a, b in ranges])
                del column
            for k in range(0, len(ranges), 128):
                part = slice(k, k + 128)
                data = [b"".join(x) for x in zip(*(x[part] for x in planes), strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[part]), "rows": pa.array(np.diff(edge)[part]), "data": pa.array(data, pa.binary())})


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `packed` has packed, one batch per bucket, sorted by key, size and place, without keys of a single row. Rows of a bucket come one after another."""
    for batch in runs(batches, "bucket"):
        bucket = batch.column("bucket").to_numpy()
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        counts, data = batch.column("rows").to_pylist(), batch.column("data")
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            columns = {k: [] for k in _KINDS}
            for i in range(a, b):
                view, at = np.frombuffer(data[i].as_buffer(), np.uint8), 0
                for k, kind in _KINDS.items():
                    size = np.dtype(kind).itemsize * counts[i]
                    columns[k].append(np.ascontiguousarray(view[at : at + size].reshape(-1, counts[i]).T).view(kind).reshape(-1))
                    at += size
            whole = {k: np.concatenate(x) for k, x in columns.items()}
            # Sorted runs one after another, as each task has sorted its rows.
            order = np.argsort(whole["key"], kind="stable")
            same = np.diff(whole["key"][order]) == 0
            order = order[np.r_[False, same] | np.r_[same, False]]
            order = order[np.lexsort((whole["place"][order], whole["n"][order], whole["key"][order]))]
            yield pa.RecordBatch.from_pydict({k: pa.array(x[order]) for k, x in whole.items()})


def _nth(keys: np.ndarray) -> np.ndarray:
    """How many equal keys come before each one."""
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(edge, np.diff(np.r_[edge, len(keys)]))
    return out


class Meeting:
    """Groups of one task. Keys with up to `tile` rows are compared all at once, others `tile` rows with `columns` others at a time.

    `close` is like `Kind.surely` and is asked about what is left, before `Kind.alike` looks at pair by pair.
    """

    def __init__(self, kind: Kind, tile: int, columns: int, close: Callable[..., np.ndarray] | None = None) -> None:
        self.kind, self.tile, self.columns, self.close = kind, tile, columns, close
        self.groups, self.unlike, self.found, self.joined, self.held, self.many = Groups(), set(), [], 0, [], 0

    def _alike(self, a: int, n: int, b: int, m: int) -> bool:
        pair = (a, b) if a < b else (b, a)
        if pair in self.unlike:
            return False
        if self.kind.alike(a, n, b, m):
            return True
        if len(self.unlike) >= 200_000:  # only spares work
            self.unlike.clear()
        self.unlike.add(pair)
        return False

    def _tiles(self, places: np.ndarray, sizes: np.ndarray, after: np.ndarray, before: np.ndarray | None) -> None:
        """All rows of one key. Some that aren't in the largest group are compared with all that are left, until the largest group is all that is left.

        So a group of alike rows is passed over once, however many pairs it has.
        """
        listed, left, inside = places.tolist(), np.ones(len(places), bool), np.zeros(len(places), bool)
        roots, joined, wide = self.groups.roots(listed), self.joined, None
        while True:
            if joined != self.joined:
                roots, joined = self.groups.roots(listed), self.joined
            names, count = np.unique(roots[left], return_counts=True)
            if len(names) < 2:
                return
            rows = np.flatnonzero(left & (roots != names[np.argmax(count)]))[: self.tile]
            inside[rows] = True
            wide = self.kind.wide(places, sizes) if wide is None else wide
            heads = self.kind.heads(places[rows])
            # Sorted by size, the others are out of reach.
            low = np.searchsorted(100 * sizes, self.kind.percent * sizes[rows[0]], "left")
            high = np.searchsorted(self.kind.percent * sizes, 100 * sizes[rows[-1]], "right")
            others = low + np.flatnonzero(left[low:high])
            for k in range(0, len(others), self.columns):
                self._tile(places, sizes, after, before, rows, heads, wide, others[k : k + self.columns], inside)
            left[rows] = inside[rows] = False

    def _tile(
        self, places: np.ndarray, sizes: np.ndarray, after: np.ndarray, before: np.ndarray | None,
        rows: np.ndarray, heads: np.ndarray, wide: np.ndarray, columns: np.ndarray, inside: np.ndarray,
    ) -> None:
        """Compare `rows` with `columns`; rows `inside` both only once."""
        kind, at, to = self.kind, rows[:, None], columns[None, :]
        of_row, of_column = self.groups.roots(places[rows].tolist()), self.groups.roots(places[columns].tolist())
        n, m = np.minimum(sizes[at], sizes[to]), np.maximum(sizes[at], sizes[to])
        possible = (of_row[:, None] != of_column[None, :]) & ((to > at) | ~inside[to]) & (kind.percent * m <= 100 * n)
        possible &= np.minimum(after[at], after[to]) + 1 >= kind.need(n, m)
        if before is not None:
            possible &= (before[at] != before[to]) | (before[at] == NONE)
        if not possible.any():
            return
        possible &= kind.possible(np.bitwise_count(heads[:, None, :] ^ kind.heads(places[columns])[None, :, :]), n, m)
        i, j = np.nonzero(possible)
        differ = np.empty(len(i), np.int64)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            differ[k : k + PAIRS] = np.bitwise_count(wide[rows[x]] ^ wide[columns[y]]).sum(axis=1, dtype=np.int64)
        near = kind.within(differ, n[i, j], m[i, j])
        # Those that look most alike come first, and at first one pair for each row: in a group of alike rows most others then needn't be looked at.
        order = np.argsort(differ[near], kind="stable")
        i, j, wave = i[near][order], j[near][order], 0
        while len(i):
            apart = of_row[i] != of_column[j]
            i, j = i[apart], j[apart]
            x, y = of_row[i], of_column[j]
            # One pair of any two groups, later on more, and for each group ever more.
            some = np.flatnonzero(_nth(mix(np.minimum(x, y).view(np.uint64)) * np.uint64(3) + np.maximum(x, y).view(np.uint64)) < 4 ** max(wave - 4, 0))
            _, of, count = np.unique(of_row, return_inverse=True, return_counts=True)
            some = some[_nth(x[some]) < 4**wave * count[of[i[some]]]]
            a, b = np.minimum(rows[i[some]], columns[j[some]]), np.maximum(rows[i[some]], columns[j[some]])
            for k in range(0, len(some), PAIRS):
                self._look(places[a[k : k + PAIRS]], places[b[k : k + PAIRS]], sizes[a[k : k + PAIRS]], sizes[b[k : k + PAIRS]])
            i, j, wave = np.delete(i, some), np.delete(j, some), wave + 1
            of_row, of_column = self.groups.roots(places[rows].tolist()), self.groups.roots(places[columns].tolist())

    def _look(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> None:
        """Join the pairs of places that are linked, of those that aren't in one group already."""
        linked = self.kind.surely(a, b, n, m)
        self._join(a[linked], b[linked])
        rest = np.flatnonzero(~linked)
        rest = rest[self._apart(a[rest], b[rest])]
        # Whether they have met before doesn't matter: one link joins a row to a group, while each of its pairs would have to be looked up.
        rest = rest[self.kind.maybe(a[rest], b[rest], n[rest], m[rest])]
        self._rest(a[rest], b[rest], n[rest], m[rest])

    def _rest(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> None:
        """The same for pairs that `Kind.surely` and `Kind.maybe` leave open."""
        if self.close is not None:
            linked = self.close(a, b, n, m)
            self._join(a[linked], b[linked])
            a, b, n, m = (x[~linked] for x in (a, b, n, m))
        for one, x, other, y in zip(a.tolist(), n.tolist(), b.tolist(), m.tolist(), strict=True):
            if self.groups.root(one) != self.groups.root(other) and self._alike(one, x, other, y):
                self._join(np.array([one]), np.array([other]))

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.groups.roots(a.tolist()) != self.groups.roots(b.tolist())

    def _pairs(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, after_a: np.ndarray, after_b: np.ndarray) -> None:
        """Pairs of places, with their sizes and what follows the key. A pair may be there for several keys."""
        # Of a pair's keys here, the one that comes first in the order of all sets.
        early = np.argsort(-after_a, kind="stable")
        _, once = np.unique((mix(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64))[early], return_index=True)
        once = np.sort(early[once])
        some, where = np.unique(np.r_[a[once], b[once]], return_inverse=True)
        heads = self.kind.heads(some)
        once = once[self.kind.possible(np.bitwise_count(heads[where[: len(once)]] ^ heads[where[len(once) :]]), n[once], m[once])]
        once = once[self._apart(a[once], b[once])]
        sure = self.kind.surely(a[once], b[once], n[once], m[once])
        keep = sure.copy()
        keep[~sure] = self.kind.maybe(*(x[once[~sure]] for x in (a, b, n, m)))
        once, sure = once[keep], sure[keep]
        new = self.kind.first(a[once], b[once], n[once], m[once], after_a[once], after_b[once])
        once, sure = once[new], sure[new]
        self._join(a[once[sure]], b[once[sure]])
        rest = once[~sure]
        rest = rest[self._apart(a[rest], b[rest])]
        self._rest(a[rest], b[rest], n[rest], m[rest])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = [pair for pair in zip(a.tolist(), b.tolist(), strict=True) if self.groups.join(*pair)]
        self.found += new
        self.joined += len(new)

    def _flush(self, least: int) -> None:
        """Compare the pairs that are held, if there are `least`."""
        if self.many >= least:
            whole = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            for k in range(0, self.many, PAIRS):
                self._pairs(*(x[k : k + PAIRS] for x in whole))
            self.held, self.many = [], 0

    def _out(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in self.found], pa.int64()), "b": pa.array([x for _, x in self.found], pa.int64())})
            self.found = []

    def links(self, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) that connect what is linked. Columns of the rows: the key, place, n and after, and before where it is known."""
        kind = self.kind
        for batch in runs(batches, key):
            keys = batch.column(key).to_numpy()
            length = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))
            some = np.flatnonzero(np.repeat(length > 1, length))
            keys, places = keys[some], batch.column("place").to_numpy()[some]
            sizes, after = (batch.column(c).to_numpy()[some].astype(np.int64) for c in ("n", "after"))
            before = batch.column("before").to_numpy()[some] if "before" in batch.schema.names else None
            length = length[length > 1]
            edge = np.cumsum(length) - length
            at, off = np.flatnonzero(np.repeat(length <= self.tile, length)), 0
            while len(at):
                off += 1
                at = at[at + off < len(keys)]
                # Sorted by size, the others are out of reach from here on.
                at = at[(keys[at] == keys[at + off]) & (kind.percent * sizes[at + off] <= 100 * sizes[at])]
                near = at[np.minimum(after[at], after[at + off]) + 1 >= kind.need(sizes[at], sizes[at + off])]
                if before is not None:
                    near = near[(before[near] != before[near + off]) | (before[near] == NONE)]
                self.held.append((places[near], places[near + off], sizes[near], sizes[near + off], after[near], after[near + off]))
                self.many += len(near)
                self._flush(PAIRS)
            for start, size in zip(edge[length > self.tile].tolist(), length[length > self.tile].tolist(), strict=True):
                self._tiles(*(None if x is None else x[start : start + size] for x in (places, sizes, after, before)))
            yield from self._out()
        self._flush(1)
        yield from self._out()
