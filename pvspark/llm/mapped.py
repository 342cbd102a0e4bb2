"""Arrays of one task in a file of the shared folder, read by others through memory mapping.

A writer's file has a name of its own, so a repeated task leaves the first file alone, and what refers to a file names it in full.
With `numbered` the name is the number of the task attempt, and a place (file and position) fits into one integer.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
from pyspark import TaskContext

#: Bits of a place that tell the position in a file.
POSITION = 36

class Writer:
    """Appends arrays of one type to a new file, made with the first one."""

    def __init__(self, folder: str, numbered: bool = False) -> None:
        context = TaskContext.get() if numbered else None
        self.number = context.taskAttemptId() if context else 0
        self.folder, self.name, self.file, self.at = folder, str(self.number) if numbered else uuid.uuid4().hex, None, 0

    def add(self, values: np.ndarray) -> int:
        """The position, in values, of the first one."""
        if self.file is None:
            os.makedirs(self.folder, exist_ok=True)
            self.file = open(f"{self.folder}/{self.name}", "wb", buffering=1 << 20)  # noqa: SIM115
        at, self.at = self.at, self.at + len(values)
        self.file.write(values.tobytes())
        return at

    def place(self, values: np.ndarray) -> int:
        """Like `add`, but the file is part of the result."""
        at = self.add(values)
        if at >> POSITION or self.number >> (63 - POSITION):
            raise ValueError(f"file {self.number} at {at}: a place has no room for this")
        return self.number << POSITION | at

    def flush(self) -> None:
        if self.file is not None:
            self.file.flush()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Reader:
    """Slices of files by name; at most `most` files are mapped at once."""

    def __init__(self, folder: str, kind, most: int = 512) -> None:
        self.folder, self.kind, self.most, self.open = folder, kind, most, OrderedDict()

    def file(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = np.asarray(np.memmap(f"{self.folder}/{name}", dtype=self.kind, mode="r"))
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        return self.open[name]

    def get(self, name: str, at: int, n: int) -> np.ndarray:
        return self.file(name)[at : at + n]

    def gather(self, places: np.ndarray, n: int) -> np.ndarray:
        """`n` values from each of these places, as rows."""
        out = np.empty((len(places), n), self.kind)
        order = np.argsort(places)
        files = places[order] >> POSITION
        edge = np.flatnonzero(np.diff(files, prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rows = order[a:b]
            out[rows] = self.file(str(int(files[a])))[(places[rows] & ((1 << POSITION) - 1))[:, None] + np.arange(n)]
        return out

    def ragged(self, places: np.ndarray, skip: int, sizes: np.ndarray) -> np.ndarray:
        """`sizes` values from behind the first `skip` ones at each of these places, behind one another."""
        out = np.empty(int(sizes.sum()), self.kind)
        ends = np.cumsum(sizes)
        order = np.argsort(places)
        files = places[order] >> POSITION
        edge = np.flatnonzero(np.diff(files, prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rows = order[a:b]
            n = sizes[rows]
            inside, before = np.arange(int(n.sum())), np.cumsum(n) - n
            at = (places[rows] & ((1 << POSITION) - 1)) + skip
            out[np.repeat(ends[rows] - n - before, n) + inside] = self.file(str(int(files[a])))[np.repeat(at - before, n) + inside]
        return out

    def at(self, place: int, skip: int, n: int) -> np.ndarray:
        return self.get(str(place >> POSITION), (place & ((1 << POSITION) - 1)) + skip, n)
