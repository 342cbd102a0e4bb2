"""Test items in training documents: pairs of words find passages, Smith-Waterman alignment scores them.

Words are runs of letters and numbers, A-Z in lower case. The score is the best local alignment of the item with the document: +1 for an equal
word, -1 for a changed, an added or a missing one, as a share of the item's words; an exact copy has 1. Nothing with the score is missed: an
alignment of m equal words with e errors has at most e + 1 runs, so a score of k takes k - 1 pairs of neighbours that the item and the
passage share, and at least one of them is among all but the k - 2 most frequent ones of the item. Those are looked up first; documents with
one of them are counted, and where the pairs suffice and stand close enough together, the words around them are aligned.
Frequent pairs thus cost little and cut nothing. Items with fewer than N words count only as a whole.

`seeds` tells how many N-grams of the item the document holds, without phrases of the language: those that are much more frequent than the
item's other ones. It is 0 for copies with many edits.

Items go to the tasks in blocks of bounded size, one pass over the documents for each block. Nothing is shuffled but counts. Null and empty
texts hold no passage, items without words have none. Repeated rows of documents are each reported; items are told apart by item_id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import ship
from pvspark.llm.words import MARKS, hashes, ngrams, parts, task

N = 4
#: From this score on a document holds the item.
SCORE = 0.5
#: Seeds occur in at most FEW documents, or TIMES as many as the lower quartile of the item's n-grams that occur at all.
FEW, TIMES = 20, 4
#: Characters of items in one block.
BLOCK = 8 << 20
#: Places of items that are looked at together.
PLACES = 1 << 21
_TABLE = 22


class Items(NamedTuple):
    """A block of items: words of all behind one another, and for each n-gram where it is."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by n: sorted hashes, item, place in the item
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # those that find passages, and how many documents hold them
    need: np.ndarray  # so many places of an item's runs are in every passage with the score


def _sorted(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(values, kind="stable")
    return tuple(x[order] for x in (values, *more))


def prepare(ids: list, texts: list[str | None], n: int = N, score: float = SCORE) -> Items:
    """An item with fewer than n words has itself as its only n-gram and run; others have pairs, or words where a single one has the score."""
    words, offsets = hashes(pa.array(texts, pa.string()), MARKS)
    size, grams, runs = np.diff(offsets), {}, {}
    least = np.array([math.ceil(score * x) for x in size.tolist()], np.int64)
    width = np.where(size < n, size, np.where(least > 1, 2, 1))
    for k in range(1, max(n, 3)):
        values, ends = ngrams(words, offsets, k)
        item = np.repeat(np.arange(len(ids)), np.diff(ends))
        own = width[item] == k
        if own.any():
            place = np.arange(len(values)) - ends[item]
            runs[k] = _sorted(values[own], item[own], place[own], np.zeros(int(own.sum()), np.int64))
    for k in range(1, n + 1):
        values, ends = ngrams(words, offsets, k)
        item = np.repeat(np.arange(len(ids)), np.diff(ends))
        place = np.arange(len(values)) - ends[item]
        if k < n:
            own = size[item] == k
            values, item, place = values[own], item[own], place[own]
        if len(values):
            grams[k] = _sorted(values, item, place)
    return Items(ids, words, offsets, grams, runs, np.where(size < n, 1, np.maximum(least - 1, 1)))


class Finder:
    """Where n-grams of a sorted array occur in texts."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[grams >> np.uint64(64 - _TABLE)] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions in `values` of those that are in the array."""
        at = np.flatnonzero(self.table[values >> np.uint64(64 - _TABLE)])
        found = np.searchsorted(self.grams, values[at])
        return at[self.grams[np.minimum(found, len(self.grams) - 1)] == values[at]]


def _count(grams: dict[int, np.ndarray]):
    """Rows (n, gram, documents) of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(g), np.int64) for k, g in grams.items()}
        finders = {k: Finder(g) for k, g in grams.items()}
        for batch in batches:
            for part in parts(batch, "text"):
                words, offsets = hashes(part.column("text"), MARKS)
                for k, finder in finders.items():
                    values, ends = ngrams(words, offsets, k)
                    at = finder.find(values)
                    doc, gram = np.searchsorted(ends, at, "right") - 1, np.searchsorted(finder.grams, values[at])
                    once = np.unique(doc * len(finder.grams) + gram) % len(finder.grams)
                    total[k] += np.bincount(once, minlength=len(finder.grams))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(some), k)), "gram": pa.array(some), "docs": pa.array(n[some])})

    return task(run)


def seeds(docs: DataFrame, items: Items) -> Items:
    """`items` with those n-grams only that are seeds, and with the documents of each run counted."""
    both = [*items.grams.items(), *items.runs.items()]
    grams = {k: np.unique(np.concatenate([x[0] for n, x in both if n == k])) for k in {k for k, _ in both}}
    counted = docs.select("text").mapInArrow(_count(grams), "n long, gram long, docs long").groupBy("n", "gram").agg(F.sum("docs").alias("docs"))
    frequency = {k: np.zeros(len(g), np.int64) for k, g in grams.items()}
    for k, gram, n in counted.collect():  # at most one row per n-gram of the block
        frequency[k][gram] = n
    kept = {}
    for k, (values, item, place) in items.grams.items():
        n = frequency[k][np.searchsorted(grams[k], values)]
        order = np.lexsort((n, item))
        order = order[n[order] > 0]
        first = np.flatnonzero(np.diff(item[order], prepend=-1) > 0)
        count = np.diff(np.r_[first, len(order)])
        quartile = np.zeros(len(items.ids), np.int64)
        quartile[item[order][first]] = n[order][first + (count - 1) // 4]
        rare = n <= np.maximum(FEW, TIMES * quartile[item])
        kept[k] = (values[rare], item[rare], place[rare])
    runs = {k: (values, item, place, frequency[k][np.searchsorted(grams[k], values)]) for k, (values, item, place, _) in items.runs.items()}
    return items._replace(grams=kept, runs=runs)


def align(item: np.ndarray, words: np.ndarray) -> int:
    """The Smith-Waterman score of two word sequences, row by row; gaps within a row are a running maximum."""
    place = np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1, np.int64), 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == w, 1, -1))
        row = np.maximum.accumulate(new + place) - place
        best = max(best, int(row.max()))
    return best


def _entries(values: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in `wanted` and in `values` (sorted) of all that are equal, some PLACES at a time."""
    low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(wanted):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PLACES, "right")))
        n = (high - low)[start:stop]
        yield np.repeat(np.arange(start, stop), n), np.arange(int(n.sum())) + np.repeat(low[start:stop] - (np.cumsum(n) - n), n)
        start = stop


class Matcher:
    """Scores of the items of a block in texts."""

    def __init__(self, items: Items, score: float) -> None:
        self.items, self.score = items, score
        self.runs = []
        for k, (values, item, place, docs) in items.runs.items():
            order = np.lexsort((place, docs, item))
            first = np.flatnonzero(np.diff(item[order], prepend=-1) > 0)
            count = np.diff(np.r_[first, len(order)])
            early = np.zeros(len(values), bool)
            # A passage has `need` of an item's `count` places, so one at least of these.
            early[order] = np.arange(len(order)) - np.repeat(first, count) <= np.repeat(count - items.need[item[order][first]], count)
            own = np.lexsort((values, item))
            ends = np.searchsorted(item[own], np.arange(len(items.ids) + 1))
            self.runs.append((k, Finder(np.unique(values)), values, item, Finder(np.unique(values[early])), values[early], item[early], (ends, values[own], place[own])))
        self.grams = {k: (np.searchsorted(x[1][o], np.arange(len(items.ids) + 1)), x[0][o]) for k, x in items.grams.items() for o in [np.lexsort((x[0], x[1]))]}
        self.known: dict = {}

    def match(self, texts: pa.Array) -> list[tuple[int, int, int, float]]:
        """(text, item, seeds found, score) for all with at least the score."""
        words, offsets = hashes(texts, MARKS)
        out, many = [], len(self.items.ids)
        for k, whole, values, item, rare, early, early_item, own in self.runs:
            runs, ends = ngrams(words, offsets, k)

            def held(finder: Finder, at: np.ndarray, runs=runs, ends=ends) -> tuple[np.ndarray, np.ndarray]:
                """Text and hash of the different runs at these places."""
                text, n = np.searchsorted(ends, at, "right") - 1, len(finder.grams)
                text, gram = np.divmod(np.unique(text * n + np.searchsorted(finder.grams, runs[at])), n)
                return text, finder.grams[gram]

            text, wanted = held(rare, rare.find(runs))
            some = [np.unique(text[each] * many + early_item[at]) for each, at in _entries(early, wanted)]
            if not some:
                continue
            pairs = np.unique(np.concatenate(some))
            among = np.zeros(len(offsets), bool)
            among[pairs // many] = True
            at = whole.find(runs)
            at = at[among[np.searchsorted(ends, at, "right") - 1]]
            text, wanted = held(whole, at)
            count = np.zeros(len(pairs), np.int64)
            for each, to in _entries(values, wanted):
                key = text[each] * many + item[to]
                found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                count += np.bincount(found[pairs[found] == key], minlength=len(pairs))
            for key in pairs[count >= self.items.need[pairs % many]].tolist():
                t, i = divmod(key, many)
                best = self._best(k, i, words[offsets[t] : offsets[t + 1]], runs[ends[t] : ends[t + 1]], own)
                size = int(self.items.offsets[i + 1] - self.items.offsets[i])
                if best >= self.score * size:
                    out.append((t, i, self._seeds(i, size, words[offsets[t] : offsets[t + 1]]), best / size))
        return sorted(out)

    def _best(self, k: int, i: int, text: np.ndarray, runs: np.ndarray, own: tuple) -> int:
        """The best score of an item in a text, or 0 where its runs don't stand close enough for one that counts."""
        words = self.items.words[self.items.offsets[i] : self.items.offsets[i + 1]]
        bounds, values, place = own
        values, place = values[bounds[i] : bounds[i + 1]], place[bounds[i] : bounds[i + 1]]
        found = np.minimum(np.searchsorted(values, runs), len(values) - 1)
        at = np.flatnonzero(values[found] == runs)
        begin = np.concatenate([at[each] - place[to] for each, to in _entries(values, runs[at])])
        if np.unique(begin, return_counts=True)[1].max() == len(place):
            return len(words)  # a whole copy
        # A passage of the score k has at most n - k words more than the item has.
        n, need = len(words), int(self.items.need[i])
        reach = 2 * n - math.ceil(self.score * n)
        last = at[need - 1 :]
        first = at[: len(last)]
        close = last - first <= reach
        best, start, stop = 0, None, None
        for a, b in [*zip((last[close] - reach).tolist(), (first[close] + reach + k).tolist(), strict=True), (None, None)]:
            if start is not None and (a is None or a > stop):
                best = max(best, self._score(i, words, text[max(0, start) : stop]))
                start = None
            if a is not None:
                start, stop = a if start is None else start, b
        return best

    def _seeds(self, i: int, size: int, text: np.ndarray) -> int:
        n = min(size, max(self.grams))
        ends, values = self.grams[n]
        values = values[ends[i] : ends[i + 1]]
        grams = ngrams(text, np.array([0, len(text)]), n)[0]
        return int((np.searchsorted(values, grams, "right") - np.searchsorted(values, grams, "left")).sum())

    def _score(self, i: int, own: np.ndarray, words: np.ndarray) -> int:
        key = i, words.tobytes()  # copies of a passage are aligned once
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = align(own, words)
        return self.known[key]


def _blocks(items: DataFrame, score: float = SCORE) -> Iterator[Items]:
    """The items in blocks of about BLOCK characters."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK) + 1
    for k in range(n):
        block = sorted(rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect(), key=lambda r: (r[0] is not None, r[0], r[1]))
        if block:
            yield prepare([r["item_id"] for r in block], [r["text"] for r in block], score=score)


def _matches(items: Items, score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, score)
        for batch in batches:
            for part in parts(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                found = matcher.match(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[t] for t, *_ in found], pa.int64()), "item_id": pa.array([items.ids[i] for _, i, *_ in found], pa.int64()),
                    "seeds": pa.array([n for *_, n, _ in found], pa.int64()), "score": pa.array([s for *_, s in found], pa.float64()),
                })

    return task(run)


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, seeds, score: one row per document and item that it holds; documents without an item have no row."""
    ship(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, seeds long, score double")
    for block in _blocks(items, score):
        block = seeds(docs, block)
        found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
        out = out.union(found.mapInArrow(_matches(block, score), "doc_id long, item_id long, seeds long, score double"))
    return out


def _without(items: Items, score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, score)
        for batch in batches:
            for part in parts(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[t for t, *_ in matcher.match(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return task(run)


def decontaminate(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """The documents that hold no item; all columns of the input."""
    ship(docs.sparkSession)
    out = docs
    for block in _blocks(items, score):
        out = out.mapInArrow(_without(seeds(docs, block), score), docs.schema)
    return out
