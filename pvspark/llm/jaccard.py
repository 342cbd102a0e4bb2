"""Documents with nearly the same word shingles: an exact Jaccard join, and the groups it makes.

The sets of all documents are written once to mapped files: per set a bitmap of hashed shingles and the sorted shingles. Two sets
with Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles in any common order; in the order used here those that are
frequent over all sets (counted in a fixed number of counters) come last, which changes no result. Sets that meet at a shingle are compared within
the band of sizes that t allows, and only if what follows the shingle in both orders is long enough: it is for the first shingle that a linked
pair shares. Two bitmaps that differ in d bits leave at most (n + m - d) / 2 common shingles; only
sets which that leaves possible are intersected. Sets that a task has already joined, directly or not, are not
compared again, so a group of k near copies costs about k intersections, not k squared.

Null and empty texts, and texts without words, have the empty set, which is linked with nothing. Equal sets are one class, joined
before anything is compared. Repeated rows give repeated rows; a null doc_id names no group, unless no other id does. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import frequency
from pvspark.llm.graph import components
from pvspark.llm.mapped import Reader, Writer
from pvspark.llm.meeting import Meeting
from pvspark.llm.shared import mounted, new_folder, ship, stored
from pvspark.llm.words import hashes, mix, ngrams, parts, task

SHINGLE = 5
#: Links from this similarity on, in hundredths.
PERCENT = 75
BITS = 1024
#: Shingles are told apart by 48 bits in the files.
WIDTH = 6
TILE, COLUMNS = 64, 1024


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text (48 bits of a hash of 64, by which they are told apart), and the offsets of the texts in them."""
    words, offsets = hashes(texts)
    values, ends = ngrams(words, offsets, size)
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = []
        for i in short:
            value = np.zeros(1, np.uint64)
            for w in words[offsets[i] : offsets[i + 1]]:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + w)
            whole.append(value[0])
        values = np.insert(values, ends[short], np.array(whole, np.uint64))
        more = np.zeros(len(count), np.int64)
        more[short] = 1
        ends = ends + np.r_[0, np.cumsum(more)]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[ends[:-1][ends[:-1] < len(values)]] = True
    return values[first] >> np.uint64(64 - 8 * WIDTH), np.r_[0, np.cumsum(first)][ends]


def bitmaps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of BITS / 8 bytes per set."""
    rows = len(ends) - 1
    bits = np.zeros(rows * BITS, bool)
    bits[np.repeat(np.arange(rows) * BITS, np.diff(ends)) + (values % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits.reshape(rows, BITS), axis=1)


def _packed(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :WIDTH].reshape(-1)


class Sets:
    """Reads what `_write_sets` has written, by place."""

    def __init__(self, folder: str) -> None:
        self.files = Reader(folder, np.uint8)

    def bits(self, places: np.ndarray) -> np.ndarray:
        return self.files.gather(places, BITS // 8).view(np.uint64)

    def values(self, place: int, n: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :WIDTH] = self.files.at(place, BITS // 8, n * WIDTH).reshape(n, WIDTH)
        return out.reshape(-1).view(np.uint64)


def _write_sets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = Writer(folder, numbered=True), {}
        for batch in batches:
            for part in parts(batch, "text"):
                values, ends = shingle_sets(part.column("text"))
                n, bits = np.diff(ends), bitmaps(values, ends)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(values + np.uint64(k)))] for k in (1, 2)]
                d1, d2 = [(s[ends[1:]] - s[ends[:-1]]).view(np.int64).tolist() for s in sums]
                at = []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    if a == b:
                        at.append(None)
                        continue
                    if (d1[i], d2[i]) not in known:
                        known[d1[i], d2[i]] = writer.place(np.concatenate([bits[i], _packed(values[a:b])]))
                    at.append(known[d1[i], d2[i]])
                writer.flush()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "content": part.column("content"), "n": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()),
                    "place": pa.array(at, pa.int64()),
                })
        writer.close()

    return task(run)


def _least(n):
    """The size of the shortest set that a set of size n may be linked with, and of the intersection of n shingles altogether."""
    return (PERCENT * n + 99) // 100


def _shingles(folder: str):
    """The shingles of a task's classes, for counting."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sets = Sets(folder)
        for batch in batches:
            for place, n in zip(batch.column("place").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield sets.values(place, n)

    return read


def _prefixes(folder: str, rank: np.ndarray):
    """The first shingles of each set, the rarest first, and how many shingles come after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                places, sizes = part.column("place").to_numpy(), part.column("n").to_numpy()
                values = np.concatenate([sets.values(p, n) for p, n in zip(places.tolist(), sizes.tolist(), strict=True)])
                of = np.repeat(np.arange(len(sizes)), sizes)
                # Set, rank and shingle in one integer of 8, 8 and 48 bits.
                order = np.sort(of.astype(np.uint64) << np.uint64(56) | rank[values % np.uint64(len(rank))].astype(np.uint64) << np.uint64(48) | values)
                pos = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                early = pos < np.repeat(sizes - _least(sizes) + 1, sizes)
                yield pa.RecordBatch.from_pydict({
                    "shingle": pa.array((order[early] & np.uint64((1 << 48) - 1)).view(np.int64)), "place": pa.array(places[of[early]]),
                    "n": pa.array(sizes[of[early]].astype(np.int32)), "after": pa.array((sizes[of] - pos - 1)[early].astype(np.int32)),
                })

    return task(run)


def _need(n, m):
    """Common shingles that link sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Comparison:
    """Sets by their bitmaps, then by their shingles."""

    percent = PERCENT

    def __init__(self, folder: str) -> None:
        self.sets = Sets(folder)

    def need(self, n, m):
        return _need(n, m)

    def heads(self, places: np.ndarray) -> np.ndarray:
        return self.sets.bits(places)

    def possible(self, differ: np.ndarray, n, m) -> np.ndarray:
        return (n + m - differ.sum(axis=-1, dtype=np.int64)) // 2 >= _need(n, m)

    def wide(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.zeros((len(places), 0), np.uint64)

    def within(self, differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.ones(len(differ), bool)

    def surely(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.zeros(len(a), bool)

    def maybe(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.ones(len(a), bool)

    def first(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, after_a: np.ndarray, after_b: np.ndarray) -> np.ndarray:
        return np.ones(len(a), bool)

    def alike(self, a: int, n: int, b: int, m: int) -> bool:
        return len(np.intersect1d(self.sets.values(a, n), self.sets.values(b, m), assume_unique=True)) >= _need(n, m)


def _links(folder: str, tile: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Meeting(Comparison(folder), tile, columns).links(batches, "shingle")

    return task(run)


def groups(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, content (hash of the text), n, class_id, component_id and root: one row per document.

    root tells groups apart and is null for the empty set. `folder` is for the mapped files; every machine must have it mounted.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = mounted(folder or new_folder(spark, "sets"))
    kinds = "doc_id long, content long, n long, d1 long, d2 long, place long"
    content = F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("content")
    rows = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), content, "text").mapInArrow(_write_sets(folder), kinds), "sets")
    classes = rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.min("place").alias("place"))
    classes = stored(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    rank = frequency.ranks(classes.select("place", "n"), _shingles(folder), total)
    shared = spark.sparkContext.broadcast(rank)
    meet = classes.select("place", "n").mapInArrow(lambda x: _prefixes(folder, shared.value)(x), "shingle long, place long, n int, after int")
    meet = meet.repartition("shingle").sortWithinPartitions("shingle", "n", "place")
    linked = components(meet.mapInArrow(_links(folder, TILE, COLUMNS), "a long, b long"))
    of = classes.join(linked, classes["place"] == linked["id"], "left").select("d1", "d2", "class_id", F.coalesce("root", "place").alias("root"))
    least = of.groupBy("root").agg(F.min("class_id").alias("component_id"))
    of = of.join(least, "root").select("d1", "d2", "class_id", "component_id", "root")
    return rows.join(of, ["d1", "d2"], "left").select("doc_id", "content", "n", "class_id", "component_id", "root")


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id: one row per document.

    class_id is the smallest doc_id with the same set, component_id the smallest that links lead to.
    """
    alone = F.col("n") == 0
    ids = [F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")]
    return groups(docs, folder).select("doc_id", F.col("n").alias("n_shingles"), *ids)


def deduplicate(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One document of each group, that with the smallest doc_id (null last, then by text hash); all columns of the input.

    Documents with the empty set all stay, repeated rows of them too. Only ids and hashes of what goes are joined to the texts.
    """
    found = stored(groups(docs, folder), "groups")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("times"), F.min(who).alias("who")).filter("times > 1")
    members = found.join(first, "root")
    later = members.filter(who != F.col("who")).select("doc_id", "content").distinct()
    out = _without(docs, later)
    # A row may be there twice; then one of its kind stays.
    twice = stored(members.filter(who == F.col("who")).groupBy("doc_id", "content").count().filter("count > 1").select("doc_id", "content"), "twice")
    if twice.isEmpty():
        return out
    again = docs.join(_named(twice), _same(docs), "left_semi")
    return _without(out, twice).unionByName(again.dropDuplicates(["doc_id", "text"]))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("__doc"), F.col("content").alias("__content"))


def _same(docs: DataFrame):
    return docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__content"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(_named(rows), _same(docs), "left_anti")
