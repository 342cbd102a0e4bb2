"""Fuzzy duplicates of lines: an edit distance confirms them, one occurrence of each group stays.

A line is normalised to its words: runs of letters and numbers, A-Z in lower case. Equal lines are one line from the start. Two lines are linked
when at most a fifth of the longer one's words must be changed, added or removed. The blocks in which linked lines must agree are pairs of
neighbouring words: d edits leave all but 2 d of the n - 1 pairs, so by the pigeonhole principle linked lines share one of the first pairs
of each, in one order for all lines, as many as one of them must be shared by. Pairs that are frequent over all lines (counted in a fixed
number of counters) come last in it, which changes no result. Lines that meet at a pair are compared if what follows it is long
enough in both, which it is at the first pair that linked lines share. Lines whose 64-bit SimHashes differ in at most NEAR bits are candidates; the
others only if the parities of their words allow so few edits, which loses no link. Candidates that hold too few common words, wherever they stand, aren't linked. Lines that a task has linked already,
directly or not, are not compared again. The words themselves lie in mapped files, written once.

Of a group of linked lines the first occurrence, by doc_id (null last), text hash and line number, stays. Lines without a word are left alone. Null and
empty texts have one empty line. Rows with equal doc_id and text count as one and are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import frequency
from pvspark.llm.graph import components
from pvspark.llm.mapped import Reader, Writer
from pvspark.llm.meeting import BITS, NONE, Meeting, buckets, packed, unpacked
from pvspark.llm.shared import mounted, new_folder, ship, stored
from pvspark.llm.words import MARKS, hashes, mix, parts, task

#: Lines are linked when at least this share of the longer one stays as it is, in hundredths.
PERCENT = 80
#: SimHashes with at most so many different bits are near.
NEAR = 12
TILE = 64
#: Parities of a line's words and its SimHash, in numbers of 64 bits; in 32-bit numbers, they come before its words in its file.
MARK = 4
HEAD = 2 * (MARK + 1)
#: Numbers of 64 bits with the parities of lines that meet many others at a key.
WIDE = 16
#: Of the hash of a pair of words 44 bits count; equal ones only cost comparisons.
_HASH = np.uint64(44)
_LINES = 1 << 14
#: Words of lines that are compared at once.
_WORDS = 1 << 20
#: Shifts beside those of both ends that `few_edits` tries, and places of all shifts that it looks at together.
SIDE = 2
_PLACES = 1 << 19


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def simhashes(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per line the 64 majorities of its words' bits; on a tie the bit is 0.

    The eight bits of a byte are counted at once, in the eight bytes of one integer, over up to 255 words; longer lines are several runs.
    """
    if not len(begins):
        return np.zeros(0, np.uint64)
    size = np.diff(np.r_[begins, len(words)])
    count = -(-size // 255)
    line = np.r_[0, np.cumsum(count)[:-1]]
    run = np.repeat(begins - 255 * line, count) + 255 * np.arange(int(count.sum()))
    bytes_of = words.view(np.uint8).reshape(-1, 8)
    most = np.empty((len(begins), 8, 8), bool)
    for k in range(8):
        ones = np.add.reduceat(_LANES[bytes_of[:, k]], run).view(np.uint8).reshape(-1, 8)
        if len(run) > len(line):
            ones = np.add.reduceat(ones, line, axis=0, dtype=np.int64)
        most[:, k] = 2 * ones.astype(np.int64) > size[:, None]
    return np.packbits(most.reshape(-1, 64), axis=1).view(np.uint64).reshape(-1)


def line_hashes(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One hash per line, of its words in order."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    size = np.diff(np.r_[begins, len(words)])
    place = (np.arange(len(words)) - np.repeat(begins, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), begins) + size.astype(np.uint64))


def parities(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per line 64 MARK bits, as 32-bit numbers; each word turns one over. An edit changes two of them at most."""
    if not len(begins):
        return np.zeros((0, 2 * MARK), np.uint32)
    line = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(words)]))
    count = np.bincount(line * (64 * MARK) + ((words >> np.uint64(40)) % np.uint64(64 * MARK)).astype(np.int64), minlength=len(begins) * 64 * MARK)
    return np.packbits((count & 1).astype(np.uint8)).view(np.uint32).reshape(-1, 2 * MARK)


def _few(begins: np.ndarray, end: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Lines some 1024 at a time: where their words begin and end, and where each line's do."""
    for k in range(0, max(len(begins), 1), 1024):
        some = begins[k : k + 1024]
        yield int(some[0]) if len(some) else 0, int(begins[k + 1024]) if k + 1024 < len(begins) else end, some


def pairs_of(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of all pairs of neighbouring words."""
    of = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(of[:-1] == of[1:])
    value = mix(words[inside].astype(np.uint64) << np.uint64(32) | words[inside + 1].astype(np.uint64)) >> (np.uint64(64) - _HASH)
    return of[inside], value


def prefixes(words: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, keys, how many pairs of the line come after each, and the key before it. At most _LINES lines.

    Any two lines within the edit distance share a key.

    A pair of words that a line holds again is another one there. A line of n words shares at least least(n) pairs with a line that is
    linked to it, so it takes all but least(n) - 1 of them. Lines under four words have no near ones.
    """
    line, value = pairs_of(words, size)
    # Line, rank and pair in one integer of 14, 6 and 44 bits.
    late = rank[value % np.uint64(len(rank))].astype(np.uint64) >> np.uint64(2)
    value = np.sort(line.astype(np.uint64) << np.uint64(50) | late << _HASH | value)
    line = (value >> np.uint64(50)).astype(np.int64)
    place = np.arange(len(value))
    value &= (np.uint64(1) << _HASH) - np.uint64(1)
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (line[1:] != line[:-1])][: len(value)])
    again = place - np.repeat(new, np.diff(np.r_[new, len(value)]))
    count = np.maximum(size - 1, 0)
    pos = place - np.repeat(np.cumsum(count) - count, count)
    early = pos < np.repeat(np.where(size < 4, 0, size - least(size)), count)
    line, value, again, pos = line[early], value[early], again[early], pos[early]
    # Few bits, as every byte of a key is written for each line.
    key = (mix(value + (again.astype(np.uint64) << _HASH)) >> np.uint64(64 - BITS)).astype(np.int64)
    return line, key, count[line] - pos - 1, np.where(pos == 0, NONE, np.r_[NONE, key[:-1]][: len(key)])


def least(n):
    """The fewest pairs of words that a line of n words shares with one that is linked to it, whichever is longer.

    The longer one, of m words, keeps m - 1 - 2 (m // 5); that is least for m = n or for the next multiple of 5.
    """
    up = -(-n // 5) * 5
    return np.minimum(n - 2 * (n * (100 - PERCENT) // 100), up - 2 * (up * (100 - PERCENT) // 100)) - 1


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words changed, added or missing; some number over `most` if there are more than that.

    What both have in common at either end goes first. The rest is Myers' bit vectors: one integer holds, for all words of
    the shorter side, whether the distance grows or falls there by 1.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(b) - len(a) > most:
        return len(b)
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    grows, falls, distance = every, 0, len(a)
    for i, w in enumerate(b.tolist(), 1):
        equal = places.get(w, 0)
        still = equal | falls
        across = (((equal & grows) + grows) ^ grows) | equal
        up, down = (falls | ~(across | grows)) & every, grows & across
        distance += 1 if up & last else -1 if down & last else 0
        if distance - (len(b) - i) > most:
            return most + 1
        up, down = (up << 1 | 1) & every, (down << 1) & every
        grows, falls = (down | ~(still | up)) & every, up & still
    return distance


def few_edits(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs whose edit distance is at most `most`, if an alignment shows it that shifts words by -SIDE to m - n + SIDE places. Of others nothing is known.

    The words of the pairs lie behind one another, n in `a` and m >= n in `b`. For all pairs and shifts at once, `reach` tells how many words of `a` are
    dealt with after so many edits; equal words that follow cost nothing.
    """
    pair, count, width = np.arange(len(n)), int((m - n).max()) + 1 + 2 * SIDE, int(n.max()) + 1
    # Numbers that equal nothing lie beside the words.
    left, right = np.full((len(n), width), -1, np.int64), np.full((len(n), width + count), -2, np.int64)
    left[np.arange(width) < n[:, None]] = a
    place = np.arange(width + count) - SIDE
    right[(place >= 0) & (place < m[:, None])] = b
    # From each place on the first one at which words differ.
    place, until = np.arange(width, dtype=np.int32), np.empty((count, len(n), width), np.int32)
    for k in range(count):
        until[k] = np.where(left != right[:, k : k + width], place, np.int32(width))
    until = np.minimum.accumulate(until[:, :, ::-1], axis=2)[:, :, ::-1]
    shift = np.arange(count)[:, None]
    end = np.minimum(n, m - shift + SIDE)
    reach = np.full((count, len(n)), -width - count)
    reach[SIDE] = 0
    out = np.zeros(len(n), bool)
    for edits in range(int(most.max()) + 1):
        reach = np.where(reach < 0, reach, until[shift, pair, np.maximum(reach, 0)])
        out |= (reach[m - n + SIDE, pair] == n) & (edits <= most)
        if out.all():
            break
        more = reach + 1
        more[1:] = np.maximum(more[1:], reach[:-1])
        more[:-1] = np.maximum(more[:-1], reach[1:] + 1)
        # Shifts that weren't reached stay so.
        reach = np.where(more < end, more, end)
        reach[more < 0] = -width - count
    return out


def _read(folder: str):
    """A row per line with words, and one per document (line_no -1, n lines); words of lines that are new to the task go to its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = Writer(folder, numbered=True), {}
        for batch in batches:
            for part in parts(batch, "text"):
                lists = pc.split_pattern(pc.fill_null(part.column("text"), "").cast(pa.large_string()), "\n")
                lines, in_text = lists.flatten(), np.diff(np.asarray(lists.offsets))
                words, offsets = hashes(lines, MARKS)
                some = np.flatnonzero(np.diff(offsets))
                begins, size = offsets[some], np.diff(offsets)[some]
                line = line_hashes(words, begins).view(np.int64)
                marks = [np.c_[parities(words[a:b], c - a), simhashes(words[a:b], c - a).view(np.uint32).reshape(-1, 2)] for a, b, c in _few(begins, len(words))]
                head = np.concatenate(marks).astype(np.uint32)
                short = (words >> np.uint64(32)).astype(np.uint32)
                at = []
                for k, (h, a, n) in enumerate(zip(line.tolist(), begins.tolist(), size.tolist(), strict=True)):
                    if h not in known:
                        known[h] = writer.place(np.concatenate([head[k], short[a : a + n]]))
                    at.append(known[h])
                writer.flush()
                text = np.repeat(np.arange(len(in_text)), in_text)[some]
                first = np.r_[0, np.cumsum(in_text)][:-1]
                take = pa.array(np.r_[text, np.arange(len(in_text))])
                null = pa.nulls(len(in_text), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(take), "content": part.column("content").take(take),
                    "line_no": pa.array(np.r_[some - first[text], np.full(len(in_text), -1)]),
                    "n": pa.array(np.r_[size, in_text].astype(np.int64)),
                    **{k: pa.concat_arrays([pa.array(v, pa.int64()), null]) for k, v in (("line", line), ("place", at))},
                })
        writer.close()

    return task(run)


class Lines:
    """Lines by their SimHashes and parities, then by the edit distance; read from what `_read` has written."""

    percent = PERCENT

    def __init__(self, folder: str, rank: np.ndarray | None = None) -> None:
        self.files, self.rank = Reader(folder, np.uint32), rank

    def need(self, n, m):
        """Pairs of words that the longer line, of m words, keeps of the other one."""
        return m - 1 - 2 * (m * (100 - PERCENT) // 100)

    def heads(self, places: np.ndarray) -> np.ndarray:
        return self.files.gather(places, HEAD).view(np.uint64)

    def possible(self, differ: np.ndarray, n, m) -> np.ndarray:
        # An edit turns over two parities at most.
        return (differ[..., MARK] <= NEAR) | (differ[..., :MARK].sum(axis=-1, dtype=np.int64) <= 2 * (m * (100 - PERCENT) // 100))

    def wide(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty((len(places), WIDE), np.uint64)
        for k in range(0, len(places), 1024):
            size = sizes[k : k + 1024]
            line = np.repeat(np.arange(len(size)), size)
            bit = self.files.ragged(places[k : k + 1024], HEAD, size) % np.uint32(64 * WIDE)
            count = np.bincount(line * (64 * WIDE) + bit, minlength=len(size) * 64 * WIDE)
            out[k : k + 1024] = np.packbits((count & 1).astype(np.uint8)).view(np.uint64).reshape(-1, WIDE)
        return out

    def within(self, differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return differ <= 2 * (m * (100 - PERCENT) // 100)

    def words(self, place: int, n: int) -> np.ndarray:
        return self.files.at(place, HEAD, n)

    def surely(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Lines of one length with few other words at the same places."""
        out = np.zeros(len(a), bool)
        same = np.flatnonzero(n == m)
        total, start = np.cumsum(n[same]), 0
        while start < len(same):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _WORDS, "right")))
            some = same[start:stop]
            size = n[some]
            differ = self.files.ragged(a[some], HEAD, size) != self.files.ragged(b[some], HEAD, size)
            out[some] = np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) <= size * (100 - PERCENT) // 100
            start = stop
        return out

    def maybe(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Lines that share enough words, wherever they stand."""
        out = np.empty(len(a), bool)
        total, start = np.cumsum(n + m), 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _WORDS, "right")))
            some = slice(start, stop)
            # Pair, word and side in one integer of 31, 32 and 1 bits.
            sides = []
            for side, (places, size) in enumerate(((a[some], n[some]), (b[some], m[some]))):
                pair = np.repeat(np.arange(stop - start, dtype=np.uint64), size)
                sides.append(pair << np.uint64(33) | self.files.ragged(places, HEAD, size).astype(np.uint64) << np.uint64(1) | np.uint64(side))
            code = np.sort(np.concatenate(sides))
            edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            count, code = np.diff(np.r_[edge, len(code)]), code[edge]
            both = np.flatnonzero(code[:-1] ^ code[1:] == np.uint64(1))
            shared = np.bincount((code[both] >> np.uint64(33)).astype(np.int64), np.minimum(count[both], count[both + 1]), stop - start)
            out[some] = shared >= m[some] - m[some] * (100 - PERCENT) // 100
            start = stop
        return out

    def first(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, after_a: np.ndarray, after_b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        total, start = np.cumsum(n + m), 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _WORDS, "right")))
            stop = min(stop, start + _LINES // 2)
            some = slice(start, stop)
            places, where = np.unique(np.r_[a[some], b[some]], return_inverse=True)
            size = np.empty(len(places), np.int64)
            size[where] = np.r_[n[some], m[some]]
            line, key, _, _ = prefixes(self.files.ragged(places, HEAD, size), size, self.rank)
            # The keys before the one at which the pair meets, of either line.
            before = size[where] - 2 - np.r_[after_a[some], after_b[some]]
            at = np.repeat(np.searchsorted(line, where), before) + np.arange(int(before.sum())) - np.repeat(np.cumsum(before) - before, before)
            pair = np.repeat(np.tile(np.arange(stop - start), 2), before)
            code = mix(key[at].view(np.uint64)) + mix(pair.astype(np.uint64) + np.uint64(1))
            order = np.argsort(code)
            twice = code[order][1:] == code[order][:-1]
            out[start + pair[order][1:][twice]] = False
            start = stop
        return out

    def close(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Lines that `few_edits` shows to be linked; very long ones are left to the edit distance."""
        out = np.zeros(len(a), bool)
        order, some = np.lexsort((n, m - n)), []
        size, shifts, wide = (n + 1).tolist(), (m - n + 1 + 2 * SIDE).tolist(), 0
        for k in [*order[((n + 1) * (m - n + 1 + 2 * SIDE))[order] <= _PLACES].tolist(), None]:
            wide = 0 if k is None else max(wide, size[k])
            if some and (k is None or (len(some) + 1) * wide * shifts[k] > _PLACES):
                words = [self.files.ragged(places[some], HEAD, sizes[some]) for places, sizes in ((a, n), (b, m))]
                out[some] = few_edits(*words, n[some], m[some], m[some] * (100 - PERCENT) // 100)
                some, wide = [], 0 if k is None else size[k]
            some.append(k)
        return out

    def alike(self, a: int, n: int, b: int, m: int) -> bool:
        most = max(n, m) * (100 - PERCENT) // 100
        return edit_distance(self.words(a, n), self.words(b, m), most) <= most


def _some(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, sizes and words of some lines at a time."""
    lines = Lines(folder)
    for batch in batches:
        places, size = batch.column("place").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
        total, start = np.cumsum(size), 0
        while start < len(places):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 18), "right")))
            stop = min(stop, start + _LINES)
            words = [lines.words(p, n) for p, n in zip(places[start:stop].tolist(), size[start:stop].tolist(), strict=True)]
            yield places[start:stop], size[start:stop], np.concatenate(words)
            start = stop


def _counted(folder: str):
    """The pairs of words of a task's lines, for counting."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, size, words in _some(folder, batches):
            yield pairs_of(words, size)[1]

    return read


def _prefixes(folder: str, rank: np.ndarray, count: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for places, size, words in _some(folder, batches):
            line, key, after, before = prefixes(words, size, rank)
            yield key, places[line], size[line], after, before

    return task(lambda batches: packed(rows(batches), count))


def _links(folder: str, rank: np.ndarray, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(folder, rank)
        yield from Meeting(lines, tile, 16 * tile, lines.close).links(unpacked(batches), "key")

    return task(run)


def duplicate_lines(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, content (hash of the text), n_lines, removed (numbers of the lines to remove, from 0): one row per doc_id and text.

    `folder` is for the mapped files; every machine must have it mounted.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = mounted(folder or new_folder(spark, "lines"))
    content = F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("content")
    kinds = "doc_id long, content long, line_no long, n long, line long, place long"
    rows = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), content, "text").mapInArrow(_read(folder), kinds), "lines")
    lines = rows.filter("line_no >= 0").select("doc_id", "content", "line_no", "line", "n", "place")
    different = lines.groupBy("line").agg(F.min("place").alias("place"), F.min("n").cast("int").alias("n"), F.count("*").alias("times"))
    different = stored(different, "different")
    long = different.filter("n > 3").select("place", "n")
    total = long.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    rank = frequency.ranks(long, _counted(folder), total)
    shared, tile, count = spark.sparkContext.broadcast(rank), TILE, buckets(total)
    meet = long.mapInArrow(lambda x: _prefixes(folder, shared.value, count)(x), "bucket long, rows long, data binary")
    meet = meet.repartition("bucket").sortWithinPartitions("bucket")
    groups = components(meet.mapInArrow(lambda x: _links(folder, shared.value, tile)(x), "a long, b long"))
    # Only lines that occur again or are linked can have anything to remove.
    of = different.join(groups, different["place"] == groups["id"], "left").filter("times > 1 OR root IS NOT NULL").select("line", F.coalesce("root", "place").alias("group"))
    where = F.struct(F.col("doc_id").isNull(), "doc_id", "content", "line_no").alias("where")
    seen = lines.select("line", "doc_id", "content", "line_no").join(of, "line").select("group", where)
    # Written, so that the join meets plain rows on both sides and a group with very many lines can be split.
    first = stored(seen.groupBy("group").agg(F.min("where").alias("first")), "first")
    gone = seen.join(first, "group").filter("where <> first").groupBy("where.doc_id", "where.content")
    gone = gone.agg(F.sort_array(F.collect_set("where.line_no")).alias("removed"))
    texts = rows.filter("line_no < 0").select(F.col("doc_id").alias("id"), F.col("content").alias("c"), F.col("n").alias("n_lines")).distinct()
    out = texts.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("content")), "left")
    none = F.array().cast("array<bigint>")
    return out.select(F.col("id").alias("doc_id"), F.col("c").alias("content"), "n_lines", F.coalesce("removed", none).alias("removed"))


def deduplicate_lines(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The documents without removed lines, and without those of which no word is left that had one; all columns of the input."""
    gone = duplicate_lines(docs, folder).filter(F.size("removed") > 0).select(F.col("doc_id").alias("__doc"), F.col("content").alias("__content"), F.col("removed").alias("__removed"))
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__content"))
    rows = docs.join(gone, same, "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i.cast("long")))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    rows = rows.withColumn("__text", text).filter(F.col("__removed").isNull() | F.col("__text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return rows.select(*[F.col("__text").alias(c) if c == "text" else docs[c] for c in docs.columns])
