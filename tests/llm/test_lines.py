import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pvspark.llm import lines, meeting
from pvspark.llm.graph import Groups
from pvspark.llm.mapped import Writer
from pvspark.llm.meeting import Meeting
from pvspark.llm.words import MARKS, hashes
from tests.llm.common import SF, documents, edge_rows


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Per (doc_id, text): numbers of the lines to remove. All pairs of different lines are compared."""
    seen = defaultdict(list)
    for doc, content, text in {tuple(r) for r in rows}:
        for k, line in enumerate((text or "").split("\n")):
            words = hashes(pa.array([line]), MARKS)[0]
            if len(words):
                seen[tuple(words.tolist())].append((doc is None, doc or 0, content, k))
    kinds = list(seen)
    groups = Groups()
    size = np.array([len(k) for k in kinds])
    bags = [Counter(k) for k in kinds]
    for i in range(len(kinds)):
        for j in (np.flatnonzero(np.abs(size[i + 1 :] - size[i]) <= np.maximum(size[i + 1 :], size[i]) // 5) + i + 1).tolist():
            a, b = kinds[i], kinds[j]
            most = max(len(a), len(b)) // 5
            if sum((bags[i] & bags[j]).values()) < max(len(a), len(b)) - most:
                continue  # words that both hold are what stays
            while a and b and a[0] == b[0] and len(a) > 1000:  # the very long line
                a, b = a[1000:] if a[:1000] == b[:1000] else a[1:], b[1000:] if a[:1000] == b[:1000] else b[1:]
            if table_distance(a, b) <= most:
                groups.join(i, j)
    of = defaultdict(list)
    for i, k in enumerate(kinds):
        of[groups.root(i)] += seen[k]
    gone = defaultdict(list)
    for found in of.values():
        for none, doc, content, k in sorted(found)[1:]:
            gone[None if none else doc, content].append(k)
    return gone


def check(docs):
    got = {(r.doc_id, r.content): r.removed for r in lines.duplicate_lines(docs).collect()}
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()
    gone = brute(rows)
    assert got == {(d, c): sorted(gone[d, c]) for d, c, _ in rows}
    return got


def test_equals_brute_force(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet").repartition(4))
    assert sum(map(len, got.values())) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_lines(spark, seed, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 8)
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        base = [f"word{rng.randrange(3000)}" for _ in range(rng.choice((4, 15, 60, 300)))]
        for _ in range(rng.choice((2, 5, 30))):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(3000)}"
            rows.append((len(rows) % 40, " ".join(w) + rng.choice(("", ".", "!"))))
    texts = defaultdict(list)
    for doc, line in rows:
        texts[doc].append(line)
    docs = documents(spark, [(d, "\n".join(x)) for d, x in texts.items()])
    got = check(docs.repartition(3))
    exact = len(rows) - len({tuple(hashes(pa.array([x]), MARKS)[0].tolist()) for _, x in rows})
    assert sum(map(len, got.values())) > exact


def test_every_pair_within_the_edit_distance_is_found(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 8)
    rng = random.Random(4)
    rows = []
    for n in [*range(1, 13), 20, 27, 40, 80, 250]:
        for pool in (2000, 6):
            base = [f"v{rng.randrange(pool)}x{n}" for _ in range(n)]
            rows.append(base)
            for edits in {1, n // 10, n // 5, n // 5 + 1}:
                for kind in range(3):
                    w = list(base)
                    for k in range(edits):  # evenly, so that no long run is left
                        at = min(len(w) - 1, k * n // edits + n // edits // 2)
                        w[at : at + 1] = [[f"e{rng.randrange(9999)}"], [w[at], f"e{rng.randrange(9999)}"], []][kind] if w else []
                    rows.append(w)
    words = [tuple(hashes(pa.array([" ".join(w)]), MARKS)[0].tolist()) for w in rows]
    groups = Groups()
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            most = max(len(a), len(b)) // 5
            if a and b and abs(len(a) - len(b)) <= most and table_distance(a, b) <= most:
                groups.join(j, i)
    want = sorted(i for i in range(len(words)) if words[i] and groups.root(i) != i)
    docs = documents(spark, [(k, " ".join(w)) for k, w in enumerate(rows)]).repartition(3)
    got = lines.duplicate_lines(docs)
    assert sorted(r.doc_id for r in got.filter(F.size("removed") > 0).collect()) == want


def test_edit_distance_equals_the_table():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 90)), rng.integers(0, 5, rng.integers(1, 90))
        if rng.random() < 0.7:
            b = a.copy()
            b[rng.integers(0, len(b), 3)] = 9
            b = np.delete(b, rng.integers(0, len(b))) if len(b) > 1 else b
        want = table_distance(a.tolist(), b.tolist())
        assert lines.edit_distance(a, b, 200) == want
        for most in (0, 3, 10):
            assert (lines.edit_distance(a, b, most) <= most) == (want <= most)


def near_copies(rng, count, most=90):
    """Pairs of lines, the shorter one first, some edits apart."""
    for _ in range(count):
        a = rng.integers(0, rng.choice((4, 1 << 32)), rng.integers(1, most)).astype(np.uint32)
        b = a.tolist()
        for _ in range(rng.integers(0, max(2, len(a) // 3))):
            at = int(rng.integers(0, len(b))) if b else 0
            b[at : at + 1] = [[7], [*b[at : at + 1], 8], []][rng.integers(0, 3)]
        yield sorted((a, np.array(b, np.uint32)), key=len)


def test_few_edits_links_no_pair_beyond_the_edit_distance():
    rng = np.random.default_rng(6)
    pairs = list(near_copies(rng, 400))
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    most = np.where(np.arange(400) % 2, m // 5, rng.integers(0, 12, 400))
    got = lines.few_edits(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), n, m, most)
    want = np.array([table_distance(a.tolist(), b.tolist()) <= k for (a, b), k in zip(pairs, most.tolist(), strict=True)])
    assert not (got & ~want).any() and 50 < want.sum() < 350
    assert got.sum() > 0.95 * want.sum()  # the rest takes the edit distance


@pytest.mark.parametrize("count", [40, 400])  # below and above the rows of a tile
def test_few_near_copies_are_looked_at_one_by_one(tmp_path, monkeypatch, count):
    rng, looked = np.random.default_rng(7), []
    writer, texts, places = Writer(str(tmp_path), numbered=True), [], []
    bases = [rng.integers(0, 1 << 32, 60) for _ in range(count // 4)]
    for k in range(count):
        words = np.delete(bases[k % len(bases)], rng.integers(0, 60, k % 3 + 1)).astype(np.uint32)
        words[rng.integers(0, len(words), 2)] = rng.integers(0, 1 << 32, 2)
        texts.append(words)
        begins = np.zeros(1, np.int64)
        wide = words.astype(np.uint64) << np.uint64(32)
        head = np.concatenate([lines.parities(wide, begins)[0], lines.simhashes(wide, begins).view(np.uint32)])
        places.append(writer.place(np.concatenate([head, words])))
    writer.close()
    size = np.array([len(t) for t in texts])
    order = np.lexsort((places, size))
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array(np.zeros(count, np.int64)), "place": pa.array(np.array(places)[order]), "n": pa.array(size[order].astype(np.int32)),
        "after": pa.array(size[order].astype(np.int32) - 2), "before": pa.array(np.full(count, meeting.NONE)),
        "bucket": pa.array(np.zeros(count, np.int64)),
    })
    plain = lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda *x: looked.append(1) or plain(*x))
    monkeypatch.setattr(lines, "unpacked", lambda batches: batches)
    groups, number = Groups(), {p: k for k, p in enumerate(places)}
    rank = np.zeros(16, np.uint8)
    for found in lines._links(str(tmp_path), rank, 64)(iter([batch])):
        for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True):
            groups.join(number[a], number[b])
    # `first` may leave a small key's pairs to a key before it.
    alike = [(a, b) for a in range(count) for b in range(a % len(bases), a, len(bases)) if plain(texts[a], texts[b], 12) <= max(size[a], size[b]) // 5]
    assert all(groups.root(k) % len(bases) == k % len(bases) for k in range(count))
    if count > 64:
        assert alike and all(groups.root(a) == groups.root(b) for a, b in alike)
    assert len(looked) <= len(alike) // 20


def test_unpacked_rows_are_those_that_share_a_key():
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 300, 400) << (meeting.BITS - 9), rng.integers(0, 50, 400), rng.integers(4, 9, 400), rng.integers(0, 5, 400), rng.integers(0, 9, 400)]
    halves = [[x[:150] for x in rows], [x[150:] for x in rows]]
    packs = [b for half in halves for b in meeting.packed(iter([half]), 3)]
    whole = pa.Table.from_batches(packs).sort_by("bucket")
    got = [tuple(r) for b in meeting.unpacked(iter(whole.to_batches())) for r in zip(*(b.column(k).to_pylist() for k in ("key", "place", "n", "after", "before")), strict=True)]
    many = Counter(rows[0].tolist())
    want = [r for r in zip(*(x.tolist() for x in rows), strict=True) if many[r[0]] > 1]
    assert sorted(got) == sorted(want) and [(r[0], r[2], r[1]) for r in got] == sorted((r[0], r[2], r[1]) for r in want)


def test_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    size = np.r_[rng.integers(1, 60, 50), [254, 255, 256, 700, 1, 2000]]
    words = rng.integers(0, 1 << 62, size.sum()).astype(np.uint64) * np.uint64(5)
    begins = np.r_[0, np.cumsum(size)[:-1]]
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    want = [np.packbits(2 * bits[b : b + n].sum(0, dtype=int) > n).view(np.uint64)[0] for b, n in zip(begins, size, strict=True)]
    assert lines.simhashes(words, begins).tolist() == want


def test_first_occurrence_stays_and_the_rest_is_joined_again(spark):
    rows = [(3, "Same line here.\nown three"), (1, "intro one\nsame LINE here!\n\n\nend one"), (2, "same line here"), (None, "same   line: here\nno id"), (1, "intro one\nsame LINE here!\n\n\nend one")]
    docs = documents(spark, rows)
    out = lines.deduplicate_lines(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    kept = rows[1][1]
    assert got == [("1", kept), ("1", kept), ("3", "own three"), ("None", "no id")]


def test_odd_texts(spark):
    docs = documents(spark, edge_rows())
    check(docs)
    left = lines.deduplicate_lines(docs)
    assert {r.doc_id for r in left.collect()} >= {1, 3, 4, 5, 6, 7, 9, 10}
    assert lines.duplicate_lines(docs.filter("false")).count() == 0 and lines.deduplicate_lines(docs.filter("false")).count() == 0
    assert lines.duplicate_lines(docs.filter("doc_id IN (3, 4, 5)")).count() == 3


class Counting(lines.Lines):
    """Sets of one size in groups of alike ones; counts how many pairs are looked at closely. None of them meet first at the key."""

    def __init__(self, group):
        self.group, self.looked = group, 0

    def need(self, n, m):
        return np.zeros(np.broadcast(n, m).shape, np.int64)

    def heads(self, places):
        return np.zeros((len(places), lines.MARK + 1), np.uint64)

    def wide(self, places, sizes):
        return np.zeros((len(places), 1), np.uint64)

    def surely(self, a, b, n, m):
        return np.zeros(len(a), bool)

    def maybe(self, a, b, n, m):
        self.looked += len(a)
        return self.group[a] == self.group[b]

    def first(self, a, b, n, m, after_a, after_b):
        self.looked += len(a)
        return np.zeros(len(a), bool)

    def alike(self, a, n, b, m):
        self.looked += 1
        return bool(self.group[a] == self.group[b])


def test_a_key_of_many_alike_lines_takes_no_look_at_all_pairs():
    count = 2000
    group = np.r_[np.zeros(count - 3, np.int64), [1, 1, 2]]
    kind = Counting(np.random.default_rng(5).permutation(group))
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array(np.zeros(count, np.int64)), "place": pa.array(np.arange(count)),
        "n": pa.array(np.full(count, 50, np.int32)), "after": pa.array(np.full(count, 50, np.int32)),
    })
    groups = Groups()
    for found in Meeting(kind, 64, 1024).links(iter([batch]), "key"):
        for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True):
            groups.join(a, b)
    roots = groups.roots(list(range(count)))
    assert all(len(set(roots[kind.group == g].tolist())) == 1 for g in range(3)) and len(set(roots.tolist())) == 3
    assert kind.looked < 12 * count


def test_maybe_counts_the_words_that_both_lines_hold(tmp_path):
    rng = np.random.default_rng(3)
    writer, texts, places = Writer(str(tmp_path), numbered=True), [], []
    for _ in range(60):
        old = texts[rng.integers(len(texts))] if texts and rng.random() < 0.8 else rng.integers(0, 12, rng.integers(4, 40)).astype(np.uint32)
        new = old.copy()
        new[rng.integers(0, len(new), rng.integers(0, 9))] = rng.integers(0, 1 << 32, dtype=np.uint32)
        texts.append(rng.permutation(new))
        places.append(writer.place(np.concatenate([np.zeros(lines.HEAD, np.uint32), texts[-1]])))
    writer.close()
    size = np.array([len(t) for t in texts])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    a, b = a[size[a] <= size[b]], b[size[a] <= size[b]]
    kind = lines.Lines(str(tmp_path))
    got = kind.maybe(np.array(places)[a], np.array(places)[b], size[a], size[b])
    bags = [Counter(t.tolist()) for t in texts]
    want = [(bags[i] & bags[j]).total() >= size[j] - size[j] // 5 for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    differ = np.bitwise_count(kind.wide(np.array(places)[a], size[a]) ^ kind.wide(np.array(places)[b], size[b])).sum(axis=1, dtype=np.int64)
    assert kind.within(differ, size[a], size[b])[got].all() and not kind.within(differ, size[a], size[b]).all()


def test_packing_holds_little_more_than_the_rows(monkeypatch):
    count = 100_000
    monkeypatch.setattr(meeting, "HELD", count)

    def rows():
        rng = np.random.default_rng(1)
        for _ in range(20):
            yield tuple(rng.integers(0, 1 << meeting.BITS, count // 20) for _ in range(5))

    some = list(meeting.packed(iter([tuple(np.arange(5) for _ in range(5))]), 3))
    assert some[0].num_rows
    tracemalloc.start()
    total = sum(sum(b.column("rows").to_pylist()) for b in meeting.packed(rows(), 1000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == count and most < 100 * count  # a row has 32 bytes
