import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pvspark.llm import vectors
from pvspark.llm.oracle import ORACLE
from pvspark.llm.queries import QUERIES
from tests.llm.common import SF, connect, same

SCHEMA = "vec_id long, embedding array<float>, label int, v string, codes string, error string, slot long, n long, total string, _label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "v", "c", "e", 1, 2, "t", 3) for i, v, label in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """The same with plain loops over Python integers."""
    ok = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], label) for i, v, label in ok]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not whole:
        return []
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    width = len(whole[0][1]) // parts
    cut = [[v[p * width : p * width + width] for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            found = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(found)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(m[j] for m in mine) // len(mine) for j in range(width)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    of = {}
    for (_, _, label), e in zip(whole, error, strict=True):
        of[label] = of.get(label, 0) + e
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, of[label], sha) for (i, _, label), f, e in zip(whole, found, error, strict=True)), key=repr
    )


def check(spark, rows, **how):
    assert sorted(map(tuple, vectors.encode(table(spark, rows), **how).collect()), key=repr) == brute(rows, **how)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 5), st.integers(1, 30))
def test_balls_equal_looking_at_all(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (200, width))
    old, new = (rng.integers(-spread, spread + 1, (entries, width)) for _ in range(2))
    was, _ = vectors.nearest_of_all(x, old)
    best, least, _ = vectors.nearest_by_balls(x, new, was)
    want, distance = vectors.nearest_of_all(x, new)
    assert best.tolist() == want.tolist() and least.tolist() == distance.tolist()


def test_cores_and_rings_spare_distances():
    rng = np.random.default_rng(3)
    entries = rng.integers(-500, 500, (64, 4))
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-30, 31, (5000, 4))
    was, _ = vectors.nearest_of_all(x, entries)
    best, _, looked = vectors.nearest_by_balls(x, entries + rng.integers(-3, 4, entries.shape), was)
    assert looked < 0.1 * 64 * len(x)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=32).astype(np.float32).tolist(), int(i) % 3 if i % 5 else None) for i in range(90)]
    rows += [rows[0], rows[1], (None, rows[2][1], 1), (0, rows[7][1], 1)]
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] + [0.0] * 31, 1), (204, [None] + [0.0] * 31, 1), (205, [0.0] * 16, 1), (206, [0.0] * 31, 1)]
    check(spark, rows)


def test_ties_and_few_vectors(spark):
    check(spark, [(i, [float(i % 4)] * 16, 0) for i in range(80)])
    check(spark, [(5, [0.5] * 16, None), (3, [-0.5] * 16, None)])
    check(spark, [(i, [float(i % 7 - 3), -0.001] * 16, i) for i in range(50)], entries=5, rounds=3)


def test_empty(spark):
    out = vectors.encode(table(spark, []))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.isEmpty()


def test_numbers_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError, match="64 bits"):
        vectors.encode(table(spark, [(1, [1e30] * 16, 0), (2, [0.0] * 16, 0)]))


def test_whole_table(spark):
    same(QUERIES["op12_vector_codes"](spark, SF), connect(), ORACLE["op12_vector_codes"])
