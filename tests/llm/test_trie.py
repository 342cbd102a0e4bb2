import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pvspark.llm import eliasfano, trie
from tests.llm.common import SF, documents, edge_rows, words


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 7), (1000, 1 << 60), (1000, 1200), (3000, 500), (777, 1 << 62), (4000, 1 << 33)])
def test_sequences_look_up_what_they_hold(n, universe, tmp_path):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    eliasfano.write(f"{tmp_path}/f", eliasfano.named("v", eliasfano.EliasFano.build(values, universe)) | {"other": np.arange(3, dtype=np.uint8)})
    arrays = eliasfano.read(f"{tmp_path}/f")
    packed = eliasfano.sequence(arrays, "v")
    assert arrays["other"].tolist() == [0, 1, 2] and (packed.get(np.arange(n)) == values).all()
    asked = np.r_[values, rng.integers(0, universe, 300), 0, universe - 1]
    assert (packed.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((packed.find(asked) >= 0) == np.isin(asked, values)).all()


def brute(texts, held, order):
    """Per text: tokens, known, training tokens, base score and score, by counting in dictionaries."""
    count, after = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    tokens = [[*words(t), "\n"] for t in texts]
    for w, out in zip(tokens, held, strict=True):
        if not out:
            for n in range(1, order + 1):
                count[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for n in range(2, order + 1):
        after[n].update(g[:-1] for g in count[n])
    total, kinds = sum(count[1].values()), len(count[1])

    def p(w, k, n):
        if n == 1:
            return (count[1][w[k],] + 1) / (total + kinds + 1)
        context, low = tuple(w[max(0, k - n + 1) : k]), p(w, k, n - 1)
        if len(context) < n - 1 or not after[n][context]:
            return low
        c = count[n - 1][context]
        return max(count[n][(*context, w[k])] - trie.DISCOUNT, 0) / c + trie.DISCOUNT * after[n][context] / c * low

    for w in tokens:
        base = sum(math.log10((count[1][x,] + 1) / (total + kinds + 1)) for x in w)
        yield len(w), sum(count[1][x,] > 0 for x in w), total, base, sum(math.log10(p(w, k, order)) for k in range(len(w)))


def check(rows, texts, held, order):
    step = trie.grid(rows[0].train_tokens)
    for r, out, (n, known, total, base, score) in zip(rows, held, brute(texts, held, order), strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - score) <= n * step / 2 * max(1, order - 1) + 1e-6  # half a step of the grid a level


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_counting_in_dictionaries(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = sorted(trie.language_model(docs, order).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    check(rows, texts, held, order)
    out = [r for r in rows if r.held_out]
    if order > 1:
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_a_hot_context_over_many_shards(spark):
    """A third of all tokens follow one word: its children lie in many shards."""
    texts = [" ".join(f"hot x{i * 7 + k}" for k in range(40)) + f" y{i}" for i in range(60)]
    docs = documents(spark, list(enumerate(texts)))
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(60)]
    rows = trie.held_out(docs)
    metas = trie.train(rows.filter("NOT held_out"), 2, shards=16)
    wide = [c for s in metas[1]["shards"] for c, _ in s["edges"]]
    assert max(Counter(wide).values()) > 6 and max(s["n"] for s in metas[1]["shards"]) < sum(s["n"] for s in metas[1]["shards"]) / 4
    check(sorted(trie.score(rows, metas).collect(), key=lambda r: r.doc_id), texts, held, 2)


def test_odd_texts(spark):
    docs = documents(spark, edge_rows())
    got = trie.language_model(docs).collect()
    assert len(got) == docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1} and all(math.isfinite(r.score) for r in got)
    twice = [r.score for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert trie.language_model(docs.filter("false")).count() == 0


def test_without_training_texts(spark):
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = trie.language_model(documents(spark, [(held, "some words")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
