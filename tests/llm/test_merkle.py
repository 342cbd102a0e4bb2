import hashlib
import zlib

import numpy as np
import pytest

from pvspark.llm import merkle, sha
from pvspark.llm.oracle import ORACLE
from pvspark.llm.queries import QUERIES
from tests.llm.common import SF, connect, documents, edge_rows, same


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    values = [row["doc_id"], row["source"], row["lang"], n, row["text"]]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    """Per level the sibling's text before and after the node."""
    for nodes in tree[:-1]:
        run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        yield "".join(run[: i % 2]), "".join(run[i % 2 + 1 :])
        i //= 2


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    sorted_rows = {
        k: sorted((r for r in rows if r["lang"] == k), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in langs
    }
    trees = {k: levels([leaf(r) for r in sorted_rows[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, row in enumerate(sorted_rows[lang]):
            steps = [*path(trees[lang], i), *path(top, at)]
            doc = row["doc_id"]
            h = leaf(row, int(doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0))
            for before, after in steps:
                h = H(before + h + after)
            root = top[-1][0]
            out.append((doc, leaf(row), trees[lang][-1][0], root, H("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


def check(df):
    rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, merkle.verify(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("blocks", [0, 1, 2, 3])
def test_sha_equals_the_library(blocks):
    data = np.random.default_rng(blocks).integers(0, 256, (5, 64 * blocks), dtype=np.uint8)
    states = sha.start(5)
    for k in range(blocks):
        states = sha.absorb(states, data[:, 64 * k : 64 * k + 64])
    assert [d.tobytes() for d in sha.finish(states, blocks)] == [hashlib.sha256(d.tobytes()).digest() for d in data]


def test_a_kept_state_resumes_as_the_library_does():
    first, second = (np.frombuffer(H(t).encode(), np.uint8).reshape(1, 64) for t in "ab")
    kept = sha.absorb(sha.start(1), first)
    whole = sha.finish(sha.absorb(kept.copy(), second), 2)
    assert sha.as_text(whole).tobytes().decode() == H(H("a") + H("b"))


def test_edge_rows(spark):
    check(documents(spark, [*edge_rows(), (20, "x", "", "s"), (21, "y", "日本", None), (22, "z", "zz", "s"), (23, None, "zz", None)]))


@pytest.mark.parametrize("n", [1, 3, 1025, 2500])
def test_trees_of_any_size(spark, n):
    check(documents(spark, [(i * 7 % 10_007, f"text {i % 5}", "en" if i % 3 else "fr") for i in range(n)]))


def test_empty(spark):
    out = merkle.verify(documents(spark, []))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.isEmpty()


def test_parents_keep_the_state_before_their_second_child(spark):
    tree = merkle.manifest(merkle.leaves(documents(spark, [(i, f"t{i}") for i in range(5)])))
    block = tree.rounds[0].collect()[0]
    nodes = [block["nodes"][k : k + 32] for k in range(0, len(block["nodes"]), 32)]
    assert len(nodes) == 5 + 3 + 2 + 1 and len(block["states"]) == 32 * (3 + 2 + 1)
    kept = np.frombuffer(bytes(block["states"][:32]), ">u4").astype(np.uint32).reshape(1, 8)
    beside = sha.as_text(np.frombuffer(bytes(nodes[1]), np.uint8).reshape(1, 32))
    assert sha.finish(sha.absorb(kept, beside), 2).tobytes() == bytes(nodes[5])


def test_whole_table(spark):
    same(QUERIES["op11_merkle_manifest"](spark, SF), connect(), ORACLE["op11_merkle_manifest"])
    check(spark.read.parquet(f"{SF}/documents.parquet"))
