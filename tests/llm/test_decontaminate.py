import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pvspark.llm import decontaminate
from pvspark.llm.words import MARKS, hashes
from tests.llm.common import SF, documents, edge_rows

ITEM = "which of the seven ancient wonders stood in the harbour of rhodes until an earthquake broke it at the knees in the year 226"


def items(spark, *texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "item_id long, text string, doc_id string, n long")


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(9)}" for _ in range(n))


def test_alignment_equals_the_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (1 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        assert decontaminate.align(a, b) == table.max()


def test_copies_edited_copies_and_clean_texts(spark):
    w = ITEM.split()
    changed = [x if k % 7 else "changed" for k, x in enumerate(w, 1)]
    added = [y for k, x in enumerate(w) for y in ((x, "well") if k % 6 == 5 else (x,))]
    rows = [
        (1, f"{prose(1)} {ITEM} {prose(2)}"), (2, ITEM.upper().replace(" ", ",\n")), (3, f"{prose(3)} {' '.join(changed)}"), (4, f"{' '.join(added)} {prose(4)}"),
        (5, f"{prose(5)} {' '.join(w[:12] + w[14:])}"), (6, prose(6)), (7, f"{prose(7)} {' '.join(w[:5])} {prose(8)}"), (8, " ".join(reversed(w))),
    ]
    got = {r.doc_id: r for r in decontaminate.contaminated(documents(spark, rows), items(spark, ITEM, prose(99, 20))).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and {r.item_id for r in got.values()} == {0}
    assert got[1].score == got[2].score == 1 and all(0.5 <= got[k].score < 1 for k in (3, 4, 5))


def test_an_item_in_very_many_documents_is_found_in_all(spark):
    rows = [(k, f"{prose(k, 20)} {ITEM} {prose(1000 + k, 20)}" if k % 2 else prose(k, 40)) for k in range(200)]
    got = decontaminate.contaminated(documents(spark, rows), items(spark, ITEM)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 200, 2))


def test_an_edited_copy_in_very_many_documents_is_found_in_all(spark):
    edited = " ".join(x if k % 7 else "changed" for k, x in enumerate(ITEM.split(), 1))
    cut = " ".join(ITEM.split()[:13])
    rows = [(k, f"{prose(k, 10)} {edited if k % 2 else cut} {prose(5000 + k, 10)}") for k in range(1000)]
    got = decontaminate.contaminated(documents(spark, rows), items(spark, ITEM)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000)) and all(r.seeds for r in got)


def test_evenly_edited_copies_equal_brute_force_alignment(spark):
    rng = random.Random(8)
    texts = [prose(-k, n) for k, n in enumerate((4, 5, 7, 15, 16, 23, 38, 63), 1)] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (9, 30)]
    docs = []
    for t in texts:
        w = t.split()
        for step in (2, 3, 4, 5):
            docs.append(" ".join(x if k % step else "changed" for k, x in enumerate(w, 1)))
            docs.append(" ".join(y for k, x in enumerate(w, 1) for y in ((x, "well") if k % step == 0 else (x,))))
            docs.append(" ".join(x for k, x in enumerate(w, 1) if k % step))
        docs.append(" ".join(w[len(w) // 3 :]))
    docs = [f"{prose(k, 30)} {d} {prose(3000 + k, 30)} {docs[k - 7][:90]}" for k, d in enumerate(docs)]
    split = lambda t: hashes(pa.array([t]), MARKS)[0]
    want = {}
    for i, t in enumerate(texts):
        for d, text in enumerate(docs):
            score = decontaminate.align(split(t), split(text)) / len(t.split())
            if score >= 0.5:
                want[d, i] = score
    got = decontaminate.contaminated(documents(spark, list(enumerate(docs))), items(spark, *texts)).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and sum(x < 0.7 for x in want.values()) > 20


def test_common_phrases_are_no_seeds(spark):
    phrase = "as we all know very well"
    rows = [(k, f"{prose(k)} {phrase} {prose(500 + k)}") for k in range(120)]
    docs = documents(spark, rows)
    block = next(decontaminate._blocks(items(spark, f"{prose(-1, 30)} {phrase} {prose(-2, 30)}")))
    kept = decontaminate.seeds(docs, block)
    assert len(block.grams[4][0]) - len(kept.grams[4][0]) == 3
    assert decontaminate.contaminated(docs, items(spark, f"{prose(-1, 30)} {phrase} {prose(-2, 30)}")).count() == 0


def test_planted_passages_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    texts = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts if t in norm(r.text)}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and want <= set(got) and all(got[k] == 1 for k in want)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    kept = sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 2500)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == kept


def test_odd_input(spark):
    docs = documents(spark, [*edge_rows(), (40, f"{prose(1)} {ITEM}"), (40, f"{prose(1)} {ITEM}"), (None, ITEM), (41, "two words")])
    bench = items(spark, None, "", "two words", ITEM, " , ")
    bench = bench.union(bench).union(items(spark, *[ITEM] * 2).withColumn("item_id", F.lit(None).cast("long")))
    got = sorted(((r.doc_id or -1, -1 if r.item_id is None else r.item_id) for r in decontaminate.contaminated(docs, bench).collect()))
    assert got == [(-1, -1), (-1, 3), (40, -1), (40, -1), (40, 3), (40, 3), (41, 2)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.contaminated(docs.filter("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0 and decontaminate.decontaminate(docs, bench.filter("false")).count() == docs.count()
