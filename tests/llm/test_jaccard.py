import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pvspark.llm import jaccard, oracle
from pvspark.llm.graph import Groups, components
from tests.llm.common import LONG, PROSE, SF, connect, documents, edge_rows, same, words


def brute(rows):
    """Per row: size of the set, smallest id reached."""
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    where, common = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for found in where.values():
        common.update(combinations(found, 2))
    groups = Groups()
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    least = {}
    for k, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[groups.root(k)] = min(doc, least.get(groups.root(k), doc))
    return sorted((repr(doc), len(sets[k]), doc if not sets[k] else least.get(groups.root(k))) for k, (doc, *_) in enumerate(rows))


def found(df):
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def family(seed, copies, n=70, edits=3):
    """Texts of n words with a few changed words each, so that some pairs lie on either side of the limit."""
    rng = random.Random(str(seed))
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        yield " ".join(w[rng.randrange(4) : n - rng.randrange(4)])


def test_equals_sql(spark):
    same(jaccard.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")), connect(), oracle.JACCARD)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_on_both_sides_of_the_limit(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng, rows = random.Random(seed), []
    passage = " ".join(f"shared{k}" for k in range(40))
    for k, copies in enumerate((60, 25, 9, 4, 2, 2, 1, 1)):
        rows += [(None, t) for t in family((seed, k), copies, rng.choice((8, 30, 70, 200)), rng.choice((1, 3, 6)))]
    rows += [(None, f"{t} {passage}") for k in range(30) for t in family((seed, 100 + k), 1)]
    rows = [(3 * k + 5, t) for k, (_, t) in enumerate(rng.sample(rows, len(rows)))]
    assert found(jaccard.near_duplicates(documents(spark, rows).repartition(5))) == brute(rows)


def test_exactly_at_the_limit(spark):
    # n shingles of which k are common: 100 k >= 75 (2 n - k)
    tail = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = []
    for k, (common, own) in enumerate(((30, 5), (30, 6), (60, 10), (61, 10), (59, 10))):
        head = " ".join(f"c{k}_{i}" for i in range(common + 4))
        rows += [(10 * k + 1, f"{head} {tail(f'a{k}_', own)}"), (10 * k + 2, f"{head} {tail(f'b{k}_', own)}")]
    got = found(jaccard.near_duplicates(documents(spark, rows)))
    assert got == brute(rows) and len({x[2] for x in got}) == 7


def test_odd_texts(spark):
    rows = [*edge_rows(), (50, "two words"), (51, "Two\tWords "), (52, "words two"), (None, "no id at all here"), (53, "one two three four five"), (54, "one two three four five")]
    docs = documents(spark, rows)
    assert found(jaccard.near_duplicates(docs)) == brute(rows)
    assert jaccard.near_duplicates(docs.filter("false")).count() == 0
    assert jaccard.near_duplicates(docs.filter("doc_id IN (3, 4, 5)")).count() == 3


def test_one_of_each_group_stays(spark):
    rows = [(5, PROSE), (5, PROSE), (4, f"{PROSE} more"), (9, LONG), (8, LONG + " end"), (None, PROSE + " x"), (None, "alone without id, but with words"), (7, None), (7, None), (6, "")]
    docs = documents(spark, rows)
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["4", "6", "7", "7", "8", "None"]
    twice = documents(spark, [(1, PROSE), (1, PROSE), (2, LONG)])
    assert sorted(r.doc_id for r in jaccard.deduplicate(twice).collect()) == [1, 2]
    assert jaccard.deduplicate(docs.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(str(seed))
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    edges += [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000 + k) for k in range(60)] + [(None, 1), (7, 7)]
    groups = Groups()
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    ids = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, groups.root(x)) for x in ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_named_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("component_id", F.lit("x")).withColumn("__x", F.lit(1))
    assert jaccard.deduplicate(docs).columns == docs.columns
