import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.llm import classifier
from tests.llm.common import SF, documents, edge_rows


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, quality int, n long, host string")


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    train, test = known.filter("doc_id % 2 = 0"), known.filter("doc_id % 2 = 1")
    got = classifier.classify(docs, train).join(test, "doc_id").select("kept", "quality").collect()
    assert len(got) > 100 and np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    bad = [r.kept for r in got if r.quality == 0]
    assert bad and np.mean(bad) < 0.1


def test_posteriors_equal_the_formulas(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", f"p{q}", float(np.clip(rng.normal(0.3 + 0.05 * h + 0.02 * q, 0.2), 0, 1))) for h in range(8) for q in range(3) for _ in range(int(rng.integers(1, 40)))]
    got = {(r.host, r.path): r for r in classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}

    def strength(n, mean, centre):
        total = max(1e-9, (np.sum(n * (mean - centre) ** 2) - np.sum(centre * (1 - centre))) / np.sum(n))
        return min(1e6, max(1.0, np.sum(n * centre * (1 - centre)) / np.sum(n) / total - 1))

    values = lambda keep: np.array([p for h, q, p in rows if keep(h, q)])
    everything = values(lambda h, q: True).mean()
    hosts = sorted({h for h, _, _ in rows})
    own = [values(lambda h, q, x=x: h == x) for x in hosts]
    k = strength(np.array([len(x) for x in own]), np.array([x.mean() for x in own]), np.full(len(own), everything))
    of_host = {h: (k * everything + x.sum()) / (k + len(x)) for h, x in zip(hosts, own, strict=True)}
    paths = sorted({(h, q) for h, q, _ in rows})
    own = [values(lambda h, q, x=x: (h, q) == x) for x in paths]
    k = strength(np.array([len(x) for x in own]), np.array([x.mean() for x in own]), np.array([of_host[h] for h, _ in paths]))
    for (h, q), x in zip(paths, own, strict=True):
        assert got[h, q].path_docs == len(x) and got[h, q].host_mean == pytest.approx(of_host[h])
        assert got[h, q].path_mean == pytest.approx((k * of_host[h] + x.sum()) / (k + len(x)))


def test_a_sparse_path_shrinks_to_its_host_and_a_large_one_does_not(spark):
    rows = [("good", "a", 0.95)] * 200 + [("bad", "a", 0.1)] * 200 + [("bad", "new", 0.95)] + [("bad", "large", 0.9)] * 200
    rows += [(f"h{k}", "a", 0.2 + 0.1 * (k % 6)) for k in range(12) for _ in range(30)]
    got = {(r.host, r.path): r for r in classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["bad", "new"].path_mean < 0.8 and got["bad", "large"].path_mean > 0.85 and got["good", "a"].path_mean > 0.9


def test_bounded_sample_and_odd_input(spark):
    rows = [(k, ("fine words make a fine text of many words " * 9 + str(k)) if k % 2 else "$$$ ### !!! " * 30) for k in range(100, 140)]
    docs = documents(spark, [*edge_rows(), *rows])
    known = labels(spark, [(k, k % 2) for k in range(100, 140)] + [(None, 1), (100, None), (9999, 1), (101, 1), (101, 1)])
    out = classifier.classify(docs, known, max_labelled=20)
    assert out.count() == docs.count() and out.filter("kept IS NULL OR isnan(posterior)").count() == 0
    judged = {r.doc_id: r.kept for r in out.filter("doc_id >= 100").collect()}
    assert all(judged[k] == bool(k % 2) for k in judged)
    # without labels there is no opinion: everything stays
    assert classifier.classify(docs, known.filter("false")).filter("NOT kept").count() == 0
    assert classifier.classify(docs, known.filter("quality = 1")).filter("NOT kept").count() == 0
    assert classifier.classify(docs.filter(F.lit(False)), known).count() == 0
