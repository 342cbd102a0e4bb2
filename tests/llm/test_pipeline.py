import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pvspark.llm import decontaminate, lines
from pvspark.llm.queries import vocabulary
from tests.llm import test_jaccard, test_lines, test_quality
from tests.llm.common import SF, documents, edge_rows
from tests.llm.test_tokens import check_packing

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns on the smallest tables, after its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = docs.cache()
        out.append((name, docs))
    return out


def rows(stages, k):
    return {r.doc_id: r for r in stages[k][1].collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert all(df.columns == stages[0][1].columns and df.dtypes == stages[0][1].dtypes for _, df in stages[1:5])


def test_quality_keeps_what_passes(stages):
    before, after = rows(stages, 0), rows(stages, 1)
    good = {d for d, r in before.items() if (m := test_quality.brute(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert set(after) == good and all(after[d].text == before[d].text for d in good)  # no line is frequent here


def test_lines_that_repeat_go(stages):
    before, after = rows(stages, 1), rows(stages, 2)
    gone = test_lines.brute([(d, 0, r.text) for d, r in before.items()])
    for d, r in before.items():
        left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[d, 0])
        if d in after:
            assert after[d].text == left and after[d].n_chars == len(left)
        else:
            assert not any(len(lines.hashes(pa.array([x]), lines.MARKS)[0]) for x in left.split("\n"))


def test_one_of_each_group_stays(stages):
    before, after = rows(stages, 2), rows(stages, 3)
    want = {c for _, n, c in test_jaccard.brute([(d, r.text) for d, r in before.items()])}
    assert set(after) == want


def test_contaminated_documents_go(spark, stages):
    before, after = rows(stages, 3), rows(stages, 4)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = lambda t: lines.hashes(pa.array([t]), lines.MARKS)[0]
    items = [words(r.text) for r in bench]
    bad = {d for d, r in before.items() if any(decontaminate.align(i, words(r.text)) >= 0.5 * len(i) for i in items)}
    assert bad and set(after) == set(before) - bad


def test_all_that_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    from pvspark.llm import packing

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    texts = {d: r.text for d, r in rows(stages, 4).items()}
    plain = lambda x, end: [*t.encode(x, add_special_tokens=False).ids, end]
    found = stages[5][1].collect()
    assert {r.doc_id for r in found} == set(texts) and check_packing(found, texts, plain, packing.Limits()) == 0


def test_run_is_the_stages_in_order(spark, stages):
    count = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert count(corpus_pipeline.run(spark, SF)) == count(stages[5][1])


def test_stages_take_odd_documents(spark):
    docs = documents(spark, edge_rows())
    for docs_in in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs_in, SF).count()


def test_the_rest_works_without_this_subpackage(tmp_path):
    for p in ("pvspark", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    (tmp_path / "pvspark" / "llm").rename(tmp_path / "left_out")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in [*q, *e.oracle_sql()]), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)


def test_all_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert np.all([n in names for n in __spark_entry__.oracle_sql()])
