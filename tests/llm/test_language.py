import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pvspark.llm import language
from pvspark.llm.queries import QUERIES
from tests.llm.common import LONG, SF, documents, edge_rows

TEXTS = {
    "en": "the house by the river was old and the wind went through every window that they had left open",
    "de": "das haus am fluss war alt und der wind zog durch jedes fenster das sie offen gelassen hatten",
    "fr": "la maison près de la rivière était vieille et le vent passait par chaque fenêtre restée ouverte",
}


def train(spark, more=()):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TEXTS[k].split())), k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    return documents(spark, [*rows, *more])


def predicted(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_shares(model, text, mask):
    """The same expectation-maximisation with plain loops, to the end."""
    _, place, count, _ = language.grams(pa.array([text]), model.buckets)
    share = {k: 1 / len(mask) for k in mask}
    for _ in range(2000):
        got = dict.fromkeys(mask, 0.0)
        for p, n in zip(place.tolist(), count.tolist(), strict=True):
            whole = sum(share[k] * float(model.likelihood[p, k]) for k in mask)
            for k in mask:
                got[k] += n * share[k] * float(model.likelihood[p, k]) / whole
        total = sum(got.values())
        share = {k: v / total for k, v in got.items()}
    value = sum(
        n * float(model.weight[p]) * math.log(sum(share[k] * float(model.likelihood[p, k]) for k in mask)) for p, n in zip(place.tolist(), count.tolist(), strict=True)
    )
    return share, value


def test_grams_are_windows_of_letters():
    text, place, count, letters = language.grams(pa.array(["Ab-ab", None, "12 .", "é"]), 1 << 16)
    # " ab", "ab ", "b a" and again; the last one has two bytes between spaces.
    assert sorted(count[text == 0].tolist()) == [1, 2, 2] and len(text[text == 3]) == 2
    assert letters.tolist() == [True, False, False, True] and set(text.tolist()) == {0, 3}
    assert language.grams(pa.array(["ab AB"]), 1 << 16)[1].tolist() == sorted(set(place[text == 0].tolist()))


def test_shares_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(language, "STILL", 1e-9)
    monkeypatch.setattr(language, "STEPS", 2000)
    model = language.learn(train(spark))
    texts = [f"{TEXTS['en']} {TEXTS['de']}", f"{TEXTS['fr']} {TEXTS['fr']} {TEXTS['de']}", TEXTS["en"]]
    text, place, count, _ = language.grams(pa.array(texts), model.buckets)
    begin = np.unique(text, return_index=True)[1]
    for mask in ([0, 1, 2], [0, 1], [1, 2]):
        masks = np.zeros((3, 3), bool)
        masks[:, mask] = True
        weight = (count * model.weight[place]).astype(np.float32)
        found, value = language.shares(model.likelihood[place], weight, begin, masks)
        for k, t in enumerate(texts):
            share, want = brute_shares(model, t, mask)
            assert np.allclose(found[k, mask], [share[j] for j in mask], atol=1e-3) and value[k] == pytest.approx(want, rel=1e-4)


def test_sets_are_the_best_by_penalised_likelihood(spark):
    """Against all sets of languages."""
    model = language.learn(train(spark))
    cut = {k: v.split() for k, v in TEXTS.items()}
    texts = [TEXTS["en"], f"{TEXTS['en']} {TEXTS['de']}", " ".join(TEXTS.values()), " ".join(cut["fr"] + cut["en"][:6]), "das haus", " ".join(cut["de"] * 4 + cut["fr"] * 2)]
    text, place, count, _ = language.grams(pa.array(texts), model.buckets)
    found, _ = language.mixtures(model, place, count, np.unique(text, return_index=True)[1])
    for row, t in zip(found, texts, strict=True):
        _, p, n, _ = language.grams(pa.array([t]), model.buckets)
        seen = float((n * model.weight[p]).sum())
        cost = language.PENALTY * math.log1p(seen) + language.FLOOR * seen
        every = {s: brute_shares(model, t, s)[1] - cost * (len(s) - 1) for s in [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]}
        assert tuple(np.flatnonzero(row)) == max(every, key=every.get)


def test_mixed_documents(spark):
    found = predicted(language.identify(train(spark, [
        (100, f"{TEXTS['en']} {TEXTS['en']} {TEXTS['de']}", None), (101, TEXTS["fr"], None), (102, " ".join(TEXTS.values()), None),
    ])))
    assert found[100]["langs"] == ["en", "de"] and found[100]["lang_pred"] == "en" and 0.55 < found[100]["score"] < 0.75
    assert found[101]["langs"] == ["fr"] and found[101]["score"] > 0.99
    assert sorted(found[102]["langs"]) == ["de", "en", "fr"] and sum(found[102]["shares"]) == pytest.approx(1)


def test_edge_rows(spark):
    rows = language.identify(train(spark, [(i if i is None else i + 1000, t, *r) for i, t, *r in edge_rows()])).collect()
    assert len(rows) == 60 + len(edge_rows())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not r["langs"])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 if r["doc_id"] is not None else True)
    assert [by[1000 + k][0]["lang_pred"] for k in (3, 4, 5, 12)] == ["und"] * 4
    assert len(by[1001]) == 2 and by[1001][0] == by[1001][1]
    assert by[1007][0]["n_grams"] == 119_999  # the whole text, "w x " without numbers


def test_nothing_to_learn_from(spark):
    out = language.identify(documents(spark, []))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.isEmpty()
    assert {r["lang_pred"] for r in language.identify(documents(spark, [(1, "some words", None, None), (2, None, "en")])).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(documents(spark, [(i, "some words", "xx") for i in range(9)])).collect()} == {"xx"}


def test_many_languages_make_the_model_no_larger(spark, monkeypatch):
    monkeypatch.setattr(language, "CELLS", 1 << 12)
    model = language.learn(train(spark))
    assert model.likelihood.size <= 1 << 12 and model.buckets == 1024
    monkeypatch.setattr(language, "CELLS", 256 * 2)
    with pytest.raises(ValueError, match="over 2 languages"):
        language.learn(train(spark))


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op13_language_id"](spark, SF).collect() if r["held_out"]]
    assert len(held) > 20 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95


def test_language_and_source_of_a_document_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    model = language.learn(docs)
    first = predicted(language.predict(docs, model))
    swapped = docs.selectExpr("doc_id", "text", "source AS lang", "lang AS source", "n_chars")
    assert predicted(language.predict(swapped, model)) == first
