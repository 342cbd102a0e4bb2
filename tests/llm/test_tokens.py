import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pvspark.llm import packing, records, tokens
from tests.llm.common import SF, documents, edge_rows, vocabulary

ODD = [
    "", None, "  a  b", " x", "x ", "a \nb\n c", "<|endoftext|> hi", "it's  John's 12 3.5 naïve  x   y", "été çà!! Ça.", "\x1c a \x1cb", "ñ, ñ. ªº ßẞ ŒǅÞ",
    "don't 're 's's 'S", "日本 語 x", "ab\tcd ef", "..., a.b.,", "Ġ Ġa Ā x", "  ", "\n\n a\r\n b", "🙂 🙂🙂 a🙂.", "x́ é. ​ a",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


def encoded(texts, end=7):
    ids, offsets = tokens.Encoder(vocabulary()).encode(pa.array(texts, pa.string()), end)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_are_those_of_the_library(plain):
    assert encoded(ODD) == [plain(t, 7) for t in ODD]
    assert encoded(ODD[::-1] * 2) == [plain(t, 7) for t in ODD[::-1] * 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé ñ.,!1 \n\t \x1c\x85日🙂<|>"), max_size=30), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    both = tokens.encoder(vocabulary())  # keeps what it has seen in other examples, as a worker does
    ids, offsets = both.encode(pa.array(texts, pa.string()), 7)
    want = [[*both.tokenizer.encode(x, add_special_tokens=False).ids, 7] for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_the_memory_starts_anew(monkeypatch, plain):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 3)
    e = tokens.Encoder(vocabulary())
    for _ in range(3):
        ids, offsets = e.encode(pa.array(ODD, pa.string()), 1)
        assert ids.tolist() == [x for t in ODD for x in plain(t, 1)]


def want_records(rows, plain):
    at, out = 0, []
    for doc, text in sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(plain(text, 2), "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("seed", [None, 4])
def test_records_come_back(spark, plain, seed):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    manifest = records.write_records(documents(spark, rows), vocabulary(), 2, files=5)
    assert len(manifest) == 5
    got = [tuple(r) for r in records.read_records(spark, manifest, seed).collect()]
    assert sorted(got) == want_records(rows, plain) and (seed is None) == (got == sorted(got))


def test_records_of_odd_texts(spark, plain):
    rows = [*edge_rows(), *((100 + k, t) for k, t in enumerate(ODD))]
    manifest = records.write_records(documents(spark, rows), vocabulary(), 2, files=3)
    got = [tuple(r) for r in records.read_records(spark, manifest).collect()]
    key = lambda r: (r[1], r[2])
    want = want_records(rows, plain)
    assert sorted(got, key=key) == sorted(want, key=key)
    empty = records.write_records(documents(spark, rows).filter("false"), vocabulary(), 2)
    assert empty == [] and records.read_records(spark, empty).count() == 0


def test_damage_is_noticed(tmp_path):
    data = b"\1\0\2\0"
    whole = records.frame(data) + records.frame(b"")
    file = np.frombuffer(whole, np.uint8)
    assert records.unframe(file, 0) == data and records.unframe(file, len(data) + 16) == b""
    for k in range(len(data) + 16):
        broken = file.copy()
        broken[k] ^= 4
        with pytest.raises(ValueError, match="record"):
            records.unframe(broken, 0)
    with pytest.raises(ValueError, match="record"):
        records.unframe(file[:10], 0)


def check_packing(rows, texts, plain, limits, quiet=None):
    """Pieces cover every id once, sequences are gapless and within all limits. Returns the share of padding."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids, at = np.array(plain(text, 0), "<u4"), 0
        for r in sorted(of_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.loss_tokens == sum(k >= (quiet or {}).get(doc, 0) for k in range(at, at + r.length))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for found in of_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(found) <= limits.segments and sum(r.loss_tokens for r in found) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
        total += at
    return padding / max(1, total)


def texts_of(spark):
    return dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


def test_packing_leaves_no_padding(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    texts = texts_of(spark)
    docs = documents(spark, list(texts.items())).repartition(3)
    assert check_packing(packing.pack_documents(docs, vocabulary()).collect(), texts, plain, packing.Limits()) == 0


def test_packing_under_three_limits(spark, plain):
    texts = texts_of(spark)
    quiet = {d: (d * 37) % 400 for d in texts}
    docs = documents(spark, list(texts.items()))
    docs = docs.withColumn("prompt", docs["doc_id"] * 37 % 400)
    limits = packing.Limits(512, 4, 400)
    padding = check_packing(packing.pack_documents(docs, vocabulary(), 0, limits, "prompt").collect(), texts, plain, limits, quiet)
    assert padding < 0.3


def test_loss_binds_with_prompts_under_the_limits_of_the_query(spark, plain):
    texts = texts_of(spark)
    quiet = {d: (d * 37) % 900 for d in texts}
    docs = documents(spark, list(texts.items()))
    docs = docs.withColumn("prompt", docs["doc_id"] * 37 % 900)
    limits = packing.Limits()._replace(loss=512)
    rows = packing.pack_documents(docs, vocabulary(), 0, limits, "prompt").collect()
    check_packing(rows, texts, plain, limits, quiet)
    loss = {}
    for r in rows:
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + r.loss_tokens
    assert max(loss.values()) == limits.loss


def test_the_heuristic_takes_the_largest_product():
    limits = packing.Limits(10, 3, 10)
    got = list(packing.pack(np.array([6, 3, 7, 4, 10]), np.zeros(5, int), limits))
    assert got[0] == [packing.Piece(4, 0, 10)]
    assert got[1] == [packing.Piece(2, 0, 7), packing.Piece(1, 0, 3)] and got[2] == [packing.Piece(0, 0, 6), packing.Piece(3, 0, 4)]


def test_the_rest_becomes_powers_of_two():
    parts = list(packing.powers([packing.Piece(0, 5, 9), packing.Piece(1, 0, 13)]))
    assert [sum(p.length for p in s) for s in parts] == [16, 4, 2]
    assert [p for s in parts for p in s] == [packing.Piece(0, 5, 9), packing.Piece(1, 0, 7), packing.Piece(1, 7, 4), packing.Piece(1, 11, 2)]


def test_packing_odd_texts(spark, plain):
    rows = [(k, t) for k, (_, t, *_) in enumerate(edge_rows())]
    docs = documents(spark, rows)
    assert check_packing(packing.pack_documents(docs, vocabulary()).collect(), dict(rows), plain, packing.Limits()) == 0
    null = packing.pack_documents(documents(spark, [(None, "x"), (None, "x")]), vocabulary()).collect()
    assert len({(r.sequence_id, r.offset) for r in null}) == len(null) and sum(r.length for r in null) == 4
    assert packing.pack_documents(docs.filter("false"), vocabulary()).count() == 0
