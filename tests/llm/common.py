"""Small inputs for the tests of the training-data operators."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion for the old king of the north"

#: Columns beside the four that operators read; their names are used inside the operators.
EXTRA = "content long, n long, host string, line string, key long, place long, root long, lines string, w string, held_out string, quiet2 long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, rows):
    """(doc_id, text[, lang, source]) as documents with clashing extra columns."""
    out = []
    for doc, text, *rest in rows:
        lang, source = (*rest, "en", "src0")[:2] if len(rest) != 1 else (rest[0], "src0")
        out.append((doc, text, lang, source, None if text is None else len(text), 1, 2, "h", "l", 3, 4, 5, "x", "y", "z", 6))
    return spark.createDataFrame(out, SCHEMA)


def edge_rows():
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    return [
        (1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, LONG), (8, LONG + " end"), (None, PROSE + " twice told"),
        (None, None), (9, "a\n\n\na\nb\n" * 40), (10, "é ü 日本 🙂 " * 30), (11, PROSE.upper()), (12, None, None, None), (13, PROSE, None, None),
    ]


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def connect(folder=SF):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(df, con, sql):
    """Whether a frame has the rows of a query."""
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    order = [d[0] for d in cur.description]
    want = sorted(repr([row[order.index(n)] for n in names]) for row in cur.fetchall())
    assert sorted(df.columns) == names
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == want


def vocabulary():
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    assert Path(path).exists()
    return path
