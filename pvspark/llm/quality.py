"""Quality rules: word and line counts of one text, and lines that many documents of one host share.

Everything is native: higher-order functions inside a row, hash aggregates and joins between rows.

Null text counts as empty, a null host as the host ''. Repeated rows give repeated rows and are documents of their own. A document is told apart by its
doc_id and the 64-bit hash of its text, so that rows which share a doc_id, or have none, don't mix. Columns of the input
that clash with the names used here are not read and don't matter. An empty table gives no rows; texts are counted whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import stored

SPACES = r"[ \x09-\x0D]+"
MIN_WORDS = 50
#: A line goes from a host once more than this share of that host's documents hold it, and more than this many ...
SHARE, LEAST = 0.2, 20
#: ... and a document goes with it if fewer than this share of its words is left.
MIN_LEFT = 0.3


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _places(s: Column) -> Column:
    """Positions, ascending, of the windows in `s` (sorted by hash) that have an equal neighbour."""
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def repeated_words(w: Column, n: int = 3) -> Column:
    """How many words lie in an n-word window that the text holds twice or more.

    Windows are compared by 64-bit hash: sorted by (hash, position), a repeated one has an equal neighbour. Each
    position found covers n words, less those that the one before it has covered.
    """

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last"))
        return _let(placed, lambda s: F.aggregate(_places(s), start, step, lambda a: a["n"]))

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        # Most texts repeat no window: then nothing is sorted.
        some = _let(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0)))
        return F.when(F.size(h) < n, F.lit(0)).otherwise(some)

    return _let(F.transform(w, lambda x: F.xxhash64(x)), count).cast("long")


def counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    of_words = _let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    return [
        of_words.alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def normalised(line: Column) -> Column:
    """Lower case, numbers as 0, anything but letters and numbers as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}0]+", " "))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """The one pass over the texts: doc_id, host, content (hash of the text), the counts, and `lines` with hash and words each."""
    text = F.coalesce(docs["text"], F.lit(""))
    line = F.transform(F.split(text, "\n"), lambda x: F.struct(normalised(x).alias("norm"), F.size(words(x)).alias("n")))
    lines = F.transform(F.filter(line, lambda x: x["norm"] != ""), lambda x: F.struct(F.xxhash64(x["norm"]).alias("line"), x["n"].alias("n")))
    return docs.select("doc_id", F.coalesce(docs[host], F.lit("")).alias("host"), F.xxhash64(text).alias("content"), *counts(docs["text"]), lines.alias("lines"))


def frequent_lines(rows: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Per host the lines (their hashes, `frequent`) that more than `share` of its documents hold, and more than `least`.

    `rows` comes from `measured`. Counts are partial before each shuffle, so a line which a third of all documents share costs one row per task there. A host
    has at most 1 / share times as many such lines as its documents have on average.
    """
    documents = rows.groupBy("host").agg(F.count("*").alias("documents"))
    lines = rows.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("holders"))
    # Few lines pass the second limit; the first one needs the size of their host.
    common = lines.filter(F.col("holders") > least).join(documents, "host").filter(F.col("holders") > F.lit(share) * F.col("documents"))
    return common.groupBy("host").agg(F.collect_list("line").alias("frequent"))


def judged(rows: DataFrame, share: float = SHARE, least: int = LEAST, min_left: float = MIN_LEFT) -> DataFrame:
    """`measured` rows with frequent (of their host), removed_lines, removed_words, base_failed and kept."""
    # Written, so that its size decides whether it is broadcast; beyond that a host with very many documents is split.
    rows = rows.join(stored(frequent_lines(rows, share, least), "frequent"), "host", "left")
    gone = F.when(F.col("frequent").isNotNull(), F.filter("lines", lambda x: F.array_contains(F.col("frequent"), x["line"])))
    rows = rows.withColumns({
        "removed_lines": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "removed_words": F.coalesce(F.aggregate(gone, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long"),
        "base_failed": F.expr(f"w.n_words < {MIN_WORDS} OR 100 * w.n_repeat_words > 50 * w.n_words"),
    })
    left = F.col("w.n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("w.n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & left)


def quality_rules(docs: DataFrame, host: str = "source", share: float = SHARE, least: int = LEAST, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: counts, base_failed, removed_lines, removed_words, kept.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. kept: not base_failed,
    and at least `min_left` of the words stand in lines that stay.
    """
    rows = judged(stored(measured(docs, host), "quality"), share, least, min_left)
    return rows.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        "base_failed", "kept", "removed_lines", "removed_words",
    )


def clean(docs: DataFrame, host: str = "source", share: float = SHARE, least: int = LEAST, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are kept, without their frequent lines; all columns of the input."""
    verdicts = judged(stored(measured(docs, host), "quality"), share, least, min_left)
    # Rows with the same doc_id, host and text have the same verdict.
    verdicts = verdicts.filter("kept").select(
        F.col("doc_id").alias("__doc"), F.col("host").alias("__host"), F.col("content").alias("__content"), F.col("frequent").alias("__frequent")
    ).dropDuplicates(["__doc", "__host", "__content"])
    keys = F.coalesce(docs[host], F.lit("")) == F.col("__host"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__content")
    rows = docs.join(verdicts, [docs["doc_id"].eqNullSafe(F.col("__doc")), *keys])
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__frequent"), F.xxhash64(normalised(x))))
    text = F.when(F.col("__frequent").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
