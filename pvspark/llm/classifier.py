"""Quality of documents by hierarchical empirical Bayes: evidence of the text, shrunken towards its path, host and the whole.

A linear classifier over a few counts of the text gives each document a probability. Hosts and paths within hosts get Beta
posteriors: the prior of a path is the posterior mean of its host, the prior of a host is the mean of all documents, and both prior
strengths are estimated from how much groups differ. What a document's surroundings say is added to what its text says.

Null text counts as empty, a null host or path as ''. Repeated rows give repeated rows. Labels that are null, or for no document, don't
count; several labels of one document count each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.quality import SPACES
from pvspark.llm.shared import stored

#: The classifier is fitted on at most so many labelled documents, chosen by the hash of their id.
MAX_LABELLED = 20_000
#: Log-odds of the surroundings weigh this much against those of the text.
PRIOR_WEIGHT = 0.5
#: Log-odds of the text alone are kept within this range.
MOST_LOGIT = 12.0
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
FEATURES = ["log_words", "symbol_share", "mark_share", "upper_share", "bar_share", "digit_share", "distinct_share", "repeat_share", "word_length", "dup_line_share"]


def features(text: Column) -> list[Column]:
    """Shares and means over the whole text, all between 0 and about 10."""
    text = F.coalesce(text, F.lit(""))
    w = F.array_remove(F.split(text, SPACES), "")
    lines = F.split(text, "\n")
    of_words = F.transform(F.array(w), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.length(F.array_join(w, "")).alias("chars"),
        F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).alias("again"),
    ))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return [
        F.get(of_words, F.lit(0)).alias("w"), count(r"[#*$%&<>]").alias("symbols"), count(r"[!?]").alias("marks"), count(r"\p{Lu}").alias("upper"),
        count(r"\|").alias("bars"), count(r"[0-9]").alias("digits"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("own_lines"),
    ]


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path and the features of every document."""
    rows = docs.select("doc_id", *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))], *features(docs["text"]))
    share = lambda a, b: (F.col(a) / F.greatest(F.lit(1), F.col(b))).cast("double")
    made = [
        F.log10(1.0 + F.col("w.n")), share("symbols", "w.chars"), share("marks", "w.n"), share("upper", "w.chars"), share("bars", "w.n"),
        share("digits", "w.chars"), share("w.distinct", "w.n"), share("w.again", "w.n"), share("w.chars", "w.n") / 10, 1 - share("own_lines", "lines"),
    ]
    return rows.select("doc_id", "host", "path", *[c.alias(n) for c, n in zip(made, FEATURES, strict=True)])


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[list[float], list[float], list[float]]:
    """Weights (the constant first), means and deviations of a ridge logistic regression on a bounded labelled sample.

    Without both kinds of label it has no opinion: all weights are 0.
    """
    known = labels.select(F.col("doc_id").alias("doc"), F.col(label).cast("double").alias("y")).dropna()
    known = stored(rows.join(known, rows["doc_id"] == known["doc"]).select("doc", "y", *FEATURES), "labelled")
    # Just below the bound, as the share of hashes under a limit varies a little; each task sends its part of the sample only.
    share = min(1.0, 0.95 * max_labelled / max(1, n)) if (n := known.count()) > max_labelled else 1.0
    chosen = known.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(max_labelled)
    sample = np.array(sorted(tuple(r) for r in chosen.select("y", *FEATURES).collect()), float).reshape(-1, 1 + len(FEATURES))
    y, x = sample[:, 0], sample[:, 1:]
    weights = np.zeros(1 + len(FEATURES))
    if len(set(y.tolist())) < 2:
        return weights.tolist(), [0.0] * len(FEATURES), [1.0] * len(FEATURES)
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.c_[np.ones(len(x)), np.clip((x - mean) / deviation, -8, 8)]
    ridge = np.diag([0.0] + [1.0] * len(FEATURES))
    for _ in range(30):  # Newton's method; the sum is convex
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(weights)), x.T @ (y - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist(), mean.tolist(), deviation.tolist()


def evidence(model: tuple[list[float], list[float], list[float]]) -> Column:
    """Log-odds of good quality by the text alone."""
    weights, mean, deviation = model
    out = F.lit(weights[0])
    for name, w, m, s in zip(FEATURES, weights[1:], mean, deviation, strict=True):
        out = out + F.lit(w) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - m) / s))
    return F.greatest(F.lit(-MOST_LOGIT), F.least(F.lit(MOST_LOGIT), out))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(centre: Column) -> Column:
    """Prior strength (as if so many documents had been seen) by moments, from rows with n and mean of each group.

    With between-group variance v and centre m, the Beta prior has strength m (1 - m) / v - 1, kept within 1 and 1e6. v is what the groups'
    means vary beyond what documents within them would explain.
    """
    n, spread, noise = F.sum("n"), F.sum(F.col("n") * (F.col("mean") - centre) ** 2), F.sum(centre * (1 - centre))
    total = F.greatest(F.lit(1e-9), (spread - noise) / F.greatest(F.lit(1.0), n))
    level = F.sum(F.col("n") * centre * (1 - centre)) / F.greatest(F.lit(1.0), n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), level / total - 1)).alias("strength")


def posteriors(scored: DataFrame) -> DataFrame:
    """One row per host and path: path_docs, all_mean, host_mean and path_mean (posterior means).

    `scored` has host, path and p. Only sums are shuffled: a host with a third of all rows costs one row per task. To the driver go
    three numbers.
    """
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mean", F.col("s") / F.col("n"))
    all_mean = F.lit(hosts.agg(F.sum("s") / F.sum("n")).first()[0]).cast("double")
    of_host = F.lit(hosts.agg(strength(all_mean)).first()[0]).cast("double")
    hosts = hosts.select("host", ((of_host * all_mean + F.col("s")) / (of_host + F.col("n"))).alias("host_mean"))
    paths = stored(paths.join(hosts, "host").withColumn("mean", F.col("s") / F.col("n")), "paths")
    of_path = F.lit(paths.agg(strength(F.col("host_mean"))).first()[0]).cast("double")
    mean = (of_path * F.col("host_mean") + F.col("s")) / (of_path + F.col("n"))
    return paths.select("host", "path", F.col("n").cast("long").alias("path_docs"), all_mean.alias("all_mean"), "host_mean", mean.alias("path_mean"))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality",
    max_labelled: int = MAX_LABELLED, weight: float = PRIOR_WEIGHT, keep_from: float = KEEP_FROM,
) -> DataFrame:
    """doc_id, evidence, host_mean, path_mean, path_docs, posterior, kept: one row per document."""
    rows = stored(measured(docs, host, path), "features")
    model = fit(rows, labels, label, max_labelled)
    scored = rows.select("doc_id", "host", "path", evidence(model).alias("evidence"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    groups = posteriors(scored)
    surroundings = F.lit(weight) * (logit(F.col("path_mean")) - logit(F.col("all_mean")))
    out = scored.join(groups, ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + surroundings))))
    return out.select("doc_id", "evidence", "host_mean", "path_mean", "path_docs", "posterior", (F.col("posterior") >= keep_from).alias("kept"))
