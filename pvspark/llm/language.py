"""The languages of a document, as a mixture whose shares expectation-maximisation finds from n-gram likelihoods.

A language is a distribution over byte n-grams of lower-cased letters, with a space for all else, one for each length of ORDERS; n-grams are
hashed into a fixed number of buckets and counted over all training texts, in Spark. A document is a mixture of languages: the
E step gives each n-gram to the languages by share times likelihood, the M step makes the shares of what they got. From the languages
with a share the smallest is taken away again and again; of the sets so met, and the best single language, the one with the highest
penalised likelihood is the document's. Overlapping n-grams repeat what they say, so an n-gram counts as 1 / (its length x
the number of lengths) of an observation. A language more costs PENALTY times the logarithm of the observations, and FLOOR for each of them: foreign names
and quotations in a text of one language add to the likelihood in proportion to its length, a second language adds far more.

The most likely language is the one with the largest share. Its score is that share, or for one language alone the probability that it is that
one. Without a letter (or a text) it is `und`, with score 0 and no languages; the same if nothing could be learned. Languages are
ordered by name where they tie. Training rows without text or language teach nothing. Repeated rows count as often as they are there. An empty table
gives no rows; texts are read whole, however long. Columns other than doc_id, text and lang are not read, and lang is only for training.

The model is one float per language and bucket. The number of buckets falls with the number of languages, so that the model never
outgrows CELLS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import ship
from pvspark.llm.words import mix, parts, task

ORDERS = (3,)
#: Buckets per length and language; all lengths, languages and buckets together stay within CELLS (64 MB).
BUCKETS, CELLS = 1 << 16, 1 << 24
SMOOTHING = 0.5
PENALTY, FLOOR = 1.0, 0.02
#: Shares below this are none.
LEAST = 0.01
STEPS, STILL = 40, 1e-3
HELD_OUT = 5
UNKNOWN = "und"
#: Cells of an expectation that are worked on at once.
_WORK = 1 << 22
OUT = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>, n_grams long"


def grams(texts: pa.Array, buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (its number, the place in a table of len(orders) x buckets, how often) and which texts have letters."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    letters = np.asarray(pc.match_substring_regex(lower, r"\p{L}"))
    space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    plain = pc.replace_substring_regex(pc.binary_join_element_wise(space, lower, space, nothing), r"[^\p{L}\p{M}]+", " ")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if plain.buffers()[2] is not None else np.zeros(0, np.uint8)
    text = np.repeat(np.arange(len(plain)), np.diff(offsets))
    found, value = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(orders) + 1):
        value = value[: max(len(data) - n + 1, 0)] | data[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
        if n in orders:
            inside = text[: len(value)] == text[n - 1 :] if len(value) else np.zeros(0, bool)
            inside &= (value >> np.uint64(8 * (n - 1)) != 32) | (n > 1)
            place = (mix(value[inside]) % np.uint64(buckets)).astype(np.int64) + orders.index(n) * buckets
            found.append(text[: len(value)][inside] * (len(orders) * buckets) + place)
    key, count = np.unique(np.concatenate(found), return_counts=True)
    some = letters[key // (len(orders) * buckets)] if len(key) else np.zeros(0, bool)
    key, count = key[some], count[some]
    return key // (len(orders) * buckets), key % (len(orders) * buckets), count, letters


def _counted(buckets: int):
    """How often each n-gram occurs in the texts of a language; of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, table in held.items():
                some = np.flatnonzero(table)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "place": pa.array(some), "n": pa.array(table[some])})
            held.clear()

        for batch in batches:
            for part in parts(batch, "text"):
                text, place, count, _ = grams(part.column("text"), buckets)
                names = part.column("lang").dictionary_encode()
                of = np.asarray(names.indices)[text]
                for k, lang in enumerate(names.dictionary.to_pylist()):
                    if lang not in held:
                        if (len(held) + 1) * len(ORDERS) * buckets > CELLS // 4:
                            yield from out()
                        held[lang] = np.zeros(len(ORDERS) * buckets, np.int64)
                    mine = of == k
                    held[lang] += np.bincount(place[mine], count[mine], len(ORDERS) * buckets).astype(np.int64)
        yield from out()

    return task(run)


class Model:
    """Names of the languages, their share of the training documents, and log-likelihoods (len(ORDERS) x buckets, languages)."""

    def __init__(self, names: list[str], documents: list[int], counts: np.ndarray) -> None:
        self.names, self.buckets = names, counts.shape[1] // len(ORDERS)
        by_order = counts.reshape(len(names), len(ORDERS), self.buckets) + SMOOTHING
        self.likelihood = np.ascontiguousarray((by_order / by_order.sum(axis=2, keepdims=True)).reshape(len(names), -1).T.astype(np.float32))
        self.prior = np.log(np.array(documents, float) / max(sum(documents), 1))
        #: What one n-gram counts for.
        self.weight = np.repeat([1 / (n * len(ORDERS)) for n in ORDERS], self.buckets).astype(np.float32)


def learn(docs: DataFrame) -> Model | None:
    """From doc_id-free rows (text, lang). Reaching the driver: one row per language, and the counts, bounded by CELLS."""
    ship(docs.sparkSession)
    docs = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    most = CELLS // (256 * len(ORDERS))
    known = docs.groupBy("lang").count().limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"over {most} languages")
    if not known:
        return None
    known.sort()
    buckets = BUCKETS
    while len(known) * len(ORDERS) * buckets > CELLS:
        buckets //= 2
    sums = docs.mapInArrow(_counted(buckets), "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    names = [r[0] for r in known]
    at = pc.index_in(table.column("lang"), pa.array(names)).to_numpy()
    counts = np.zeros((len(names), len(ORDERS) * buckets), np.float64)
    counts[at, table.column("place").to_numpy()] = table.column("n").to_numpy()
    return Model(names, [r[1] for r in known], counts)


def shares(likelihood: np.ndarray, count: np.ndarray, begin: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents, languages) within the languages of each mask, and the log-likelihood of the documents. `begin`: where each one's n-grams start.

    A document is done when no share moves by STILL in a step; the others go on.
    """
    found, total = np.zeros(masks.shape), np.zeros(len(masks))
    now = masks / masks.sum(axis=1, keepdims=True)
    size = np.diff(np.r_[begin, len(count)])
    who = np.arange(len(masks))
    for step in range(STEPS):
        doc = np.repeat(np.arange(len(who)), size)
        part = likelihood * now[doc].astype(np.float32)
        whole = np.maximum(part.sum(axis=1), np.float32(1e-30))
        new = np.add.reduceat(part * (count / whole)[:, None], begin, axis=0, dtype=np.float64)
        new /= new.sum(axis=1, keepdims=True)
        done = (np.abs(new - now).max(axis=1) < STILL) | (step == STEPS - 1)
        found[who[done]] = new[done]
        total[who[done]] = np.add.reduceat(count * np.log(whole), begin, dtype=np.float64)[done]
        if done.all():
            break
        now = new
        if 4 * done.sum() >= len(done):
            rows = np.repeat(~done, size)
            likelihood, count, now, who, size = likelihood[rows], count[rows], now[~done], who[~done], size[~done]
            begin = np.cumsum(size) - size
        # A document that is done and still here goes on unharmed; its result is written again.
    return found, total


def mixtures(model: Model, place: np.ndarray, count: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents, languages) of each document's set of languages, and the score of its first language."""
    likelihood, weight = model.likelihood[place], (count * model.weight[place]).astype(np.float32)
    seen = np.add.reduceat(weight, begin, dtype=np.float64)
    alone = np.add.reduceat(weight[:, None] * np.log(likelihood), begin, axis=0, dtype=np.float64)
    guess = alone + model.prior
    first = guess.argmax(axis=1)
    rows = np.arange(len(begin))
    sure = np.exp(guess - guess.max(axis=1, keepdims=True))
    score = (sure / sure.sum(axis=1, keepdims=True))[rows, first]
    cost = PENALTY * np.log1p(seen) + FLOOR * seen
    out = np.zeros(alone.shape)
    out[rows, first] = 1
    best = alone[rows, first].copy()
    size = np.diff(np.r_[begin, len(count)])

    def some(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.zeros(len(begin), bool)
        keep[docs] = True
        at = np.repeat(keep, size)
        return likelihood[at], weight[at], np.cumsum(size[docs]) - size[docs]

    docs, masks = rows, np.ones(alone.shape, bool)
    while len(docs) and alone.shape[1] > 1:
        now, value = shares(*some(docs), masks)
        now[now < LEAST] = 0
        used = (now > 0).sum(axis=1)
        # Fewer languages never fit better: what can't pay for one more is done.
        worth = value - cost[docs] > alone[docs, first[docs]]
        total = value - cost[docs] * (used - 1)
        better = worth & (used > 1) & (total > best[docs])
        best[docs[better]] = total[better]
        out[docs[better]] = now[better] / now[better].sum(axis=1, keepdims=True)
        score[docs[better]] = out[docs[better]].max(axis=1)
        go = worth & (used > 2)
        docs, now = docs[go], now[go]
        masks = now > 0
        masks[np.arange(len(docs)), np.where(masks, now, 2).argmin(axis=1)] = False
    return out, score


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                n = part.num_rows
                pred, score, langs, each, seen = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)], np.zeros(n, np.int64)
                if model is not None:
                    text, place, count, _ = grams(part.column("text"), model.buckets)
                    seen += np.bincount(text, count, n).astype(np.int64)
                    docs, begin = np.unique(text, return_index=True)
                    begin = np.r_[begin, len(text)]
                    at = 0
                    while at < len(docs):
                        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + _WORK // len(model.names), "right")) - 1)
                        here = slice(begin[at], begin[stop])
                        found, sure = mixtures(model, place[here], count[here], begin[at:stop] - begin[at])
                        score[docs[at:stop]] = sure
                        for doc, row in zip(docs[at:stop].tolist(), found, strict=True):
                            order = np.argsort(-row, kind="stable")[: np.count_nonzero(row)]
                            langs[doc], each[doc] = [model.names[k] for k in order], row[order].tolist()
                            pred[doc] = langs[doc][0]
                        at = stop
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score),
                    "langs": pa.array(langs, pa.list_(pa.string())), "shares": pa.array(each, pa.list_(pa.float64())), "n_grams": pa.array(seen),
                })

    return task(run)


def predict(docs: DataFrame, model: Model | None, held_out: Column | None = None) -> DataFrame:
    """The mixture of every document; held_out is only passed on."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most CELLS floats
    mark = (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), mark)
    return rows.mapInArrow(lambda x: _predict(shared.value)(x), OUT)


def identify(docs: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) isn't divisible by `held_out` (a null id is 0), and predict all."""
    out = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(0)) % held_out == 0
    model = learn(docs.select(docs["text"].alias("text"), docs["lang"].alias("lang"), out.alias("out")).filter("NOT out"))
    return predict(docs, model, out)
