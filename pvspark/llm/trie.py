"""An n-gram language model as a trie in mapped Elias-Fano levels, built and queried by all executors.

Tokens are words (runs of bytes outside white space, A-Z in lower case) and one end per text. Level 1 is the vocabulary: sorted 64-bit hashes of
the tokens; a token's number is its place there. An n-gram is a context (an entry of the level above) and a token; its number is its place among
all, sorted by context and token. A level stores, for each context, a monotone pointer to its first child, and for each child its token, made
monotone by adding the number of its context times the size of the vocabulary. Looking an n-gram up is a successor search for that sum, which
stays among the children of the context. Levels that have one below also store counts as monotone running sums.

Probabilities are interpolated by absolute discounting: p(w|h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) p(w|shorter h), where T(h) is the number of
different tokens seen after h; of single tokens p(w) = (c(w) + 1) / (N + V + 1). The logarithm of the first term is stored in one byte on an even
grid; T(h) is the difference of two pointers. N-grams don't reach over the start of a text.

Each level is cut into shards by token mass: context h, with c(h) tokens after it, owns a stretch of that length, and child w lies in it at the share w / V.
Shards are equal stretches, so a context with a third of all tokens is spread over a third of the shards. Counts are summed in each
task first, and shuffled as sorted, delta-coded blocks. To the driver go a few numbers per shard. A repeated task writes a file of another name.

Null text counts as empty: one end. A null id counts as '' when texts are held out. Repeated rows count each. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import eliasfano as ef
from pvspark.llm.shared import mounted, new_folder, ship
from pvspark.llm.words import hashes, mix, parts, task

ORDER = 2
DISCOUNT = 0.75
#: The hash that stands for the end of a text.
END = int(mix(np.array([0x656E64], np.uint64))[0])
#: Distinct n-grams that a task gathers before it hands them on, and text it reads at once, in bytes.
GATHER, PART = 2_000_000, 4 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the offsets of the texts in them."""
    words, offsets = hashes(texts)
    ends = offsets[1:] + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), np.uint64)
    where = np.ones(len(out), bool)
    where[ends] = False
    out[where] = words
    out[ends] = END
    return out, offsets + np.arange(len(offsets))


def grid(total: int) -> float:
    """The step of the stored logarithms; 0 stands for 1, 255 for (1 - D) / total."""
    return float(np.log10(max(total, 1) / (1 - DISCOUNT))) / 255


class Level:
    """What the shards of one level say, for numbers of contexts and tokens."""

    def __init__(self, above: Level | None, meta: dict) -> None:
        self.above, self.meta = above, meta
        self.shards = [None] * len(meta["shards"])
        self.base = np.r_[0, np.cumsum([s["n"] for s in meta["shards"]])].astype(np.int64)
        self.mass = np.r_[0, np.cumsum([s["count"] for s in meta["shards"]])].astype(np.int64)
        self.size, self.total = int(self.base[-1]), int(self.mass[-1])
        self._cut = None

    def shard(self, k: int) -> dict:
        if self.shards[k] is None:
            name = self.meta["shards"][k]["name"]
            arrays = ef.read(f"{self.meta['folder']}/{name}") if name else {}
            self.shards[k] = {n: ef.sequence(arrays, n) for n in ("keys", "mass", "pointer") if f"{n}.head" in arrays} | {"p": arrays.get("p")}
        return self.shards[k]

    def counts(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The running sum before each entry, and its count."""
        before, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for k, at in _split(np.searchsorted(self.base, number, "right") - 1):
            own = number[at] - self.base[k]
            mass = self.shard(k)["mass"]
            before[at] = mass.get(own)
            count[at] = mass.get(own + 1) - before[at]
            before[at] += self.mass[k]
        return before, count

    def at_mass(self, mass: np.ndarray) -> np.ndarray:
        """The entry in whose stretch each mass lies."""
        out, mass = np.zeros(len(mass), np.int64), np.minimum(mass, self.total - 1)
        for k, at in _split(np.searchsorted(self.mass, mass, "right") - 1):
            out[at] = self.base[k] + self.shard(k)["mass"].successor(mass[at] - self.mass[k] + 1) - 1
        return out


class Vocabulary(Level):
    """Level 1."""

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of tokens by hash, -1 for unknown ones."""
        out = np.full(len(words), -1, np.int64)
        shards = len(self.shards)
        for k, at in _split(shard_of(words, shards)):
            if self.meta["shards"][k]["n"]:
                found = self.shard(k)["keys"].find(below(words[at], k, shards))
                out[at] = np.where(found >= 0, found + self.base[k], -1)
        return out


class Grams(Level):
    """A level of n-grams, n > 1."""

    def __init__(self, above: Level, meta: dict, vocabulary: Vocabulary) -> None:
        super().__init__(above, meta)
        self.layout = Layout(above, vocabulary.size, len(meta["shards"]))
        self.step = grid(above.total)
        # Contexts whose children lie in several shards: in all, as many as there are shards at most.
        wide: dict[int, int] = {}
        for s in meta["shards"]:
            for context, n in s["edges"]:
                wide[context] = wide.get(context, 0) + n
        self.wide = np.array(sorted(wide.items()), np.int64).reshape(-1, 2)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1 if unseen), discounted share, children and count of the context. Contexts are known, words may be -1."""
        number, share = np.full(len(context), -1, np.int64), np.zeros(len(context))
        children = np.zeros(len(context), np.int64)
        before, count = self.above.counts(context)
        shard = self.layout.shard(before, count, np.maximum(word, 0))
        for k, at in _split(shard):
            if not self.meta["shards"][k]["n"]:
                continue
            own, first = self.shard(k), self.layout.first[k]
            local = context[at] - first
            children[at] = own["pointer"].get(local + 1) - own["pointer"].get(local)
            known = np.flatnonzero((word[at] >= 0) & (children[at] > 0))
            found = own["keys"].find(local[known] * self.layout.words + word[at][known])
            hit = known[found >= 0]
            found = found[found >= 0]
            number[at[hit]] = found + self.base[k]
            share[at[hit]] = 10.0 ** (-self.step * own["p"][found].astype(float))
        if len(self.wide):
            at = np.minimum(np.searchsorted(self.wide[:, 0], context), len(self.wide) - 1)
            children = np.where(self.wide[at, 0] == context, self.wide[at, 1], children)
        return number, share, children, count


class Layout:
    """In which shard of a level a child lies."""

    def __init__(self, above: Level, words: int, shards: int) -> None:
        self.words = words
        self.bounds = above.total * np.arange(shards + 1) // shards
        self.first = above.at_mass(self.bounds) if above.size else np.zeros(shards + 1, np.int64)

    def shard(self, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        mass = before + np.floor(count * (word / self.words)).astype(np.int64)
        return np.clip(np.searchsorted(self.bounds, mass, "right") - 1, 0, len(self.bounds) - 2)


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and where."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0, True])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(shard[order[a]]), order[a:b]


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def below(words: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Hashes of a shard as differences to the smallest hash it may hold."""
    return (words - np.uint64(-(-(shard << 32) // shards) << 32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _block(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as differences in 4 bytes (8 where one is larger), counts over 1 with their places."""
    steps = np.diff(keys, prepend=0)
    more = np.flatnonzero(counts > 1)
    return steps.astype(np.uint32 if len(steps) == 0 or steps.max() < 1 << 32 else np.int64).tobytes(), more.astype(np.uint32).tobytes(), counts[more].astype(np.int64).tobytes()


def _unblock(n: int, steps: bytes, places: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.cumsum(np.frombuffer(steps, np.uint32 if len(steps) == 4 * n else np.int64), dtype=np.int64)
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(places, np.uint32)] = np.frombuffer(more, np.int64)
    return keys, counts


BLOCK = "shard long, n long, steps binary, places binary, more binary"


class _Gather:
    """Counts of a task, by shard."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}
        self.n = 0

    def add(self, shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        for k, at in _split(shard):
            self.held.setdefault(k, []).append((keys[at], counts[at]))
        self.n += len(keys)

    def rows(self) -> pa.RecordBatch:
        rows = []
        for k, held in self.held.items():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows.append((k, len(keys), *_block(keys, counts)))
        self.held, self.n = {}, 0
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "n", "steps", "places", "more"])


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather()
        for batch in batches:
            for part in parts(batch, "text", PART):
                words, counts = np.unique(tokens(part.column("text"))[0], return_counts=True)
                shard = shard_of(words, shards)
                lowest = np.array([-(-(k << 32) // shards) << 32 for k in range(shards)], np.uint64)
                held.add(shard, (words - lowest[shard]).astype(np.int64), counts)
                if held.n > GATHER:
                    yield held.rows()
        yield held.rows()

    return task(run)


def _count_grams(metas: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Model(metas), _Gather()
        above, words = model.levels[-1], model.levels[0].size
        layout = Layout(above, words, len(metas[0]["shards"]))
        for batch in batches:
            for part in parts(batch, "text", PART):
                offsets, _, of, _ = model.look_up(part.column("text"))
                context, word = of[-1][:-1].copy(), of[0][1:]
                context[offsets[1:-1] - 1] = -1  # what follows is another text
                some = context >= 0
                pair, counts = _pairs(context[some], word[some], words)
                before, count = above.counts(pair[0])
                shard = layout.shard(before, count, pair[1])
                held.add(shard, (pair[0] - layout.first[shard]) * words + pair[1], counts)
                if held.n > GATHER:
                    yield held.rows()
        yield held.rows()

    return task(run)


def _pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs, sorted, and how often each occurs; b is below `size`."""
    kinds, a = np.unique(a, return_inverse=True)  # numbers of contexts may be too large to be multiplied
    keys, counts = np.unique(a * size + b, return_counts=True)
    return (kinds[keys // size] if len(kinds) else kinds, keys % size), counts


META = "shard long, n long, count long, name string, edges string"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    held: dict[int, list] = {}
    for batch in batches:
        for shard, *block in zip(*(batch.column(k).to_pylist() for k in ("shard", "n", "steps", "places", "more")), strict=True):
            held.setdefault(shard, []).append(_unblock(*block))
    for shard in sorted(held):
        yield shard, *summed(*(np.concatenate(x) for x in zip(*held.pop(shard), strict=True)))


def _save(folder: str, shard: int, arrays: dict) -> str:
    os.makedirs(folder, exist_ok=True)
    name = f"{shard:06d}-{uuid.uuid4().hex}"
    ef.write(f"{folder}/{name}", arrays)
    return name


def _meta(shard: int, n: int, count: int, name: str, edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": [shard], "n": [n], "count": pa.array([count], pa.int64()), "name": [name], "edges": [json.dumps(edges)]})


def _mass(counts: np.ndarray) -> dict[str, np.ndarray]:
    sums = np.r_[0, np.cumsum(counts)].astype(np.int64)
    return ef.named("mass", ef.EliasFano.build(sums, int(sums[-1]) + 1))


def _write_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            arrays = ef.named("keys", ef.EliasFano.build(keys, (1 << 64) // shards)) | _mass(counts)
            yield _meta(shard, len(keys), int(counts.sum()), _save(folder, shard, arrays), [])

    return task(run)


def _write_grams(folder: str, metas: list[dict], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(metas)
        above, words = model.levels[-1], model.levels[0].size
        layout, step = Layout(above, words, len(metas[0]["shards"])), grid(above.total)
        for shard, keys, counts in _merged(batches):
            first, end = int(layout.first[shard]), int(layout.first[shard + 1])
            span = end - first + 1
            pointer = np.searchsorted(keys, np.arange(span + 1) * words)
            _, total = above.counts(first + np.arange(span))
            share = (counts - DISCOUNT) / total[keys // words]
            p = np.clip(np.round(-np.log10(share) / step), 0, 255).astype(np.uint8)
            arrays = ef.named("pointer", ef.EliasFano.build(pointer, len(keys) + 1)) | ef.named("keys", ef.EliasFano.build(keys, span * words)) | {"p": p}
            if not last:
                arrays |= _mass(counts)
            edges = [(first, int(pointer[1])), (end, int(len(keys) - pointer[-2]))][: 2 if end > first else 1]
            yield _meta(shard, len(keys), int(counts.sum()), _save(folder, shard, arrays), edges)

    return task(run)


class Model:
    """A model by the descriptions of its levels."""

    def __init__(self, metas: list[dict]) -> None:
        self.levels: list[Level] = [Vocabulary(None, metas[0])]
        for meta in metas[1:]:
            self.levels.append(Grams(self.levels[-1], meta, self.levels[0]))

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Offsets of texts; per token its count, per level the number of the n-gram that ends there (-1 if there is none), its probability."""
        vocabulary = self.levels[0]
        hashed, offsets = tokens(texts)
        kinds, kind = np.unique(hashed, return_inverse=True)
        number = vocabulary.numbers(kinds)
        count = np.zeros(len(kinds), np.int64)
        known = np.flatnonzero(number >= 0)
        count[known] = vocabulary.counts(number[known])[1]
        p = ((count + 1) / (vocabulary.total + vocabulary.size + 1))[kind]
        count, number = count[kind], number[kind]
        of = [number]
        inner = np.ones(len(hashed), bool)
        inner[offsets[:-1]] = False
        for level in self.levels[1:]:
            here = np.flatnonzero(inner)
            context = of[-1][here - 1]
            here, context = here[context >= 0], context[context >= 0]
            contexts, c = np.unique(context, return_inverse=True)
            pair, at = np.unique(c * (len(kinds) + 1) + kind[here], return_inverse=True)
            word = np.full(len(kinds), -1, np.int64)
            word[kind] = number
            found, share, children, total = level.find(contexts[pair // (len(kinds) + 1)], word[pair % (len(kinds) + 1)])
            after = np.full(len(hashed), -1, np.int64)
            after[here] = found[at]
            # A context that only ends texts has no children and says nothing.
            rest = np.where(children > 0, DISCOUNT * children / np.maximum(total, 1), 1.0)
            p[here] = share[at] + rest[at] * p[here]
            of.append(after)
        return offsets, count, of, p


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id, text and whether crc32 of the id as text leaves 2 when divided by 7."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text").withColumn("held_out", F.crc32(name.cast("binary")) % 7 == 2)


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None, shards: int | None = None) -> list[dict]:
    """Build the levels from all texts of `docs`; returns their descriptions, which hold a few numbers per shard."""
    spark = docs.sparkSession
    ship(spark)
    folder = mounted(folder or new_folder(spark, "trie"))
    shards = max(4, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    metas: list[dict] = []
    for n in range(1, order + 1):
        own = f"{folder}/{n}"
        count = _count_words(shards) if n == 1 else _count_grams(metas)
        save = _write_words(own, shards) if n == 1 else _write_grams(own, metas, n == order)
        blocks = docs.select("text").mapInArrow(count, BLOCK).repartitionById(shards, F.col("shard").cast("int"))
        rows = {r["shard"]: r for r in blocks.mapInArrow(save, META).collect()}
        none = {"n": 0, "count": 0, "name": "", "edges": "[]"}
        found = [rows[k].asDict() if k in rows else none for k in range(shards)]
        metas.append({"folder": own, "shards": [{"n": r["n"], "count": r["count"], "name": r["name"], "edges": json.loads(r["edges"])} for r in found]})
    return metas


def _scores(metas: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(metas)
        vocabulary = model.levels[0]
        for batch in batches:
            for part in parts(batch, "text", PART):
                offsets, count, _, p = model.look_up(part.column("text"))
                base = np.log10((count + 1) / (vocabulary.total + vocabulary.size + 1))
                total = lambda x, at=offsets: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(np.diff(offsets)),
                    "n_known": pa.array(total((count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(part.num_rows, vocabulary.total)),
                    "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p))),
                })

    return task(run)


def score(docs: DataFrame, metas: list[dict]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows of `held_out`."""
    kinds = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.mapInArrow(_scores(metas), f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def language_model(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """Scores of all texts by a model of those that are not held out."""
    rows = held_out(docs)
    return score(rows, train(rows.filter("NOT held_out"), order, folder))


def vocabulary_size(spark: SparkSession, metas: list[dict]) -> int:
    return Vocabulary(None, metas[0]).size
