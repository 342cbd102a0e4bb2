"""A Merkle manifest of a dataset: one leaf per row, a tree per language, one root over all of them.

The leaf of a row is the SHA-256 of its five fields, the digest of a node that of its children's digests as text. Two consecutive nodes
of a level have one parent; a last one without a neighbour gets a parent of its own. A parent keeps the hash state that stands before
its second child (before the first it is SHA-256's own). To fold a changed leaf up to the root, each parent's kept state is resumed
with the replacement and the siblings to its right; what is left of it is never read again.

Leaves are numbered per language by a range sort, so a language that holds most rows is spread over many tasks. A task then builds
whole subtrees of SPAN levels (blocks of consecutive leaves), their tops are the nodes of the next round, and so on: a round shrinks
the table a thousand times. On the way down each block hands its nodes their steps to the root; the leaves fold over their own block
and then over the steps it was handed. Nothing but the root itself passes the driver.

Null fields count as `-`; a null language is a tree of its own, first in order, apart from the empty string's. Leaves of equal
doc_id (null first) are ordered by their digest; repeated rows are leaves of their own. An empty table gives no rows. Texts are hashed
whole, however long. Columns other than the five are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.llm import sha
from pvspark.llm.meeting import runs
from pvspark.llm.shared import ship, stored
from pvspark.llm.words import task

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block is a subtree of so many levels.
SPAN = 10
#: The driver's check changes n_chars where this divides the crc32 of doc_id.
EVERY = 7
#: A step to the root: which child and whether it has a sibling, the state kept before the second child, the sibling's digest.
FIRST, FIRST_OF_TWO, SECOND = 0, 1, 2
_STEP = 1 + 32 + 32
_MASK = (1 << SPAN) - 1


@dataclass(frozen=True)
class Manifest:
    """The leaves (tree, index, doc_id, leaf, replacement) and, per round, the blocks (tree, block, size, digest, nodes, states)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    above: list[DataFrame]
    root: bytes | None


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    """The leaf of a row with these fields."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def leaves(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, tree (the language), leaf, and replacement: the leaf with n_chars + 1 where `every` divides the id's crc32, else null."""
    fields = [docs[c] for c in FIELDS]
    more = (docs["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = F.crc32(docs["doc_id"].cast("string").cast("binary")) % every == 0
    again = digest([more if c == "n_chars" else docs[c] for c in FIELDS])
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("tree"), digest(fields).alias("leaf"), F.when(changed, again).alias("replacement")
    )


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with index (from 0 in each tree) and size (of the tree), by a range sort over all rows and one running total over its parts."""
    by = ["tree", *order]
    # Rows that are equal in all of these are spread by their place in the input.
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie")
    rows = stored(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # at most one row per part of the range sort
    before = F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")
    counts = stored(counts.select(F.col("tree").alias("_tree"), "_part", "_first", before.alias("_before"), F.sum("_n").over(tree).alias("size")), "counts")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part"))
    out = rows.join(counts, same)
    return out.select(*[c for c in rows.columns if c != "_at"], (F.col("_before") + F.col("_at") - F.col("_first")).alias("index"), "size")


def _key(block: Column) -> Column:
    return F.xxhash64(F.col("tree").isNull(), F.coalesce("tree", F.lit("")), block)


def _bytes(column: pa.Array, width: int = 32) -> np.ndarray:
    """Binary values of one length, none of them null, as rows."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The rows of each group behind one another, as one binary value."""
    ends = np.r_[0, np.cumsum(counts * rows.shape[1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _text(digests: np.ndarray) -> pa.Array:
    ends = np.arange(0, 64 * len(digests) + 1, 64, dtype=np.int64)
    text = pa.LargeStringArray.from_buffers(len(digests), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sha.as_text(digests))))
    return text.cast(pa.string())


def _levels(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many levels a block of `count` nodes has above them: all if its tree has more blocks, else up to its only top."""
    alone = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    return np.where(size > 1 << SPAN, SPAN, alone)


def _width(count: np.ndarray, level: int) -> np.ndarray:
    """Nodes of a block on a level."""
    return (count + (1 << level) - 1) >> level


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block over each run of nodes: its digests level by level, and the state each parent keeps."""
    for batch in runs(batches, "key"):
        index, size = batch.column("index").to_numpy(), batch.column("size").to_numpy()
        first = np.flatnonzero(index & _MASK == 0)
        count = np.diff(np.r_[first, len(index)])
        top = _levels(count, size[first])
        group, place, nodes = np.repeat(np.arange(len(first)), count), index & _MASK, _bytes(batch.column("digest"))
        found, kept, tops = [(group, np.zeros_like(group), nodes)], [], nodes[first].copy()
        for level in range(int(top.max(initial=0))):
            go = top[group] > level
            group, place, nodes = group[go], place[go], nodes[go]
            left = np.flatnonzero(place % 2 == 0)
            two = np.flatnonzero(np.r_[place[1:] % 2 == 1, False][left])  # the next node is then the sibling
            states = sha.absorb(sha.start(len(left)), sha.as_text(nodes[left]))
            whole = states.copy()
            whole[two] = sha.absorb(states[two], sha.as_text(nodes[left[two] + 1]))
            blocks = np.ones(len(left), np.int64)
            blocks[two] = 2
            group, place, nodes = group[left], place[left] // 2, sha.finish(whole, blocks)
            found.append((group, np.full(len(group), level + 1), nodes))
            kept.append((group, np.full(len(group), level), states.astype(">u4").view(np.uint8)))
            done = top[group] == level + 1
            tops[group[done]] = nodes[done]
        out = []
        for rows in (found, kept):
            groups, levels = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (0, 1))
            values = np.concatenate([r[2] for r in rows] or [np.zeros((0, 32), np.uint8)])
            order = np.lexsort((levels, groups))  # stable, so places stay in order
            out.append(_binary(values[order], np.bincount(groups, minlength=len(first))))
        yield pa.RecordBatch.from_pydict({
            "tree": batch.column("tree").take(pa.array(first)), "block": pa.array(index[first] >> SPAN), "size": pa.array(size[first]), "count": pa.array(count),
            "digest": _binary(tops, np.ones(len(first), np.int64)), "nodes": out[0], "states": out[1],
        })


_BLOCKS = "tree string, block long, size long, count long, digest binary, nodes binary, states binary"


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the bottom up, until every tree has one top. `nodes`: tree, index, size, digest."""
    out = []
    while True:
        key = _key(F.shiftright("index", SPAN)).alias("key")
        rows = nodes.select(key, "tree", "index", "size", "digest").repartition("key").sortWithinPartitions("key", "tree", "index")
        out.append(stored(rows.mapInArrow(task(_grow), _BLOCKS), "blocks"))
        rest = out[-1].filter(F.col("size") > 1 << SPAN)
        if rest.isEmpty():
            return out
        nodes = rest.select("tree", F.col("block").alias("index"), F.shiftright(F.col("size") + _MASK, SPAN).alias("size"), "digest")


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """tree, digest: what remains of each tree."""
    out = None
    for table in rounds:
        part = table.filter(F.col("size") <= 1 << SPAN).select("tree", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def manifest(rows: DataFrame) -> Manifest:
    """Build the trees over `rows` (see `leaves`) and the tree over their tops."""
    ship(rows.sparkSession)
    numbered = stored(_numbered(stored(rows, "digests"), ["doc_id", "leaf"]), "numbered")
    rounds = _rounds(numbered.withColumnRenamed("leaf", "digest"))
    tops = _tops(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    subroots = stored(_numbered(tops, ["of"]), "subroots")
    above = _rounds(subroots)
    root = _tops(above).first()  # one row, or none of an empty table
    return Manifest(numbered, rounds, subroots, above, None if root is None else bytes(root["digest"]))


class _Blocks:
    """The blocks of a batch; digests and states of all of them lie behind one another."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.count, size = batch.column("count").to_numpy(), batch.column("size").to_numpy()
        self.top = _levels(self.count, size)
        nodes, states = batch.column("nodes"), batch.column("states")
        self.nodes, self.states = _bytes(nodes), _bytes(states)
        self.node = np.r_[0, np.cumsum([len(x) // 32 for x in nodes.to_pylist()])][:-1].astype(np.int64)
        self.state = np.r_[0, np.cumsum([len(x) // 32 for x in states.to_pylist()])][:-1].astype(np.int64)

    def steps(self, group: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level for the nodes at `place` of blocks `group`: which of them still climb, the kind of step, the kept state, the sibling."""
        at_node, at_state = self.node.copy(), self.state.copy()
        for level in range(int(self.top.max(initial=0))):
            who = np.flatnonzero(self.top[group] > level)
            g, p = group[who], place[who] >> level
            width = _width(self.count, level)
            kind = np.where(p % 2 == 1, SECOND, np.where((p ^ 1) < width[g], FIRST_OF_TWO, FIRST))
            beside = np.minimum(p ^ 1, width[g] - 1)  # of no use for the only child
            yield who, kind, self.states[at_state[g] + p // 2], self.nodes[at_node[g] + beside]
            at_node += width
            at_state += _width(self.count, level + 1)


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a block with its steps to the root."""
    for batch in batches:
        for k in range(batch.num_rows):  # one block, up to a thousand nodes
            one = batch.slice(k, 1)
            blocks = _Blocks(one)
            n = int(blocks.count[0])
            steps = np.zeros((n, int(blocks.top[0]), _STEP), np.uint8)
            for level, (_, kind, state, beside) in enumerate(blocks.steps(np.zeros(n, np.int64), np.arange(n))):
                steps[:, level, 0], steps[:, level, 1:33], steps[:, level, 33:] = kind, state, beside
            rest = one.column("path")[0].as_py()
            yield pa.RecordBatch.from_pydict({
                "tree": one.column("tree").take(pa.array(np.zeros(n, np.int64))), "index": pa.array((one.column("block")[0].as_py() << SPAN) + np.arange(n)),
                "path": pa.array([x.tobytes() + rest for x in steps], pa.binary()),
            })


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """`paths`: tree, block, path."""
    paths = paths.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "path")
    return blocks.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the lowest round with their path to the root. `tops`: tree and path of what remains of each tree."""
    tops = tops.select("tree", F.lit(0).cast("long").alias("block"), "path")
    handed = None
    for table in reversed(rounds):
        last = _with_paths(table.filter(F.col("size") <= 1 << SPAN), tops)
        with_paths = last if handed is None else last.unionByName(_with_paths(table.filter(F.col("size") > 1 << SPAN), handed))
        if table is rounds[0]:
            return with_paths
        steps = with_paths.mapInArrow(task(_hand_down), "tree string, index long, path binary")
        handed = stored(steps.withColumnRenamed("index", "block"), "paths")


class _Fold:
    """Digests on their way up, and the hash of the siblings they pass."""

    def __init__(self, digests: np.ndarray) -> None:
        self.now = digests.copy()
        self.proof, self.passed = sha.start(len(digests)), np.zeros(len(digests), np.int64)

    def step(self, who: np.ndarray, kind: np.ndarray, kept: np.ndarray, beside: np.ndarray) -> None:
        states = sha.start(len(who))
        second = kind == SECOND
        states[second] = np.ascontiguousarray(kept[second]).view(">u4")
        states = sha.absorb(states, sha.as_text(self.now[who]))
        text = sha.as_text(beside)
        right = np.flatnonzero(kind == FIRST_OF_TWO)
        states[right] = sha.absorb(states[right], text[right])
        self.now[who] = sha.finish(states, np.where(kind == FIRST, 1, 2))
        some = np.flatnonzero(kind != FIRST)
        self.proof[who[some]] = sha.absorb(self.proof[who[some]], text[some])
        self.passed[who[some]] += 1


def _fold(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "key"):
            index = batch.column("index").to_numpy()
            head = np.flatnonzero(index < 0)
            tops, here = batch.take(pa.array(head)), np.flatnonzero(index >= 0)
            group, rows = (np.cumsum(index < 0) - 1)[here], batch.take(pa.array(here))
            blocks = _Blocks(tops)
            leaf = _bytes(rows.column("leaf"))
            changed = np.flatnonzero(~np.asarray(rows.column("replacement").is_null()))
            now = leaf.copy()
            now[changed] = _bytes(rows.column("replacement").take(pa.array(changed)))
            fold = _Fold(now)
            for step in blocks.steps(group, index[here] & _MASK):
                fold.step(*step)
            paths = tops.column("path").to_pylist()
            length = np.array([len(p) // _STEP for p in paths], np.int64)
            steps = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, _STEP)
            begin = np.cumsum(length) - length
            for k in range(int(length.max(initial=0))):
                who = np.flatnonzero(length[group] > k)
                step = steps[begin[group[who]] + k]
                fold.step(who, step[:, 0], step[:, 1:33], step[:, 33:])
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "leaf": _text(leaf), "subroot": _text(_bytes(tops.column("subroot")))
                .take(pa.array(group)), "root": pa.array([root.hex()] * len(here), pa.string()),
                "proof_sha256": _text(sha.finish(fold.proof, fold.passed)), "folded_root": _text(fold.now),
                "verified": pa.array((fold.now == np.frombuffer(root, np.uint8)).all(axis=1)),
            })

    return task(run)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold(tree: Manifest) -> DataFrame:
    """Per leaf its subroot, the root, the hash of its proof, and the root that its replacement (or itself) folds to."""
    spark = tree.leaves.sparkSession
    if tree.root is None:
        return spark.createDataFrame([], PROOFS)
    top = tree.subroots.limit(0).select("tree", F.lit(b"").cast("binary").alias("path"))
    top = top.unionByName(spark.range(1).select(F.lit("").alias("tree"), F.lit(b"").cast("binary").alias("path")))
    handed = _paths(tree.above, top).mapInArrow(task(_hand_down), "tree string, index long, path binary")
    tops = stored(tree.subroots.join(handed.drop("tree"), "index").select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot")), "tops")
    blocks = _paths(tree.rounds, tops)
    whose = tops.select(F.col("tree").alias("_tree"), "subroot")
    blocks = blocks.join(whose, F.col("tree").eqNullSafe(F.col("_tree")))
    none = F.lit(None)
    heads = blocks.select(
        _key(F.col("block")).alias("key"), "tree", "block", F.lit(-1).cast("long").alias("index"), none.cast("long").alias("doc_id"), none.cast("binary").alias("leaf"),
        none.cast("binary").alias("replacement"), "size", "count", "nodes", "states", "path", "subroot",
    )
    block = F.shiftright("index", SPAN)
    rows = tree.leaves.select(
        _key(block).alias("key"), "tree", block.alias("block"), "index", "doc_id", "leaf", "replacement", "size", none.cast("long").alias("count"),
        *[none.cast("binary").alias(c) for c in ("nodes", "states", "path", "subroot")],
    )
    both = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "tree", "block", "index")
    return both.mapInArrow(_fold(tree.root), PROOFS)


def verify(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """The manifest of `docs`, and each row's proof folded with its leaf changed where `every` divides the crc32 of its id."""
    return fold(manifest(leaves(docs, every)))
