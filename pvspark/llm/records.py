"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is the length of its data (8 bytes), the masked checksum of those bytes (4), the data, and the masked checksum of the
data (4), all little-endian. The data are the ids of one document, 2 bytes each if the vocabulary allows it, else 4. A checksum is
crc32 turned right by 15 bits plus a constant, so that records inside records don't look valid. Beside each file of records lies its index:
per record the document's id, where the record begins, and its number of ids.

Documents are in ascending doc_id order over all files, a null doc_id first, equal ones by text. A null text is empty and has its end id only.
Repeated rows give records of their own. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import mounted, new_folder, ship
from pvspark.llm.tokens import PART, encoder
from pvspark.llm.words import parts, task

INDEX = np.dtype([("doc_id", "<i8"), ("named", "u1"), ("at", "<u8"), ("n", "<u8")])
MASK = 0xA282EAD8


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return ((((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF).to_bytes(4, "little")


def frame(data: bytes) -> bytes:
    length = len(data).to_bytes(8, "little")
    return b"".join((length, masked(length), data, masked(data)))


def unframe(file: np.ndarray, at: int) -> bytes:
    """The data of the record at byte `at`; raises if it isn't whole."""
    length = file[at : at + 8].tobytes()
    n = int.from_bytes(length, "little")
    if len(length) < 8 or file[at + 8 : at + 12].tobytes() != masked(length) or at + 16 + n > len(file):
        raise ValueError(f"no record at byte {at}")
    data = file[at + 12 : at + 12 + n].tobytes()
    if file[at + 12 + n : at + 16 + n].tobytes() != masked(data):
        raise ValueError(f"damaged record at byte {at}")
    return data


def _write(folder: str, path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index, at, total = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], 0, 0
        file = None
        for batch in batches:
            for part in parts(batch, "text", PART):
                if file is None:
                    os.makedirs(folder, exist_ok=True)
                    file = open(f"{folder}/{name}.rec", "wb", buffering=1 << 20)  # noqa: SIM115
                ids, offsets = encoder(path).encode(part.column("text"), end)
                ids = ids.astype(kind)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    index.append((doc or 0, doc is not None, at, b - a))
                    at += file.write(frame(ids[a:b].tobytes()))
                total += len(ids)
        if file is not None:
            file.close()
            np.array(index, INDEX).tofile(f"{folder}/{name}.idx")
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "records": [len(index)], "ids": [total]})

    return task(run)


def write_records(docs: DataFrame, path: str, end: int, folder: str | None = None, files: int | None = None) -> list[dict]:
    """Write all documents; returns the manifest: per file, in order, name, width, records, ids and start (ids in files before it).

    The manifest has one entry per file. A repeated task writes a file of another name, which no manifest has.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = mounted(folder or new_folder(spark, "records"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "<u2" if max(encoder(path).tokenizer.get_vocab_size() - 1, end) < 1 << 16 else "<u4"
    ordered = docs.select("doc_id", "text").repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    found = sorted(ordered.mapInArrow(_write(folder, path, end, kind), "part long, name string, records long, ids long").collect())
    starts = np.r_[0, np.cumsum([r["ids"] for r in found])].astype(int).tolist()
    return [{"folder": folder, "kind": kind, "name": r["name"], "records": r["records"], "ids": r["ids"], "start": s} for r, s in zip(found, starts, strict=False)]


def read_file(entry: dict, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of the records of one file, by its index, in any order of record numbers."""
    path = f"{entry['folder']}/{entry['name']}"
    index = np.fromfile(f"{path}.idx", INDEX)
    file = np.memmap(f"{path}.rec", np.uint8, "r")
    starts = entry["start"] + np.r_[0, np.cumsum(index["n"].astype(np.int64))]
    for k in range(len(index)) if order is None else order:
        doc, named, at, n = index[k].tolist()
        ids = np.frombuffer(unframe(file, at), entry["kind"])
        if len(ids) != n:
            raise ValueError(f"record {k} of {path} has {len(ids)} ids, its index says {n}")
        yield doc if named else None, int(starts[k]), ids


def read_records(spark, manifest: list[dict], seed: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all records, one task per file; with a seed in shuffled order within files."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                order = None if seed is None else np.random.default_rng((seed, k)).permutation(manifest[k]["records"]).tolist()
                rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in read_file(manifest[k], order)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.range(0, len(manifest), 1, max(1, len(manifest)))
    return files.mapInArrow(task(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
