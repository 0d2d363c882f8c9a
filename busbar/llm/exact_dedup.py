"""Exact deduplication by a Grace hash over complete texts.

Each map task first folds its own rows into an open-addressing table, so a text
with a third of all rows leaves every task once. The folded records are dealt
out by a hash of the text; the receiving task folds them again and, whenever the
distinct texts in its table outgrow the budget, partitions the table to spill
files by further bits of the hash. Every spill file is read back the same way,
recursively, until its distinct texts fit. Two records are one text only if all
their bytes are equal; the hash only finds the slot.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, join_groups, per_batch, table, utf8

#: Bytes of distinct text that a table holds before it spills.
TABLE_BYTES = 64 << 20
FAN_OUT_BITS = 4
HASH_BITS = 64

_RECORD = struct.Struct("<QqqI")  # hash, largest id, rows, bytes of text
_NO_ID = -(1 << 63)  # stands for "no id yet", below every id


class OpenTable:
    """Distinct texts with their largest id and row count, by linear probing."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, h: int, text: bytes, doc_id: int, n: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                self.counts[k] += n
                if doc_id > self.ids[k]:
                    self.ids[k] = doc_id
                return
            at = (at + 1) & mask
        slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.ids.append(doc_id)
        self.counts.append(n)
        self.bytes += len(text)
        if 2 * len(self.texts) > len(slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def records(self) -> Iterator[tuple[int, bytes, int, int]]:
        return zip(self.hashes, self.texts, self.ids, self.counts)


def grace(
    records: Iterator[tuple[int, bytes, int, int]], budget: int, folder: str, level: int = 0
) -> Iterator[OpenTable]:
    """Tables that together hold every distinct text once, none with more than `budget` bytes of them.

    A single text larger than the budget has a table of its own; texts whose
    whole hashes are equal share the last level's table.
    """
    held, files = OpenTable(), None
    last = FAN_OUT_BITS * (level + 1) > HASH_BITS
    shift = max(HASH_BITS - FAN_OUT_BITS * (level + 1), 0)
    fan = 1 << FAN_OUT_BITS
    paths = [os.path.join(folder, f"{level}-{k}") for k in range(fan)]
    for h, text, doc_id, n in records:
        held.add(h, text, doc_id, n)
        if held.bytes > budget and len(held.texts) > 1 and not last:
            if files is None:
                files = [open(p, "wb") for p in paths]
            _spill(held, files, shift, fan)
            held = OpenTable()
    if files is None:
        yield held
        return
    _spill(held, files, shift, fan)
    del held
    for f in files:
        f.close()
    for k, path in enumerate(paths):
        with tempfile.TemporaryDirectory(dir=folder) as below:
            yield from grace(_read_spill(path), budget, below, level + 1)
        os.unlink(path)


def _spill(held: OpenTable, files: list, shift: int, fan: int) -> None:
    for h, text, doc_id, n in held.records():
        out = files[(h >> shift) & (fan - 1)]
        out.write(_RECORD.pack(h, doc_id, n, len(text)))
        out.write(text)


def _read_spill(path: str) -> Iterator[tuple[int, bytes, int, int]]:
    with open(path, "rb") as f:
        while head := f.read(_RECORD.size):
            h, doc_id, n, size = _RECORD.unpack(head)
            yield h, f.read(size), doc_id, n


_FOLDED = pa.schema([("bucket", pa.int64()), ("content", pa.large_binary()), ("top", pa.int64()), ("n", pa.int64())])
_GROUPS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = OpenTable()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            text = (text or b"").translate(LOWER)
            held.add(xxhash.xxh3_64_intdigest(text), text, _NO_ID if doc_id is None else doc_id, 1)
            if held.bytes > TABLE_BYTES // 2:
                yield from _folded(held)
                held = OpenTable()
    yield from _folded(held)


def _folded(held: OpenTable) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(held.texts), 500):
        cut = slice(lo, lo + 500)
        hashes = np.array(held.hashes[cut], np.uint64).view(np.int64)
        columns = [hashes, held.texts[cut], held.ids[cut], held.counts[cut]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOLDED.types)], schema=_FOLDED)


def _grace_task(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                hashes = batch.column(0).to_numpy().view(np.uint64).tolist()
                yield from zip(hashes, *(batch.column(k).to_pylist() for k in (1, 2, 3)))

        with tempfile.TemporaryDirectory() as folder:
            for held in grace(records(), budget, folder):
                digests = [hashlib.sha256(t).hexdigest() for t in held.texts]
                ids = [None if x == _NO_ID else x for x in held.ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip((digests, ids, held.counts), _GROUPS.types)], schema=_GROUPS
                )

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct lower-cased text: its digest, the largest key, and how many rows have it."""
    folded = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        _fold_task, "bucket long, content binary, top long, n long"
    )
    return folded.repartition("bucket").mapInArrow(
        _grace_task(budget), "text_sha256 string, keep_id long, group_size long"
    )


def _digests():
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [hashlib.sha256((t or b"").translate(LOWER)).hexdigest() for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], schema=schema)

    return step


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """Every row of `docs` with its group of equal texts and whether it stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest key stays. Keys are meant to be unique: of repeated
    rows with one key and one text each is marked as kept. A null key is below
    every other; a group of null keys alone keeps them all. No rows give no
    rows, and other columns are not read.
    """
    groups = materialize(exact_groups(docs, key, text, budget), "exact-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        per_batch(_digests), "doc_id long, text_sha256 string"
    )
    out = join_groups(rows, groups, "text_sha256", "group_size", total)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {"op4_exact_dedup": OP4_SQL}
