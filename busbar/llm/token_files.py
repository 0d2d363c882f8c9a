"""Token ids as bit-packed files: each id in the fewest bits that its vocabulary needs.

A file holds whole documents in ascending order of their ids:

    magic, bits per id, ids per block, ids, documents
    document ids, whether each is null, the place of each document's first id
    byte offset of every block
    the blocks, each `ids per block` ids (the last one fewer), packed without gaps

A block begins at a byte border, so any stretch of ids is reached by its block
offsets and unpacked with a few numpy operations, whatever the width.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, work_path
from .common import SharedFolder, spread_files, table, take_over

MAGIC = b"TOKIDS01"
BLOCK_IDS = 4096
#: A file is closed once it has this many ids.
FILE_IDS = 4 << 20
#: Pieces of text whose ids a worker remembers, for each of its two tables.
CACHE_PIECES = 600_000
#: Text that is taken apart at a time: the more, the more often a piece is met again.
SLICE_BYTES = 4 << 20
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"

_HEAD = struct.Struct("<8sBIQQ")
_FILES = "folder string, part int, seq int, name string, n_docs long, n_ids long"


def id_bits(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids without gaps, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first `n` ids of a packed block: one unaligned 8-byte load, shift and mask for each."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    loads = np.ascontiguousarray(words[(at >> np.uint64(3)).astype(np.int64)]).view("<u8").ravel()
    return ((loads >> (at & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_parts(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, bits: int) -> Iterator[bytes]:
    """The bytes of one file."""
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    yield _HEAD.pack(MAGIC, bits, BLOCK_IDS, len(ids), len(doc_ids))
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    yield np.array([d is None for d in doc_ids], np.uint8).tobytes()
    yield np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
    yield np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes()
    yield from blocks


class TokenFile:
    """Random access to one open file."""

    def __init__(self, f):
        self.f = f
        magic, self.bits, self.block_ids, self.n_ids, n = _HEAD.unpack(self._read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        ids, nulls = np.frombuffer(self._read(8 * n), "<i8"), np.frombuffer(self._read(n), np.uint8)
        self.doc_ids = [None if gone else d for d, gone in zip(ids.tolist(), nulls)]
        self.starts = np.frombuffer(self._read(8 * (n + 1)), "<u8").astype(np.int64)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(self._read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.data = _HEAD.size + 8 * n + n + 8 * (n + 1) + 8 * (blocks + 1)

    def _read(self, n: int) -> bytes:
        got = bytes(self.f.read(n))
        if len(got) != n:
            raise ValueError("the token file ends early")
        return got

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids from place `lo` up to `hi`, reading the blocks that hold them and no others."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        self.f.seek(self.data + int(self.offsets[first]))
        raw = self._read(int(self.offsets[last + 1] - self.offsets[first]))
        base, out = int(self.offsets[first]), []
        if self.block_ids * self.bits % 8 == 0:  # full blocks join without padding bits
            out.append(unpack(raw, min((last + 1) * self.block_ids, self.n_ids) - first * self.block_ids, self.bits))
        else:
            for k in range(first, last + 1):
                cut = raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]
                out.append(unpack(cut, min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
        return np.concatenate(out)[lo - first * self.block_ids : hi - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
#: Marks that a word may end in; an apostrophe may join what follows it.
MARKS = string.punctuation.replace("'", "")


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, each piece of text encoded once per worker.

    The byte-level pattern always ends a word before a space that a letter, digit
    or ASCII punctuation mark follows, so a text may be cut there and each piece
    encoded by itself. Other spaces are never cut at. A piece that is one Latin
    word and marks behind it needs no pattern: the library's merges are applied to
    the word and to the marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.heads: dict[str, bytes] = {}  # a text's first piece, or several that stay together
        self.parts: dict[str, bytes] = {}  # a later piece, without its leading space
        self.marks: dict[str, bytes] = {}
        self.four = [struct.pack("<I", k) for k in range(self.vocabulary)]

    @staticmethod
    def _cut_before(part: str) -> bool:
        return part != "" and (part[0].isalnum() or "!" <= part[0] <= "~")

    def _merged(self, pretoken: str) -> bytes:
        if not pretoken.isascii():
            pretoken = pretoken.encode().decode("latin-1").translate(BYTE_LETTERS)
        four = self.four
        return b"".join([four[t.id] for t in self.merge(pretoken)])

    def _learn(self, known: dict[str, bytes], pieces: Iterable[str], lead: str) -> None:
        other, marks, merge, four = [], self.marks, self.merge, self.four
        space = lead and BYTE_LETTERS[32]
        for p in pieces:
            word = p.rstrip(MARKS)
            if word.isalpha() and ((plain := word.isascii()) or max(word) < "\u0250"):
                ids = b"".join([four[t.id] for t in merge(space + word)]) if plain else self._merged(lead + word)
                if len(word) < len(p):
                    tail = p[len(word) :]
                    if tail not in marks:
                        if len(marks) > CACHE_PIECES:
                            marks.clear()
                        marks[tail] = self._merged(tail)
                    ids += marks[tail]
                known[p] = ids
            else:
                other.append(p)
        for p, got in zip(other, self.tokenizer.encode_batch_fast([lead + p for p in other], add_special_tokens=False)):
            known[p] = array("I", got.ids).tobytes()

    @staticmethod
    def _bound(known: dict[str, bytes]) -> None:
        """Short pieces recur, so they stay when a table is full."""
        if len(known) > CACHE_PIECES:
            short = {p: ids for p, ids in known.items() if len(p) <= 8}
            known.clear()
            known.update(short if len(short) < CACHE_PIECES // 2 else {})

    def _safe(self, column: pa.Array, pieces: list[str]) -> np.ndarray:
        """For each piece, whether a text may be cut before the space in front of it."""
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer((column.buffers()[2] or b"") if len(column) else b"", np.uint8)
        some = np.flatnonzero(ends[1:] > ends[:-1])
        out = np.zeros(len(pieces), bool)
        first = data[ends[some]]
        out[some] = (first >= ord("!")) & (first <= ord("~"))
        for k in some[first >= 128].tolist():
            out[k] = self._cut_before(pieces[k])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Arrow splits the texts and numbers their different pieces; Python looks
        up each different piece once, and the ids are gathered by those numbers.
        """
        if not texts:
            return []
        self._bound(self.heads)
        self._bound(self.parts)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        codes, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        starts = bounds[:-1]
        later = np.ones(len(codes), bool)
        later[starts] = False
        needed = np.zeros(len(pieces), bool)
        needed[codes[later]] = True
        safe = self._safe(coded.dictionary, pieces)
        odd = needed & ~safe
        whole = np.zeros(len(texts), bool)  # texts with a space that must not be cut at
        if odd.any():
            whole[np.searchsorted(bounds, np.flatnonzero(later & odd[codes]), "right") - 1] = True
        parts = self.parts
        self._learn(parts, [p for p, want in zip(pieces, (needed & safe).tolist()) if want and p not in parts], " ")
        rejoined = {t: self._rejoin(texts[t].split(" ")) for t in np.flatnonzero(whole).tolist()}
        heads = [pieces[c] for c in codes[starts].tolist()]
        firsts = {h for t, h in enumerate(heads) if not whole[t]} | {h for j in rejoined.values() for h in j}
        self._learn(self.heads, [h for h in firsts if h not in self.heads], "")

        known = [parts.get(p, b"") for p in pieces] + [b"" if whole[t] else self.heads[h] for t, h in enumerate(heads)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, places = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        codes[starts] = len(pieces) + np.arange(len(texts))
        n = sizes[codes]
        ends = np.cumsum(n)
        flat = ids[np.repeat(places[codes] - (ends - n), n) + np.arange(n.sum())].tobytes()
        cuts = np.append(0, 4 * ends[bounds[1:] - 1]).tolist()
        return [b"".join(map(self.heads.__getitem__, rejoined[t])) if t in rejoined else flat[a:b] for t, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def _rejoin(self, parts: list[str]) -> list[str]:
        """Pieces of a text with spaces that must not be cut at."""
        out = [[parts[0]]]
        for p in parts[1:]:
            if self._cut_before(p):
                out.append(["", p])
            else:
                out[-1].append(p)
        return [" ".join(o) for o in out]


@lru_cache(1)
def _encoder(path: str) -> PieceEncoder:
    """The worker's encoder; what it has learnt serves the worker's next tasks."""
    return PieceEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_BYTES of text, or of one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _encode_task(uri: str, path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("token_files", _encoder.cache_clear)
        encoder, folder, part = _encoder(path), SharedFolder(uri), TaskContext.get().partitionId()
        bits, end = id_bits(encoder.vocabulary), np.array([end_id], "<u4").tobytes()
        seq, doc_ids, sizes, held = 0, [], [], []

        def flush():
            nonlocal seq, doc_ids, sizes, held
            name = f"part-{part:06d}-{seq:04d}.tok"
            ids = np.frombuffer(b"".join(held), "<u4")
            with folder.create(name) as out:
                for x in file_parts(doc_ids, sizes, ids, bits):
                    out.write(x)
            row = {"folder": [uri], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name], "n_docs": [len(sizes)], "n_ids": [len(ids)]}
            seq, doc_ids, sizes, held = seq + 1, [], [], []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for cut in _slices(batch):
                for doc_id, ids in zip(cut.column(0).to_pylist(), encoder.encode([t or "" for t in cut.column(1).to_pylist()])):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    sizes.append(len(ids) // 4 + 1)
                if sum(sizes) >= file_ids:
                    yield flush()
        if sizes:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending key order; one row per file, with the ids before it.

    Null text is empty, and an empty text is the end id alone. Null keys come
    first; rows with one key are ordered by a hash of their text. No rows give
    no files.
    """
    task = _encode_task(work_path(docs.sparkSession, "tokens"), path, end_id, FILE_IDS)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = materialize(placed.mapInArrow(task, _FILES), "token-files")
    # Prefix sums in two levels, so that no task sees a row for every file.
    files = files.withColumn("shelf", F.floor(F.col("part") / 1000))
    shelves = files.groupBy("shelf").agg(F.sum("n_ids").alias("ids"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    shelves = shelves.select("shelf", F.coalesce(F.sum("ids").over(upto.orderBy("shelf")), F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(upto.partitionBy("shelf").orderBy("part", "seq"))
    return files.withColumn("inside", F.coalesce(inside, F.lit(0))).join(shelves, "shelf").select(
        "folder", "name", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("start")
    )


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            with SharedFolder(file["folder"]).open(file["name"]) as f:
                tokens = TokenFile(f)
                if (len(tokens.doc_ids), tokens.n_ids) != (file["n_docs"], file["n_ids"]):
                    raise ValueError(f"{file['name']} is not the file that was written")
                ids = tokens.ids(0, tokens.n_ids)
            sums = [zlib.crc32(ids[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(tokens.starts, tokens.starts[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(tokens.doc_ids, pa.int64()),
                "start": pa.array(tokens.starts[:-1] + file["start"], pa.int64()),
                "n_tokens": pa.array(np.diff(tokens.starts), pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
                "bits": pa.array([tokens.bits] * len(sums), pa.int32()),
                "file": [file["name"]] * len(sums),
            })


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files: its place, its number of ids and their checksum."""
    return spread_files(files).mapInArrow(
        _read_task, "doc_id long, start long, n_tokens long, ids_crc32 long, bits int, file string"
    )


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_vocabulary())
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_files": op1_token_files}
SQL: dict[str, str] = {}
