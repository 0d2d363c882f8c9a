"""Scoring texts with an interpolated modified Kneser-Ney bigram model.

The counts are made in Spark and stored as sorted arrays that workers map into
memory instead of loading:

- words: the sorted 64-bit hashes of all training words, in shards by their
  leading bits, and how often each occurs; a word's number is its place there
- word statistics, by number: in how many contexts the word occurs, and of the
  word as a context how many tokens follow and how many different words follow
  once, twice, and three times or more
- bigrams: sorted keys of both numbers and their counts, in shards by context

Words are found, hashed and looked up for many texts together, each different
word and each different pair of them once. Counts are shuffled as packed arrays,
one for each shard and some million tokens, and added where a shard is written.

A context with more than a thousandth of all tokens is spread over all shards,
so no task holds a hot context. All statistics are sums over bigrams, so it does
not matter where a context's bigrams are.

    p(w | h) = (max(c(hw) - D(c(hw)), 0) + G(h) p(w)) / c(h)
    p(w)     = (max(n(w) - D'(n(w)), 0) + G' / (V + 1)) / n

with n(w) the contexts of w, n all bigrams, G(h) what the discounts of h's
followers add up to, and V + 1 for the words and the unknown word.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_path
from .common import LOWER, SPACES, SharedFolder, annotate, held_out, mix64, table, utf8

#: Tokens that a task counts at a time.
COUNTED = 4_000_000
#: Texts that are taken apart together.
SLICE = 600
#: Words in a shard and ids in a block of statistics are about 2 to this power; bigrams in a shard about so many tokens'.
WORD_BITS, SHARD_TOKENS = 18, 2_000_000
#: Contexts with more than 1/HOT_SHARE of all tokens are spread.
HOT_SHARE = 1000
CACHE_WORDS = 300_000
#: The end of a text is a token of its own; no word is empty.
END = b""

_COUNT = struct.Struct("<Q")
_STATS = np.dtype([("contexts", "<i8"), ("total", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8")])


_BREAKS = bytes(b in SPACES for b in range(256))
_END_HASH = xxhash.xxh3_64_intdigest(END)
#: Fixed values of the xxh3 hash: what words of up to 3, 8 and 16 bytes are mixed with.
_FLIP_3, _FLIP_8, _FLIP_LOW, _FLIP_HIGH = 0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A
#: Words that are longer are hashed one by one.
_SHORT = 16


def _folded_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper half of each 128-bit product, xor its lower half."""
    low = np.uint64(0xFFFFFFFF)
    al, ah, bl, bh = a & low, a >> 32, b & low, b >> 32
    cross = ah * bl
    middle = (al * bl >> 32) + (cross & low) + al * bh
    return (cross >> 32) + (middle >> 32) + ah * bh ^ a * b


def hashes_of(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh3 of the words raw[start:end], none of them empty; `raw` goes on for 8 bytes behind the last."""
    sizes, out = ends - starts, np.empty(len(starts), np.uint64)
    eight = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))  # the 8 bytes from every place on
    k = np.flatnonzero(sizes <= 3)
    n, x = sizes[k].astype(np.uint64), eight[starts[k]]
    x = (x & 255) << 16 | (x >> (n >> 1) * 8 & 255) << 24 | x >> (n - 1) * 8 & 255 | n << 8
    x ^= np.uint64(_FLIP_3)
    x = (x ^ x >> 33) * 0xC2B2AE3D27D4EB4F
    x = (x ^ x >> 29) * 0x165667B19E3779F9
    out[k] = x ^ x >> 32
    k = np.flatnonzero((sizes > 3) & (sizes <= 8))
    x = ((eight[ends[k] - 4] & 0xFFFFFFFF) + (eight[starts[k]] << 32)) ^ _FLIP_8
    x = (x ^ (x << 49 | x >> 15) ^ (x << 24 | x >> 40)) * 0x9FB21C651E98DF25
    x = (x ^ (x >> 35) + sizes[k].astype(np.uint64)) * 0x9FB21C651E98DF25
    out[k] = x ^ x >> 28
    k = np.flatnonzero((sizes > 8) & (sizes <= _SHORT))
    low, high = eight[starts[k]] ^ _FLIP_LOW, eight[ends[k] - 8] ^ _FLIP_HIGH
    x = sizes[k].astype(np.uint64) + low.byteswap() + high + _folded_product(low, high)
    x = (x ^ x >> 37) * 0x165667919E3779F9
    out[k] = x ^ x >> 32
    for k in np.flatnonzero(sizes > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return out


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, and the place of each text's first; the end of a text is a token."""
    texts = [t or b"" for t in texts]
    raw = b"\n".join([b"", *texts, b"       \n"]).translate(LOWER)
    gap = np.frombuffer(raw.translate(_BREAKS), np.bool_)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # up to the end of each text
    ending = words + np.arange(len(texts))
    out = np.empty(len(starts) + len(texts), np.uint64)
    inside = np.ones(len(out), np.bool_)
    inside[ending] = False
    out[inside], out[ending] = hashes_of(raw, starts, ends), _END_HASH
    return out, np.append(0, ending[:-1] + 1)


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in some arrays and how often each occurs; the arrays are given up on the way."""
    flat = np.concatenate(held)
    held.clear()
    flat.sort()
    edges = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[edges], np.diff(np.append(edges, len(flat)))


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[bytes | None]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield utf8(batch.column(column).slice(lo, SLICE))


def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def drain() -> pa.RecordBatch:
        words, counts = _counted(held)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    for texts in _texts(batches):
        held.append(token_hashes(texts)[0])
        n += len(held[-1])
        if n > COUNTED:
            yield drain()
            n = 0
    if held:
        yield drain()


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed: the lowest bytes of all of them, then the next, as small numbers have few."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _columns_file(folder: SharedFolder, name: str, arrays: list[np.ndarray]) -> None:
    with folder.create(name) as out:
        out.write(_COUNT.pack(len(arrays[0])))
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)


@lru_cache(4096)
def _mapped(uri: str, name: str) -> np.ndarray:
    """The bytes of a shared file, as a memory map; a file of a remote store is first copied next to the task."""
    folder = SharedFolder(uri)
    path = folder.local(name)
    if path is None:
        fd, path = tempfile.mkstemp(prefix="ngrams-")
        with os.fdopen(fd, "wb") as copy, folder.open(name) as f:
            while part := f.read(8 << 20):
                copy.write(part)
        data = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the map keeps it until the worker ends
        return data
    return np.memmap(path, np.uint8, "r")


def _columns(uri: str, name: str, *kinds: str) -> list[np.ndarray]:
    data = _mapped(uri, name)
    n, at, out = _COUNT.unpack(data[: _COUNT.size].tobytes())[0], _COUNT.size, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(data[at : at + size].view(kind))
        at += size
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each value of the first column, which they are sorted by."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in names}
        key = rows[names[0]]
        if not len(key):
            continue
        edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and held[0][names[0]][0] != key[lo]:
                yield {c: np.concatenate([h[c] for h in held]) for c in names}
                held = []
            held.append({c: rows[c][lo:hi] for c in names})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


def _packed_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The same for a few rows with packed arrays."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _write_words(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = SharedFolder(uri)
        for rows in _groups(batches, ["shard", "word", "n"]):
            shard = int(rows["shard"][0])
            _columns_file(folder, f"words-{shard}", [rows["word"].view(np.uint64), rows["n"]])
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(rows["n"])])], ["shard", "n"])

    return run


def _alike(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of some small numbers with the places where it stands, in ascending order."""
    if len(numbers) and int(numbers.max()) < 1 << 15:
        numbers = numbers.astype(np.int16)  # sorted by digits
    order = np.argsort(numbers, kind="stable")
    edges = np.flatnonzero(np.diff(numbers[order])) + 1
    for own in np.split(order, edges):
        if len(own):
            yield int(numbers[own[0]]), own


@dataclass
class Words:
    """The stored words: number and count of each."""

    uri: str
    bits: int  # leading bits of a hash that name its shard
    sizes: np.ndarray  # words of each shard
    tokens: int
    block_bits: int  # a block of statistics has two to this power words

    def __post_init__(self) -> None:
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.size = int(self.offsets[-1])
        self.known: dict[bytes, int] = {}

    def _of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for s, own in _alike((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.sizes[s]:
                keys, _ = _columns(self.uri, f"words-{s}", "<u8", "<i8")
                at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
                out[own] = np.where(keys[at] == hashes[own], at + self.offsets[s], -1)
        return out

    def of_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the different words in some texts, which of them each token is, and the place of each text's first token."""
        hashes, first = token_hashes(texts)
        different, which = np.unique(hashes, return_inverse=True)
        return self._of(different), which, first

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        """Number of each token of a list, -1 if training has no such word; for whole texts see `of_texts`."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = np.fromiter(map(known.get, tokens, repeat(-2)), np.int64, len(tokens))
        at = np.flatnonzero(out == -2)
        if len(at):
            missed = [tokens[k] for k in at.tolist()]
            new = list(set(missed))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            order = np.argsort(hashes)  # so that a search walks forwards
            known.update(zip([new[k] for k in order.tolist()], self._of(hashes[order]).tolist()))
            out[at] = np.fromiter(map(known.__getitem__, missed), np.int64, len(missed))
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for s, own in _alike(np.where(numbers >= 0, np.searchsorted(self.offsets, numbers, side="right") - 1, -1)):
            if s >= 0:
                out[own] = _columns(self.uri, f"words-{s}", "<u8", "<i8")[1][numbers[own] - self.offsets[s]]
        return out


def count_words(texts: DataFrame, uri: str) -> tuple[Words, list[int]]:
    """Store the words of `texts`; and the hashes of the hot ones, fewer than HOT_SHARE."""
    counts = texts.mapInArrow(_word_task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    all_ = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bits = max(1, (all_.v >> WORD_BITS).bit_length())
    placed = counts.withColumn("shard", F.shiftrightunsigned("word", 64 - bits)).repartition("shard").sortWithinPartitions("shard", "word")
    stored = materialize(placed.select("shard", "word", "n").mapInArrow(_write_words(uri), "shard long, n long"), "word-files")
    sizes = np.zeros(1 << bits, np.int64)
    for r in stored.collect():  # a row for each file
        sizes[r.shard] = r.n
    hot = [r.word for r in counts.filter(F.col("n") > max(all_.n // HOT_SHARE, 1)).select("word").collect()]
    return Words(uri, bits, sizes, all_.n, WORD_BITS), hot


def _shard(words: Words, hot: np.ndarray, bits: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Shard of each pair of numbers; `hot` is sorted."""
    key = one.astype(np.uint64)
    spread = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, one), len(hot) - 1)] == one)
    key[spread] ^= mix64(two[spread], 5)
    return (mix64(key, 6) >> np.uint64(64 - bits)).astype(np.int64)


_BIGRAMS = "shard long, size long, bigrams binary, n binary"


def _bigram_task(words: Words, hot: np.ndarray, bits: int):
    """A row for each shard and some million tokens: the different bigrams, as distances, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def drain() -> pa.RecordBatch:
            keys, counts = _counted(held)
            rows = []
            for shard, own in _alike(_shard(words, hot, bits, keys >> 32, keys & 0xFFFFFFFF)):
                rows.append((shard, len(own), _packed(np.diff(keys[own], prepend=0)), _packed(counts[own])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "size", "bigrams", "n"])

        for texts in _texts(batches):
            numbers, which, first = words.of_texts(texts)
            flat = numbers[which]
            before = np.append(words.size, flat[:-1])  # the first token of a text follows the number after the last word's
            before[first] = words.size
            held.append(before << 32 | flat)
            n += len(flat)
            if n > COUNTED:
                yield drain()
                n = 0
        if held:
            yield drain()

    return run


_PARTS = "shard long, total long, n1 long, n2 long, n3 long, n4 long, block long, size long, stats binary"
_SEEN = ("n1", "n2", "n3", "n4", "more")


def _write_bigrams(uri: str, bits: int):
    """Writes a file for each shard; a row for the file, and one for each block of words with sums over the file's bigrams."""
    names = [part.split()[0] for part in _PARTS.split(", ")]

    def row(**values) -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([values.get(c)], k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = SharedFolder(uri)
        for rows in _packed_groups(batches, ["shard", "size", "bigrams", "n"]):
            shard = rows[0][0]
            keys = np.concatenate([np.cumsum(_unpacked(data, size)) for _, size, data, _ in rows])
            n = np.concatenate([_unpacked(data, size) for _, size, _, data in rows])
            del rows
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            del order
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, n = keys[edges], np.add.reduceat(n, edges)
            _columns_file(folder, f"bigrams-{shard}", [keys, n])
            # The file's number of bigrams, and of those seen one to four times.
            yield row(shard=shard, total=len(keys), **{f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)})
            one = keys >> 32
            edges = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            two, contexts = np.unique(keys & 0xFFFFFFFF, return_counts=True)
            ids = np.union1d(one[edges], two)
            stats = np.zeros((len(_STATS.names), len(ids)), np.int64)
            stats[0, np.searchsorted(ids, two)] = contexts
            at = np.searchsorted(ids, one[edges])
            for k, x in enumerate((n, n == 1, n == 2, n >= 3), 1):
                stats[k, at] = np.add.reduceat(x.astype(np.int64), edges)
            bounds = np.append(np.flatnonzero(np.append(True, ids[1:] >> bits != ids[:-1] >> bits)), len(ids))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                block = int(ids[lo]) >> bits
                packed = _packed(np.concatenate([np.diff(ids[lo:hi], prepend=block << bits), stats[:, lo:hi].ravel()]))
                yield row(block=block, size=hi - lo, stats=packed)

    return run


def _write_stats(uri: str, bits: int):
    """Adds up what the files say of each block; a row with the number of its words with one to four contexts, and three or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = SharedFolder(uri)
        for rows in _packed_groups(batches, ["block", "size", "stats"]):
            block, stats = rows[0][0], np.zeros(1 << bits, _STATS)
            for _, size, data in rows:
                ids, *sums = _unpacked(data, size * (1 + len(_STATS.names))).reshape(-1, size)
                ids = np.cumsum(ids)  # each once in a row
                for c, values in zip(_STATS.names, sums):
                    stats[c][ids] += values
            _columns_file(folder, f"stats-{block}", [stats.view(np.uint8)])
            k = stats["contexts"]
            seen = [(k == 1).sum(), (k == 2).sum(), (k == 3).sum(), (k == 4).sum(), (k >= 3).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (block, *seen)], ["block", *_SEEN])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """The modified discounts for counts of 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.1), k) for k, d in enumerate(found, 1))])


@dataclass
class Model:
    """The stored model; arrays are opened where they are used."""

    words: Words
    shards: set[int]
    bits: int
    hot: np.ndarray
    blocks: set[int]
    bigram_discounts: np.ndarray
    word_discounts: np.ndarray
    bigrams: int
    word_rest: float  # what the word discounts add up to

    def _stats(self, numbers: np.ndarray) -> np.ndarray:
        out, bits = np.zeros(len(numbers), _STATS), self.words.block_bits
        for b, own in _alike(np.where(numbers >= 0, numbers >> bits, -1)):
            if b in self.blocks:
                stored = _mapped(self.words.uri, f"stats-{b}")[_COUNT.size :].view(_STATS)
                out[own] = stored[numbers[own] - (b << bits)]
        return out

    def _bigram_counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), np.int64)
        known = np.flatnonzero((one >= 0) & (two >= 0))
        one, two = one[known], two[known]
        keys = one << 32 | two
        for s, own in _alike(_shard(self.words, self.hot, self.bits, one, two)):
            if s in self.shards:
                stored, n = _columns(self.words.uri, f"bigrams-{s}", "<i8", "<i8")
                at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
                out[known[own]] = np.where(stored[at] == keys[own], n[at], 0)
        return out

    def log10(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log probability of each token `two` after `one`."""
        ids, which = np.unique(np.concatenate([one, two]), return_inverse=True)
        return self.log10_of(ids, which[: len(one)], which[len(one) :])

    def log10_of(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The same for places in a list of words, each of which is looked up once, and so is each different pair of places."""
        v, own, d = self.words.size, self._stats(ids), self.bigram_discounts
        contexts = own["contexts"]
        lower = (np.maximum(contexts - self.word_discounts[np.minimum(contexts, 3)], 0) + self.word_rest / (v + 1)) / self.bigrams if self.bigrams else np.full(len(ids), 1 / (v + 1))
        rest = d[1] * own["n1"] + d[2] * own["n2"] + d[3] * own["n3"]
        total = own["total"]
        pairs, which = np.unique(one * len(ids) + two, return_inverse=True)
        one, two = np.divmod(pairs, len(ids))  # in ascending order, so that a search walks forwards
        c, lower, total = self._bigram_counts(ids[one], ids[two]), lower[two], total[one]
        higher = (np.maximum(c - d[np.minimum(c, 3)], 0) + rest[one] * lower) / np.maximum(total, 1)
        return np.log10(np.where(total > 0, higher, lower))[which]


def fit(docs: DataFrame, train: Column, text: str = "text") -> Model:
    """A model of the texts where `train` holds."""
    texts = docs.filter(train).select(F.col(text))
    uri = work_path(docs.sparkSession, "ngrams")
    words, hot_hashes = count_words(texts, uri)
    if words.size >= 1 << 31:
        raise ValueError("more than 2**31 distinct words; numbers of two of them do not fit a key")
    hot = np.append(np.sort(words._of(np.array(hot_hashes, np.int64).view(np.uint64))), words.size)
    bits = max(1, (words.tokens // SHARD_TOKENS).bit_length())
    counts = texts.mapInArrow(_bigram_task(words, hot, bits), _BIGRAMS).repartition("shard").sortWithinPartitions("shard")
    parts = materialize(counts.mapInArrow(_write_bigrams(uri, WORD_BITS), _PARTS), "bigram-parts")
    files = parts.filter("shard IS NOT NULL").select("shard", "total", "n1", "n2", "n3", "n4").collect()  # a row for each file
    placed = parts.filter("block IS NOT NULL").select("block", "size", "stats").repartition("block").sortWithinPartitions("block")
    blocks = materialize(placed.mapInArrow(_write_stats(uri, WORD_BITS), ", ".join(f"{c} long" for c in ("block", *_SEEN))), "stat-files")
    blocks = blocks.collect()  # a row for each block
    n1, n2, n3, n4, more = (sum(r[c] for r in blocks) for c in _SEEN)
    d = discounts([n1, n2, n3, n4])
    return Model(
        words, {r.shard for r in files}, bits, hot, {r.block for r in blocks},
        discounts([sum(r[f"n{k}"] for r in files) for k in (1, 2, 3, 4)]), d,
        sum(r.total for r in files), float(d[1] * n1 + d[2] * n2 + d[3] * more),
    )


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score.

    A null text is empty and consists of its end alone. A word that training has
    not seen is the unknown word; without training data every token has
    probability 1. Repeated rows are scored alike; columns of the same names are
    replaced, all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sizes and discounts, no counts

    def make():
        model = shared.value
        words = model.words
        floor = np.log10(words.tokens + words.size + 1)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for texts in _texts([batch], batch.schema.get_field_index(text)):
                numbers, two, first = words.of_texts(texts)
                one = np.append(0, two[:-1])
                one[first] = len(numbers)  # what stands before a text
                base = np.log10(words.counts(numbers) + 1) - floor
                found = model.log10_of(np.append(numbers, words.size), one, two)
                columns[0].append(np.diff(first, append=len(two)))
                for column, values in zip(columns[1:], ((numbers >= 0)[two], base[two], found)):
                    column.append(np.add.reduceat(values.astype(np.float64), first))
            n, known, base, found = (np.concatenate(c) for c in columns)
            return [pa.array(n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), words.tokens)), pa.array(base), pa.array(found)]

        return step

    return annotate(docs, make, "n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    out = score(docs, fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_kneser_ney": op8_kneser_ney}
SQL: dict[str, str] = {}
