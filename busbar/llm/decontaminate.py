"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of 13 words (an item of fewer words is one
window). A window can only occur in a document that has all shingles of the
window, so one shingle, its rarest in the corpus, is a sufficient prefix. Pass
one counts the items' shingles over all documents; windows with a shingle that
no document has are gone. Pass two joins the documents' shingles with the prefix
shingles, places each match by the shingle's offset in its window, drops what
would reach over an end of the document, and compares the remaining places word
by word.

The items are a table of their own size, not of the corpus': they are kept as
Parquet in blocks of a bounded number of windows, which every task reads one
after the other, so a large benchmark needs more time and no more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_path
from .common import LOWER, SharedFolder, annotate, table, take_over, utf8

WINDOW_WORDS = 13
SHINGLE_WORDS = 4
#: Windows in a block; a task holds one block at a time.
BLOCK_WINDOWS = 100_000
#: Texts that are taken apart at a time, and their bytes when shingles are counted and when hits are looked for.
SLICE_TEXTS, COUNTED_BYTES, SLICE_BYTES = 1000, 1 << 20, 4 << 20
#: A document is contaminated if one word in so many is hit, and at least one is.
HIT_SHARE = 20

#: Word characters are ASCII letters, digits and everything beyond ASCII; A-Z are lower-cased.
_WORD_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _slices(column: pa.Array, most: int) -> Iterator[list[bytes | None]]:
    """The texts of a batch, few at a time; a text that is longer comes by itself."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > lo and (held + size > most or k - lo >= SLICE_TEXTS):
            yield utf8(column.slice(lo, k - lo))
            lo, held = k, 0
        held += size
    if len(sizes):
        yield utf8(column.slice(lo))


def _give_up() -> None:
    _all_shingles.cache_clear()
    _prefixes.cache_clear()


def _windows_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, items = [], []
        for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = words_of(text)
            for k in range(max(len(words) - WINDOW_WORDS, 0) + 1 if words else 0):
                found.append(b" ".join(words[k : k + WINDOW_WORDS]).decode())
                items.append(item)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], ["window", "item"])


class Block:
    """Some windows, and where their shingles are looked up."""

    def __init__(self, windows: list[str], entries: list[tuple[int, int, int]]):
        """entries: window, offset and length of each shingle that is looked up; a match also has its number."""
        split = [w.encode().split() for w in windows]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s), 1)}
        self.number = vocabulary.get
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.words = np.zeros((len(split), WINDOW_WORDS), np.int64)
        for k, s in enumerate(split):
            self.words[k, : len(s)] = [vocabulary[w] for w in s]
        self.lookups = []
        at = np.array(entries, np.int64).reshape(-1, 3)
        at = np.column_stack([at, np.arange(len(at))])
        for size in np.unique(at[:, 2]):
            own = at[at[:, 2] == size]
            keys = shingle_keys(self.words, int(size))[own[:, 0], own[:, 1]]
            order = np.argsort(keys, kind="stable")
            self.lookups.append((int(size), keys[order], own[order]))

    def numbers(self, docs: list[list[bytes]]) -> np.ndarray:
        """The words of several documents as numbers, a 0 behind each; 0 also is a word that no window has."""
        number, flat = self.number, []
        for words in docs:
            flat += [number(w, 0) for w in words]
            flat.append(0)
        return np.array(flat, np.int64)

    def matches(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in `flat` and the entries whose shingle stands there."""
        for size, keys, own in self.lookups:
            if len(flat) < size:
                continue
            known = np.lib.stride_tricks.sliding_window_view(flat > 0, size).all(axis=1)
            at = np.flatnonzero(known)
            got = shingle_keys(flat[None, :], size)[0, at]
            lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            for cut in range(0, len(at), 20_000):  # a passage that every document has meets each window it is in
                a, b, c = at[cut : cut + 20_000], lo[cut : cut + 20_000], n[cut : cut + 20_000]
                first = np.repeat(np.cumsum(c) - c, c)
                yield np.repeat(a, c), own[np.repeat(b, c) + np.arange(c.sum()) - first]


def shingle_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for each run of `size` words in every row."""
    n = words.shape[1] - size + 1
    keys = np.zeros((words.shape[0], max(n, 0)), np.uint64)
    for k in range(size):
        keys = (keys ^ words[:, k : k + n].astype(np.uint64)) * _FACTOR
        keys ^= keys >> np.uint64(29)
    return keys


class WindowFiles:
    """The stored windows, block by block."""

    def __init__(self, uri: str, blocks: int):
        self.uri, self.blocks = uri, blocks

    def read(self, k: int) -> dict[str, list]:
        folder = SharedFolder(self.uri)
        stored = ds.dataset(f"{folder.root}/block={k}", filesystem=folder.files, format="parquet")
        return stored.to_table(filter=ds.field("window").is_valid()).to_pydict()


@lru_cache(1)
def _all_shingles(uri: str, k: int) -> tuple[Block, list[str]]:
    """A block with every distinct shingle, and their texts."""
    windows = WindowFiles(uri, 0).read(k)["window"]
    seen: dict[str, tuple[int, int, int]] = {}
    for w, text in enumerate(windows):
        for offset, shingle in enumerate(shingles_of(text)):
            seen.setdefault(shingle, (w, offset, shingle.count(" ") + 1))
    return Block(windows, list(seen.values())), list(seen)


@lru_cache(1)
def _prefixes(uri: str, k: int) -> tuple[Block, list[list[str]]]:
    got = WindowFiles(uri, 0).read(k)
    entries = list(zip(range(len(got["window"])), got["offset"], got["size"]))
    return Block(got["window"], entries), got["items"]


def shingles_of(window: str) -> list[str]:
    words = window.split(" ")
    size = min(SHINGLE_WORDS, len(words))
    return [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def _count_task(files: WindowFiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("decontaminate", _give_up)
        sums: list[np.ndarray | None] = [None] * files.blocks
        for batch in batches:
            for k in range(files.blocks):
                block, texts = _all_shingles(files.uri, k)
                if sums[k] is None:
                    sums[k] = np.zeros(len(texts), np.int64)
                for part in _slices(batch.column(0), COUNTED_BYTES):
                    for _, entries in block.matches(block.numbers([words_of(t) for t in part])):
                        sums[k] += np.bincount(entries[:, 3], minlength=len(texts))
        for k, found in enumerate(sums):
            if found is not None and found.any():
                texts = _all_shingles(files.uri, k)[1]
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([texts[s] for s in some], pa.string()), pa.array(found[some])], ["shingle", "n"])

    return run


def _store(windows: DataFrame, name: str) -> WindowFiles:
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    path = work_path(windows.sparkSession, name)
    # Every block gets a file, also when it has no rows.
    rows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    empty = windows.sparkSession.range(blocks).select(*(F.lit(None).cast(t).alias(c) for c, t in windows.dtypes), F.col("id").alias("block"))
    rows.unionByName(empty).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return WindowFiles(path, blocks)


def build_index(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> WindowFiles:
    """Windows whose shingles all occur in `docs`, each with its items and its rarest shingle."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text))
    windows = items.mapInArrow(_windows_task, "window string, item string").distinct()
    windows = materialize(windows.groupBy("window").agg(F.array_sort(F.collect_list("item")).alias("items")), "windows")
    plain = _store(windows.select("window"), "window-texts")
    counts = docs.select(text).mapInArrow(_count_task(plain), "shingle string, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    words = F.split("window", " ")
    size = F.least(F.size(words), F.lit(SHINGLE_WORDS))
    each = windows.select("window", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda k: F.array_join(F.slice(words, k + 1, size), " "))).alias("offset", "shingle"))
    known = each.join(counts, "shingle", "left").fillna(0, ["n"])
    first = known.groupBy("window").agg(F.min(F.struct("n", "shingle", "offset", "size")).alias("rarest"))
    kept = first.filter("rarest.n > 0").select("window", "rarest.offset", "rarest.size")
    return _store(windows.join(kept, "window"), "window-index")


def _hits(files: WindowFiles, text: str):
    def make():
        take_over("decontaminate", _give_up)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            columns = [[], [], [], []]
            for texts in _slices(batch.column(text), SLICE_BYTES):
                for column, got in zip(columns, _hit_texts(files, texts)):
                    column += got
            n_words, n_hit, n_items, digests = columns
            bad = [h > 0 and HIT_SHARE * h >= n for h, n in zip(n_hit, n_words)]
            longs = [pa.array(c, pa.int64()) for c in (n_words, n_hit, n_items)]
            return [*longs, pa.array(digests, pa.string()), pa.array(bad, pa.bool_())]

        return step

    return make


def _hit_texts(files: WindowFiles, texts: list[bytes | None]) -> tuple[list[int], list[int], list[int], list[str]]:
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # the 0 behind each document
    begins = ends - sizes
    edges = np.zeros(int(ends[-1]) + 2, np.int64)
    found: list[set[str]] = [set() for _ in docs]
    for k in range(files.blocks):
        block, items = _prefixes(files.uri, k)
        flat = block.numbers(docs)
        for at, entries in block.matches(flat):
            window, start = entries[:, 0], at - entries[:, 1]
            doc = np.searchsorted(ends, at)
            size = block.sizes[window]
            fits = (start >= begins[doc]) & (start + size <= ends[doc])
            window, start, size, doc = window[fits], start[fits], size[fits], doc[fits]
            same = np.ones(len(window), bool)
            for j in range(WINDOW_WORDS):
                own = j < size
                same &= ~own | (flat[np.where(own, start + j, 0)] == block.words[window, j])
            window, start, size, doc = window[same], start[same], size[same], doc[same]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + size, -1)
            for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                found[d].update(items[w])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
    n_hit = covered[ends] - covered[begins]
    digests = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
    return sizes.tolist(), n_hit.tolist(), [len(f) for f in found], digests


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A null or wordless text has no words and is clean; items without words have
    no window. Repeated items count once by their id; a null id is no item, but
    its words are hit. Repeated documents are each judged by themselves. Without
    items, or without documents, nothing is hit. Columns with those names are
    replaced, all others pass through.
    """
    files = build_index(docs, benchmark, text, item_id, item_text)
    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return annotate(docs, _hits(files, text), added)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, least(len(w), {WINDOW_WORDS}) AS size, w[k:k + least(len(w), {WINDOW_WORDS}) - 1] AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 1}, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM bw),
     dw AS (SELECT r, p, size, w[p:p + size - 1] AS win
            FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
     m AS (SELECT r, p, size, item FROM dw JOIN bw USING (size, win)),
     hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM m) GROUP BY r),
     its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
SQL = {"op6_decontaminate": OP6_SQL}
