"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms. A term that occurs 2, 4,
8, ... times is also entered under further names, so the filter tells of every
term between which powers of two its frequency lies, and never too little.
Documents with filters of one size are stored in blocks, bit by bit: a slice
has one bit of every document of the block.

For a query, the slices of a term's bits are intersected, which gives a bitmap
of the documents that may hold the term so often. The bitmaps, weighted with
what such a frequency can add to a score, sum up to a bound that no score
exceeds. The documents with the highest bounds are scored exactly and give each
query a threshold; all documents whose bounds reach it are scored exactly. The
others are proved not to be among the best.

Blocks lie in files, with the terms of their documents behind them; a task
reads the slices of a block, and its terms only if a document has to be scored.
Queries go in blocks of a bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import LOWER, Scratch, SharedFolder, mix64, table, utf8

#: The ranking formula.
UNIT, CEILING, LENGTH_SHARE, BASE, TF_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 90, 100, 1000, 8

BEST = 10
#: A term has a bit pattern for frequencies of at least 1, 2, 4, ... up to this many powers of two.
LEVELS = 6
BITS_PER_NAME, PATTERN_BITS, LEAST_BITS = 12, 4, 256
#: A block has at most so many documents, bits and bytes of terms.
BLOCK_DOCS, BLOCK_BITS, BLOCK_BYTES = 1024, 1 << 23, 8 << 20
#: Queries, and different terms, that are looked for at once.
QUERY_BLOCK, QUERY_TERMS = 500, 50_000

#: Term characters are ASCII letters, digits and everything beyond ASCII; A-Z are lower-cased.
_TERM_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LEVEL_STEP = np.uint64(0x9E3779B97F4A7C15)
_MANIFEST = "file string, at long, head long, slices long, payload long, bits long, docs long, held long, words long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def patterns(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each term at each level, PATTERN_BITS in a row; `bits` is a power of two."""
    mixed = mix64(hashes + levels.astype(np.uint64) * _LEVEL_STEP)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return ((mixed[:, None] + np.arange(PATTERN_BITS, dtype=np.uint64)[None, :] * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def level_of(tf: np.ndarray) -> np.ndarray:
    """The number of the highest level that holds for each frequency, from 0."""
    return np.minimum(np.frexp(tf.astype(np.float64))[1] - 1, LEVELS - 1)


class _Draft:
    """Documents with filters of one size that wait for their block."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys, self.counts, self.names, self.terms, self.held = [], [], [], [], 0
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BITS // bits))

    def full(self) -> bool:
        return len(self.keys) >= self.most or self.held >= BLOCK_BYTES

    def slices(self) -> np.ndarray:
        """(bits, documents / 8) bytes, the first document in the highest bit."""
        rows = np.repeat(np.arange(len(self.names)), [len(x) for x in self.names])
        table_ = np.zeros((-(-len(self.names) // 8) * 8, self.bits), bool)
        table_[rows, np.concatenate(self.names)] = True
        return np.ascontiguousarray(np.packbits(table_, axis=0).T)


def _index_task(folder: SharedFolder, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"signatures-{TaskContext.get().taskAttemptId()}"
        drafts: dict[int, _Draft] = {}
        packer = zstandard.ZstdCompressor(level=1)
        first = next(batches, None)
        if first is None:
            return

        def store(out, draft: _Draft) -> pa.RecordBatch:
            slices = draft.slices().tobytes()
            sizes = [len(x) for x in draft.terms]
            head = pa.RecordBatch.from_arrays([pa.array(draft.keys, key_type), pa.array(draft.counts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "n", "size"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_batch(head)
            meta, at = sink.getvalue(), out.tell()
            out.write(meta)
            out.write(slices)
            for x in draft.terms:
                out.write(x)
            row = [name, at, meta.size, len(slices), sum(sizes), draft.bits, len(draft.keys), sum(n > 0 for n in draft.counts), sum(draft.counts)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [c.split()[0] for c in _MANIFEST.split(", ")])

        def chain():
            yield first
            yield from batches

        with folder.create(name) as out:
            for batch in chain():
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                        words = terms_of(text)
                        tf = Counter(words)
                        levels = level_of(np.fromiter(tf.values(), np.int64, len(tf)))
                        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tf), np.uint64, len(tf))
                        n = levels + 1
                        total = int(n.sum())
                        level = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                        bits = max(LEAST_BITS, 1 << (total * BITS_PER_NAME - 1).bit_length())
                        draft = drafts.setdefault(bits, _Draft(bits))
                        draft.keys.append(key)
                        draft.counts.append(len(words))
                        draft.names.append(np.unique(patterns(np.repeat(hashes, n), level, bits).ravel()))
                        draft.terms.append(packer.compress(b" ".join(words)))
                        draft.held += len(draft.terms[-1]) + 8 * len(draft.names[-1])
                        if draft.full():
                            yield store(out, drafts.pop(bits))
            for draft in drafts.values():
                yield store(out, draft)

    return run


@dataclass
class Index:
    """A stored index: its blocks, the folder of its files, the type of the keys, and how many documents and terms it has."""

    manifest: DataFrame
    folder: SharedFolder
    key: str
    key_type: object
    documents: int
    words: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every row of `docs`, whole.

    A null or empty text is a document without terms, which no query finds and
    which does not count as a document. Repeated rows and rows without a key are
    documents of their own. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = SharedFolder(work_path(spark, "signatures"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    arrow = pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string()
    rows = rows.withColumn("key", F.col("key").cast("long" if arrow == pa.int64() else "string"))
    manifest = Scratch().keep(rows.mapInArrow(_index_task(folder, arrow), _MANIFEST), "signature-blocks")
    total = manifest.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    return Index(manifest, folder, key, kind, total.held, total.words)


class _Block:
    """One block of the index, read as far as it is needed."""

    def __init__(self, folder: SharedFolder, row: dict):
        self.folder, self.row = folder, row
        with folder.open(row["file"]) as f:
            f.seek(row["at"])
            head = pa.ipc.open_stream(f.read(row["head"])).read_all()
            self.slice_bytes = f.read(row["slices"])
        self.keys, self.n = head.column("key").to_pylist(), head.column("n").to_numpy()
        self.ends = np.cumsum(head.column("size").to_numpy())

    def slices(self) -> np.ndarray:
        return np.frombuffer(self.slice_bytes, np.uint8).reshape(self.row["bits"], -1)

    def terms(self, which: list[int] | None = None) -> Iterator[tuple[int, list[bytes]]]:
        """The terms of some documents, or all, in order."""
        unpacker = zstandard.ZstdDecompressor()
        with self.folder.open(self.row["file"]) as f:
            start = self.row["at"] + self.row["head"] + self.row["slices"]
            for k in range(len(self.keys)) if which is None else which:
                lo = int(self.ends[k - 1]) if k else 0
                f.seek(start + lo)
                yield k, unpacker.decompress(f.read(int(self.ends[k]) - lo)).split()


class Queries:
    """A block of queries: their terms, numbered, and after `weigh` their weights."""

    def __init__(self, texts: list[set[bytes]]):
        self.number: dict[bytes, int] = {}
        for terms in texts:
            for t in sorted(terms):
                self.number.setdefault(t, len(self.number))
        self.terms = [np.array(sorted(self.number[t] for t in terms), np.int64) for terms in texts]
        self.weights = np.zeros(len(self.number), np.int64)
        self.documents = self.words = 0

    def weigh(self, frequency: dict[int, int], documents: int, words: int) -> None:
        self.documents, self.words = documents, words
        for t, df in frequency.items():
            self.weights[t] = math.floor(UNIT * math.log((2 * documents + 2) / (2 * df + 1)))
        self.terms = [t[self.weights[t] > 0] for t in self.terms]  # the others add nothing
        self.flat = np.concatenate([*self.terms, np.zeros(0, np.int64)])
        self.starts = np.cumsum([0, *(len(t) for t in self.terms)])
        order = sorted(self.number, key=self.number.get)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in order], np.uint64)

    def long_parts(self, n: np.ndarray) -> np.ndarray:
        """What a document's length adds below the fraction."""
        if len(n) and LENGTH_SHARE * int(n.max()) * self.documents >= 2**62:
            return np.array([BASE - LENGTH_SHARE + LENGTH_SHARE * int(x) * self.documents // self.words for x in n], np.int64)
        return BASE - LENGTH_SHARE + (LENGTH_SHARE * n * self.documents) // max(self.words, 1)

    def bounds(self, block: _Block) -> np.ndarray:
        """(queries, documents) numbers that no score exceeds."""
        docs, bits = len(block.keys), block.row["bits"]
        slices, count = block.slices(), len(self.number)
        length = self.long_parts(block.n).astype(np.float64)
        grow = lambda tf: CEILING * tf / (TF_SCALE * tf + LENGTH_SCALE * length)
        out, before, present = np.zeros((len(self.terms), docs)), 0.0, None
        for level in range(LEVELS):
            at = patterns(self.hashes, np.full(count, level), bits)
            maps = slices[at[:, 0]]
            for k in range(1, PATTERN_BITS):
                maps &= slices[at[:, k]]
            present = maps if present is None else present & maps
            if not present.any():
                break
            most = block.n if level == LEVELS - 1 else np.minimum(2 ** (level + 1) - 1, block.n)
            upto = grow(np.maximum(most, 1).astype(np.float64))
            holds = np.unpackbits(present, axis=1, count=docs)
            for q, terms in enumerate(self.terms):
                if len(terms):
                    out[q] += (upto - before) * (self.weights[terms].astype(np.float32) @ holds[terms])
            before = upto
        return out * (1 + 1e-6)

    def scores(self, terms: list[bytes], length: int) -> np.ndarray:
        """The exact score of one document for every query."""
        counts = Counter(terms)
        common = counts.keys() & self.number.keys()
        add = np.zeros(len(self.number), np.int64)
        if common:
            t = np.array([self.number[x] for x in common])
            tf = np.array([counts[x] for x in common], np.int64)
            add[t] = self.weights[t] * ((CEILING * tf) // (TF_SCALE * tf + LENGTH_SCALE * length))
        sums = np.append(0, np.cumsum(add[self.flat]))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


class _Best:
    """The best k of every query so far; equal scores by ascending key, no key last."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors.copy(), k
        self.rows: list[list[tuple]] = [[] for _ in floors]

    def add(self, scores: np.ndarray, key) -> None:
        for q in np.flatnonzero((scores >= self.floors) & (scores > 0)).tolist():
            rows = self.rows[q]
            rows.append((-int(scores[q]), key is None, key if key is not None else 0))
            if len(rows) >= 4 * self.k:
                self.cut(q)

    def cut(self, q: int) -> None:
        rows = self.rows[q] = sorted(self.rows[q])[: self.k]
        if len(rows) == self.k:
            self.floors[q] = max(self.floors[q], -rows[-1][0])

    def batch(self, key_type: pa.DataType) -> pa.RecordBatch:
        for q in range(len(self.rows)):
            self.cut(q)
        flat = [(q, -s, None if none else key) for q, rows in enumerate(self.rows) for s, none, key in rows]
        cols = list(zip(*flat)) if flat else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], key_type)], ["query", "score", "key"])


def _blocks_of(folder: SharedFolder, batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(folder, row)


def _frequency_task(folder: SharedFolder, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        known, found = frozenset(number), Counter()
        for block in _blocks_of(folder, batches):
            for _, terms in block.terms():
                found.update(known.intersection(terms))
        yield pa.RecordBatch.from_arrays([pa.array([number[t] for t in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    return run


def _promising_task(folder: SharedFolder, shared, k: int):
    """The k documents of the task with the highest bounds for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best: list[list[tuple]] = [[] for _ in queries.terms]
        floors = np.zeros(len(best))
        for block in _blocks_of(folder, batches):
            bounds = queries.bounds(block)
            for q in np.flatnonzero(bounds.max(axis=1, initial=0) > floors).tolist():
                top = np.argsort(-bounds[q], kind="stable")[:k]
                own = [(-float(bounds[q, d]), block.row["file"], block.row["at"], d) for d in top.tolist() if bounds[q, d] > floors[q]]
                best[q] = sorted(best[q] + own)[:k]
                if len(best[q]) == k:
                    floors[q] = -best[q][-1][0]
        flat = [(q, -b, f, at, d) for q, rows in enumerate(best) for b, f, at, d in rows]
        cols = list(zip(*flat)) if flat else [[]] * 5
        types = pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int32()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["query", "bound", "file", "at", "doc"])

    return run


def _exact_task(folder: SharedFolder, shared, key_type: pa.DataType, floors: np.ndarray | None, k: int):
    """The best k of every query in the task's blocks.

    Scored are the documents that a column `chosen` lists; without one, those
    whose bound reaches the floor of a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = _Best(np.zeros(len(queries.terms), np.int64) if floors is None else floors, k)
        for block in _blocks_of(folder, batches):
            if floors is None:
                which = sorted(set(block.row["chosen"]))
            else:
                which = np.flatnonzero((queries.bounds(block) >= np.maximum(best.floors, 1)[:, None]).any(axis=0)).tolist()
            length = queries.long_parts(block.n)
            for d, terms in block.terms(which):
                best.add(queries.scores(terms, int(length[d])), block.keys[d])
        yield best.batch(key_type)

    return run


def _query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[set[bytes]]]]:
    keys, sets, held = [], [], 0
    for row in queries.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).toLocalIterator():
        keys.append(row.key)
        sets.append(set(terms_of((row.text or "").encode())))
        held += len(sets[-1])
        if len(keys) >= QUERY_BLOCK or held >= QUERY_TERMS:
            yield keys, sets
            keys, sets, held = [], [], 0
    if keys:
        yield keys, sets


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = BEST) -> DataFrame:
    """The best k documents of every query: query's key, rank (from 1), document's key, score.

    Every row of `queries` is a query of its own, also if its key is null or
    repeated; one without terms, or whose terms no document has, finds nothing.
    Only scores above 0 count; equal ones come by ascending key, documents
    without a key last. Other columns of `queries` are not looked at.
    """
    spark = queries.sparkSession
    arrow = pa.int64() if index.key_type.simpleString() in ("bigint", "int") else pa.string()
    kind = "long" if arrow == pa.int64() else "string"
    query_type = queries.schema[key].dataType.simpleString()
    doc_key = index.key if index.key != key else f"found_{index.key}"
    out = spark.createDataFrame([], f"`{key}` {query_type}, rank int, `{doc_key}` {index.key_type.simpleString()}, score long")
    context, scratch = spark.sparkContext, Scratch()
    blocks = index.manifest.repartition(max(1, min(index.manifest.count(), 4 * context.defaultParallelism)))
    for number, (keys, sets) in enumerate(_query_blocks(queries, key, text)):
        asked = Queries(sets)
        shared = context.broadcast(asked)  # at most QUERY_TERMS terms and those of one query
        counted = blocks.mapInArrow(_frequency_task(index.folder, shared), "term int, df long")
        frequency = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        asked.weigh(frequency, index.documents, index.words)
        shared = context.broadcast(asked)

        likely = blocks.mapInArrow(_promising_task(index.folder, shared, k), "query int, bound double, file string, at long, doc int")
        order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "file", "at", "doc")
        likely = likely.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        chosen = F.broadcast(likely.groupBy("file", "at").agg(F.collect_set("doc").alias("chosen")))  # k for every query of the block
        sample = index.manifest.join(chosen, ["file", "at"]).select(*index.manifest.columns, "chosen")
        seeds = sample.mapInArrow(_exact_task(index.folder, shared, arrow, None, k), f"query int, score long, key {kind}")
        ranked = _ranked(seeds, k).filter(F.col("rank") == k).select("query", "score").collect()  # one row for every query of the block
        floors = np.zeros(len(keys), np.int64)
        for r in ranked:
            floors[r.query] = r.score

        exact = blocks.mapInArrow(_exact_task(index.folder, shared, arrow, floors, k), f"query int, score long, key {kind}")
        names = spark.createDataFrame(list(enumerate(keys)), f"query int, `_name` {query_type}")
        found = _ranked(exact, k).join(F.broadcast(names), "query")
        found = found.select(F.col("_name").alias(key), "rank", F.col("key").cast(index.key_type).alias(doc_key), "score")
        out = out.unionByName(scratch.keep(found, f"found-{number}"))
    return out


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op11_lexical_search": op11_lexical_search}
SQL = {
    "op11_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
a AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(t) AS term FROM i)),
w AS (SELECT term, CAST(floor({UNIT} * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
m AS (SELECT r, doc_id, {BASE} - {LENGTH_SHARE} + (({LENGTH_SHARE} * len(t) * docs) // words) AS m FROM d, s),
f AS (SELECT q, item_id, r, doc_id, CAST(sum(w * (({CEILING} * tf) // ({TF_SCALE} * tf + {LENGTH_SCALE} * m))) AS BIGINT) AS score
    FROM a JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= {BEST}"""
}
