"""A BM25 index that documents enter and leave, searched without scoring every posting.

Documents come in batches, and each batch is a segment that is never changed:
postings in blocks of BLOCK_DOCS, sorted by document, with the largest term
frequency and the least document length of each block. From these follows the
most that a posting of the block can add to a score, whatever the collection's
mean length is by then. A document that goes is listed as gone from the segments
that there are; what it counted for its terms is kept beside it. So the
statistics of the whole are sums over segments less what is gone, and results
are those of an index that is built anew.

Only plain text is shuffled, once, by shard. Postings are made where the text of
a shard is, and never move: a task that needs them reads the shard's files, and
what is shuffled are the names of files and the ids of documents that are gone.

A task takes one shard of one segment. For a query it reads lists in the order
of what they can add. As soon as the rest cannot lift a new document above the
k-th score so far, only documents already met can be among the best: in the
remaining lists it reads those blocks that hold such a document that can still
get there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..session import materialize
from .retrieval import BROADCAST_ROWS, EPSILON, K1, B, query_terms
from .spread import top_per_group

BLOCK_DOCS = 128
#: Documents and bytes of text in a shard: a task makes the postings of one shard, or holds the lists of a query block's terms for one.
SHARD_DOCS, SHARD_BYTES = 20_000, 16 << 20
#: Scores are compared at 6 places; less than this cannot change the order.
_SLACK = 1e-6


@dataclass
class SegmentedIndex:
    """Segments below `path`; `id_col` names documents, `text_cols` what is searched."""

    spark: SparkSession
    path: str
    id_col: str
    text_cols: list[str]

    # --- segments

    def _tasks(self, shards: int) -> int:
        """Tasks for so many shards; given as a number, since names of files are few bytes and would be put into one task."""
        return max(1, min(2 * shards, 8 * self.spark.sparkContext.defaultParallelism))

    def _folders(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if n.startswith("segment-") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/terms/_SUCCESS"))]
        return sorted(int(n[8:]) for n in whole)

    def _all(self, kind: str, shape: str) -> DataFrame:
        """One table of every segment, with the segment's number."""
        out = self.spark.createDataFrame([], f"{shape}, segment int")
        for s in self._folders():
            out = out.unionByName(self.spark.read.schema(shape).parquet(f"{self.path}/segment-{s}/{kind}").withColumn("segment", F.lit(s)))
        return out

    def add(self, docs: DataFrame) -> int:
        """A new segment of documents that are in no other; see `replace`. Its number is returned."""
        number = max(self._folders(), default=-1) + 1
        place = f"{self.path}/segment-{number}"
        text = F.concat_ws(" ", *self.text_cols).alias("text")
        rows = materialize(docs.select(F.col(self.id_col).cast("long").alias("doc_id"), text), "segment-docs")
        about = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
        shards = max(1, -(-about["n"] // SHARD_DOCS), -(-about["size"] // SHARD_BYTES))
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
        # sorted while it is text, so that no tokens are sorted
        placed = rows.withColumn("shard", shard).repartition(self._tasks(shards), "shard").sortWithinPartitions("shard")
        split = placed.select("shard", "doc_id", tokens(F.col("text")).alias("toks"))
        split.groupBy("shard").applyInArrow(_blocks_of_shard, _BLOCKS).write.mode("overwrite").parquet(f"{place}/blocks")
        stored = self.spark.read.schema(_BLOCKS).parquet(f"{place}/blocks")
        stored.select("shard", F.col("_metadata.file_name").alias("file")).distinct().write.mode("overwrite").parquet(f"{place}/files")
        documents = stored.filter("term IS NULL").select("shard", F.explode(F.arrays_zip("docs", "dls")).alias("d"))
        documents.select(F.col("d.docs").alias("doc_id"), F.col("d.dls").alias("dl"), "shard").write.mode("overwrite").parquet(f"{place}/docs")
        postings = stored.filter("term IS NOT NULL").select("term", "n")
        # last, since a segment without it does not count
        postings.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{place}/terms")
        return number

    def delete(self, ids: DataFrame) -> None:
        """Documents go from all segments that there are."""
        asked = ids.select(F.col(self.id_col).cast("long").alias("doc_id")).distinct()
        gone = materialize(self._live().join(asked, "doc_id", "left_semi"), "gone")
        if gone.isEmpty():
            return
        hit = self._files().join(F.broadcast(gone.select("segment", "shard").distinct()), ["segment", "shard"], "left_semi")
        lost = self._by_shard(hit, gone).applyInArrow(_lost_task(self.path), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        lost.write.mode("append").parquet(f"{self.path}/lost")
        gone.write.mode("append").parquet(f"{self.path}/gone")

    def replace(self, docs: DataFrame) -> int:
        """Documents that are there under the same id go, these come."""
        docs = materialize(docs.select(self.id_col, *self.text_cols), "replacing")
        self.delete(docs)
        return self.add(docs)

    # --- what the index holds

    def _blocks(self) -> DataFrame:
        return self._all("blocks", _BLOCKS).filter("term IS NOT NULL")

    def _by_shard(self, files: DataFrame, gone: DataFrame):
        """The files of each shard, with its documents that are gone."""
        keys = ["segment", "shard"]
        tasks = self._tasks(self._files().count())
        left, right = files.repartition(tasks, *keys), gone.select(*keys, "doc_id").repartition(tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))

    def _files(self) -> DataFrame:
        """`(segment, shard, file)`: where the blocks of each shard are."""
        return self._all("files", "shard int, file string")

    def _stored(self, name: str, shape: str) -> DataFrame:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.schema(shape).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], shape)

    def _gone(self) -> DataFrame:
        return self._stored("gone", "doc_id long, dl int, shard int, segment int")

    def _live(self) -> DataFrame:
        """`(doc_id, dl, shard, segment)` of the documents that are in."""
        docs = self._all("docs", "doc_id long, dl int, shard int")
        return docs.join(self._gone().select("doc_id", "segment"), ["doc_id", "segment"], "left_anti").select("doc_id", "dl", "shard", "segment")

    def document_frequency(self) -> DataFrame:
        """Term and number of its documents, over all segments."""
        terms = self._all("terms", "term string, df long").select("term", "df").unionByName(self._stored("lost", "term string, df long"))
        return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def statistics(self) -> DataFrame:
        """Document count and mean length; a document without a token counts with length 0."""
        every = self._all("docs", "doc_id long, dl int").select(F.lit(1).alias("s"), "dl")
        less = self._gone().select(F.lit(-1).alias("s"), "dl")
        both = every.unionByName(less).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_docs"), F.sum(F.col("s") * F.col("dl")).alias("words"))
        return both.select("n_docs", (F.col("words") / F.greatest("n_docs", F.lit(1))).alias("avg_len"))

    def _weights(self, queries: DataFrame, query_id: str, text: str, n_docs: int) -> DataFrame:
        n = F.lit(float(n_docs))
        raw = self.document_frequency().select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        raw = materialize(raw, "idf")
        floor = raw.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor")).scalar()
        idf = raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
        return query_terms(queries, query_id, text).join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))

    def _scan(self, queries: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
        """`(query_id, doc_id, score, listed, scored)`: the best k of every shard, and a row without a document for its counts."""
        about = self.statistics().first()
        id_type = queries.schema[query_id].dataType
        shape = T.StructType([T.StructField("query_id", id_type), *(T.StructField(c, t) for c, t in (
            ("doc_id", T.LongType()), ("score", T.DoubleType()), ("listed", T.LongType()), ("scored", T.LongType())))])
        out = self.spark.createDataFrame([], shape)
        if not about["n_docs"]:
            return out
        weights = materialize(self._weights(queries, query_id, text, about["n_docs"]), "query-weights")
        parts = max(1, -(-weights.count() // BROADCAST_ROWS))
        gone = self._gone()
        for part in range(parts):
            own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
            asked: dict = {}
            for r in own.orderBy("query_id", "term").toLocalIterator():  # some BROADCAST_ROWS
                asked.setdefault(r["query_id"], []).append((r["term"], r["w"]))
            shared = self.spark.sparkContext.broadcast(asked)
            task = _shard_task(self.path, shared, k, float(about["avg_len"]), to_arrow_schema(shape))
            out = out.unionByName(self._by_shard(self._files(), gone).applyInArrow(task, shape))
        return out

    def search(self, queries: DataFrame, query_id: str, text: str, k: int = 20) -> DataFrame:
        """Top `k` documents per query: `(query_id, doc_id, score, rank)`, as of an index built anew."""
        best = self._scan(queries, query_id, text, k).filter("doc_id IS NOT NULL")
        return top_per_group(best.select("query_id", "doc_id", "score"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)

    def postings_read(self, queries: DataFrame, query_id: str, text: str, k: int = 20) -> DataFrame:
        """`(query_id, listed, scored)`: postings in the query's lists, and those that the search had to look at."""
        counts = self._scan(queries, query_id, text, k).filter("doc_id IS NULL")
        return counts.groupBy("query_id").agg(F.sum("listed").alias("listed"), F.sum("scored").alias("scored"))

    def compact(self, path: str) -> SegmentedIndex:
        """All that is in, as one segment of a new index at `path`; the old one stays as it is."""
        new = SegmentedIndex(self.spark, path, self.id_col, self.text_cols)
        live = materialize(self._live(), "live")
        postings = self._blocks().select("segment", "term", F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
        postings = postings.select("segment", F.col("p.docs").alias("doc_id"), F.array_repeat("term", F.col("p.tfs")).alias("words"))
        words = postings.groupBy("segment", "doc_id").agg(F.concat_ws(" ", F.flatten(F.collect_list("words"))).alias("words"))
        rows = live.join(words, ["segment", "doc_id"], "left").select(F.col("doc_id").alias(self.id_col), F.coalesce("words", F.lit("")).alias(self.text_cols[0]))
        SegmentedIndex(self.spark, path, self.id_col, self.text_cols[:1]).add(rows)
        return new


def create_index(docs: DataFrame, path: str, id_col: str, text_cols: Sequence[str]) -> SegmentedIndex:
    index = SegmentedIndex(docs.sparkSession, path, id_col, list(text_cols))
    index.add(docs)
    return index


_BLOCKS = "shard int, term string, n int, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>"


def _blocks_of_shard(rows: pa.Table) -> pa.Table:
    """The blocks of a shard, by term; one more row without a term lists its documents and their lengths.

    Rows of the same document and length are one posting of a term, with the sum of their frequencies.
    """
    rows = rows.combine_chunks()
    shard, ids = rows.column("shard")[0].as_py(), rows.column("doc_id").combine_chunks()
    toks = rows.column("toks").combine_chunks()
    dl = np.diff(toks.offsets.to_numpy())
    known, id_values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.lexsort((dl, id_values, known))
    other = np.append(True, (np.diff(id_values[order]) != 0) | (np.diff(known[order].astype(int)) != 0))
    new = other | np.append(True, np.diff(dl[order]) != 0)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    first = order[new]  # a row of each document and length, in the order of documents
    words = toks.flatten().dictionary_encode()
    by_term = pc.array_sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(by_term), np.int64)
    place[by_term] = np.arange(len(by_term))
    keys = place[words.indices.to_numpy()] << 32 | np.repeat(own, dl)
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    tf = np.diff(np.append(at, len(keys)))
    term, doc = keys[at] >> 32, keys[at] & 0xFFFFFFFF
    if not other[new].all():  # a document of several lengths: by frequency, then length
        same = np.cumsum(other[new])[doc]
        by = np.lexsort((dl[first][doc], tf, same, term))
        term, doc, tf = term[by], doc[by], tf[by]
    begins = np.flatnonzero(np.append(True, np.diff(term) != 0)[: len(term)])
    sizes = np.diff(np.append(begins, len(term)))
    starts = np.flatnonzero((np.arange(len(term)) - np.repeat(begins, sizes)) % BLOCK_DOCS == 0)
    lengths = dl[first][doc]
    offsets = np.append(starts, len(term)).astype(np.int32)
    offsets = np.append(offsets, len(term) + len(dl)).astype(np.int32)

    def lists(values, of_rows, kind):
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([pa.array(values, kind), of_rows.cast(kind)]))

    def longs(reduce, values):
        return np.append(reduce.reduceat(values, starts) if len(starts) else [], 0)

    terms = pa.concat_arrays([words.dictionary.take(pa.array(by_term[term[starts]])), pa.nulls(1, pa.string())])
    columns = {
        "shard": np.full(len(terms), shard), "term": terms, "n": np.diff(offsets), "max_tf": longs(np.maximum, tf), "min_dl": longs(np.minimum, lengths),
        "docs": lists(ids.take(pa.array(first[doc])), ids, pa.int64()), "tfs": lists(tf, pa.array(np.zeros(len(dl), int)), pa.int32()),
        "dls": lists(lengths, pa.array(dl), pa.int32()),
    }
    return pa.table({name: c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for name, c in columns.items()})


def _read_shard(path: str, files: pa.Table, columns: list[str], of: pc.Expression) -> pa.Table:
    """The stored blocks of one shard, read where they are."""
    places = files.to_pydict()
    system, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/segment-{places['segment'][0]}/blocks"
    stored = ds.dataset([f"{folder}/{name}" for name in places["file"]], filesystem=system, format="parquet")
    return stored.to_table(columns=columns, filter=(ds.field("shard") == places["shard"][0]) & of).combine_chunks()


def _lost_task(path: str):
    def run(files: pa.Table, gone: pa.Table) -> pa.Table:
        ids, times = np.unique(gone.column("doc_id").to_numpy(), return_counts=True)
        blocks = _read_shard(path, files, ["term", "docs"], ds.field("term").is_valid())
        terms, counts = pa.array([], pa.string()), np.zeros(0, np.int64)
        if blocks.num_rows:
            docs = blocks.column("docs").combine_chunks()
            flat = docs.flatten()
            values = flat.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
            hit = np.where((ids[at] == values) & flat.is_valid().to_numpy(zero_copy_only=False), times[at], 0)
            sums = np.add.reduceat(hit, docs.offsets.to_numpy()[:-1] - docs.offsets[0].as_py())
            some = np.flatnonzero(sums)
            terms, counts = blocks.column("term").combine_chunks().take(pa.array(some)), sums[some]
        return pa.table({"term": terms, "df": pa.array(-counts, pa.int64())})

    return run


class _List:
    """The postings of one term in a shard, block by block."""

    def __init__(self, rows: list[tuple], avg_len: float):
        rows.sort(key=lambda r: r[2][0])
        self.blocks = [r[2:] for r in rows]
        self.first = np.array([r[2][0] for r in rows])
        self.last = np.array([r[2][-1] for r in rows])
        self.sizes = np.array([len(r[2]) for r in rows])
        self.bounds = _part(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), avg_len)
        self.most = float(self.bounds.max())
        self.avg_len = avg_len

    def read(self, which: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some blocks, ascending, and what the term adds to each, before its weight."""
        docs = np.concatenate([self.blocks[b][0] for b in which])
        tf, dl = (np.concatenate([self.blocks[b][c] for b in which]).astype(float) for c in (1, 2))
        return docs, _part(tf, dl, self.avg_len)


def _part(tf: np.ndarray, dl: np.ndarray, avg_len: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avg_len or 1.0)))


def best_of_shard(lists: list[tuple[float, _List]], gone: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores that hold the shard's best `k`, and the postings that were looked at."""
    lists = sorted(lists, key=lambda x: -x[0] * x[1].most)
    positive = all(w > 0 for w, _ in lists)  # else a partial sum is no lower bound: every list is read
    rest = np.append(np.cumsum([w * x.most for w, x in lists][::-1])[::-1], 0.0)
    docs, scores, seen, bar = np.zeros(0, np.int64), np.zeros(0), 0, -np.inf
    closed = False
    for t, (w, own) in enumerate(lists):
        closed = closed or (positive and rest[t] < bar - _SLACK)
        if not closed:
            which = range(len(own.blocks))
        else:
            alive = scores + rest[t] >= bar - _SLACK
            docs, scores = docs[alive], scores[alive]
            lo, hi = np.searchsorted(docs, own.first), np.searchsorted(docs, own.last, side="right")
            best = np.full(len(own.blocks), -np.inf)
            some = np.flatnonzero(hi > lo)
            if len(some):
                # the largest score among the documents that a block may hold
                padded = np.append(scores, -np.inf)
                best[some] = np.maximum.reduceat(padded, np.stack([lo[some], hi[some]], axis=1).ravel())[::2]
            which = np.flatnonzero(best + w * own.bounds + rest[t + 1] >= bar - _SLACK).tolist()
            if not which:
                continue
        found, part = own.read(which)
        seen += len(found)
        if not closed:
            if len(gone):
                keep = ~np.isin(found, gone)
                found, part = found[keep], part[keep]
            every = np.union1d(docs, found)
            grown = np.zeros(len(every))
            grown[np.searchsorted(every, docs)] = scores
            docs, scores = every, grown
            scores[np.searchsorted(docs, found)] += w * part
        else:
            at = np.minimum(np.searchsorted(docs, found), max(len(docs) - 1, 0))
            same = docs[at] == found if len(docs) else np.zeros(len(found), bool)
            scores[at[same]] += w * part[same]
        if positive and len(scores) >= k:
            bar = max(bar, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
    return docs, scores, seen


def _shard_task(path: str, shared, k: int, avg_len: float, arrow: pa.Schema):
    def run(files: pa.Table, dead: pa.Table) -> pa.Table:
        asked = pa.array(sorted({t for terms in shared.value.values() for t, _ in terms}), pa.string())
        rows = _read_shard(path, files, ["term", "max_tf", "min_dl", "docs", "tfs", "dls"], ds.field("term").isin(asked)) if files.num_rows else None
        by_term: dict[str, list[tuple]] = {}
        if rows is not None and rows.num_rows:
            lists_of = [rows.column(c).combine_chunks() for c in ("docs", "tfs", "dls")]
            if lists_of[0].flatten().null_count:
                raise ValueError("a document without an id cannot be found")
            docs, tfs, dls = (x.flatten().to_numpy() for x in lists_of)
            edges = (lists_of[0].offsets.to_numpy() - lists_of[0].offsets[0].as_py()).tolist()
            column = lambda c: rows.column(c).to_pylist()
            for term, max_tf, min_dl, lo, hi in zip(column("term"), column("max_tf"), column("min_dl"), edges[:-1], edges[1:]):
                by_term.setdefault(term, []).append((max_tf, min_dl, docs[lo:hi], tfs[lo:hi], dls[lo:hi]))
        lists = {t: _List(x, avg_len) for t, x in by_term.items()}
        gone = dead.column("doc_id").to_numpy()
        out: list[tuple] = []
        for query, terms in shared.value.items():
            own = [(w, lists[t]) for t, w in terms if t in lists]
            if not own:
                continue
            docs, scores, seen = best_of_shard(own, gone, k)
            scores = np.round(scores, 6)
            order = np.lexsort((docs, -scores))[:k]
            out += [(query, d, s, None, None) for d, s in zip(docs[order].tolist(), scores[order].tolist())]
            out.append((query, None, None, int(sum(x.sizes.sum() for _, x in own)), seen))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return run
