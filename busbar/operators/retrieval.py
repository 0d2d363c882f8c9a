"""Lexical and vector retrieval over whole tables of queries."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..session import materialize, work_path
from .clean import filter_meta
from .joins import join_measured
from .sampling import upsert
from .spread import top_per_group

BROADCAST_ROWS = 500_000  # query terms: (id, term, weight), some 64 bytes each
QUERY_BLOCK = 2_000  # query vectors held by one task
ROW_BLOCK = 100_000  # collection rows held by one task when the query side is large
SCORES_AT_ONCE = 2_000_000  # products of a row and a query that a task holds at a time

# BM25 and fusion constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


@dataclass
class Bm25Index:
    """Postings `(doc_id, term, tf, dl)` bucketed by document, plus corpus statistics."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    n_docs: int
    avg_len: float

    def document_frequency(self) -> DataFrame:
        return self.terms

    def statistics(self) -> DataFrame:
        """Document count and mean length; a document without a token counts with length 0."""
        total = self.postings.agg(F.sum("tf").alias("t")).scalar()
        return self.docs.agg(F.count("*").alias("n_docs"), (total / F.count("*")).alias("avg_len"))


def bm25_index(df: DataFrame, id_col: str, text_cols: Sequence[str]) -> Bm25Index:
    """Build the index once and keep it in the shared folder.

    The plain text is shuffled by document and split into terms afterwards.
    Postings are bucketed by document, so scoring groups by document without
    moving them, and a term that occurs everywhere is never a shuffle key.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws(" ", *text_cols).alias("text")
    by_doc = df.select(F.col(id_col).alias("doc_id"), text).repartition(n, "doc_id")
    toks = by_doc.select("doc_id", tokens(F.col("text")).alias("toks"))
    # `explode` would make the optimizer push a filter on the token count below the
    # shuffle, and every text would be split twice; `explode_outer` does not.
    # One document's terms are all in one task already: this groupBy adds no exchange.
    postings = (
        toks.select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("doc_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    name = f"postings_{uuid.uuid4().hex}"
    postings.write.bucketBy(n, "doc_id").option("path", work_path(spark, "postings")).saveAsTable(name)
    stored = spark.table(name)
    terms = materialize(stored.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")), "terms")
    docs = df.select(F.col(id_col).alias("doc_id"))
    n_docs = docs.count()
    total = terms.agg(F.sum("ctf")).first()[0] or 0
    return Bm25Index(stored, terms, docs, n_docs, total / n_docs if n_docs else 0.0)


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Distinct terms per query with their repeat count."""
    return (
        queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokens(F.col(text))).alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def term_weights(index: Bm25Index) -> DataFrame:
    """Okapi idf per term; a negative idf becomes a quarter of the mean idf."""
    n = F.lit(float(index.n_docs))
    raw = index.terms.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor")).scalar()
    return raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def bm25_search(
    index: Bm25Index, queries: DataFrame, query_id: str, text: str, k: int = 20, k1: float = K1, b: float = B,
    pad: bool = False,
) -> DataFrame:
    """Top `k` documents per query: `(query_id, doc_id, score, rank)`.

    Scores are compared at 6 places, so that copies of a document tie and the
    smaller id comes first. `pad` fills up to `k` rows with zero-score documents.
    """
    spark = queries.sparkSession
    weights = materialize(
        query_terms(queries, query_id, text)
        .join(term_weights(index), "term")
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")),
        "weights",
    )
    # The query side is broadcast only when it is known to be small. Otherwise the
    # term join shuffles, and adaptive execution splits the partitions of hot terms.
    small = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avg_len))
    part = F.col("w") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm)
    scored = (
        index.postings.join(F.broadcast(weights) if small else weights, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(part), 6).alias("score"))
    )
    order = [F.desc("score"), F.asc("doc_id")]
    hits = top_per_group(scored, ["query_id"], order, k)
    if not pad:
        return hits
    # The first 2k ids hold at least k documents that a query with fewer than k hits missed.
    first_ids = index.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    ids = first_ids.agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).scalar()
    zeros = queries.select(F.col(query_id).alias("query_id"), F.explode(ids).alias("doc_id"))
    zeros = zeros.join(hits, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    both = hits.select("query_id", "doc_id", "score").unionByName(zeros)
    return top_per_group(both, ["query_id"], order, k)


def _stages(dims: int) -> list:
    return [
        HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ]


def embedder(df: DataFrame, text: str, dims: int = 256) -> PipelineModel:
    """Fit hashed TF-IDF vectors of unit length on a corpus."""
    toks = df.select(tokens(F.col(text)).alias("_toks"))
    return Pipeline(stages=_stages(dims)).fit(toks)


def embedded(df: DataFrame, text: str, dims: int = 256, out: str = "vec") -> tuple[PipelineModel, DataFrame]:
    """`embedder` and `embed` of the same rows, whose texts are split and hashed once; the hashed counts are stored."""
    hashing, idf, unit = _stages(dims)
    counts = hashing.transform(df.withColumn("_toks", tokens(F.col(text)))).drop("_toks")
    counts = materialize(counts, "hashed")
    weights = idf.fit(counts.select("_tf"))
    vectors = unit.transform(weights.transform(counts))
    vectors = vectors.withColumn(out, vector_to_array("_vec", "float32")).drop("_tf", "_idf", "_vec")
    return PipelineModel([hashing, weights, unit]), vectors


def embed(model: PipelineModel, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
    vectors = model.transform(df.withColumn("_toks", tokens(F.col(text))))
    return vectors.withColumn(out, vector_to_array("_vec", "float32")).drop("_toks", "_tf", "_idf", "_vec")


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label as `(query_id, qv)`; partial sums are combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(vec)).alias("_m")
    out = df.groupBy(F.col(label).alias("query_id")).agg(mean)
    return out.select("query_id", F.transform(vector_to_array("_m"), lambda x: F.round(x, 6)).alias("qv"))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors; one of another length fails the query, since it cannot be compared."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"vectors of {dim} and of {int(lengths[lengths != dim][0])} numbers cannot be compared")
    return _unit(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties go to the smaller id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        cand = np.flatnonzero(scores >= bar)
    else:
        cand = np.arange(len(scores))
    return cand[np.lexsort((ids[cand], -scores[cand]))][:k]


def vector_search(
    coll: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int = 10,
    filters: Mapping[str, object | None] | None = None,
) -> DataFrame:
    """Exact cosine top `k` per query: `(query_id, doc_id, score, rank)`.

    The filter reaches the scan. Every task multiplies its rows with a block of
    query vectors and hands on only its own best `k`, so the pairs are never
    materialised. Up to `QUERY_BLOCK` queries are broadcast; more are met block
    by block in a co-grouped shuffle with bounded groups.
    """
    rows = filter_meta(coll, filters or {}).filter(F.col(vec_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vec_col).alias("v"))
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("q")).filter("q IS NOT NULL")
    id_type = asks.schema["query_id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("doc_id", T.LongType()),
         T.StructField("score", T.DoubleType())]
    )
    head = asks.limit(QUERY_BLOCK + 1).collect()
    if not head:
        partial = queries.sparkSession.createDataFrame([], schema)
    elif len(head) <= QUERY_BLOCK:
        partial = _scan_broadcast(rows, head, schema, k)
    else:
        partial = _scan_blocks(rows, asks, schema, k, len(head[0]["q"]))
    return top_per_group(partial, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _scan_broadcast(rows: DataFrame, head, schema: T.StructType, k: int) -> DataFrame:
    dim = len(head[0]["q"])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(
        ([r["query_id"] for r in head], _unit(np.array([r["q"] for r in head], dtype=np.float64)))
    )
    arrow = to_arrow_schema(schema)

    def scan(batches):
        names, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in names]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)
            scores = np.round(_matrix(batch.column(1), dim) @ q.T, 6)
            for j in range(len(names)):
                s = np.concatenate([best[j][0], scores[:, j]])
                i = np.concatenate([best[j][1], ids])
                keep = _best(s, i, k)
                best[j] = (s[keep], i[keep])
        out_q = [name for name, (s, _) in zip(names, best) for _ in range(len(s))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out_q, type=arrow.field(0).type),
                pa.array(np.concatenate([i for _, i in best]) if best else [], type=pa.int64()),
                pa.array(np.concatenate([s for s, _ in best]) if best else [], type=pa.float64()),
            ],
            schema=arrow,
        )

    return rows.mapInArrow(scan, schema)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _scan_blocks(rows: DataFrame, asks: DataFrame, schema: T.StructType, k: int, dim: int) -> DataFrame:
    n_rows, n_asks = rows.count(), asks.count()
    parts = max(1, math.ceil(n_rows / ROW_BLOCK))
    blocks = max(1, math.ceil(n_asks / QUERY_BLOCK))
    left = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    left = left.withColumn("block", F.explode(_numbers(blocks)))
    right = asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    right = right.withColumn("part", F.explode(_numbers(parts)))
    arrow = to_arrow_schema(schema)

    def meet(key, docs, qs):
        if docs.num_rows == 0 or qs.num_rows == 0:
            return arrow.empty_table()
        ids = np.asarray(docs.column("doc_id"), dtype=np.int64)
        rows, asked, names = _matrix(docs.column("v"), dim), _matrix(qs.column("q"), dim), qs.column("query_id").to_pylist()
        out, step = [], max(1, SCORES_AT_ONCE // len(rows))
        for first in range(0, len(names), step):
            scores = np.round(rows @ asked[first : first + step].T, 6)
            for j, name in enumerate(names[first : first + step]):
                keep = _best(scores[:, j], ids, k)
                out.append((name, ids[keep], scores[keep, j]))
        return pa.Table.from_arrays(
            [
                pa.array([n for n, own, _ in out for _ in own], type=arrow.field(0).type),
                pa.array(np.concatenate([own for _, own, _ in out]), type=pa.int64()),
                pa.array(np.concatenate([s for _, _, s in out]), type=pa.float64()),
            ],
            schema=arrow,
        )

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, schema)


def merge_lists(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Ranks of several lists side by side per (query, document).

    A union and one grouped aggregate, which gives the full outer join of the
    lists without joining on a possibly hot key.
    """
    tagged = [df.select("query_id", "doc_id", "rank", F.lit(name).alias("src")) for name, df in lists.items()]
    both = reduce(DataFrame.unionByName, tagged)
    aggs = [F.min(F.when(F.col("src") == name, F.col("rank"))).alias(name) for name in lists]
    return both.groupBy("query_id", "doc_id").agg(*aggs)


def rrf_fuse(lists: Sequence[DataFrame], k_rrf: int = RRF_K, final_k: int = 20) -> DataFrame:
    """Reciprocal rank fusion: `(query_id, doc_id, rrf_score, rank)`."""
    both = reduce(DataFrame.unionByName, [df.select("query_id", "doc_id", "rank") for df in lists])
    fused = both.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k_rrf) + F.col("rank"))), 6).alias("rrf_score")
    )
    return top_per_group(fused, ["query_id"], [F.desc("rrf_score"), F.asc("doc_id")], final_k)


def coverage(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text holds."""
    asked = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(cands: DataFrame, scorer: Column | None, k: int = 5) -> DataFrame:
    """Second-stage score and cut; without a scorer the first-stage order stays."""
    first = cands.withColumnRenamed("rank", "first_rank")
    if scorer is None:
        scored = first.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        scored = first.withColumn("rerank_score", F.round(scorer, 4))
    order = [F.desc_nulls_last("rerank_score"), F.asc("first_rank"), F.asc("doc_id")]
    return top_per_group(scored, ["query_id"], order, k)


def hybrid_search(
    corpus: DataFrame, queries: DataFrame, index: Bm25Index, model: PipelineModel, candidate_k: int = 20,
    final_k: int = 5, filters: Mapping[str, object | None] | None = None, filter_both: bool = False,
    stored: DataFrame | None = None,
) -> DataFrame:
    """BM25 and vectors, fused and reranked. Filters narrow the vector leg only, unless `filter_both`.

    `corpus` has `doc_id, text` and the filter columns; `queries` has `query_id, text`;
    `stored` has `doc_id, vec` and the filter columns, made when the collection was
    built. Without it the corpus is embedded for this search.
    """
    lexical = bm25_search(index, queries, "query_id", "text", candidate_k)
    if filter_both and filters:
        allowed = filter_meta(corpus, filters).select("doc_id")
        lexical = bm25_search(
            Bm25Index(index.postings.join(allowed, "doc_id", "left_semi"), index.terms, index.docs, index.n_docs,
                      index.avg_len), queries, "query_id", "text", candidate_k)
    vectors = embed(model, corpus, "text") if stored is None else stored
    asked = embed(model, queries.select("query_id", "text"), "text")
    # Used twice below; it holds at most candidate_k rows per query.
    semantic = materialize(
        vector_search(vectors, "doc_id", "vec", asked, "query_id", "vec", candidate_k, filters), "semantic")
    fused = rrf_fuse([lexical, semantic], final_k=candidate_k)
    # At most candidate_k rows per query are joined with their texts and cosine.
    asked_for = materialize(fused.join(queries.select("query_id", F.col("text").alias("question")), "query_id"), "fused")
    cands = (
        join_measured(corpus.select("doc_id", "text"), asked_for, "doc_id")
        .join(semantic.select("query_id", "doc_id", F.col("score").alias("cosine")), ["query_id", "doc_id"], "left")
    )
    scorer = coverage(F.col("question"), F.col("text")) + F.coalesce("cosine", F.lit(0.0))
    return rerank(cands, scorer, final_k).select(
        "query_id", "doc_id", "rrf_score", "rerank_score", F.col("rank").alias("final_rank")
    )


def merge_hits(exact: DataFrame, semantic: DataFrame, lexical: DataFrame, total: int = 10) -> DataFrame:
    """Exact id hits first, then semantic, then lexical hits not seen before; at most `total` per query."""
    sources = [df.select("query_id", "doc_id", "rank", F.lit(p).alias("src"))
               for p, df in enumerate((exact, semantic, lexical))]
    both = reduce(DataFrame.unionByName, sources)
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("src", "rank")).alias("_m"))
    flat = first.select("query_id", "doc_id", "_m.src", F.col("_m.rank").alias("src_rank"))
    order = [F.asc("src"), F.asc("src_rank"), F.asc("doc_id")]
    return top_per_group(flat, ["query_id"], order, total, name="place")


def cache_lookup(
    queries: DataFrame, query_id: str, query_vec: str, cache: DataFrame, cache_id: str, cache_vec: str,
    threshold: float = 0.97,
) -> DataFrame:
    """Nearest past query per query if similar enough; misses, and queries without a vector, keep a null `cached_id`."""
    small = cache.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    if small:
        best = _nearest_entry(queries, query_id, query_vec, cache, cache_id, cache_vec)
        return best.select(
            "query_id",
            F.when(F.col("score") >= threshold, F.col("entry_id")).alias("cached_id"),
            F.when(F.col("score") >= threshold, F.col("score")).alias("similarity"),
        )
    hits = vector_search(cache, cache_id, cache_vec, queries, query_id, query_vec, k=1)
    found = hits.filter(F.col("score") >= threshold).select(
        "query_id", F.col("doc_id").alias("cached_id"), F.col("score").alias("similarity"))
    return queries.select(F.col(query_id).alias("query_id")).join(found, "query_id", "left")


def _nearest_entry(queries, query_id, query_vec, cache, cache_id, cache_vec) -> DataFrame:
    """Best entry of a small cache for every query, in one narrow pass over the queries."""
    known = cache.filter(F.col(cache_vec).isNotNull())
    entries = known.select(F.col(cache_id).cast("bigint").alias("i"), F.col(cache_vec).alias("v")).orderBy("i").collect()
    id_type = queries.schema[query_id].dataType
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("entry_id", T.LongType()),
         T.StructField("score", T.DoubleType())]
    )
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("q"))
    if not entries:
        return asks.select("query_id", F.lit(None).cast("bigint").alias("entry_id"),
                           F.lit(None).cast("double").alias("score"))
    dim = len(entries[0]["v"])
    shared = queries.sparkSession.sparkContext.broadcast(
        (np.array([e["i"] for e in entries]), _unit(np.array([e["v"] for e in entries], dtype=np.float64)))
    )
    arrow = to_arrow_schema(schema)

    def scan(batches):
        ids, m = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            known = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
            scores = np.round(_matrix(batch.column(1).take(pa.array(known)), dim) @ m.T, 6)
            at = scores.argmax(axis=1)  # entries are in id order, so ties go to the smaller id
            entry, best = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            entry[known], best[known] = ids[at], scores[np.arange(len(at)), at]
            none = np.isnan(best)  # a query without a vector, or that is not a number, meets no entry
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(entry, pa.int64(), mask=none), pa.array(best, pa.float64(), mask=none)],
                schema=arrow,
            )

    return asks.mapInArrow(scan, schema)


def cache_rows(df: DataFrame, question: Column, answer: Column, version: Column, keep: Column,
               answer_chars: int | None = None) -> DataFrame:
    """Cacheable answers keyed by the md5 of their question; cut to `answer_chars` only if that is given."""
    text = answer if answer_chars is None else F.substring(answer, 1, answer_chars)
    return df.filter(keep).select(
        F.md5(question).alias("cache_id"), question.alias("question"), text.alias("answer"), version.alias("version")
    )


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Add answers, replacing older ones of the same question."""
    return upsert(cache, new, ["cache_id"], "version")
