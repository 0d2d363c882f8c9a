"""Retrieval over tables of queries."""

from pyspark.sql import functions as F

from ..operators import retrieval, segments, vector_index
from ..operators.guard import answer_rubric, evidence_score, passes_gate
from ..operators.joins import join_measured
from ..operators.spread import top_per_group
from ..session import materialize, work_path
from ..sources import files, merging
from ..sources.bindings import corpus, fb, pairs, qset, vec
from . import query
from .aggregate_checks import TOKENS_SQL
from .function_checks import WORDS_SQL
from .guard_checks import EVIDENCE_SQL, RUBRIC_SQL
from .join_checks import CENTROIDS_SQL, RANKINGS_SQL, rankings

TEXT_COLS = ["text", "region", "equipment", "severity"]

BM25_SQL = f"""{TOKENS_SQL},
    post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT c.doc_id, coalesce(n, 0) AS dl FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
    n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, n GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text),
        '[A-Za-z0-9]+')) AS term FROM qset) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE
        + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc_id), n GROUP BY query_id, doc_id),
    bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc
        QUALIFY rank <= 20)"""


# Built once per session and input, and shared by the searches below.
_stored: dict[tuple[str, str, str], object] = {}


def _once(kind, spark, d, build):
    key = (kind, spark.sparkContext.applicationId, d)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def new_index(spark, d):
    return retrieval.bm25_index(corpus(spark, d), "doc_id", TEXT_COLS)


def index(spark, d):
    return _once("bm25", spark, d, lambda: new_index(spark, d))


def collection(spark, d):
    """The embedder, and the corpus with its vectors as it is stored."""

    def build():
        docs = corpus(spark, d)
        model, vectors = retrieval.embedded(docs, "text")
        meta = ["region", "equipment", "severity"]
        stored = files.build_collection(vectors, work_path(spark, "vectors"), "doc_id", "text", meta, "region", vec_col="vec")
        return model, stored.select(F.col("id").alias("doc_id"), "vec", "meta.*")

    return _once("vectors", spark, d, build)


@query("r01_bm25_index", "SELECT doc_id, term, tf FROM post", views="corpus",
       ctes=f"{TOKENS_SQL}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)")
def bm25_index(spark, d):
    return new_index(spark, d).postings.select("doc_id", "term", "tf")


@query("r02_bm25_search", "SELECT query_id, doc_id, score, rank FROM bm", views="corpus qset", ctes=BM25_SQL)
def bm25_search(spark, d):
    hits = retrieval.bm25_search(index(spark, d), qset(spark, d), "query_id", "text", 20)
    return hits.select("query_id", "doc_id", "score", "rank")


def segmented(spark, d):
    """The corpus in segments: half of it comes first, then the rest, and some of it goes and comes again."""

    def build():
        docs = corpus(spark, d).select("doc_id", *TEXT_COLS)
        out = segments.create_index(docs.filter("doc_id % 2 = 0"), work_path(spark, "segments"), "doc_id", TEXT_COLS)
        out.add(docs.filter("doc_id % 2 <> 0"))
        out.replace(docs.filter("doc_id % 11 = 0"))
        return out

    return _once("segments", spark, d, build)


@query("r01_segment_statistics", "SELECT term, count(*) AS df FROM post GROUP BY term", views="corpus",
       ctes=f"{TOKENS_SQL}, post AS (SELECT DISTINCT doc_id, term FROM tok)")
def segment_statistics(spark, d):
    return segmented(spark, d).document_frequency()


@query("r02_segment_search", "SELECT query_id, doc_id, score, rank FROM bm", views="corpus qset", ctes=BM25_SQL)
def segment_search(spark, d):
    """The exact top 20 without looking at every posting."""
    return segmented(spark, d).search(qset(spark, d), "query_id", "text", 20).select("query_id", "doc_id", "score", "rank")


@query(
    "r02_bm25_search_padded",
    """SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT q.query_id, c.doc_id, coalesce(score, 0.0) AS score
       FROM qset q CROSS JOIN len c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = c.doc_id)
       QUALIFY rank <= 20""",
    views="corpus qset",
    ctes=BM25_SQL,
)
def bm25_search_padded(spark, d):
    hits = retrieval.bm25_search(index(spark, d), qset(spark, d), "query_id", "text", 20, pad=True)
    return hits.select("query_id", "doc_id", "score", "rank")


@query(
    "r03_embed",
    """SELECT doc_id, 256 AS dims, CASE WHEN len(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
       FROM corpus""",
    views="corpus",
)
def embed(spark, d):
    docs = corpus(spark, d).select("doc_id", "text")
    out = retrieval.embed(retrieval.embedder(docs, "text"), docs, "text")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("doc_id", F.size("vec").alias("dims"), F.round(norm, 3).alias("norm"))


VEC_SQL = """SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) DESC,
    vec_id) AS INT) AS rank FROM embeddings, cent"""


@query("r04_vector_search", f"SELECT query_id, doc_id, score, rank FROM ({VEC_SQL} WHERE label = 3 QUALIFY rank <= 10)",
       ctes=CENTROIDS_SQL)
def vector_search(spark, d):
    vectors = vec(spark, d)
    hits = retrieval.vector_search(vectors, "vec_id", "embedding", retrieval.centroids(vectors, "label", "embedding"),
                                   "query_id", "qv", 10, filters={"label": 3})
    return hits.select("query_id", "doc_id", "score", "rank")


def vector_file(spark, d):
    return _once("cells", spark, d, lambda: vector_index.build_vector_index(vec(spark, d), "vec_id", "embedding", keep=["label"]))


@query("r04_index_every_cell", f"SELECT query_id, doc_id, score, rank FROM ({VEC_SQL} QUALIFY rank <= 10)", ctes=CENTROIDS_SQL)
def index_every_cell(spark, d):
    """The inverted file with every cell probed: the exact result over all rows."""
    index, asks = vector_file(spark, d), retrieval.centroids(vec(spark, d), "label", "embedding")
    return vector_index.indexed_search(index, asks, "query_id", "qv", 10, probes=len(index.centres))


@query("r04_index_recall", "SELECT count(*) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def index_recall(spark, d):
    """Every twentieth row asked for its ten nearest among all rows: the share that the probed cells hold."""
    rows = vec(spark, d)
    asks = rows.filter("vec_id % 20 = 0")
    found = vector_index.indexed_search(vector_file(spark, d), asks, "vec_id", "embedding", 10)
    true = retrieval.vector_search(rows, "vec_id", "embedding", asks, "vec_id", "embedding", 10)
    return vector_index.measured_recall(found, true).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "r05_rrf_fuse",
    """SELECT query_id, doc_id, s AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INT)
       AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS s FROM
       (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) QUALIFY rank <= 20""",
    ctes=RANKINGS_SQL,
)
def rrf_fuse(spark, d):
    return retrieval.rrf_fuse(list(rankings(spark, d)))


@query(
    "r06_rerank",
    """SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id)
       AS INT) AS final_rank FROM (SELECT bm.query_id, bm.doc_id, bm.rank, round(len(list_intersect(qd, td)) / greatest(len(qd), 1), 4)
       AS rerank_score FROM bm JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS qd FROM qset)
       USING (query_id) JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS td FROM corpus)
       USING (doc_id)) QUALIFY final_rank <= 5""",
    views="corpus qset",
    ctes=BM25_SQL,
)
def rerank(spark, d):
    hits = retrieval.bm25_search(index(spark, d), qset(spark, d), "query_id", "text", 20)
    asked = materialize(hits.join(qset(spark, d).withColumnRenamed("text", "question"), "query_id"), "hits")
    cands = join_measured(corpus(spark, d).select("doc_id", "text"), asked, "doc_id")
    out = retrieval.rerank(cands, retrieval.coverage(F.col("question"), F.col("text")), 5)
    return out.select("query_id", "doc_id", "rerank_score", F.col("rank").alias("final_rank"))


@query("r07_hybrid_search")
def hybrid_search(spark, d):
    model, stored = collection(spark, d)
    return retrieval.hybrid_search(corpus(spark, d), qset(spark, d), index(spark, d), model, filters={"region": "en"}, stored=stored)


@query("r07_hybrid_shape", "SELECT query_id, 5::BIGINT AS n, TRUE AS ranked, TRUE AS ordered FROM qset", views="qset")
def hybrid_shape(spark, d):
    """Every question gets its five answers, ranked one to five by falling score."""
    out = hybrid_search(spark, d)
    by_rank = F.sort_array(F.collect_list(F.struct("final_rank", "rerank_score")))
    found = out.groupBy("query_id").agg(F.count("*").alias("n"), by_rank.alias("_r"))
    falling = F.transform("_r", lambda r: -r["rerank_score"])
    return found.select("query_id", "n", (F.transform("_r", lambda r: r["final_rank"].cast("int")) == F.array(*map(F.lit, range(1, 6)))).alias("ranked"),
                        (falling == F.array_sort(falling)).alias("ordered"))


@query(
    "r08_merge_hits",
    """SELECT query_id, doc_id, src, CAST(row_number() OVER (PARTITION BY query_id ORDER BY src, rank, doc_id) AS INT) AS place FROM
       (SELECT * FROM (SELECT 0 AS src, query_id, doc_id, rank FROM e UNION ALL SELECT 1, query_id, doc_id, rank FROM a
        UNION ALL SELECT 2, query_id, doc_id, rank FROM b) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id
        ORDER BY src, rank) = 1) QUALIFY place <= 10""",
    ctes=RANKINGS_SQL + """, e AS (SELECT p_brand AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand
        ORDER BY p_partkey) AS rank FROM part QUALIFY rank <= 2)""",
)
def merge_hits(spark, d):
    from ..sources.bindings import table

    semantic, lexical = rankings(spark, d)
    part = table(spark, d, "part").selectExpr("p_brand AS query_id", "p_partkey AS doc_id")
    exact = top_per_group(part, ["query_id"], [F.asc("doc_id")], 2)
    return retrieval.merge_hits(exact, semantic, lexical).select("query_id", "doc_id", "src", "place")


@query(
    "r09_cache_lookup",
    """SELECT vec_id AS query_id, CASE WHEN s >= 0.7 THEN query_id END AS cached_id, CASE WHEN s >= 0.7 THEN s END AS similarity
       FROM (SELECT vec_id, query_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS s FROM embeddings, cent)
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, query_id) = 1""",
    ctes=CENTROIDS_SQL,
)
def cache_lookup(spark, d):
    vectors = vec(spark, d)
    cache = retrieval.centroids(vectors, "label", "embedding")
    return retrieval.cache_lookup(vectors, "vec_id", "embedding", cache, "query_id", "qv", threshold=0.7)


CACHE_SQL = f"""SELECT md5(question) AS cache_id, question, answer, version FROM
    (SELECT *, conv_id * 1000 + turn AS version FROM w WHERE {EVIDENCE_SQL} >= 0.5 AND {RUBRIC_SQL} >= 3)
    QUALIFY row_number() OVER (PARTITION BY question ORDER BY version DESC) = 1"""


def answers_to_keep(spark, d):
    rows = pairs(spark, d)
    q, a = F.col("question"), F.col("answer")
    keep = passes_gate(evidence_score(a, F.lit(1)), answer_rubric(q, a))
    return retrieval.cache_rows(rows, q, a, F.col("conv_id") * 1000 + F.col("turn"), keep)


@query("r10_stored_cache", CACHE_SQL, views="pairs", ctes=WORDS_SQL)
def stored_cache(spark, d):
    """The answer cache as a stored table: answers come in batches, and a batch that comes again changes nothing."""
    answers = answers_to_keep(spark, d)
    cache = merging.create_table(answers.filter("version % 3 = 0"), work_path(spark, "cache"), ["cache_id"], "version", buckets=16)
    for batch, part in ((1, 1), (2, 2), (1, 1)):
        cache.upsert(answers.filter(F.col("version") % 3 == part), batch)
    return cache.read()


@query("r10_cache_upsert", CACHE_SQL, views="pairs", ctes=WORDS_SQL)
def cache_upsert(spark, d):
    answers = answers_to_keep(spark, d)
    return retrieval.cache_upsert(answers.filter("version % 2 = 0"), answers.filter("version % 2 <> 0"))


@query(
    "r10_cache_from_feedback",
    """SELECT md5(comment) AS cache_id, comment AS question, CAST(session_id AS VARCHAR) AS answer, feedback_id AS version
       FROM fb WHERE helpful AND CAST(rating AS INT) >= 4""",
    views="fb",
)
def cache_from_feedback(spark, d):
    keep = F.col("helpful") & (F.col("rating").try_cast("int") >= 4)
    new = retrieval.cache_rows(fb(spark, d), F.col("comment"), F.col("session_id").cast("string"), F.col("feedback_id"), keep)
    # The first half is cached, then the whole comes in: every one of its questions is replaced by itself.
    return retrieval.cache_upsert(new.filter("version % 2 = 0"), new)
