"""Search paths that the small tables do not reach, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from busbar.operators import retrieval
from busbar.sources.bindings import corpus, qset


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).round(3)
    m[7] = m[3]  # an exact copy
    m[11] = 0.0
    rows = [(i, [float(x) for x in v], "a" if i % 2 else "b") for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(5).persist(), m


def brute(m, q, k, keep=None):
    norm = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    s = np.round(np.divide(m @ q, norm, out=np.zeros(len(m)), where=norm > 0), 6)
    ids = [i for i in range(len(m)) if keep is None or keep(i)]
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


@pytest.mark.parametrize("block", [2000, 7])
def test_vector_search_equals_brute_force(spark, vectors, block, monkeypatch):
    df, m = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 60)
    queries = df.filter("id < 20").select(F.col("id").alias("q"), "v")
    got = retrieval.vector_search(df, "id", "v", queries, "q", "v", 5, {"g": "a"}).toPandas()
    for q in range(20):
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.doc_id) == brute(m, m[q], 5, lambda i: i % 2 == 1), q


def test_vector_search_filter_matching_nothing(spark, vectors):
    df, _ = vectors
    queries = df.limit(2).select(F.col("id").alias("q"), "v")
    assert retrieval.vector_search(df, "id", "v", queries, "q", "v", 5, {"g": "zz"}).count() == 0


def test_k_above_the_collection(spark, vectors):
    df, _ = vectors
    queries = df.filter("id = 1").select(F.col("id").alias("q"), "v")
    assert retrieval.vector_search(df, "id", "v", queries, "q", "v", 1000).count() == 300


@pytest.mark.parametrize("block", [2000, 5])
def test_cache_lookup_keeps_queries_without_a_vector(spark, vectors, block, monkeypatch):
    df, _ = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    asks = df.filter("id < 4").withColumn("v", F.when(F.col("id") != 2, F.col("v")))
    cache = df.filter("id BETWEEN 1 AND 20").withColumn("v", F.when(F.col("id") != 9, F.col("v")))
    got = {r.query_id: r.cached_id for r in retrieval.cache_lookup(asks, "id", "v", cache, "id", "v", 0.99).collect()}
    assert got == {0: None, 1: 1, 2: None, 3: 3}


@pytest.mark.parametrize("block", [2000, 5])
def test_vectors_of_other_lengths_fail(spark, vectors, block, monkeypatch):
    df, _ = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    odd = df.withColumn("v", F.when(F.col("id") == 50, F.slice("v", 1, 3)).otherwise(F.col("v")))
    with pytest.raises(Exception, match="cannot be compared"):
        retrieval.vector_search(odd, "id", "v", df.limit(20), "id", "v", 3).collect()


@pytest.mark.parametrize("block", [2000, 5])
def test_cache_lookup_paths(spark, vectors, block, monkeypatch):
    df, m = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    cache = df.filter("id < 30")
    got = retrieval.cache_lookup(df, "id", "v", cache, "id", "v", 0.9).toPandas().set_index("query_id")
    assert len(got) == 300
    for q in range(0, 300, 17):
        best = brute(m[:30], m[q], 1)[0]
        norm = np.linalg.norm(m[best]) * np.linalg.norm(m[q])
        s = round(float(m[best] @ m[q] / norm), 6) if norm else 0.0
        assert (got.cached_id[q] == best) if s >= 0.9 else math.isnan(got.cached_id[q])


DOCS = ["the grid the outage", "grid voltage dip", "solar wind", "outage outage grid", "", "the the the"]


def okapi(docs, query, k1=1.5, b=0.75):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in toks:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg)) for t in query.split()))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_bm25_by_broadcast_and_by_shuffle(spark, limit, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "outage grid outage"), (2, "nowhere"), (3, "the")], "q int, t string")
    index = retrieval.bm25_index(df, "doc_id", ["text"])
    got = retrieval.bm25_search(index, queries, "q", "t", 20).toPandas()
    assert set(got.query_id) == {1, 3}
    for q, text in ((1, "outage grid outage"), (3, "the")):
        want = okapi(DOCS, text)
        mine = got[got.query_id == q].set_index("doc_id").score
        for i, s in enumerate(want):
            assert abs(mine.get(i, 0.0) - s) < 1e-6
            assert i in mine.index or not set(text.split()) & set(DOCS[i].split())
    padded = retrieval.bm25_search(index, queries, "q", "t", 4, pad=True).toPandas()
    assert (padded.groupby("query_id").size() == 4).all() and len(padded) == 12
    assert list(padded[padded.query_id == 2].sort_values("rank").doc_id) == [0, 1, 2, 3]


def test_scoring_moves_no_postings(spark, sf):
    index = retrieval.bm25_index(corpus(spark, sf), "doc_id", ["text"])
    plan = retrieval.bm25_search(index, qset(spark, sf), "query_id", "text")._jdf.queryExecution().executedPlan().toString()
    below_limit = plan[plan.index("HashAggregate"):]
    assert "Exchange hashpartitioning" not in below_limit


def test_rrf_is_symmetric_and_keeps_single_list_docs(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    x = retrieval.rrf_fuse([a, b]).orderBy("rank").collect()
    assert x == retrieval.rrf_fuse([b, a]).orderBy("rank").collect()
    assert [r["doc_id"] for r in x] == [11, 10, 12]
    assert x[0]["rrf_score"] == round(1 / 61 + 1 / 62, 6)


def test_merge_hits_order_and_total(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    out = retrieval.merge_hits(mk([(1, 5, 1)]), mk([(1, 5, 1), (1, 6, 2)]), mk([(1, i, i) for i in range(1, 20)]), 10)
    rows = out.orderBy("place").collect()
    assert [r["doc_id"] for r in rows] == [5, 6, 1, 2, 3, 4, 7, 8, 9, 10]


def test_rerank_without_scorer_keeps_order(spark):
    c = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 3)], "query_id int, doc_id int, rank int")
    rows = retrieval.rerank(c, None, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [11, 10] and rows[0]["rerank_score"] is None


def test_hybrid_filter_both(spark, sf):
    docs = corpus(spark, sf)
    index = retrieval.bm25_index(docs, "doc_id", ["text"])
    model = retrieval.embedder(docs, "text")
    hits = retrieval.hybrid_search(docs, qset(spark, sf), index, model, filters={"region": "en"}, filter_both=True)
    langs = {r["region"] for r in hits.join(docs, "doc_id").select("region").distinct().collect()}
    assert langs == {"en"}


def test_texts_are_hashed_once(spark, monkeypatch):
    """`embedded` gives the model and vectors of `embedder` and `embed`, and splits each text once."""
    docs = spark.createDataFrame([(1, "Grid down in Zone A", "x"), (2, "up", "y"), (2, "grid up", None), (None, "", "z")], "doc_id long, text string, region string")
    model = retrieval.embedder(docs, "text", 32)
    want = retrieval.embed(model, docs, "text").collect()
    split = []
    monkeypatch.setattr(retrieval, "tokens", lambda c, real=retrieval.tokens: split.append(c) or real(c))
    again, vectors = retrieval.embedded(docs, "text", 32)
    assert sorted(map(str, vectors.collect())) == sorted(map(str, want)) and vectors.columns == [*docs.columns, "vec"]
    assert len(split) == 1
    assert sorted(map(str, retrieval.embed(again, docs, "text").collect())) == sorted(map(str, want))
