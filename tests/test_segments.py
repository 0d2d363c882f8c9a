"""The segmented index: what it finds, what it reads, and what changes leave of it."""

import numpy as np
import pyarrow as pa
import pytest

from busbar.operators import retrieval, segments
from busbar.session import work_path
from busbar.sources.bindings import corpus, qset

COLS = ["text", "region"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return corpus(spark, sf).select("doc_id", *COLS).cache()


@pytest.fixture(scope="module")
def asks(spark, sf):
    return qset(spark, sf).select("query_id", "text").cache()


def anew(docs, asks, k):
    index = retrieval.bm25_index(docs, "doc_id", COLS)
    return rows_of(retrieval.bm25_search(index, asks, "query_id", "text", k).select("query_id", "doc_id", "score", "rank"))


def test_search_equals_scoring_everything(spark, docs, asks, monkeypatch):
    monkeypatch.setattr(segments, "SHARD_DOCS", 70)
    index = segments.create_index(docs, work_path(spark, "segments"), "doc_id", COLS)
    found = index.search(asks, "query_id", "text", 7).select("query_id", "doc_id", "score", "rank")
    assert rows_of(found) == anew(docs, asks, 7)


def test_changes_equal_an_index_built_anew(spark, docs, asks):
    path = work_path(spark, "segments")
    index = segments.create_index(docs.filter("doc_id % 3 = 0"), path, "doc_id", COLS)
    index.add(docs.filter("doc_id % 3 = 1"))
    index.delete(docs.filter("doc_id % 5 = 0"))
    changed = docs.filter("doc_id % 7 < 2").selectExpr("doc_id", "concat('transformer outage ', text) AS text", "region")
    index.replace(changed)
    index.delete(spark.createDataFrame([(10**9,), (3,)], "doc_id long"))
    now = docs.filter("doc_id % 3 <> 2 AND doc_id % 5 <> 0 AND doc_id % 7 >= 2").unionByName(changed).filter("doc_id <> 3")
    again = segments.SegmentedIndex(spark, path, "doc_id", COLS)
    want = anew(now, asks, 10)
    for one in (again, again.compact(work_path(spark, "compacted"))):
        assert rows_of(one.search(asks, "query_id", "text", 10).select("query_id", "doc_id", "score", "rank")) == want
        about = one.statistics().first()
        fresh = retrieval.bm25_index(now, "doc_id", COLS)
        assert about["n_docs"] == fresh.n_docs and about["avg_len"] == pytest.approx(fresh.avg_len)
        assert rows_of(one.document_frequency()) == rows_of(fresh.terms.select("term", "df"))


def shard(rng, n_docs, terms):
    """Lists of one shard as the index has them, and all postings."""
    dl = rng.integers(5, 200, n_docs)
    lists, every = [], {}
    for share in terms:
        docs = np.flatnonzero(rng.random(n_docs) < share)
        if not len(docs):
            continue
        tf = np.minimum(rng.geometric(0.5, len(docs)), dl[docs])
        rows = [(int(tf[k : k + 16].max()), int(dl[docs[k : k + 16]].min()), docs[k : k + 16], tf[k : k + 16], dl[docs[k : k + 16]]) for k in range(0, len(docs), 16)]
        w = float(np.log((n_docs - len(docs) + 0.5) / (len(docs) + 0.5)))
        w = w if w > 0 else 0.1
        lists.append((w, segments._List(rows, 80.0)))
        for d, p in zip(docs.tolist(), segments._part(tf.astype(float), dl[docs].astype(float), 80.0).tolist()):
            every[d] = every.get(d, 0.0) + w * p
    return lists, every


def test_skipping_keeps_the_best_and_reads_less():
    rng, listed, read = np.random.default_rng(3), 0, 0
    for trial in range(60):
        lists, every = shard(rng, 3000, rng.choice([0.002, 0.01, 0.1, 0.5, 0.9], 4))
        gone = rng.choice(3000, 40 * (trial % 2), replace=False)
        docs, scores, seen = segments.best_of_shard(lists, gone, 10)
        want = sorted((-round(s, 6), d) for d, s in every.items() if d not in set(gone.tolist()))[:10]
        got = sorted((-round(s, 6), d) for d, s in zip(docs.tolist(), scores.tolist()))[:10]
        assert got == want
        listed, read = listed + sum(int(x.sizes.sum()) for _, x in lists), read + seen
    assert read < 0.6 * listed


def test_counts_and_empty_tables(spark, docs, asks):
    index = segments.create_index(docs, work_path(spark, "segments"), "doc_id", COLS)
    counts = index.postings_read(asks, "query_id", "text", 3)
    assert counts.filter("scored > listed OR scored < 0").count() == 0 and counts.filter("scored < listed").count() > 0
    none = segments.create_index(docs.limit(0), work_path(spark, "none"), "doc_id", COLS)
    assert none.search(asks, "query_id", "text").count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "")], "doc_id long, text string, region string")
    index = segments.create_index(blank, work_path(spark, "blank"), "doc_id", COLS)
    assert index.search(asks, "query_id", "text").count() == 0 and index.statistics().first()["n_docs"] == 2


def test_postings_are_not_shuffled(spark, docs, asks):
    index = segments.create_index(docs, work_path(spark, "segments"), "doc_id", COLS)
    blocks = spark.read.parquet(f"{index.path}/segment-0/blocks")
    plan = index.search(asks, "query_id", "text", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_tf" not in plan and "file" in plan  # names of files move, lists do not
    index.delete(docs.filter("doc_id % 2 = 0"))
    odd = docs.filter("doc_id % 2 = 1")
    assert rows_of(index.document_frequency()) == rows_of(retrieval.bm25_index(odd, "doc_id", COLS).terms.select("term", "df"))
    assert blocks.filter("term IS NULL").selectExpr("sum(size(docs)) AS n").first().n == docs.count()


def test_blocks_equal_counted_terms(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_DOCS", 3)
    rng = np.random.default_rng(5)
    ids = [None if i == 9 else int(i) for i in rng.integers(0, 25, 40)]  # some come twice, some have no id
    toks = [[f"t{t}" for t in rng.integers(0, 6, n)] for n in rng.integers(0, 8, 40)]
    rows = pa.table({"shard": pa.array([4] * 40, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "toks": pa.array(toks, pa.list_(pa.string()))})
    want = {}
    for i, words in zip(ids, toks):
        for w in words:
            want[w, i, len(words)] = want.get((w, i, len(words)), 0) + 1
    got, lists = {}, {}
    for r in segments._blocks_of_shard(rows).to_pylist():
        assert r["shard"] == 4 and r["n"] == len(r["docs"]) == len(r["tfs"]) == len(r["dls"])
        if r["term"] is None:
            assert sorted(zip(map(str, r["docs"]), r["dls"])) == sorted(zip(map(str, ids), map(len, toks)))
            continue
        assert r["n"] <= 3 and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])
        lists.setdefault(r["term"], []).extend(zip(((-1 if d is None else d) for d in r["docs"]), r["tfs"], r["dls"]))
        got |= {(r["term"], d, n): tf for d, tf, n in zip(r["docs"], r["tfs"], r["dls"])}
    assert got == want and all(x == sorted(x) for x in lists.values())
    none = segments._blocks_of_shard(rows.slice(0, 1).set_column(2, "toks", pa.array([[]], pa.list_(pa.string()))))
    assert none.to_pylist()[0]["term"] is None and none.num_rows == 1
