"""The inverted file: recall, what it reads, and how it changes."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from busbar.operators import retrieval, vector_index
from busbar.sources.bindings import vec


@pytest.fixture(scope="module")
def rows(spark, sf):
    return vec(spark, sf).select("vec_id", "embedding", "label").cache()


@pytest.fixture(scope="module")
def index(rows):
    return vector_index.build_vector_index(rows, "vec_id", "embedding", keep=["label"])


def hits(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_all_cells_give_the_exact_result(rows, index):
    asks = rows.filter("vec_id % 20 = 0")
    true = retrieval.vector_search(rows, "vec_id", "embedding", asks, "vec_id", "embedding", 10)
    found = vector_index.indexed_search(index, asks, "vec_id", "embedding", 10, probes=len(index.centres))
    assert hits(found) == hits(true)
    narrow = vector_index.indexed_search(index, asks, "vec_id", "embedding", 5, probes=len(index.centres), filters={"label": 3})
    exact = retrieval.vector_search(rows, "vec_id", "embedding", asks, "vec_id", "embedding", 5, filters={"label": 3})
    assert hits(narrow) == hits(exact)


def test_recall_of_every_twentieth_row(rows, index):
    asks = rows.filter("vec_id % 20 = 0")
    true = retrieval.vector_search(rows, "vec_id", "embedding", asks, "vec_id", "embedding", 10)
    found = vector_index.indexed_search(index, asks, "vec_id", "embedding", 10)
    row = vector_index.measured_recall(found, true).first()
    assert row["n_queries"] == asks.count() and row["recall"] >= 0.9


def clustered(spark, n=4000, dim=16, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(clusters, size=n)] + 0.15 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>")


def test_reads_few_cells_where_rows_gather(spark):
    rows = clustered(spark)
    index = vector_index.build_vector_index(rows, "id", "v")
    assert index.probes <= len(index.centres) // 4
    asks = rows.filter("id % 20 = 0")
    true = retrieval.vector_search(rows, "id", "v", asks, "id", "v", 10)
    found = vector_index.indexed_search(index, asks, "id", "v", 10)
    assert vector_index.measured_recall(found, true).first()["recall"] >= 0.9
    one = rows.filter("id = 40")
    plan = vector_index.indexed_search(index, one, "id", "v", 10)
    text = plan._jdf.queryExecution().toString()
    cells = re.findall(r"PartitionFilters: \[[^]]*cell#\d+ (?:IN \(([\d,]+)\)|= (\d+))", text)
    assert cells and all(len((many or single).split(",")) <= index.probes for many, single in cells)


def test_rows_come_change_and_go(spark):
    rows = clustered(spark, 600, 8, 6)
    index = vector_index.build_vector_index(rows.filter("id < 500"), "id", "v")
    vector_index.add_vectors(index, rows.filter("id >= 500"), "id", "v")
    moved = spark.createDataFrame([(3, [9.0] * 8), (4, None), (700, [-9.0] * 8)], "id long, v array<double>")
    before = {f: f for f in index.rows(spark).inputFiles()}
    touched = vector_index.replace_vectors(index, moved, "id", "v")
    after = set(index.rows(spark).inputFiles())
    assert 1 <= len(touched) <= 4
    kept = [f for f in before if int(f.split("cell=")[1].split("/")[0]) not in touched]
    assert kept and set(kept) <= after  # no other cell is written
    want = rows.filter("id NOT IN (3, 4)").unionByName(moved.filter("v IS NOT NULL"))
    again = vector_index.load_vector_index(spark, index.path)
    asks = want.filter("id % 50 = 0 OR id = 3")
    found = vector_index.indexed_search(again, asks, "id", "v", 7, probes=len(again.centres))
    assert hits(found) == hits(retrieval.vector_search(want, "id", "v", asks, "id", "v", 7))
    assert sorted(r["doc_id"] for r in again.rows(spark).collect()) == sorted(r["id"] for r in want.collect())


def test_awkward_rows(spark):
    names = "id long, v array<double>"
    none = spark.createDataFrame([], names)
    index = vector_index.build_vector_index(none, "id", "v")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (1, [1.0, 0.0])], names)
    assert vector_index.indexed_search(index, one, "id", "v").count() == 0
    index = vector_index.build_vector_index(one, "id", "v")
    found = vector_index.indexed_search(index, one, "id", "v", 10, probes=len(index.centres)).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in found if r["score"] == 1) == [(1, 1)] * 4
    assert vector_index.indexed_search(index, spark.createDataFrame([(9, [1.0])], names), "id", "v").count() == 0


def test_blocks_of_many_queries_hold_few_products(spark, monkeypatch):
    """More queries than one block: results are those of one pass, and no task holds all products of its rows and queries."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(700, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "doc_id long, v array<double>")
    asks = df.filter("doc_id % 2 = 0").selectExpr("doc_id AS query_id", "v AS q")
    want = sorted(map(tuple, retrieval.vector_search(df, "doc_id", "v", asks, "query_id", "q", 3).collect()))
    ids, q = pa.array(range(700)), pa.array(range(0, 700, 2))
    held = []

    def spied(scores, own, k, plain=retrieval._best):
        held.append(scores.base.size if scores.base is not None else scores.size)
        return plain(scores, own, k)

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 60)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 200)
    assert sorted(map(tuple, retrieval.vector_search(df, "doc_id", "v", asks, "query_id", "q", 3).collect())) == want
    caught = {}
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 7000, raising=False)
    monkeypatch.setattr(retrieval, "_best", spied)

    class Caught:
        def __init__(self, rows): self.rows = rows
        def count(self): return 700
        def withColumn(self, *_): return self
        def groupBy(self, *_): return self
        def cogroup(self, _): return self
        def applyInArrow(self, fn, _): caught["meet"] = fn

    schema = asks.select(F.col("query_id"), F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score")).schema
    retrieval._scan_blocks(Caught(0), Caught(0), schema, 3, 6)
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    got = caught["meet"](None, pa.table({"doc_id": ids, "v": lists(v)}), pa.table({"query_id": q, "q": lists(v[::2])}))
    assert max(held) <= 7000 and len(held) == 350
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("query_id", "doc_id", "score")))) == sorted(r[:3] for r in want)


def test_places_of_vectors_without_direction(spark, monkeypatch):
    """Nearest cells in slices, with nulls, other lengths and null components between."""
    monkeypatch.setattr(vector_index, "SCORES_AT_ONCE", 4, raising=False)
    rows = [(0, [1.0, 0.1]), (1, None), (2, [0.1, 1.0]), (3, [1.0]), (4, [None, 1.0]), (5, [-1.0, 0.2])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    got = {r[0]: r[1] for r in df.select("id", vector_index._cells_of(spark, centres, "v", 2).alias("c")).collect()}
    assert got == {0: [0, 1], 1: None, 2: [1, 0], 3: None, 4: None, 5: [2, 1]}
    none = df.filter("v IS NULL").select(vector_index._cells_of(spark, centres, "v", 9).alias("c")).collect()
    assert [r[0] for r in none] == [None]
