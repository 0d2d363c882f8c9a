"""The stored table: what a change writes, what it leaves alone, and what is read."""

import pytest

from busbar.operators.sampling import upsert
from busbar.session import work_path
from busbar.sources import merging
from busbar.sources.bindings import table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def base(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment", "c_acctbal", "0 AS version")


@pytest.fixture
def stored(spark, base):
    return merging.create_table(base, work_path(spark, "customers"), ["c_custkey"], "version", buckets=16)


def files(spark, stored):
    return {f for f in spark.read.parquet(f"{stored.path}/rows").inputFiles()}


def test_upsert_equals_the_whole_rewrite(spark, base, stored):
    changes = base.filter("c_acctbal < 0").selectExpr("c_custkey", "c_mktsegment", "0.0D AS c_acctbal", "1 AS version")
    more = spark.createDataFrame([(10**9, "NEW", 1.0, 0)], base.schema)
    stored.upsert(changes.unionByName(more), 1)
    want = rows_of(upsert(base, changes.unionByName(more), ["c_custkey"], "version").select(*base.columns))
    assert rows_of(stored.read()) == want
    stored.compact()
    assert stored.batches() == [] and rows_of(stored.read()) == want
    assert rows_of(merging.open_table(spark, stored.path).read()) == want


def test_one_row_rewrites_one_bucket(spark, base, stored):
    before = files(spark, stored)
    one = base.filter("c_custkey = 7").selectExpr("c_custkey", "'X' AS c_mktsegment", "c_acctbal", "5 AS version")
    stored.upsert(one, 1)
    assert files(spark, stored) == before and len(stored.touched()) == 1
    assert stored.read().filter("c_custkey = 7").first()["c_mktsegment"] == "X"
    touched = stored.compact()
    after = files(spark, stored)
    assert len(touched) == 1
    own = f"_bucket={touched[0]}/"
    assert {f for f in before if own not in f} == {f for f in after if own not in f}
    assert {f for f in before if own in f}.isdisjoint(f for f in after if own in f)


def test_batches_are_idempotent_and_ordered(spark, base, stored):
    row = lambda seg, version: spark.createDataFrame([(7, seg, 1.0, version)], base.schema)
    seg = lambda: stored.read().filter("c_custkey = 7").first()["c_mktsegment"]
    stored.upsert(row("A", 1), 1)
    stored.upsert(row("A", 1), 1)
    stored.upsert(row("B", 1), 2)  # of equal versions the later batch wins
    assert seg() == "B" and stored.read().count() == base.count()
    stored.upsert(row("old", 0), 3)
    assert seg() == "B"
    stored.upsert(row("C", 2), 2)  # the batch comes again, changed
    assert seg() == "C"
    stored.compact()
    stored.upsert(row("late", 9), 2)  # it is known, and over
    assert seg() == "C"
    stored.upsert(row("D", 9), 4)
    assert seg() == "D"


def test_rows_go(spark, base, stored):
    n = base.count()
    stored.delete(spark.createDataFrame([(7, 3), (8, 3), (10**9, 3)], "c_custkey long, version int"), 1)
    assert stored.read().count() == n - 2
    stored.compact()
    assert stored.read().count() == n - 2 and stored.lookup(base.filter("c_custkey IN (7, 9)")).count() == 1
    every = base.selectExpr("c_custkey", "9 AS version")
    stored.delete(every, 2)
    stored.compact()
    assert stored.read().count() == 0


def test_lookup_reads_the_keys_buckets(spark, base, stored):
    wanted = base.filter("c_custkey IN (3, 4)")
    stored.upsert(base.filter("c_custkey = 4").selectExpr("c_custkey", "'X' AS c_mktsegment", "c_acctbal", "5 AS version"), 1)
    found = stored.lookup(wanted)
    assert {(r["c_custkey"], r["c_mktsegment"] == "X") for r in found.collect()} == {(3, False), (4, True)}
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString()


def test_empty_tables_null_keys_and_clashes(spark):
    names = "k string, v int, n int"
    none = spark.createDataFrame([], names)
    stored = merging.create_table(none, work_path(spark, "empty"), ["k"], "n", buckets=4)
    assert stored.read().count() == 0
    stored.upsert(none, 1)
    stored.upsert(spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("", 3, 1)], names), 2)
    assert rows_of(stored.read()) == [("", 3, 1), (None, 2, 2)]
    stored.compact()
    assert rows_of(stored.read()) == [("", 3, 1), (None, 2, 2)]
    with pytest.raises(ValueError):
        merging.create_table(spark.createDataFrame([(1, 2)], "k int, _batch int"), work_path(spark, "clash"), ["k"], "k")
