"""Roll-ups against the readings themselves, whatever the batches, slices and order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from busbar.operators import rollups
from busbar.session import work_path
from busbar.sources.bindings import tel

Q = {"p10": 0.1, "p50": 0.5, "p95": 0.95}


@pytest.fixture(scope="module")
def rows(spark, sf):
    gap = F.when(F.col("reading_id") % 17 != 0, F.col("value"))
    return tel(spark, sf).select("reading_id", "ts", "zone", "equipment", gap.alias("value")).cache()


def check(got, rows):
    """Exact figures equal those of the readings, estimated ones are within their bounds."""
    for r in got.collect():
        own = rows.filter(F.col("zone") == r["zone"]).toPandas()
        v = own.value.dropna().to_numpy()
        assert r["n_rows"] == len(own) and r["value_n"] == len(v)
        assert r["value_mean"] == pytest.approx(v.mean()) and r["value_std"] == pytest.approx(v.std(ddof=1), rel=1e-6)
        assert (r["value_min"], r["value_max"]) == (v.min(), v.max())
        for name, q in Q.items():
            assert abs((v <= r[f"value_{name}"]).mean() - q) <= rollups.RANK_ERROR + 1 / len(v)
        assert abs(r["reading_id_distinct"] - len(own)) <= rollups.COUNT_ERROR * len(own)
        assert r["equipment_distinct"] == own.equipment.nunique()


@pytest.mark.parametrize("every", ["1 minute", "1 day"])
def test_slices_give_the_whole(rows, every):
    rolled = rollups.roll_up(rows, ["zone"], "ts", every, ["value"], ["equipment", "reading_id"])
    check(rollups.statistics(rolled, ["zone"], ["value"], Q, ["equipment", "reading_id"]), rows)


def test_batches_in_any_order_repeated_and_compacted(spark, rows):
    path = work_path(spark, "rolled")
    kept = ["equipment", "reading_id"]
    roll = lambda part: rollups.roll_up(rows.filter(F.col("reading_id") % 5 == part), ["zone"], "ts", "6 hours", ["value"], kept, "reading_id")
    for batch, part in ((3, 3), (0, 0), (1, 1), (4, 4), (2, 2), (1, 1)):
        rollups.keep_batch(roll(part), path, batch)
    check(rollups.statistics(rollups.stored(spark, path), ["zone"], ["value"], Q, kept), rows)
    n = rollups.stored(spark, path).count()
    rollups.compact(spark, path, ["zone"], ["value"], kept, last=True, below=2)
    rollups.compact(spark, path, ["zone"], ["value"], kept, last=True)
    after = rollups.stored(spark, path)
    assert after.count() < n and after.count() == after.select("zone", "slice").distinct().count()
    check(rollups.statistics(after, ["zone"], ["value"], Q, kept), rows)
    newest = {r["zone"]: r["x"] for r in rollups.merge(after, ["zone"], ["value"], last=True).select("zone", F.col("value_last.x").alias("x")).collect()}
    want = rows.filter("value IS NOT NULL").groupBy("zone").agg(F.max_by("value", F.struct("ts", "reading_id")).alias("x")).collect()
    assert newest == {r["zone"]: r["x"] for r in want}


def test_stream_keeps_it(spark, rows, tmp_path):
    for k in range(3):
        rows.filter(F.col("reading_id") % 3 == 2 - k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = work_path(spark, "rolled")
    query = rollups.maintain(stream, path, f"{tmp_path}/checkpoint", ["zone"], "ts", "1 hour", ["value"], ["equipment", "reading_id"])
    query.trigger(availableNow=True).start().awaitTermination()
    check(rollups.statistics(rollups.stored(spark, path), ["zone"], ["value"], Q, ["equipment", "reading_id"]), rows)


def test_awkward_rows(spark):
    names = "k string, ts timestamp, v double, id int"
    rolled = rollups.roll_up(spark.createDataFrame([], names), ["k"], "ts", "1 hour", ["v"], ["id"])
    assert rolled.count() == 0 and rollups.statistics(rolled, [], ["v"]).first()["n_rows"] is None
    rows = spark.createDataFrame([(None, None, None, None), ("a", None, 2.0, 1), ("a", None, None, 1), (None, None, 5.0, 2)], names)
    got = rollups.statistics(rollups.roll_up(rows, ["k"], "ts", "1 hour", ["v"], ["id"]), ["k"], ["v"], {"p50": 0.5}, ["id"]).collect()
    assert sorted((r["k"] or "", r["n_rows"], r["v_n"], r["v_mean"], r["v_p50"], r["id_distinct"]) for r in got) == [("", 2, 1, 5.0, 5.0, 1), ("a", 2, 1, 2.0, 2.0, 1)]
    assert np.isclose(rollups.statistics(rollups.roll_up(rows, ["k"], "ts", "1 hour", ["v"]), [], ["v"]).first()["v_mean"], 3.5)
