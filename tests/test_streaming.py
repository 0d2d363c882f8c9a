"""Many small batches, repeated batches, and restarts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from busbar.catalog.streaming_checks import readings
from busbar.sources.bindings import tel
from busbar.streaming import live


@pytest.fixture(scope="module")
def folder(spark, sf):
    """The events of one table in six files, in arrival order."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i in range(6):
        spark.read.parquet(f"{sf}/events.parquet").filter(f"event_id % 6 = {i}").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return live.read_files(spark, folder, live.EVENT_SCHEMA, "*.parquet", per_trigger=1)


def test_buffer_over_many_batches(spark, sf, folder):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/buffer"
    live.bounded_buffer(stream(spark, folder), path, [F.desc("ts"), F.desc("event_id")], rows=50)
    versions = live._batches(spark, path)
    assert versions == [3, 4, 5]  # older versions are deleted
    for v in versions:
        assert spark.read.parquet(f"{path}/v{v}").count() <= 50
    got = {r["event_id"] for r in live.read_buffer(spark, path, live.EVENT_SCHEMA).collect()}
    want = tel(spark, sf).orderBy(F.desc("ts"), F.desc("reading_id")).limit(50).collect()
    assert got == {r["reading_id"] for r in want}


def test_reading_before_the_first_batch(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/nothing"
    assert live.read_buffer(spark, path, live.EVENT_SCHEMA).count() == 0


def test_a_running_query_takes_new_files(spark, sf, folder):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/running"
    writer = stream(spark, folder).writeStream.format("parquet").option("path", path).outputMode("append")
    query = live.keep_running(writer, f"{path}-checkpoint", "1 second")
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert spark.read.parquet(path).count() == tel(spark, sf).count()


def test_windows_over_many_batches_equal_batch(spark, sf, folder):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/windows"
    rows = stream(spark, folder).withColumns({"prob": F.col("value") / 500, "freq": 50 + (F.col("value") - 50) / 100})
    # A watermark wider than the data: nothing is late, however the files are ordered.
    result = live.minute_windows(rows, "ts", "prob", "freq", late="60 days")
    live.delta_log(result, path)
    got = live.read_delta_log(spark, path, result.schema, ["window_id"]).agg(F.sum("n"), F.count("*"), F.sum("unstable")).first()
    t = tel(spark, sf)
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    want = t.agg(F.count("*"), F.countDistinct(minute), F.count_if(F.col("prob") >= 0.5)).first()
    assert tuple(got) == tuple(want)


def test_late_readings_go_to_a_side_table(spark):
    folder, path = tempfile.mkdtemp(prefix="run-", dir="/tmp"), tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/minutes"
    schema = "id long, ts timestamp_ntz, prob double, freq double"
    files = [
        [(1, "00:00:10", 0.1, 50.0), (2, "00:30:00", 0.9, 51.0)],
        [(3, "00:09:59", 0.9, 52.0), (4, "00:20:30", 0.9, None), (5, None, 0.1, 50.0), (6, "00:19:59", 0.1, 50.0)],
        [(7, "00:00:20", 0.1, 50.0), (8, "00:30:40", 0.1, 52.0), (9, "00:20:10", 0.2, 50.0)],
    ]
    for rows in files:  # one batch each, in this order
        frame = spark.createDataFrame([(k, t and f"2024-01-01 {t}", p, f) for k, t, p, f in rows], "id long, ts string, prob double, freq double")
        frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):  # the second run finds its checkpoint and no new files
        rows = live.read_files(spark, folder, spark.createDataFrame([], schema).schema, "*.parquet", per_trigger=1)
        live.minute_log(rows, path, "ts", "prob", "freq")
    # The watermark after the first batch is 00:20:00.
    assert sorted(r["id"] for r in live.read_late(spark, path, rows.schema).collect()) == [3, 5, 6, 7]
    got = sorted((r["window_id"] % 60, r["n"], r["unstable"], r["mean_freq"]) for r in live.read_minutes(spark, path).collect())
    assert got == [(0, 1, 0, 50.0), (20, 2, 1, 50.0), (30, 2, 1, 51.5)]
    assert live.read_minutes(spark, path + "-none").count() == 0


def test_last_known_over_many_batches(spark, sf, folder):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/state"
    rows = stream(spark, folder).withColumn("zone", F.expr("concat('Zone_', char(65 + user_id % 4))"))
    result = live.last_known(rows, ["zone"], "ts", "event_id", ["value"])
    live.delta_log(result, path)
    got = {r["zone"]: r["event_id"] for r in live.read_delta_log(spark, path, result.schema, ["zone"]).collect()}
    want = tel(spark, sf).groupBy("zone").agg(F.max_by("reading_id", F.struct("ts", "reading_id")).alias("r")).collect()
    assert got == {r["zone"]: r["r"] for r in want}


def test_restart_adds_nothing(spark, folder):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/append"
    for _ in range(2):  # the second run finds its checkpoint and no new files
        out = live.append_stream(stream(spark, folder), path)
    assert out.count() == 1000 and out.select("event_id").distinct().count() == 1000


def test_ingest_defaults(spark):
    df = spark.createDataFrame([(None, "Zone_C"), (49.9, None)], "freq double, zone string")
    rows = live.ingest(df).collect()
    assert [(r["freq"], r["zone"], r["source_id"]) for r in rows] == [
        (50.0, "Zone_C", "SCADA-RTU-001"), (49.9, "Zone_A", "SCADA-RTU-001")]


def test_stream_scores_equal_batch_scores(spark, sf):
    from busbar.catalog import model_checks as mc
    from busbar.catalog.streaming_checks import score_stream

    live_rows = score_stream(spark, sf).toPandas()
    batch = mc.predict_batch(spark, sf).toPandas()
    assert len(live_rows) == len(batch) and live_rows.unstable.isna().all()
    assert sorted(live_rows.pred_health_score) == sorted(batch.pred_health_score)


def test_readings_have_the_batch_columns(spark, sf):
    assert readings(spark, sf).columns == tel(spark, sf).columns
