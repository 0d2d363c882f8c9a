"""Streaming queries, drained with `availableNow` and compared with the batch answer."""

from pyspark.sql import functions as F

from ..sources.bindings import FEATURES, OUTAGES, table
from ..session import prepare, work_path
from ..streaming import live
from . import query
from .aggregate_checks import MAP_TEXT
from .model_checks import models


def readings(spark, d):
    """The event files as a stream of telemetry readings."""
    outages = ",".join(f"'{o}'" for o in OUTAGES)
    return live.read_files(prepare(spark), d, live.EVENT_SCHEMA, "events.parquet").selectExpr(
        "event_id AS reading_id", "ts", "concat('Zone_', char(65 + user_id % 4)) AS zone", "event_type AS equipment",
        "value", "value / 500 AS prob", "50 + (value - 50) / 100 AS freq",
        f"element_at(array({outages}), CAST(user_id % 8 AS INT) + 1) AS outage")


@query(
    "st1_ingest",
    """SELECT reading_id, coalesce(CASE WHEN equipment <> 'error' THEN freq END, 50.0) AS freq,
       coalesce(CASE WHEN equipment <> 'view' THEN zone END, 'Zone_A') AS zone, equipment,
       'SCADA-RTU-001' AS source_id FROM tel""",
    views="tel",
)
def ingest(spark, d):
    gaps = readings(spark, d).select(
        "reading_id", F.when(F.col("equipment") != "error", F.col("freq")).alias("freq"),
        F.when(F.col("equipment") != "view", F.col("zone")).alias("zone"), "equipment")
    return live.append_stream(live.ingest(gaps), work_path(spark, "ingest"))


@query("st2_score_stream")
def score_stream(spark, d):
    _, cls, reg = models(spark, d)
    schema = table(spark, d, "lineitem").schema
    lines = live.read_files(spark, d, schema, "lineitem.parquet")
    rows = lines.selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id", *FEATURES,
                            "l_returnflag = 'R' AS unstable")
    scored = live.score_stream(rows, cls, reg, FEATURES, ["unstable"])
    return live.append_stream(scored, work_path(spark, "scored"))


@query(
    "st3_bounded_buffer",
    "SELECT reading_id, zone, value FROM tel ORDER BY ts DESC, reading_id DESC LIMIT 500",
    views="tel",
)
def bounded_buffer(spark, d):
    path, stream = work_path(spark, "buffer"), readings(spark, d)
    live.bounded_buffer(stream, path, [F.desc("ts"), F.desc("reading_id")])
    return live.read_buffer(spark, path, stream.schema).select("reading_id", "zone", "value")


@query(
    "st4_minute_windows",
    """SELECT CAST(epoch_us(ts) // 60000000 AS BIGINT) AS window_id, count(*) AS n, count(*) FILTER (prob >= 0.5) AS unstable,
       round(avg(freq), 6) AS mean_freq FROM tel GROUP BY 1""",
    views="tel",
)
def minute_windows(spark, d):
    path = work_path(spark, "windows")
    live.minute_log(readings(spark, d), path, "ts", "prob", "freq")
    return live.read_minutes(spark, path)


@query(
    "st5_last_known",
    """SELECT zone, ts, reading_id, value, outage FROM tel
       QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC, reading_id DESC) = 1""",
    views="tel",
)
def last_known(spark, d):
    path = work_path(spark, "state")
    result = live.last_known(readings(spark, d), ["zone"], "ts", "reading_id", ["value", "outage"])
    live.delta_log(result, path)
    return live.read_delta_log(spark, path, result.schema, ["zone"])


@query(
    "st6_append_feedback",
    """SELECT o_orderkey AS feedback_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating,
       o_orderstatus = 'F' AS helpful FROM orders""",
)
def append_feedback(spark, d):
    schema = table(spark, d, "orders").schema
    rows = live.read_files(spark, d, schema, "orders.parquet").selectExpr(
        "o_orderkey AS feedback_id", "CAST(substring(o_orderpriority, 1, 1) AS INT) AS rating", "o_orderstatus = 'F' AS helpful")
    return live.append_stream(rows, work_path(spark, "feedback"))


@query(
    "st7_buffer_summary",
    """SELECT count(*) AS buffer_size, round(count(*) FILTER (prob >= 0.5) / count(*) * 100, 1) AS unstable_pct,
       round(avg(greatest(0, least(100, trunc((1 - prob) * 100)))), 1) AS mean_health, round(avg(freq), 3) AS mean_freq_hz,
       (SELECT string_agg(outage || '=' || n, ',' ORDER BY outage) FROM (SELECT outage, count(*) AS n FROM buf GROUP BY 1))
         AS outage_distribution,
       (SELECT string_agg(CAST(reading_id AS VARCHAR), ',' ORDER BY reading_id) FROM (SELECT reading_id FROM buf
         ORDER BY ts DESC, reading_id DESC LIMIT 10)) AS last_ids FROM buf""",
    views="tel",
    ctes="buf AS (SELECT * FROM tel ORDER BY ts DESC, reading_id DESC LIMIT 500)",
)
def buffer_summary(spark, d):
    path, stream = work_path(spark, "buffer"), readings(spark, d)
    live.bounded_buffer(stream, path, [F.desc("ts"), F.desc("reading_id")])
    buffer = live.read_buffer(spark, path, stream.schema)
    latest = buffer.orderBy(F.desc("ts"), F.desc("reading_id")).limit(10)  # the ten readings on show
    ids = latest.agg(F.array_join(F.transform(F.sort_array(F.collect_list("reading_id")), lambda x: x.cast("string")), ","))
    out = live.buffer_summary(buffer, "prob", "freq", ["outage"])
    return out.withColumn("outage_distribution", F.expr(MAP_TEXT.format("outage_distribution"))).withColumn(
        "last_ids", ids.scalar())
