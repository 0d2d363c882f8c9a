"""Window functions."""

from pyspark.sql import functions as F

from ..operators import windows
from ..operators.spread import top_per_group
from ..sources.bindings import corpus, met, table, tel
from . import query

_BY_METER = "OVER (PARTITION BY meter_id ORDER BY ts, reading_id ROWS BETWEEN"


@query(
    "w01_forward_fill",
    f"SELECT reading_id, meter_id, last_value(power IGNORE NULLS) {_BY_METER} UNBOUNDED PRECEDING AND CURRENT ROW) AS power FROM met",
    views="met",
)
def forward_fill(spark, d):
    rows = met(spark, d).select("reading_id", "meter_id", "ts", "power")
    return windows.forward_fill(rows, ["meter_id"], ["ts", "reading_id"], ["power"]).drop("ts")


@query(
    "w02_back_fill",
    f"SELECT reading_id, meter_id, first_value(power IGNORE NULLS) {_BY_METER} CURRENT ROW AND UNBOUNDED FOLLOWING) AS power FROM met",
    views="met",
)
def back_fill(spark, d):
    rows = met(spark, d).select("reading_id", "meter_id", "ts", "power")
    return windows.back_fill(rows, ["meter_id"], ["ts", "reading_id"], ["power"]).drop("ts")


@query(
    "w03_block_fill",
    """SELECT reading_id, coalesce(last_value(power IGNORE NULLS) OVER (PARTITION BY b ORDER BY ts, reading_id ROWS
       BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(power IGNORE NULLS) OVER (PARTITION BY b
       ORDER BY ts, reading_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS power FROM
       (SELECT *, (row_number() OVER (ORDER BY ts, reading_id) - 1) // 100 AS b FROM met)""",
    views="met",
)
def block_fill(spark, d):
    rows = met(spark, d).select("reading_id", "ts", "power")
    return windows.block_fill(rows, ["ts", "reading_id"], ["power"], block=100).drop("ts")


@query(
    "w04_spread_timestamps",
    """SELECT reading_id, make_timestamp(CAST(epoch_us(TIMESTAMP '2020-01-01') + floor(
       (epoch_us(TIMESTAMP '2023-12-31 23:00:00') - epoch_us(TIMESTAMP '2020-01-01')) *
       ((rn - 1) / (n - 1))) AS BIGINT)) AS timestamp FROM (SELECT reading_id, row_number() OVER (ORDER BY value,
       reading_id) AS rn, count(*) OVER () AS n FROM tel)""",
    views="tel",
)
def spread_timestamps(spark, d):
    rows = tel(spark, d).select("reading_id", "value")
    return windows.spread_timestamps(rows, ["value", "reading_id"]).select("reading_id", "timestamp")


@query(
    "w05_rank_within_query",
    """SELECT severity, doc_id, CAST(rank AS INT) AS rank FROM (SELECT severity, doc_id, row_number() OVER
       (PARTITION BY severity ORDER BY length(text) DESC, doc_id) AS rank FROM corpus) WHERE rank <= 100""",
    views="corpus",
)
def rank_within_query(spark, d):
    rows = corpus(spark, d).select("severity", "doc_id", F.length("text").alias("n"))
    return top_per_group(rows, ["severity"], [F.desc("n"), F.asc("doc_id")], 100).drop("n")


@query(
    "w06_last_n_per_zone",
    """SELECT zone, reading_id, value, CAST(row_number() OVER (PARTITION BY zone ORDER BY ts DESC, reading_id DESC)
       AS INT) AS age_rank FROM tel QUALIFY age_rank <= 500""",
    views="tel",
)
def last_n_per_zone(spark, d):
    rows = tel(spark, d).select("zone", "reading_id", "ts", "value")
    return windows.last_n(rows, ["zone"], "ts", "reading_id", 500).drop("ts")


@query(
    "w07_sequence_ids",
    "SELECT o_orderkey, printf('INC-%04d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS incident_id FROM orders",
)
def sequence_ids(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return windows.sequence_ids(rows, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "w08_last_hours",
    """SELECT reading_id, zone, value FROM tel
       QUALIFY ts > max(ts) OVER (PARTITION BY zone) - INTERVAL 24 HOURS""",
    views="tel",
)
def last_hours(spark, d):
    return windows.last_hours(tel(spark, d).select("reading_id", "zone", "ts", "value"), ["zone"], "ts", 24).drop("ts")
