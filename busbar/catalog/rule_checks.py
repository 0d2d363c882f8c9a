"""Rule derivations."""

from pyspark.sql import functions as F

from ..functions.hashing import gaussian, uniform
from ..operators import clean, rules
from ..operators.aggregates import nominal_level
from ..sources.bindings import FEATURES, feat, met, tel
from . import query


@query(
    "d01_equipment_class",
    """SELECT row_id, CASE WHEN l_quantity >= (SELECT quantile_cont(l_quantity, 0.75) FROM feat) THEN 'transformer'
       WHEN (l_discount + l_tax) / 2 >= (SELECT quantile_cont((l_discount + l_tax) / 2, 0.75) FROM feat)
         THEN 'smart_meter_bank'
       WHEN abs(l_discount - l_tax) < 0.005 THEN 'substation' ELSE 'distribution_unit' END AS equipment_class
       FROM feat""",
    views="feat",
)
def equipment_class(spark, d):
    el = (F.col("l_discount") + F.col("l_tax")) / 2
    rows = feat(spark, d).select("row_id", *FEATURES)
    out = rules.equipment_class(rows, "l_quantity", el, F.col("l_discount") - F.col("l_tax"))
    return out.select("row_id", "equipment_class")


@query(
    "d02_status_from_margin",
    """SELECT row_id, CASE WHEN unstable AND l_tax >= 0.07 THEN 'critical' WHEN unstable AND l_tax >= 0.04
       THEN 'overloaded' WHEN unstable THEN 'degraded' WHEN l_tax >= 0.02 THEN 'monitoring' ELSE 'normal' END
       AS status FROM feat""",
    views="feat",
)
def status_from_margin(spark, d):
    return feat(spark, d).select("row_id", rules.status_from_margin(F.col("unstable"), F.col("l_tax")).alias("status"))


_PROB_CASE = """CASE WHEN prob < 0.40 THEN 'normal' WHEN prob < 0.65 THEN 'degraded' WHEN prob < 0.85
    THEN 'overloaded' ELSE 'critical' END"""


@query(
    "d03_outage_from_status",
    """SELECT reading_id, status, CASE status WHEN 'normal' THEN 'no_event' WHEN 'degraded' THEN 'voltage_deviation'
       WHEN 'overloaded' THEN 'partial_outage' ELSE 'full_outage' END AS outage_class FROM st""",
    views="tel",
    ctes=f"st AS (SELECT reading_id, {_PROB_CASE} AS status FROM tel)",
)
def outage_from_status(spark, d):
    st = tel(spark, d).select("reading_id", rules.by_threshold(F.col("prob"), rules.STATUS_BY_PROB).alias("status"))
    return rules.lookup(st, "status", rules.STATUS_TO_OUTAGE, "outage_class")


@query(
    "d04_status_from_voltage",
    """SELECT reading_id, CASE WHEN value < 230 THEN 'degraded' WHEN value < 237 THEN 'monitoring'
       WHEN value <= 245 THEN 'normal' ELSE 'monitoring' END AS status FROM tel""",
    views="tel",
)
def status_from_voltage(spark, d):
    return tel(spark, d).select("reading_id", rules.status_from_voltage(F.col("value")).alias("status"))


@query(
    "d05_meter_event",
    """SELECT reading_id, CASE WHEN filled > 8.0 THEN 'high_demand_event' WHEN power IS NULL THEN 'meter_dropout'
       ELSE 'no_event' END AS event FROM (SELECT *, coalesce(power, k / 5.0) AS filled FROM met)""",
    views="met",
)
def meter_event(spark, d):
    filled = F.coalesce("power", F.col("k") / 5.0)
    return met(spark, d).select("reading_id", rules.meter_event(filled, F.col("power").isNull()).alias("event"))


@query(
    "d06_status_from_probability",
    f"""SELECT reading_id, {_PROB_CASE} AS status, CASE WHEN prob < 0.40 THEN 'no_event' WHEN prob < 0.65
       THEN 'voltage_deviation' WHEN prob < 0.85 THEN 'partial_outage' ELSE 'full_outage' END AS outage_class FROM tel""",
    views="tel",
)
def status_from_probability(spark, d):
    p = F.col("prob")
    return tel(spark, d).select(
        "reading_id",
        rules.by_threshold(p, rules.STATUS_BY_PROB).alias("status"),
        rules.by_threshold(p, rules.OUTAGE_BY_PROB).alias("outage_class"),
    )


@query(
    "d07_minmax_frequency",
    """SELECT reading_id, round(50.0 + ((value - (SELECT min(value) FROM tel)) / ((SELECT max(value) FROM tel)
       - (SELECT min(value) FROM tel)) - 0.5) * 2.4, 4) AS grid_frequency FROM tel""",
    views="tel",
)
def minmax_frequency(spark, d):
    out = rules.minmax_frequency(tel(spark, d).select("reading_id", "value"), "value")
    return out.select("reading_id", F.round("grid_frequency", 4).alias("grid_frequency"))


@query(
    "d08_deviation_frequency",
    """SELECT reading_id, round(50.0 - (power - n) / n * 0.5, 4) AS grid_frequency FROM met,
       (SELECT avg(power) AS n FROM met)""",
    views="met",
)
def deviation_frequency(spark, d):
    rows = met(spark, d).select("reading_id", "ts", "power")
    nominal = nominal_level(rows, "power").scalar()
    return rows.select("reading_id", F.round(rules.deviation_frequency(F.col("power"), nominal), 4)
                       .alias("grid_frequency"))


@query(
    "d09_frequency_state",
    """SELECT zone, CASE WHEN m IS NULL THEN 'unknown' WHEN m BETWEEN 49.8 AND 50.2 THEN 'normal'
       WHEN abs(m - 50.0) > 0.5 THEN 'excursion' ELSE 'deviation' END AS state
       FROM (SELECT zone, avg(freq) AS m FROM tel GROUP BY zone)""",
    views="tel",
)
def frequency_state(spark, d):
    return tel(spark, d).groupBy("zone").agg(rules.frequency_state(F.avg("freq")).alias("state"))


@query(
    "d10_health_score",
    """SELECT reading_id, CAST(greatest(0, least(100, trunc((1 - prob) * 100))) AS INT) AS health,
       CASE WHEN prob >= 0.5 THEN 'unstable' ELSE 'stable' END AS label FROM tel""",
    views="tel",
)
def health_score(spark, d):
    p = F.col("prob")
    return tel(spark, d).select("reading_id", rules.health_score(p).alias("health"),
                                rules.stability_label(p).alias("label"))


@query(
    "d11_event_lookups",
    """SELECT reading_id, outage, CASE outage WHEN 'no_event' THEN 'low' WHEN 'full_outage' THEN 'critical'
       WHEN 'voltage_deviation' THEN 'medium' WHEN 'meter_dropout' THEN 'medium'
       WHEN 'renewable_variability' THEN 'medium' ELSE 'high' END AS severity,
       CASE outage WHEN 'no_event' THEN 'normal' WHEN 'voltage_deviation' THEN 'monitoring'
       WHEN 'meter_dropout' THEN 'monitoring' WHEN 'high_demand_event' THEN 'overloaded'
       WHEN 'partial_outage' THEN 'overloaded' WHEN 'full_outage' THEN 'critical' ELSE 'degraded' END AS status
       FROM tel""",
    views="tel",
)
def event_lookups(spark, d):
    rows = tel(spark, d).select("reading_id", "outage")
    rows = rules.lookup(rows, "outage", rules.EVENT_TO_SEVERITY, "severity")
    return rules.lookup(rows, "outage", rules.EVENT_TO_STATUS, "status")


@query(
    "d12_electrical",
    """SELECT row_id, voltage, current, power_kw, round(power_kw * (0.88 + 0.24 * u3), 2) AS demand FROM (
         SELECT *, round(current * voltage / 1000, 2) AS power_kw FROM (
           SELECT *, round(greatest(220.0, least(260.0, (49 + l_tax * 25) * 4.8 + z * 4.0)), 2) AS voltage,
                  round(abs(l_quantity / 10) * 8 + 2.0 + 10.0 * u2, 2) AS current FROM u))""",
    views="feat",
    ctes="""u AS (SELECT *, sqrt(-2.0 * ln((('0x' || substr(md5(row_id || 'va'), 1, 8))::BIGINT + 1) / 4294967296.0))
            * cos(2 * pi() * (('0x' || substr(md5(row_id || 'vb'), 1, 8))::BIGINT / 4294967296.0)) AS z,
            ('0x' || substr(md5(row_id || 'c'), 1, 8))::BIGINT / 4294967296.0 AS u2,
            ('0x' || substr(md5(row_id || 'd'), 1, 8))::BIGINT / 4294967296.0 AS u3 FROM feat)""",
)
def electrical(spark, d):
    key = F.col("row_id")
    out = rules.electrical(
        feat(spark, d), 49 + F.col("l_tax") * 25, F.col("l_quantity") / 10, gaussian(key, "v", 0.0, 4.0),
        2.0 + 10.0 * uniform(key, "c"), 0.88 + 0.24 * uniform(key, "d"),
    )
    return out.select("row_id", "voltage", "current", "power_kw", "demand")


@query(
    "d13_impute_mean",
    """SELECT reading_id, coalesce(TRY_CAST(CASE WHEN power IS NULL THEN 'x' ELSE CAST(power AS VARCHAR) END AS DOUBLE),
       4.116) AS imputed FROM met""",
    views="met",
)
def impute_mean(spark, d):
    raw = F.coalesce(F.col("power").cast("string"), F.lit("x"))
    return met(spark, d).select("reading_id", rules.impute_mean(raw, 4.116).alias("imputed"))
