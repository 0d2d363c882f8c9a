"""End-to-end jobs."""

from pyspark.sql import functions as F

from ..operators import forest, retrieval
from ..operators.rules import EVENT_TO_SEVERITY, EVENT_TO_STATUS
from ..operators.sampling import INCIDENT_QUOTAS
from ..plans import jobs
from ..session import work_path
from ..sources import files
from ..sources.bindings import FEATURES, corpus, evalm, fb, feat, met, qset, table, tel
from . import query
from .aggregate_checks import MAP_TEXT, PASS_SQL
from .function_checks import TEL_NAMES, template_sql
from .model_checks import fitted_forest, labelled, models
from .sampling_checks import hex32


def enriched(spark, d):
    el = (F.col("l_discount") + F.col("l_tax")) / 2
    rows = feat(spark, d).select("row_id", "l_quantity", "l_discount", "l_tax", "unstable")
    return jobs.enrich_stability(rows, "row_id", "l_tax", "unstable", "l_quantity", el, path=work_path(spark, "stability"))


@query(
    "c01_stability_enrichment",
    f"""SELECT row_id, make_timestamp(CAST(epoch_us(TIMESTAMP '2020-01-01') + floor((epoch_us(TIMESTAMP '2023-12-31 23:00:00')
        - epoch_us(TIMESTAMP '2020-01-01')) * ((rn - 1) / (n - 1))) AS BIGINT)) AS timestamp,
        CASE WHEN unstable THEN CASE WHEN u <= 0.15 THEN 'Zone_A' WHEN u <= 0.5 THEN 'Zone_B' WHEN u <= 0.85 THEN 'Zone_C'
          ELSE 'Zone_D' END ELSE CASE WHEN u <= 0.25 THEN 'Zone_A' WHEN u <= 0.5 THEN 'Zone_B' WHEN u <= 0.75 THEN 'Zone_C'
          ELSE 'Zone_D' END END AS region,
        CASE WHEN l_quantity >= q75 THEN 'transformer' WHEN (l_discount + l_tax) / 2 >= e75 THEN 'smart_meter_bank'
          WHEN abs(l_tax) < 0.005 THEN 'substation' ELSE 'distribution_unit' END AS equipment_type, status AS transformer_status,
        round(50.0 + ((l_tax - lo) / (hi - lo) - 0.5) * 2.4, 3) AS grid_frequency,
        CASE status WHEN 'normal' THEN 'no_event' WHEN 'overloaded' THEN 'partial_outage' WHEN 'critical' THEN 'full_outage'
          ELSE 'voltage_deviation' END AS outage_event
        FROM (SELECT *, row_number() OVER (ORDER BY l_tax, row_id) AS rn, count(*) OVER () AS n,
          {hex32("row_id || 'zone'")} / 4294967296.0 AS u,
          CASE WHEN unstable AND l_tax >= 0.07 THEN 'critical' WHEN unstable AND l_tax >= 0.04 THEN 'overloaded'
            WHEN unstable THEN 'degraded' WHEN l_tax >= 0.02 THEN 'monitoring' ELSE 'normal' END AS status FROM feat),
        (SELECT quantile_cont(l_quantity, 0.75) AS q75, quantile_cont((l_discount + l_tax) / 2, 0.75) AS e75,
          min(l_tax) AS lo, max(l_tax) AS hi FROM feat)""",
    views="feat",
)
def stability_enrichment(spark, d):
    return enriched(spark, d).select("row_id", "timestamp", "region", "equipment_type", "transformer_status",
                                     "grid_frequency", "outage_event")


def raw_meters(spark, d):
    """Delimited meter file, written from the readings and scanned back."""
    path = work_path(spark, "meter-file")
    rows = met(spark, d).select(
        "reading_id", F.date_format("ts", "dd/MM/yyyy").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.col("power").alias("Global_active_power"), (F.lit(220) + F.col("k") * 0.3).alias("Voltage"),
        (F.col("k") / 4).alias("Global_intensity"))
    rows.write.option("header", True).option("sep", ";").option("nullValue", "?").csv(path)
    return files.scan_delimited(spark, path, rows.schema)


METER_SQL = """raw AS (SELECT reading_id, strftime(ts, '%d/%m/%Y') AS date, strftime(ts, '%H:%M:%S') AS time, power, 220 + k * 0.3::DOUBLE AS v,
      k / 4 AS cur, (row_number() OVER (ORDER BY reading_id) - 1) // 200000 AS b FROM met),
    filled AS (SELECT reading_id, date, time, v, cur, power IS NULL AS missing, coalesce(last_value(power IGNORE NULLS) OVER
      (PARTITION BY b ORDER BY reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(power IGNORE NULLS)
      OVER (PARTITION BY b ORDER BY reading_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM raw),
    nom AS (SELECT avg(v) AS n FROM raw),
    meters AS (SELECT reading_id, strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S') AS timestamp, p AS power_consumption,
      p AS demand_load, v AS voltage, cur AS current, round(50.0 - (v - n) / n * 0.5, 3) AS grid_frequency,
      CASE WHEN v < 230 THEN 'degraded' WHEN v < 237 THEN 'monitoring' WHEN v <= 245 THEN 'normal' ELSE 'monitoring' END
        AS transformer_status,
      CASE WHEN p > 8.0 THEN 'high_demand_event' WHEN missing THEN 'meter_dropout' ELSE 'no_event' END AS outage_event
      FROM filled, nom)"""


def enriched_meters(spark, d):
    return jobs.enrich_meters(raw_meters(spark, d), ["reading_id"], path=work_path(spark, "meters"))


@query(
    "c02_meter_enrichment",
    """SELECT reading_id, timestamp, power_consumption, demand_load, voltage, current, grid_frequency, transformer_status,
       outage_event, 'Zone_A_Residential' AS region, 'smart_meter' AS equipment_type FROM meters""",
    views="met",
    ctes=METER_SQL,
)
def meter_enrichment(spark, d):
    return enriched_meters(spark, d).select(
        "reading_id", "timestamp", "power_consumption", "demand_load", "voltage", "current", "grid_frequency",
        "transformer_status", "outage_event", "region", "equipment_type")


def _choice_sql(u: str, names) -> str:
    steps, total = "CASE", 0.0
    for n in names[:-1]:
        total += 1.0 / len(names)
        steps += f" WHEN {u} <= {round(total, 10)} THEN '{n}'"
    return steps + f" ELSE '{names[-1]}' END"


def _u_sql(expr: str) -> str:
    return f"({hex32(expr)} / 4294967296.0::DOUBLE)"


_QUOTA_CASE = "CASE outage_event " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in INCIDENT_QUOTAS.items()) + " END"
_K = "CAST(reading_id AS VARCHAR)"
_DESC = "CASE outage_event " + " ".join(
    f"WHEN '{c}' THEN {template_sql(c, {n: n for n in TEL_NAMES})}" for c in EVENT_TO_STATUS) + " END"

INCIDENT_SQL = f"""{METER_SQL},
    gs AS (SELECT reading_id, outage AS outage_event, freq AS grid_frequency, value / 100 AS p1 FROM tel
      WHERE outage IN ({', '.join(f"'{e}'" for e in jobs.GRID_EVENTS)}) QUALIFY row_number() OVER (PARTITION BY outage
      ORDER BY md5({_K} || '42'), reading_id) <= {_QUOTA_CASE}),
    g1 AS (SELECT *, round(greatest(220.0, least(260.0, grid_frequency * 4.8 + 4.0 * (sqrt(-2.0 * ln(({hex32(_K + " || 'volta'")} + 1)
      / 4294967296.0)) * cos(2 * pi() * {_u_sql(_K + " || 'voltb'")})))), 2) AS voltage,
      round(abs(p1) * 8 + (2.0 + 10.0 * {_u_sql(_K + " || 'amp'")}), 2) AS current FROM gs),
    g2 AS (SELECT *, round(current * voltage / 1000, 2) AS power_consumption FROM g1),
    g AS (SELECT 'grid' AS source, reading_id, outage_event, {_choice_sql(_u_sql(_K + " || 'region'"), jobs.REGIONS)} AS region,
      {_choice_sql(_u_sql(_K + " || 'site'"), jobs.EQUIPMENT)} AS equipment_type, voltage, current, power_consumption,
      round(power_consumption * (0.88 + 0.24 * {_u_sql(_K + " || 'demand'")}), 2) AS demand_load, round(grid_frequency, 3) AS grid_frequency
      FROM g2),
    hi AS (SELECT *, 'high_demand_event' AS ev FROM meters WHERE power_consumption >= (SELECT quantile_cont(power_consumption, 0.85)
      FROM meters) ORDER BY md5({_K} || '42'), reading_id LIMIT 25),
    lo AS (SELECT *, 'meter_dropout' AS ev FROM meters WHERE power_consumption <= (SELECT quantile_cont(power_consumption, 0.02)
      FROM meters) OR power_consumption >= (SELECT quantile_cont(power_consumption, 0.97) FROM meters)
      ORDER BY md5({_K} || '42'), reading_id LIMIT 20),
    m AS (SELECT 'meter' AS source, reading_id, ev AS outage_event, 'Zone_A' AS region,
      {_choice_sql(_u_sql(_K + " || 'site'"), jobs.METER_SITES)} AS equipment_type, round(voltage, 2) AS voltage,
      round(current, 2) AS current, round(power_consumption, 3) AS power_consumption, round(demand_load, 3) AS demand_load,
      round(grid_frequency, 3) AS grid_frequency FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)),
    r AS (SELECT *, concat_ws(':', source, outage_event, {_K}) AS tag,
      CASE outage_event {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TO_SEVERITY.items())} END AS severity,
      CASE outage_event {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TO_STATUS.items())} END AS transformer_status
      FROM (SELECT * FROM g UNION ALL SELECT * FROM m))"""


@query(
    "c03_incident_derivation",
    f"""SELECT printf('INC-%04d', row_number() OVER (ORDER BY md5(tag || '99'), tag)) AS incident_id,
        TIMESTAMP '2021-01-01' + to_days(CAST(floor({_u_sql("tag || 'day'")} * 1096) AS INT)) AS timestamp, region, equipment_type,
        voltage, current, power_consumption, demand_load, grid_frequency, transformer_status, outage_event, severity,
        {_DESC} AS description FROM r""",
    views="tel met",
    ctes=INCIDENT_SQL,
)
def incident_derivation(spark, d):
    grid = tel(spark, d).selectExpr("reading_id", "outage AS outage_event", "freq AS grid_frequency", "value / 100 AS p1")
    return jobs.derive_incidents(grid, enriched_meters(spark, d), "reading_id", path=work_path(spark, "incidents"))


def zone_assessment(spark, d):
    _, cls, reg = models(spark, d)
    rows = labelled(spark, d).withColumn("freq", 50 + F.col("margin"))
    return jobs.assess_stability(rows, ["grp"], "ts", "row_id", "freq", FEATURES, cls, reg, fitted_forest(spark, d))


@query("c04_stability_assessment")
def stability_assessment(spark, d):
    out = zone_assessment(spark, d)
    return out.withColumns({"anomaly_flags": F.to_json("anomaly_flags"), "drivers": F.to_json("drivers")})


_METER_STATS = """SELECT count(power) AS n, round(avg(power), 3) AS mean_kw, round(max(power), 3) AS max_kw, round(min(power), 3) AS min_kw,
    round(stddev_samp(power), 3) AS std_kw, count(*) FILTER (power > (SELECT quantile_cont(power, 0.95) FROM met)) AS peak_events,
    count(*) AS readings FROM met"""


@query(
    "c05_meter_analysis",
    f"""SELECT n, mean_kw, max_kw, min_kw, std_kw, peak_events, round(mean_kw * 1.1, 3) AS next_1h_kw,
        round(mean_kw * 24 * 1.1, 3) AS next_24h_kw, 'Smart meter analysis over ' || format('{{:,}}', readings) || ' readings: ' ||
        printf('Mean demand %.2f kW, peak %.2f kW, %d high-demand events detected.', mean_kw, max_kw, peak_events) AS summary
        FROM ({_METER_STATS})""",
    views="met",
)
def meter_analysis(spark, d):
    return jobs.analyse_meters(met(spark, d), "power")


@query("c05_meter_analysis_anomalies")
def meter_analysis_anomalies(spark, d):
    rows = met(spark, d)
    iso = forest.fit_forest(rows, "reading_id", ["power", "k"], incomplete="drop")
    return jobs.analyse_meters(rows, "power", forest.score_forest(rows, iso, "reading_id"))


@query("c06_cross_domain_report")
def cross_domain_report(spark, d):
    docs = corpus(spark, d).withColumn("zone", F.when(F.col("region") == "en", "F").otherwise("O"))
    index = retrieval.bm25_index(docs, "doc_id", ["text", "region", "equipment", "severity"])
    hits = retrieval.hybrid_search(docs, qset(spark, d), index, retrieval.embedder(docs, "text"))
    state = zone_assessment(spark, d).select(
        F.col("grp").alias("zone"), "pred_label", "pred_health_score", "grid_freq_status", "anomaly_count")
    meters = met(spark, d).groupBy(F.when(F.col("meter_id") % 2 == 0, "F").otherwise("O").alias("zone")).agg(
        F.count("*").alias("meter_rows"), F.round(F.avg("power"), 3).alias("mean_kw"))
    return jobs.cross_domain_report(state, meters, hits, docs.select("doc_id", "zone"))


@query(
    "c07_dashboard_kpis",
    """SELECT buffer_size, unstable_pct, mean_health, mean_freq_hz, outage_distribution, zone_distribution,
       critical AS incidents_critical, high AS incidents_high, medium AS incidents_medium, low AS incidents_low, total AS incidents_total,
       round(p25, 4) AS prob_p25, round(p75, 4) AS prob_p75, ts AS latest_timestamp, prob AS latest_prob, outage AS latest_outage,
       zone AS latest_zone, CAST(greatest(0, least(100, trunc((1 - prob) * 100))) AS INT) AS latest_health,
       CAST(epoch_us(ts) // 60000000 AS BIGINT) AS window_id, CAST(60 - epoch_us(ts) // 1000000 % 60 AS INT) AS next_refresh_in FROM
       (SELECT count(*) AS buffer_size, round(count(*) FILTER (prob >= 0.5) / count(*) * 100, 1) AS unstable_pct,
        round(avg(greatest(0, least(100, trunc((1 - prob) * 100)))), 1) AS mean_health, round(avg(freq), 3) AS mean_freq_hz FROM tel),
       (SELECT string_agg(outage || '=' || n, ',' ORDER BY outage) AS outage_distribution FROM (SELECT outage, count(*) AS n FROM tel GROUP BY 1)),
       (SELECT string_agg(zone || '=' || n, ',' ORDER BY zone) AS zone_distribution FROM (SELECT zone, count(*) AS n FROM tel GROUP BY 1)),
       (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM corpus),
       (SELECT max(prob) FILTER (rn = n // 4) AS p25, max(prob) FILTER (rn = 3 * n // 4) AS p75 FROM
        (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS rn, count(*) OVER () AS n FROM tel)),
       (SELECT ts, prob, outage, zone FROM tel ORDER BY ts DESC, reading_id DESC LIMIT 1)""",
    views="tel corpus",
)
def dashboard_kpis(spark, d):
    out = jobs.dashboard(tel(spark, d), corpus(spark, d), "prob", "freq", "ts", "reading_id")
    return out.withColumns({c: F.expr(MAP_TEXT.format(c)) for c in ("outage_distribution", "zone_distribution")})


@query(
    "c08_evaluation_summary",
    f"""SELECT *, (SELECT string_agg(metric || '=' || printf('%.4f', s), ',' ORDER BY metric) FROM (SELECT metric, round(avg(score), 4) AS s
        FROM evalm WHERE score IS NOT NULL GROUP BY metric)) AS metric_averages FROM ({PASS_SQL})""",
    views="evalm",
)
def evaluation_summary(spark, d):
    out = jobs.evaluation_summary(evalm(spark, d), "doc_id", table(spark, d, "documents").select("doc_id"))
    entries = F.transform(F.map_entries("metric_averages"), lambda e: F.concat(e["key"], F.lit("="), F.call_function(
        "format_number", e["value"], F.lit("0.0000"))))
    return out.withColumn("metric_averages", F.array_join(entries, ","))


@query(
    "c09_feedback_report",
    """SELECT count(*) AS total, round(avg(CAST(rating AS INT)), 2) AS avg_rating,
       round(count(*) FILTER (helpful) / count(*) * 100, 1) AS helpful_pct,
       (SELECT string_agg(i || '=' || coalesce(n, 0), ',' ORDER BY i) FROM range(1, 6) r(i) LEFT JOIN (SELECT CAST(rating AS INT) AS i,
        count(*) AS n FROM fb GROUP BY 1) USING (i)) AS rating_dist,
       (SELECT string_agg(CAST(feedback_id AS VARCHAR), ',' ORDER BY ts, feedback_id) FROM (SELECT * FROM fb ORDER BY ts DESC,
        feedback_id DESC LIMIT 5)) AS recent FROM fb""",
    views="fb",
)
def feedback_report(spark, d):
    out = jobs.feedback_report(fb(spark, d), "ts", "feedback_id")
    return out.withColumns({
        "rating_dist": F.expr(MAP_TEXT.format("rating_dist")),
        "recent": F.array_join(F.transform("recent", lambda x: x.cast("string")), ",")})
