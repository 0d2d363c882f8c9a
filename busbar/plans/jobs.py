"""Jobs a user calls: enrichment, incident derivation, assessments and reports.

Each job is one lazy plan over its inputs; what it writes goes to `path` when
one is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import gaussian, hash_key, uniform, weighted_choice
from ..functions.text import fixed, render_by_class
from ..operators import aggregates as agg
from ..operators import attribution, clean, forest, joins, rules, sampling, stability, windows
from ..operators.boosting import BoostedTrees
from ..session import materialize
from ..sources.files import write_once

# Names and constants of the enriched tables.
METER_NAMES = {
    "Date": "date",
    "Time": "time",
    "Global_active_power": "power_consumption",
    "Global_reactive_power": "reactive_power",
    "Voltage": "voltage",
    "Global_intensity": "current",
    "Sub_metering_1": "sub_metering_kitchen",
    "Sub_metering_2": "sub_metering_laundry",
    "Sub_metering_3": "sub_metering_hvac",
}
METER_REGION, METER_EQUIPMENT = "Zone_A_Residential", "smart_meter"
METER_REGION_MAP = {f"Zone_{z}_Residential": f"Zone_{z}" for z in "ABCD"}
REGIONS = ["Zone_A", "Zone_B", "Zone_C", "Zone_D"]
EQUIPMENT = [
    "transformer", "distribution_unit", "substation", "smart_meter_bank", "transmission_line", "renewable_inverter",
]
METER_SITES = ["smart_meter_bank", "distribution_unit", "substation"]
GRID_EVENTS = [
    "frequency_excursion", "partial_outage", "full_outage", "voltage_deviation", "renewable_variability", "no_event",
]
METER_EVENTS = ["high_demand_event", "meter_dropout"]
INCIDENT_COLUMNS = [
    "incident_id", "timestamp", "region", "equipment_type", "voltage", "current", "power_consumption", "demand_load",
    "grid_frequency", "transformer_status", "outage_event", "severity", "description",
]


def _stored(df: DataFrame, path: str | None, force: bool) -> DataFrame:
    return write_once(df, path, force) if path else df


def _even_choice(u: Column, names: Sequence[str]) -> Column:
    return weighted_choice(u, {n: 1.0 / len(names) for n in names})


def enrich_stability(
    df: DataFrame, key: str, margin: str, unstable: str, reaction: str, elasticity: Column, noise: bool = False,
    path: str | None = None, force: bool = False,
) -> DataFrame:
    """Stability telemetry with time, zone, equipment class, status, frequency and outage.

    Timestamps follow the order of the margin, so later readings are less stable.
    """
    out = windows.spread_timestamps(df, [margin, key])
    out = out.withColumn("region", sampling.draw_zone(F.col(unstable), uniform(F.col(key), "zone")))
    out = rules.equipment_class(out, reaction, elasticity, F.col(margin), "equipment_type")
    out = out.withColumn("transformer_status", rules.status_from_margin(F.col(unstable), F.col(margin)))
    jitter = gaussian(F.col(key), "freq", 0.0, 0.05) if noise else None
    out = rules.minmax_frequency(out, margin, "grid_frequency", jitter)
    out = out.withColumn("grid_frequency", F.round("grid_frequency", 3))
    out = rules.lookup(out, "transformer_status", rules.STATUS_TO_OUTAGE, "outage_event")
    return _stored(out, path, force)


def enrich_meters(
    raw: DataFrame, order: Sequence[str], block: int = 200_000, noise_key: str | None = None, path: str | None = None,
    force: bool = False,
) -> DataFrame:
    """Smart-meter readings with gaps filled block by block and derived columns.

    The high-demand rule sees the filled power and overrides a dropout.
    """
    nominal = agg.nominal_level(raw, "Voltage").scalar()
    flagged = clean.flag_missing(raw, "Global_active_power", "_missing")
    cols = [c for c in METER_NAMES if c in raw.columns]
    filled = windows.block_fill(flagged, order, cols, block)
    out = clean.rename(filled, {c: METER_NAMES[c] for c in cols})
    jitter = gaussian(F.col(noise_key), "freq", 0.0, 0.02) if noise_key else None
    freq = rules.deviation_frequency(F.col("voltage"), nominal, jitter)
    out = out.withColumns(
        {
            "timestamp": clean.parse_ts(F.col("date"), F.col("time")).cast("timestamp_ntz"),
            "demand_load": F.col("power_consumption"),
            "grid_frequency": F.round(freq, 3),
            "region": F.lit(METER_REGION),
            "equipment_type": F.lit(METER_EQUIPMENT),
            "transformer_status": rules.status_from_voltage(F.col("voltage")),
            "outage_event": rules.meter_event(F.col("power_consumption"), F.col("_missing")),
        }
    ).drop("_missing")
    return _stored(out, path, force)


def _grid_seeds(grid: DataFrame, key: str, quotas: dict[str, int]) -> DataFrame:
    """Rows per grid event class up to its quota; a class nobody saw draws from all rows."""
    wanted = {e: quotas[e] for e in GRID_EVENTS}
    seen = [r[0] for r in grid.select("outage_event").distinct().filter(F.col("outage_event").isin(GRID_EVENTS)).collect()]
    parts = []
    if seen:
        rows = grid.filter(F.col("outage_event").isin(seen))
        parts.append(sampling.quota_sample(rows, "outage_event", key, {e: wanted[e] for e in seen}))
    for event in sorted(set(GRID_EVENTS) - set(seen)):
        parts.append(sampling.sample_n(grid, key, wanted[event]).withColumn("outage_event", F.lit(event)))
    return sampling.union_all(*parts)


def _meter_seeds(meters: DataFrame, key: str, quotas: dict[str, int]) -> DataFrame:
    """High demand from the top 15 %, dropouts from both tails of the consumption."""
    known = clean.drop_null(meters, ["power_consumption", "voltage", "current"])
    power = F.col("power_consumption")
    q = agg.exact_quantiles(known.select(power), "power_consumption", {"low": 0.02, "high": 0.85, "top": 0.97}).first()
    low, bar, top = (F.lit(q[n] if q else None).cast("double") for n in ("low", "high", "top"))
    high, odd = known.filter(power >= bar), known.filter((power <= low) | (power >= top))
    parts = [
        sampling.sample_n(rows, key, quotas[event]).withColumn("outage_event", F.lit(event))
        for event, rows in zip(METER_EVENTS, (high, odd))
    ]
    return sampling.union_all(*parts)


def derive_incidents(
    grid: DataFrame, meters: DataFrame, key: str, quotas: dict[str, int] = sampling.INCIDENT_QUOTAS,
    path: str | None = None, force: bool = False,
) -> DataFrame:
    """Incident corpus from enriched telemetry (`outage_event, grid_frequency, p1`) and meter rows.

    Sample per class, derive the electrical values, write the report text, number the rows.
    """
    k = F.col(key).cast("string")
    seeds = rules.electrical(
        _grid_seeds(grid, key, quotas), F.col("grid_frequency"), F.col("p1"), gaussian(k, "volt", 0.0, 4.0),
        2.0 + 10.0 * uniform(k, "amp"), 0.88 + 0.24 * uniform(k, "demand"),
    )
    grid_rows = seeds.select(
        key, "outage_event", _even_choice(uniform(k, "region"), REGIONS).alias("region"),
        _even_choice(uniform(k, "site"), EQUIPMENT).alias("equipment_type"), "voltage", "current",
        F.col("power_kw").alias("power_consumption"), F.col("demand").alias("demand_load"),
        F.round("grid_frequency", 3).alias("grid_frequency"), F.lit("grid").alias("source"),
    )
    m = _meter_seeds(meters, key, quotas)
    shown = [c for c in ("reactive_power", "sub_metering_kitchen", "sub_metering_laundry", "sub_metering_hvac")
             if c in meters.columns]
    meter_rows = m.select(
        key, "outage_event",
        clean.map_values(F.col("region"), METER_REGION_MAP, _even_choice(uniform(k, "region"), REGIONS)).alias("region"),
        _even_choice(uniform(k, "site"), METER_SITES).alias("equipment_type"),
        F.round("voltage", 2).alias("voltage"), F.round("current", 2).alias("current"),
        F.round("power_consumption", 3).alias("power_consumption"),
        F.round(F.coalesce("demand_load", "power_consumption"), 3).alias("demand_load"),
        F.round("grid_frequency", 3).alias("grid_frequency"), *shown, F.lit("meter").alias("source"),
    )
    rows = sampling.union_all(grid_rows, meter_rows)
    rows = rules.lookup(rows, "outage_event", rules.EVENT_TO_SEVERITY, "severity")
    rows = rules.lookup(rows, "outage_event", rules.EVENT_TO_STATUS, "transformer_status")
    tag = F.concat_ws(":", "source", "outage_event", k)
    rows = rows.withColumn("description", render_by_class(F.col("outage_event"), rows.columns)).withColumn("_tag", tag)
    day = F.floor(uniform(F.col("_tag"), "day") * 1096).cast("int")
    rows = rows.withColumn(
        "timestamp", F.timestamp_add("DAY", day, F.lit("2021-01-01").cast("timestamp")).cast("timestamp_ntz"))
    out = windows.sequence_ids(rows, [hash_key(F.col("_tag"), "99"), F.col("_tag")])
    return _stored(out.select(*INCIDENT_COLUMNS), path, force)


def assess_stability(
    telemetry: DataFrame, keys: Sequence[str], ts: str, tie: str, freq: str, features: Sequence[str],
    classifier: BoostedTrees, regressor: BoostedTrees | None, iso: forest.IsolationForest, rows: int = 500,
    flags: int = 10,
) -> DataFrame:
    """Per zone: newest reading scored, its drivers, anomalies in the last rows, frequency state."""
    window = windows.last_n(telemetry, keys, ts, tie, rows)
    scored = stability.score_latest(window, keys, ts, tie, classifier, regressor, features)
    drivers = attribution.explain_top_k(scored.select(tie, *features), tie, classifier, features, 5)
    state = window.groupBy(*keys).agg(rules.frequency_state(F.avg(freq)).alias("grid_freq_status"))
    marked = materialize(forest.score_forest(window, iso, tie, [*keys, ts]).filter("is_anomaly"), "marked")
    worst = sampling.top_per_group(marked, keys, [F.asc("anomaly_score"), F.asc(tie)], flags)
    # All anomalies of the window are counted; at most `flags` of them per zone are listed.
    counted = marked.groupBy(*keys).agg(F.count("*").alias("anomaly_count"))
    listed = worst.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("anomaly_score", tie, ts))).alias("anomaly_flags")).join(counted, list(keys))
    return (
        scored.join(drivers.select(tie, F.col("top").alias("drivers")), tie)
        .join(state, list(keys))
        .join(listed, list(keys), "left")
        .select(*keys, ts, tie, "pred_label", F.round("pred_prob_unstable", 4).alias("pred_prob_unstable"),
                "pred_stab_score", "pred_health_score", "grid_freq_status",
                F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"), "anomaly_flags", "drivers")
    )


def analyse_meters(df: DataFrame, power: str, anomalies: DataFrame | None = None) -> DataFrame:
    """Demand statistics, forecast and summary sentence; `anomalies` has `is_anomaly`."""
    known = clean.drop_null(df, [power])
    stats = agg.demand_statistics(known, power)
    cols = {c: F.round(c, 3) for c in ("mean_kw", "max_kw", "min_kw", "std_kw")}
    out = stats.withColumns(cols)
    out = out.withColumns({"next_1h_kw": F.round(F.col("mean_kw") * 1.1, 3),
                           "next_24h_kw": F.round(F.col("mean_kw") * 24 * 1.1, 3)})
    readings = df.agg(F.count("*").alias("n")).scalar()
    parts = [
        F.lit("Smart meter analysis over "), F.format_number(readings, 0), F.lit(" readings: Mean demand "),
        fixed(F.col("mean_kw"), 2), F.lit(" kW, peak "), fixed(F.col("max_kw"), 2), F.lit(" kW, "),
        F.col("peak_events").cast("string"), F.lit(" high-demand events detected."),
    ]
    if anomalies is not None:
        out = out.withColumn("anomaly_count", anomalies.agg(F.count_if("is_anomaly").alias("n")).scalar())
        parts += [F.lit(" Isolation Forest detected "), F.col("anomaly_count").cast("string"),
                  F.lit(" consumption anomalies in this window.")]
    return out.withColumn("summary", F.concat(*parts))


def cross_domain_report(stability_part: DataFrame, meters: DataFrame, hits: DataFrame, corpus: DataFrame,
                        zone: str = "zone") -> DataFrame:
    """Stability, meters and retrieved incidents side by side per zone."""
    found = joins.join_measured(corpus, materialize(hits, "hits"), "doc_id").groupBy(zone).agg(
        F.count("*").alias("incidents_found"), F.countDistinct("query_id").alias("queries_served"))
    return joins.side_by_side([stability_part, meters, found], zone)


def dashboard(telemetry: DataFrame, incidents: DataFrame, prob: str, freq: str, ts: str, tie: str) -> DataFrame:
    """One row: incident counts, live summary, quartiles, newest reading and refresh clock."""
    summary = agg.live_summary(telemetry, prob, freq, ["outage", "zone"])
    levels = agg.level_counts(incidents, "severity")
    quart = agg.nearest_quartiles(telemetry, prob)
    newest = telemetry.agg(F.max_by(F.struct(ts, tie, prob, "outage", "zone"), F.struct(ts, tie)).alias("r"))
    seconds = F.unix_seconds(F.col("latest_timestamp").cast("timestamp"))
    out = summary.withColumns(
        {
            **{f"incidents_{c}": levels.select(c).scalar() for c in [*agg.SEVERITIES, "total"]},
            "prob_p25": F.round(quart.select("p25").scalar(), 4),
            "prob_p75": F.round(quart.select("p75").scalar(), 4),
            **{name: newest.select(f"r.{c}").scalar() for name, c in
               {"latest_timestamp": ts, "latest_prob": prob, "latest_outage": "outage", "latest_zone": "zone"}.items()},
        }
    )
    return out.withColumns(
        {
            "latest_health": rules.health_score(F.col("latest_prob")),
            "window_id": F.floor(seconds / 60),
            "next_refresh_in": (60 - seconds % 60).cast("int"),
        }
    )


def evaluation_summary(metrics: DataFrame, case: str, cases: DataFrame | None = None) -> DataFrame:
    """Pass counts and rate in one row, with the mean score per metric as a map."""
    wanted = joins.subset_by_ids(metrics, cases, case) if cases is not None else metrics
    per_case = wanted.groupBy(case).agg(
        F.every("passed").alias("overall_pass"), F.bool_or(F.col("score").isNull()).alias("errored"))
    means = agg.metric_means(wanted.filter("score IS NOT NULL"))
    # One entry per metric name.
    as_map = means.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "mean_score")))).alias("m"))
    return agg.pass_counts(per_case, F.col("errored")).withColumn("metric_averages", as_map.scalar())


def feedback_report(df: DataFrame, ts: str, tie: str, recent: int = 5) -> DataFrame:
    """Summary row with the rating histogram and the newest comments."""
    hist = agg.rating_histogram(df)
    hist_map = hist.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rating_value", "n")))).alias("m"))
    last = df.orderBy(F.desc(ts), F.desc(tie)).limit(recent)
    ids = last.agg(F.transform(F.sort_array(F.collect_list(F.struct(ts, tie))), lambda s: s[tie]).alias("ids"))
    return agg.feedback_summary(df).withColumns({"rating_dist": hist_map.scalar(), "recent": ids.scalar()})

