"""Aggregations."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import retrieval, rollups
from ..operators.spread import exact_quantiles
from ..sources.bindings import FEATURES, corpus, evalm, fb, feat, met, table, tel
from . import query


@query(
    "a01_value_counts",
    """SELECT 'zone' AS dim, zone AS val, count(*) AS n FROM tel GROUP BY zone UNION ALL
       SELECT 'equipment', equipment, count(*) FROM tel GROUP BY equipment UNION ALL
       SELECT 'outage', outage, count(*) FROM tel GROUP BY outage""",
    views="tel",
)
def value_counts(spark, d):
    return agg.value_counts(tel(spark, d), ["zone", "equipment", "outage"])


@query(
    "a02_severity_kpis",
    """SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
       count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total
       FROM corpus""",
    views="corpus",
)
def severity_kpis(spark, d):
    return agg.level_counts(corpus(spark, d), "severity")


def _moments_sql(cols):
    return ", ".join(
        f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max"
        for c in cols
    )


def _rounded(df, cols, places=4):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "a03_telemetry_profile",
    f"""SELECT count(*) AS n, round(count(*) FILTER (unstable) / count(*) * 100, 4) AS unstable_pct,
        round(100 - count(*) FILTER (unstable) / count(*) * 100, 4) AS stable_pct,
        {_moments_sql(['l_quantity', 'l_tax'])} FROM feat""",
    views="feat",
)
def telemetry_profile(spark, d):
    out = agg.telemetry_profile(feat(spark, d), "unstable", ["l_quantity", "l_tax"])
    return _rounded(out, [c for c in out.columns if c.endswith(("_pct", "_mean", "_std"))])


@query("a04_meter_profile", f"SELECT {_moments_sql(FEATURES)} FROM lineitem")
def meter_profile(spark, d):
    out = table(spark, d, "lineitem").agg(*agg.moments(FEATURES))
    return _rounded(out, [c for c in out.columns if c.endswith(("_mean", "_std"))])


@query(
    "a05_conditional_counts",
    """SELECT equipment, count(*) FILTER (value < 220) AS below_band, count(*) FILTER (value > 250) AS above_band,
       count(*) FILTER (outage = 'high_demand_event') AS high_demand_events FROM tel GROUP BY equipment""",
    views="tel",
)
def conditional_counts(spark, d):
    high = F.count_if(F.col("outage") == "high_demand_event").alias("high_demand_events")
    return tel(spark, d).groupBy("equipment").agg(*agg.band_counts("value"), high)


@query(
    "a06_exact_quantiles",
    """SELECT zone, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.85), 4) AS p85,
       round(quantile_cont(value, 0.95), 4) AS p95 FROM tel GROUP BY zone""",
    views="tel",
)
def quantiles(spark, d):
    out = exact_quantiles(tel(spark, d), "value", {"p50": 0.5, "p85": 0.85, "p95": 0.95}, by=["zone"])
    return _rounded(out, ["p50", "p85", "p95"])


@query(
    "a07_demand_statistics",
    """SELECT count(power) AS n, round(avg(power), 3) AS mean_kw, max(power) AS max_kw, min(power) AS min_kw,
       round(stddev_samp(power), 3) AS std_kw, count(*) FILTER (power > (SELECT quantile_cont(power, 0.95) FROM met))
       AS peak_events FROM met""",
    views="met",
)
def demand_statistics(spark, d):
    return _rounded(agg.demand_statistics(met(spark, d), "power"), ["mean_kw", "std_kw"], 3)


@query(
    "a08_naive_forecast",
    """SELECT meter_id, round(avg(power) * 1.1, 3) AS next_1h_kw, round(avg(power) * 24 * 1.1, 3) AS next_24h_kw
       FROM met GROUP BY meter_id""",
    views="met",
)
def naive_forecast(spark, d):
    return _rounded(agg.naive_forecast(met(spark, d), "power", ["meter_id"]), ["next_1h_kw", "next_24h_kw"], 3)


MAP_TEXT = "array_join(transform(map_entries({0}), e -> concat(e.key, '=', e.value)), ',')"


@query(
    "a09_live_summary",
    """SELECT count(*) AS buffer_size, round(count(*) FILTER (prob >= 0.5) / count(*) * 100, 1) AS unstable_pct,
       round(avg(greatest(0, least(100, trunc((1 - prob) * 100)))), 1) AS mean_health, round(avg(freq), 3) AS mean_freq_hz,
       (SELECT string_agg(outage || '=' || n, ',' ORDER BY outage) FROM (SELECT outage, count(*) AS n FROM tel GROUP BY 1))
         AS outage_distribution,
       (SELECT string_agg(zone || '=' || n, ',' ORDER BY zone) FROM (SELECT zone, count(*) AS n FROM tel GROUP BY 1))
         AS zone_distribution FROM tel""",
    views="tel",
)
def live_summary(spark, d):
    out = agg.live_summary(tel(spark, d), "prob", "freq", ["outage", "zone"])
    return out.withColumns({c: F.expr(MAP_TEXT.format(c)) for c in ("outage_distribution", "zone_distribution")})


@query(
    "a09_live_summary_by_zone",
    """SELECT zone, count(*) AS buffer_size, round(count(*) FILTER (prob >= 0.5) / count(*) * 100, 1) AS unstable_pct,
       round(avg(greatest(0, least(100, trunc((1 - prob) * 100)))), 1) AS mean_health, round(avg(freq), 3) AS mean_freq_hz,
       (SELECT string_agg(outage || '=' || n, ',' ORDER BY outage) FROM (SELECT outage, count(*) AS n FROM tel AS i
        WHERE i.zone = tel.zone GROUP BY 1)) AS outage_distribution FROM tel GROUP BY zone""",
    views="tel",
)
def live_summary_by_zone(spark, d):
    out = agg.live_summary(tel(spark, d), "prob", "freq", ["outage"], ["zone"])
    return out.withColumn("outage_distribution", F.expr(MAP_TEXT.format("outage_distribution")))


@query(
    "a10_nearest_quartiles",
    """SELECT zone, max(value) FILTER (rn = n // 4) AS p25, max(value) FILTER (rn = 3 * n // 4) AS p75 FROM
       (SELECT zone, value, row_number() OVER (PARTITION BY zone ORDER BY value) - 1 AS rn,
        count(*) OVER (PARTITION BY zone) AS n FROM tel) GROUP BY zone""",
    views="tel",
)
def nearest_quartiles(spark, d):
    return agg.nearest_quartiles(tel(spark, d), "value", ["zone"])


@query(
    "a11_latest",
    """SELECT zone, ts, reading_id, value, outage FROM tel
       QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC, reading_id DESC) = 1""",
    views="tel",
)
def latest(spark, d):
    return agg.latest(tel(spark, d), ["zone"], "ts", "reading_id", ["value", "outage"])


@query(
    "a12_feedback_summary",
    """SELECT count(*) AS total, round(avg(CAST(rating AS INT)), 2) AS avg_rating,
       round(count(*) FILTER (helpful) / count(*) * 100, 1) AS helpful_pct FROM fb""",
    views="fb",
)
def feedback_summary(spark, d):
    return agg.feedback_summary(fb(spark, d))


@query(
    "a13_rating_histogram",
    """SELECT CAST(i AS INT) AS rating_value, coalesce(n, 0) AS n FROM range(1, 6) r(i)
       LEFT JOIN (SELECT CAST(rating AS INT) AS i, count(*) AS n FROM fb GROUP BY 1) USING (i)""",
    views="fb",
)
def rating_histogram(spark, d):
    return agg.rating_histogram(fb(spark, d))


@query("a14_metric_means", "SELECT metric, round(avg(score), 4) AS mean_score FROM evalm GROUP BY metric", views="evalm")
def metric_means(spark, d):
    return agg.metric_means(evalm(spark, d))


@query("a15_overall_pass", "SELECT doc_id, bool_and(passed) AS overall_pass FROM evalm GROUP BY doc_id", views="evalm")
def overall_pass(spark, d):
    return agg.overall_pass(evalm(spark, d), "doc_id")


PASS_SQL = """SELECT count(*) AS total_cases, count(*) FILTER (overall_pass) AS passed,
    count(*) FILTER (NOT overall_pass) AS failed, count(*) FILTER (errored) AS errored,
    round(count(*) FILTER (overall_pass) / count(*), 4) AS pass_rate FROM
    (SELECT doc_id, bool_and(passed) AS overall_pass, bool_or(score IS NULL) AS errored FROM evalm GROUP BY doc_id)"""


@query("a16_pass_counts", PASS_SQL, views="evalm")
def pass_counts(spark, d):
    cases = evalm(spark, d).groupBy("doc_id").agg(
        F.every("passed").alias("overall_pass"), F.bool_or(F.col("score").isNull()).alias("errored"))
    return agg.pass_counts(cases, F.col("errored"))


@query(
    "a18_nominal_level",
    "SELECT round(avg(value), 4) AS nominal FROM tel",
    views="tel",
)
def nominal_level(spark, d):
    return _rounded(agg.nominal_level(tel(spark, d), "value"), ["nominal"])


@query("a19_distinct_count", "SELECT count(DISTINCT equipment) AS n_distinct FROM tel", views="tel")
def distinct_count(spark, d):
    return agg.distinct_count(tel(spark, d), "equipment")


@query(
    "a20_feature_distribution",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, "
        f"max({c}) AS max FROM feat" for c in FEATURES),
    views="feat",
)
def feature_distribution(spark, d):
    return _rounded(agg.feature_distribution(feat(spark, d), FEATURES), ["mean", "std"])


@query(
    "a20_category_weights",
    "SELECT grp, round(count(*) / (SELECT count(*) FROM feat), 4) AS weight FROM feat GROUP BY grp",
    views="feat",
)
def category_weights(spark, d):
    return _rounded(agg.category_weights(feat(spark, d), "grp"), ["weight"])


TOKENS_SQL = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', text, region, equipment, severity)),
    '[A-Za-z0-9]+')) AS term FROM corpus)"""


@query(
    "a21_corpus_statistics",
    """SELECT (SELECT count(*) FROM corpus) AS n_docs, round((SELECT count(*) FROM tok) / (SELECT count(*) FROM corpus), 4)
       AS avg_len, count(DISTINCT term) AS n_terms, (SELECT max(df) FROM (SELECT count(DISTINCT doc_id) AS df FROM tok
       GROUP BY term)) AS max_df FROM tok""",
    views="corpus",
    ctes=TOKENS_SQL,
)
def corpus_statistics(spark, d):
    index = retrieval.bm25_index(corpus(spark, d), "doc_id", ["text", "region", "equipment", "severity"])
    terms = index.document_frequency().agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
    stats = index.statistics()
    return terms.withColumns({
        "n_docs": stats.select("n_docs").scalar(), "avg_len": F.round(stats.select("avg_len").scalar(), 4)})


def hourly(spark, d):
    return rollups.roll_up(met(spark, d), ["meter_id"], "ts", "1 hour", ["power"], ["k", "reading_id"])


@query(
    "a07_rolled_statistics",
    """SELECT meter_id, count(*) AS n_rows, count(power) AS n, round(avg(power), 3) AS mean_kw, min(power) AS min_kw, max(power) AS max_kw,
       round(stddev_samp(power), 3) AS std_kw, count(DISTINCT k) AS n_k FROM met GROUP BY meter_id""",
    views="met",
)
def rolled_statistics(spark, d):
    """Meter statistics from hourly partials: equal to those of all readings."""
    out = rollups.statistics(hourly(spark, d), ["meter_id"], ["power"], distinct=["k"])
    out = out.select("meter_id", "n_rows", F.col("power_n").alias("n"), F.col("power_mean").alias("mean_kw"), F.col("power_min").alias("min_kw"),
                     F.col("power_max").alias("max_kw"), F.col("power_std").alias("std_kw"), F.col("k_distinct").alias("n_k"))
    return _rounded(out, ["mean_kw", "std_kw"], 3)


@query(
    "a06_sketched_quantiles",
    "SELECT p, TRUE AS within FROM (VALUES ('p50'), ('p85'), ('p95')) v(p)",
)
def sketched_quantiles(spark, d):
    """Quantiles of all meters from hourly sketches: the share of readings up to each is its own, within the sketch's error."""
    shares = {"p50": 0.5, "p85": 0.85, "p95": 0.95}
    found = rollups.statistics(hourly(spark, d), [], ["power"], shares)
    rows = met(spark, d).filter("power IS NOT NULL")
    ranks = rows.agg(*[F.avg((F.col("power") <= found.select(f"power_{p}").scalar()).cast("double")).alias(p) for p in shares])
    off = F.create_map(*[x for p, q in shares.items() for x in (F.lit(p), F.abs(F.col(p) - q) <= rollups.RANK_ERROR)])
    return ranks.select(F.explode(off).alias("p", "within"))
