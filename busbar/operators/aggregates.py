"""Counts, profiles, statistics and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import exact_quantiles, order_statistics

SEVERITIES = ["critical", "high", "medium", "low"]


def value_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts per value of several dimensions in one pass: `(dim, val, n)`."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("val")) for d in dims])
    return df.select(F.inline(pairs)).filter("val IS NOT NULL").groupBy("dim", "val").agg(F.count("*").alias("n"))


def level_counts(df: DataFrame, col: str, levels: Sequence[str] = SEVERITIES) -> DataFrame:
    """One row with a count per level, 0 where absent, and their total."""
    out = df.agg(*[F.count_if(F.col(col) == v).alias(v) for v in levels])
    total = sum((F.col(v) for v in levels[1:]), F.col(levels[0]))
    return out.withColumn("total", total)


def moments(cols: Sequence[str]) -> list[Column]:
    """Mean, sample deviation, minimum and maximum of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return aggs


def telemetry_profile(df: DataFrame, unstable: str, cols: Sequence[str]) -> DataFrame:
    """Row count, label shares in percent and the moments of the chosen columns."""
    share = F.count_if(F.col(unstable)) / F.count("*") * 100
    return df.agg(F.count("*").alias("n"), share.alias("unstable_pct"), (100 - share).alias("stable_pct"),
                  *moments(cols))


def band_counts(col: str, low: float = 220.0, high: float = 250.0) -> list[Column]:
    return [F.count_if(F.col(col) < low).alias("below_band"), F.count_if(F.col(col) > high).alias("above_band")]


def demand_statistics(df: DataFrame, col: str, peak_q: float = 0.95) -> DataFrame:
    """Mean, maximum, minimum, deviation, and the rows above the peak quantile."""
    peak = F.lit(exact_quantiles(df.select(col), col, {"q": peak_q}).first()["q"])
    return df.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean_kw"), F.max(col).alias("max_kw"), F.min(col).alias("min_kw"),
        F.stddev_samp(col).alias("std_kw"), F.count_if(F.col(col) > peak).alias("peak_events"),
    )


def naive_forecast(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean plus a 10 % buffer for the next hour and the next day."""
    mean = F.avg(col)
    return df.groupBy(*by).agg((mean * 1.1).alias("next_1h_kw"), (mean * 24 * 1.1).alias("next_24h_kw"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """One row with a map value -> count; its size is the number of classes."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, "n")))).alias(col))


def live_summary(df: DataFrame, prob: str, freq: str, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of unstable readings, mean health and frequency, and a count map per dimension, all per group of `by`."""
    from .rules import health_score

    by = list(by)
    out = df.groupBy(*by).agg(
        F.count(prob).alias("buffer_size"),
        F.round(F.count_if(F.col(prob) >= 0.5) / F.count(prob) * 100, 1).alias("unstable_pct"),
        F.round(F.avg(health_score(F.col(prob))), 1).alias("mean_health"),
        F.round(F.avg(freq), 3).alias("mean_freq_hz"),
    )
    if not by:
        return out.withColumns({f"{c}_distribution": distribution(df, c).scalar() for c in dims}) if dims else out
    for c in dims:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_n"))
        entries = F.sort_array(F.collect_list(F.struct(c, "_n")))
        maps = counts.groupBy(*by).agg(F.map_from_entries(entries).alias(f"{c}_distribution"))
        right = maps.select(*[F.col(k).alias(f"_r_{k}") for k in by], f"{c}_distribution")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by])
        out = out.join(right, same, "left").drop(*[f"_r_{k}" for k in by])
    return out


def nearest_quartiles(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Sorted values at places n//4 and 3n//4 (not `percentile_disc`)."""
    n = F.col("_total")
    picks = {"p25": F.floor(n / 4), "p75": F.floor(3 * n / 4)}
    return order_statistics(df, col, picks, by).select(*by, *picks)


def latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Attributes of the newest row per key; ties go to the larger `tie`."""
    newest = F.max_by(F.struct(ts, tie, *cols), F.struct(ts, tie)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def feedback_summary(df: DataFrame, rating: str = "rating", helpful: str = "helpful") -> DataFrame:
    """Row count, mean of the ratings that are digits, percent helpful."""
    digits = F.when(F.col(rating).rlike("^[0-9]+$"), F.col(rating).try_cast("int"))
    return df.agg(
        F.count("*").alias("total"),
        F.round(F.avg(digits), 2).alias("avg_rating"),
        F.round(F.count_if(F.col(helpful)) / F.count("*") * 100, 1).alias("helpful_pct"),
    )


def rating_histogram(df: DataFrame, rating: str = "rating", lo: int = 1, hi: int = 5) -> DataFrame:
    """One row per rating, 0 where nobody gave it."""
    seen = df.groupBy(F.col(rating).try_cast("int").alias("r")).agg(F.count("*").alias("seen"))
    scale = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("rating_value"))
    joined = scale.join(seen, F.col("rating_value") == F.col("r"), "left")
    return joined.select("rating_value", F.coalesce("seen", F.lit(0)).alias("n"))


def metric_means(df: DataFrame) -> DataFrame:
    return df.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean_score"))


def overall_pass(df: DataFrame, case: str) -> DataFrame:
    """AND of the flags that are known; null when none is."""
    return df.groupBy(case).agg(F.every("passed").alias("overall_pass"))


def pass_counts(cases: DataFrame, errored: Column | None = None) -> DataFrame:
    """Passed, failed, errored and the pass rate (0 when there is no case)."""
    n = F.count("*")
    bad = F.count_if(errored) if errored is not None else F.count_if(F.col("overall_pass").isNull())
    rate = F.coalesce(F.try_divide(F.count_if("overall_pass"), n), F.lit(0.0))
    return cases.agg(
        n.alias("total_cases"),
        F.count_if("overall_pass").alias("passed"),
        F.count_if(~F.col("overall_pass")).alias("failed"),
        bad.alias("errored"),
        F.round(rate, 4).alias("pass_rate"),
    )


def nominal_level(df: DataFrame, col: str, order: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Mean of a column over the whole table, or of its first `n` rows in `order` if that is asked for."""
    rows = df.select(col) if n is None else df.select(col, *order).orderBy(*order).limit(n)
    return rows.agg(F.avg(col).alias("nominal"))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(count.alias("n_distinct"))


def feature_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per feature with its moments."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def category_weights(df: DataFrame, col: str) -> DataFrame:
    """Share of each class; the total is a scalar subquery, not a window over all rows."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t")).scalar()
    return counts.select(col, (F.col("n") / total).alias("weight"))
