"""Rule-based derivations of equipment class, status, outage, frequency and health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import clamp, clean_numeric
from .spread import exact_quantiles

# The class tables and thresholds below must equal the published rules.
STATUS_TO_OUTAGE = {
    "normal": "no_event",
    "monitoring": "voltage_deviation",
    "degraded": "voltage_deviation",
    "overloaded": "partial_outage",
    "critical": "full_outage",
}
EVENT_TO_SEVERITY = {
    "no_event": "low",
    "voltage_deviation": "medium",
    "meter_dropout": "medium",
    "high_demand_event": "high",
    "frequency_excursion": "high",
    "partial_outage": "high",
    "full_outage": "critical",
    "renewable_variability": "medium",
}
EVENT_TO_STATUS = {
    "no_event": "normal",
    "voltage_deviation": "monitoring",
    "meter_dropout": "monitoring",
    "high_demand_event": "overloaded",
    "frequency_excursion": "degraded",
    "partial_outage": "overloaded",
    "full_outage": "critical",
    "renewable_variability": "degraded",
}
STATUS_BY_PROB = [(0.40, "normal"), (0.65, "degraded"), (0.85, "overloaded"), (1.01, "critical")]
OUTAGE_BY_PROB = [(0.40, "no_event"), (0.65, "voltage_deviation"), (0.85, "partial_outage"), (1.01, "full_outage")]
HIGH_DEMAND_KW = 8.0
FREQ_NORMAL = (49.8, 50.2)


def lookup(df: DataFrame, key: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Join a fixed class table; its size is the length of the literal mapping."""
    rows = F.explode(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]))
    classes = df.sparkSession.range(1).select(rows.alias(key, out))
    return df.join(F.broadcast(classes), key, "left")


def equipment_class(df: DataFrame, reaction: str, elasticity: Column, margin: Column, out: str = "equipment_class"):
    """First match of: slow reaction, high elasticity, near-zero margin; else a distribution unit."""
    with_el = df.withColumn("_el", elasticity)
    both = F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).cast("double").alias("v")) for n, c in (("r", reaction), ("e", "_el"))])
    found = exact_quantiles(with_el.select(F.inline(both)), "v", {"q": 0.75}, ["which"]).collect()  # both in one pass
    bounds = {r["which"]: r["q"] for r in found}
    r75, e75 = F.lit(bounds.get("r")).cast("double"), F.lit(bounds.get("e")).cast("double")
    rule = (
        F.when(F.col(reaction) >= r75, "transformer")
        .when(F.col("_el") >= e75, "smart_meter_bank")
        .when(F.abs(margin) < 0.005, "substation")
        .otherwise("distribution_unit")
    )
    return with_el.withColumn(out, rule).drop("_el")


def status_from_margin(unstable: Column, margin: Column) -> Column:
    """Status from the stability label and margin; the severest matching band wins."""
    return (
        F.when(unstable & (margin >= 0.07), "critical")
        .when(unstable & (margin >= 0.04), "overloaded")
        .when(unstable, "degraded")
        .when(~unstable & (margin >= 0.02), "monitoring")
        .otherwise("normal")
    )


def status_from_voltage(v: Column) -> Column:
    """`<230` degraded, `[230,237)` monitoring, `[237,245]` normal, `>245` monitoring."""
    return (
        F.when(v < 230, "degraded")
        .when((v >= 230) & (v < 237), "monitoring")
        .when(v > 245, "monitoring")
        .otherwise("normal")
    )


def meter_event(power: Column, missing: Column, limit: float = HIGH_DEMAND_KW) -> Column:
    """High demand is tested on the filled value and overrides a dropout."""
    return F.when(power > limit, "high_demand_event").when(missing, "meter_dropout").otherwise("no_event")


def by_threshold(p: Column, steps: Sequence[tuple[float, str]]) -> Column:
    """First class whose upper bound exceeds `p`; the last one otherwise."""
    out = F.when(p < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(p < bound, name)
    return out.otherwise(steps[-1][1])


def minmax_frequency(df: DataFrame, col: str, out: str = "grid_frequency", noise: Column | None = None) -> DataFrame:
    """Scale a margin to [0, 1] over the table and spread it around 50 Hz."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    freq = 50.0 + ((F.col(col) - lo) / (hi - lo) - 0.5) * 2.4
    return df.withColumn(out, freq if noise is None else freq + noise)


def deviation_frequency(v: Column, nominal: Column, noise: Column | None = None) -> Column:
    """50 Hz minus half the relative deviation from the nominal level."""
    freq = 50.0 - (v - nominal) / nominal * 0.5
    return freq if noise is None else freq + noise


def frequency_state(mean: Column) -> Column:
    lo, hi = FREQ_NORMAL
    return (
        F.when(mean.isNull(), "unknown")
        .when((mean >= lo) & (mean <= hi), "normal")
        .when(F.abs(mean - 50.0) > 0.5, "excursion")
        .otherwise("deviation")
    )


def health_score(p: Column) -> Column:
    """0 (worst) to 100 (best); the fraction is cut off, not rounded."""
    return clamp(((1 - p) * 100).cast("int"), 0, 100).cast("int")


def stability_label(p: Column) -> Column:
    return F.when(p >= 0.5, "unstable").otherwise("stable")


def electrical(df: DataFrame, freq: Column, p1: Column, volt_noise: Column, amp_noise: Column, factor: Column):
    """Voltage, current, power and demand of an incident, each rounded to 2 places in turn."""
    df = df.withColumn("voltage", F.round(clamp(freq * 4.8 + volt_noise, 220.0, 260.0), 2))
    df = df.withColumn("current", F.round(F.abs(p1) * 8 + amp_noise, 2))
    df = df.withColumn("power_kw", F.round(F.col("current") * F.col("voltage") / 1000, 2))
    return df.withColumn("demand", F.round(F.col("power_kw") * factor, 2))


def impute_mean(c: Column, mean: float) -> Column:
    """Bad input becomes the mean of the distribution."""
    return clean_numeric(c, F.lit(mean))
