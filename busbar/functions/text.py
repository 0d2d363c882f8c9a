"""Text columns: tokens, keyword tests, templates and formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of ASCII letters and digits.
TOKEN = "[A-Za-z0-9]+"

# Words ignored when a question is compared with its answer.
QUESTION_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "what", "how", "why", "give", "show", "list", "me",
    "in", "of", "with", "for", "to", "and", "i", "my",
]

# One report template per event class. `{name:format}` takes a column.
TEMPLATES = {
    "full_outage": (
        "Full power outage reported affecting {equipment_type} cluster in {region}. "
        "Approximately 80-100% of connected load lost. Voltage collapsed to {voltage:.1f}V. "
        "Peak demand prior to event: {power_consumption:.2f}kW. "
        "Grid frequency deviated to {grid_frequency:.2f}Hz. "
        "Transformer status: {transformer_status}. Restoration team dispatched."
    ),
    "partial_outage": (
        "Partial outage reported affecting {equipment_type} cluster in {region}. "
        "Approx. 30-40% of connected load lost. Voltage collapsed to {voltage:.1f}V. "
        "Peak demand prior to event: {power_consumption:.2f}kW. "
        "Grid frequency deviated to {grid_frequency:.2f}Hz. "
        "Transformer status: {transformer_status}. Restoration in progress."
    ),
    "voltage_deviation": (
        "Voltage deviation detected on {equipment_type} in {region}. "
        "Measured voltage: {voltage:.1f}V (nominal: 240V). "
        "Current draw: {current:.1f}A. "
        "Grid frequency: {grid_frequency:.2f}Hz. "
        "Demand load at time of event: {demand_load:.2f}kW. "
        "Transformer status: {transformer_status}. Engineers investigating root cause."
    ),
    "frequency_excursion": (
        "Grid frequency excursion detected in {region}. "
        "Frequency measured at {grid_frequency:.2f}Hz (nominal: 50Hz). "
        "Affected equipment: {equipment_type}. Voltage: {voltage:.1f}V. "
        "Power consumption at event: {power_consumption:.2f}kW. "
        "Transformer status: {transformer_status}. "
        "Automatic frequency regulation engaged. Monitoring for reoccurrence."
    ),
    "high_demand_event": (
        "High demand event recorded at {equipment_type} in {region}. "
        "Consumption peaked at {power_consumption:.3f}kW (reactive: {reactive_power:.3f}kVAR) — "
        "exceeding 85th percentile threshold. "
        "Demand load: {demand_load:.3f}kW. Voltage: {voltage:.1f}V. Current: {current:.1f}A. "
        "Sub-metering: kitchen {sub_metering_kitchen:.1f}W, "
        "laundry {sub_metering_laundry:.1f}W, HVAC {sub_metering_hvac:.1f}W. "
        "Grid frequency: {grid_frequency:.3f}Hz. Transformer: {transformer_status}. "
        "Load shedding protocols activated to prevent cascade failure."
    ),
    "meter_dropout": (
        "Smart meter communication loss detected at {equipment_type} in {region}. "
        "Last recorded consumption: {power_consumption:.3f}kW (reactive: {reactive_power:.3f}kVAR). "
        "Voltage at dropout: {voltage:.1f}V, current: {current:.1f}A. "
        "Sub-metering breakdown — kitchen: {sub_metering_kitchen:.1f}W, "
        "laundry: {sub_metering_laundry:.1f}W, HVAC: {sub_metering_hvac:.1f}W. "
        "Grid frequency: {grid_frequency:.3f}Hz. Transformer status: {transformer_status}. "
        "Field team dispatched for meter hardware inspection."
    ),
    "no_event": (
        "Routine monitoring report for {equipment_type} in {region}. "
        "All parameters within normal operating range. "
        "Voltage: {voltage:.1f}V. Current: {current:.1f}A. "
        "Power consumption: {power_consumption:.2f}kW. "
        "Grid frequency: {grid_frequency:.2f}Hz. "
        "Transformer status: {transformer_status}. No action required."
    ),
    "renewable_variability": (
        "Renewable energy variability event detected in {region}. "
        "Intermittent generation fluctuations at {equipment_type} causing instability. "
        "Voltage swing: {voltage:.1f}V. Grid frequency deviation: {grid_frequency:.2f}Hz. "
        "Power consumption during event: {power_consumption:.2f}kW. "
        "Transformer status: {transformer_status}. "
        "Grid balancing reserves activated. Storage dispatch initiated."
    ),
}
# What a template shows where a source lacks the column.
TEMPLATE_DEFAULTS = {
    "reactive_power": 0.0,
    "sub_metering_kitchen": 0.0,
    "sub_metering_laundry": 0.0,
    "sub_metering_hvac": 0.0,
}


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def contains_any(text: Column, words: Sequence[str], whole_word: bool = False) -> Column:
    """True if a lower-cased text holds any of the words, as a substring by default."""
    low = F.lower(text)
    if whole_word:
        import re

        return low.rlike("(^|[^a-z0-9_])(" + "|".join(re.escape(w) for w in words) + ")($|[^a-z0-9_])")
    return reduce(or_, [low.contains(w) for w in words])


def first_of(text: Column, words: Sequence[str], spaced: bool = False) -> Column:
    """First word of the list (in list order) that the text holds; null if none."""
    low = F.lower(text)
    out = None
    for w in words:
        cond = low.contains(w)
        if spaced and "_" in w:
            cond = cond | low.contains(w.replace("_", " "))
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out


def replace_chain(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regex replacements applied one after another."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def fixed(x: Column, places: int) -> Column:
    """Number with a fixed count of decimals, rounded on its exact binary value.

    `format_string('%.2f')` rounds the shortest decimal text instead, which turns
    49.605 into 49.61 where C and Python print 49.60.
    """
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def render(template: str, available: Sequence[str], defaults: Mapping[str, object] = TEMPLATE_DEFAULTS) -> Column:
    """`{name:.2f}` template as a text column; absent or null columns take their default."""
    import string

    parts = []
    for literal, name, spec, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = F.col(name) if name in available else F.lit(None).cast("double" if spec else "string")
            if name in defaults:
                value = F.coalesce(value, F.lit(defaults[name]))
            shown = fixed(value, int(spec[1:-1])) if spec else value.cast("string")
            parts.append(F.coalesce(shown, F.lit("None")))
    return F.concat(*parts)


def render_by_class(cls: Column, available: Sequence[str], templates: Mapping[str, str] = TEMPLATES) -> Column:
    """Template chosen by event class; an unknown class is a routine report."""
    out = None
    for name, template in templates.items():
        body = render(template, available)
        out = F.when(cls == name, body) if out is None else out.when(cls == name, body)
    return out.otherwise(render(templates["no_event"], available))


def split_words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_overlap(question: Column, answer: Column) -> Column:
    """Share of the question's words (stop words removed) that the answer uses."""
    stop = F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS])
    asked = F.array_except(F.array_distinct(split_words(F.lower(question))), stop)
    said = F.array_distinct(split_words(F.lower(answer)))
    return F.size(F.array_intersect(asked, said)) / F.greatest(F.size(asked), F.lit(1))


def map_text(m: Column, indent: str = "  ") -> Column:
    """Map as indented `k: v` lines."""
    line = F.transform(
        F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit(indent), e["key"], F.lit(": "), e["value"])
    )
    return F.array_join(line, "\n")


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(fixed(x * 100, places), F.lit("%"))


def signed(x: Column, places: int = 3) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, places))
