"""Rule-based validation, masking, routing and scoring of questions and answers.

Patterns carry `(?U)`, so that word borders, digits and blanks follow Unicode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_of, split_words, word_overlap

# Limits and word lists of the rules.
MIN_LEN, MAX_LEN = 5, 1000
EMPTY = "Query cannot be empty."
SHORT = f"Query too short (minimum {MIN_LEN} characters)."
LONG = f"Query too long (maximum {MAX_LEN} characters)."

DOMAIN_KEYWORDS = [
    "grid", "power", "energy", "voltage", "current", "transformer", "substation",
    "outage", "stability", "frequency", "meter", "smart meter", "demand", "load",
    "watt", "kwh", "ampere", "circuit", "fault", "trip", "overload", "distribution",
    "transmission", "feeder", "relay", "scada", "renewable", "solar", "wind",
    "zone", "region", "incident", "anomaly", "deviation", "excursion", "failure",
    "restoration", "equipment", "infrastructure", "forecast", "consumption", "peak",
    "health", "score", "critical", "high", "medium", "low", "severity", "risk",
    "mitigation", "recommendation", "analysis", "trend", "monitor", "detect",
    "explain", "summarise", "summarize", "compare", "show", "why", "what", "how",
    "rate", "count", "status", "feed", "agent", "bank", "cluster", "phase",
    "cascade", "instability", "dip", "spike", "drop", "imbalance", "safe", "limit",
    "INC", "AN-", "zone_a", "zone_b", "zone_c", "zone_d", "sm-c", "t-22",
]

HARMFUL_PATTERNS = [
    r"\b(kill|murder|stab|shoot|bomb|attack|harm|hurt|threaten|assassin|terror)\b",
    r"\b(suicide|suicidal|self.?harm|cut myself|end my life|want to die|wanna die|"
    r"die with|dying with|kill myself|i want (to )?die|i wanna die|"
    r"poison (myself|me)|take my (own )?life|hurt myself)\b",
    r"\b(knife|gun|weapon|explosive|grenade)\b.*\b(person|people|human|someone|him|her|me|myself)\b",
    r"\b(poison|cyanide|arsenic|overdose|lethal dose)\b",
    r"\b(hack|ddos|malware|ransomware|phish|steal data)\b",
    r"\b(sex|porn|naked|nude|rape|molest)\b",
]

GPS_LOOSE = r"\b\d{1,3}\.\d+[NS]?\s*,?\s*\d{1,3}\.\d+[EW]?\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
ID_MASKS = [
    (r"\b\d{10,}\b", "[ID_MASKED]"),
    (r"\b[A-Z]{2,}\d{4,}\b", "[REF_MASKED]"),
    (r"\b\d{1,3}\.\d+[NS],?\s*\d{1,3}\.\d+[EW]\b", "[GPS_MASKED]"),
]
OUTPUT_EMAIL = r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
OUTPUT_PHONE = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
GREETING = (
    r"^\s*(hi|hello|hey|howdy|good\s*(morning|evening|afternoon)|sup|yo|greetings"
    r"|what('s| is) up|how are you|who are you|what (can|do) you do)\s*[!?.]?\s*$"
)
ZONE = r"\bzone[_\s-]?([a-d])\b"
SEVERITY_WORDS = ["critical", "high", "medium", "low"]
EQUIPMENT_WORDS = [
    "transformer", "substation", "distribution_unit", "smart_meter_bank", "transmission_line", "renewable_inverter",
]

STABILITY_WORDS = [
    "tau", "tau1", "tau2", "tau3", "tau4", "p1", "p2", "p3", "p4", "g1", "g2", "g3", "g4",
    "stab", "stabf", "stability", "unstable", "stable", "reaction time", "elasticity", "power balance",
    "xgboost", "ds1", "telemetry", "oscillation",
]
METER_WORDS = [
    "voltage", "volt", "current", "amp", "power consumption", "reactive power", "reactive",
    "sub metering", "sub_metering", "kitchen", "laundry", "hvac", "household", "demand load", "demand",
    "ds2", "smart meter", "consumption", "kwh", "watt", "energy use", "energy usage",
]
INCIDENT_WORDS = [
    "incident", "outage", "fault", "failure", "event", "zone", "region", "severity", "critical", "high",
    "medium", "low", "full outage", "partial outage", "frequency excursion", "voltage deviation", "renewable",
    "meter dropout", "equipment", "transformer", "substation",
]
RAW_WORDS = [
    "last", "latest", "recent", "first", "top", "give me", "show me", "list", "fetch", "records", "rows",
    "readings", "levels", "values", "entries", "data", "10", "20", "5", "50",
]
FREQUENCY_WORDS = ["frequency", "hz"]
ROUTE_NAMES = {"stability": "DS1-Stability", "meter": "DS2-SmartMeter", "incidents": "Incidents-RAG"}

REFUSALS = [
    "i don't have", "i cannot", "not available", "no information", "unable to", "i'm not sure",
    "i do not have access",
]
DISCLAIMERS = ["note:", "disclaimer:", "please note", "keep in mind", "it is important"]
INJECTIONS = ["ignore previous", "jailbreak", "forget your instructions", "act as", "you are now", "pretend you"]
BLOCKED_ANSWER = "⚠️ Response blocked by output guardrails."
FALLBACK_ANSWER = "No meaningful answer could be generated for this query. Try rephrasing."
ZONES = ["Zone_A", "Zone_B", "Zone_C", "Zone_D"]


def u(pattern: str) -> str:
    return f"(?U){pattern}"


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, u(r"^\s+|\s+$"), "")


def format_error(text: Column) -> Column:
    """Why the text is refused for its form; null if it is fine."""
    bare = F.length(strip(F.coalesce(text, F.lit(""))))
    return F.when(bare == 0, EMPTY).when(bare < MIN_LEN, SHORT).when(F.length(text) > MAX_LEN, LONG)


def harmful_match(text: Column, patterns: Sequence[str] = HARMFUL_PATTERNS) -> Column:
    """Text matched by the first pattern that hits; null if none does."""
    low = F.lower(text)
    hits = [F.nullif(strip(F.regexp_extract(low, u(p), 0)), F.lit("")) for p in patterns]
    return F.coalesce(*hits)


def harmful_rule(text: Column, patterns: Sequence[str] = HARMFUL_PATTERNS) -> Column:
    """1-based place of the first pattern that hits."""
    low = F.lower(text)
    out = None
    for i, p in enumerate(patterns, 1):
        out = F.when(low.rlike(u(p)), i) if out is None else out.when(low.rlike(u(p)), i)
    return out


def in_domain(text: Column, words: Sequence[str] = DOMAIN_KEYWORDS, whole_word: bool = False) -> Column:
    return contains_any(text, words, whole_word)


def mask_contacts(text: Column) -> Column:
    """Mask coordinates, then e-mail addresses."""
    return F.regexp_replace(F.regexp_replace(text, u(GPS_LOOSE), "<GPS_MASKED>"), u(EMAIL), "<EMAIL_MASKED>")


def mask_ids(text: Column) -> Column:
    """Mask long numbers, reference codes and coordinates with a compass letter."""
    out = text
    for pattern, mark in ID_MASKS:
        out = F.regexp_replace(out, u(pattern), mark.replace("$", r"\$"))
    return out


def validate(df: DataFrame, text: str) -> DataFrame:
    """Four layers in one projection; the first that fails gives `blocked_by` and `reason`."""
    t = F.col(text)
    out = df.withColumns({"_fmt": format_error(t), "_harm": harmful_match(t), "_masked": mask_contacts(t)})
    blocked = (
        F.when(F.col("_fmt").isNotNull(), "format")
        .when(F.col("_harm").isNotNull(), "harmful")
        .when(~in_domain(t), "domain")
    )
    reason = (
        F.when(F.col("_fmt").isNotNull(), F.col("_fmt"))
        .when(F.col("_harm").isNotNull(), F.concat(F.lit("Unsafe keyword: "), "_harm"))
        .when(~in_domain(t), "Query is outside the grid domain.")
    )
    ok = blocked.isNull()
    pii = ok & (F.col("_masked") != t)
    return out.withColumns(
        {
            "blocked_by": blocked,
            "reason": reason,
            "is_valid": ok,
            "sanitised": F.when(ok, strip(mask_ids(F.col("_masked")))),
            "pii_detected": pii,
            "pii_entities": F.when(pii, F.array(F.lit("regex_fallback"))).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_fmt", "_harm", "_masked")


def is_greeting(text: Column) -> Column:
    return text.rlike(f"(?iU){GREETING}")


def extract_filters(text: Column) -> dict[str, Column]:
    """Zone, severity and equipment named in a question; null where absent."""
    letter = F.upper(F.regexp_extract(text, f"(?iU){ZONE}", 1))
    return {
        "region": F.when(letter != "", F.concat(F.lit("Zone_"), letter)),
        "severity": first_of(text, SEVERITY_WORDS),
        "equipment": first_of(text, EQUIPMENT_WORDS, spaced=True),
    }


def route_flags(
    text: Column,
    stability: Sequence[str] = STABILITY_WORDS,
    meter: Sequence[str] = METER_WORDS,
    incidents: Sequence[str] = INCIDENT_WORDS,
    meter_takes_frequency: bool = True,
) -> dict[str, Column]:
    """Datasets a question needs; a frequency question goes to stability unless the meter words
    claim it, and a question that names nothing needs everything."""
    m, i = contains_any(text, meter), contains_any(text, incidents)
    freq = contains_any(text, FREQUENCY_WORDS)
    s = contains_any(text, stability) | (freq & ~m if meter_takes_frequency else freq)
    none = ~s & ~m & ~i
    return {"wants_stability": s | none, "wants_meter": m | none, "wants_incidents": i | none}


def route_list(flags: Mapping[str, Column]) -> Column:
    return F.array_compact(
        F.array(
            F.when(flags["wants_stability"], ROUTE_NAMES["stability"]),
            F.when(flags["wants_meter"], ROUTE_NAMES["meter"]),
            F.when(flags["wants_incidents"], ROUTE_NAMES["incidents"]),
        )
    )


def raw_rows_request(text: Column, default: int = 10, cap: int = 20) -> dict[str, Column]:
    """Whether rows are asked for, how many, and from which end."""
    number = F.regexp_extract(text, u(r"\b(\d+)\b"), 1).try_cast("double")
    return {
        "wants_rows": contains_any(text, RAW_WORDS),
        "n_rows": F.least(F.coalesce(number, F.lit(float(default))), F.lit(float(cap))).cast("int"),
        "mode": F.when(contains_any(text, ["last", "recent"]), "last").otherwise("first"),
    }


def output_filter(df: DataFrame, answer: str) -> DataFrame:
    """Clean an answer before it is shown: `final_answer` and the list of `issues`."""
    a = F.col(answer)
    injected = contains_any(a, INJECTIONS)
    first = F.when(injected, BLOCKED_ANSWER).otherwise(a)
    leaked = first.contains("=== ")
    out = df.withColumns({"_leak": leaked, "_inj": injected,
                          "_a2": F.when(leaked, strip(F.regexp_replace(first, "(?s)===.*?===", ""))).otherwise(first)})
    short = F.length(strip(F.col("_a2"))) < 20
    out = out.withColumns({"_short": short, "_a3": F.when(short, FALLBACK_ANSWER).otherwise(F.col("_a2"))})
    final = F.regexp_replace(F.regexp_replace("_a3", u(OUTPUT_EMAIL), "[EMAIL]"), u(OUTPUT_PHONE), "[PHONE]")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_inj"), "Harmful content detected and blocked"),
            F.when(F.col("_leak"), "System prompt fragments removed"),
            F.when(F.col("_short"), "Response too short — replaced with fallback"),
        )
    )
    return out.withColumns({"final_answer": final, "issues": issues}).drop("_leak", "_inj", "_short", "_a2", "_a3")


def _has_number(a: Column) -> Column:
    return a.rlike(u(r"\d+\.?\d*"))


def _specific(a: Column) -> Column:
    zone = F.lit(False)
    for z in ZONES:
        zone = zone | a.contains(z)
    return _has_number(a) | a.rlike(u(r"INC-\d+")) | zone


def evidence_score(answer: Column, n_hits: Column) -> Column:
    """1.0 minus penalties for short, refusing, number-free or unreferenced answers."""
    low = F.lower(answer)
    has_hits = n_hits > 0
    score = (
        F.lit(1.0)
        - F.when(F.length(strip(answer)) < 40, 0.40).otherwise(0.0)
        - F.when(contains_any(low, REFUSALS), 0.35).otherwise(0.0)
        - F.when(~_has_number(answer) & has_hits, 0.15).otherwise(0.0)
        - F.when(has_hits & ~_specific(answer), 0.10).otherwise(0.0)
    )
    clamped = F.greatest(F.lit(0.0), F.round(F.least(F.lit(1.0), score), 2))
    return F.when(answer.isNull() | (answer == ""), 1.0).otherwise(clamped)


def answer_rubric(question: Column, answer: Column) -> Column:
    """5 minus one point per failed criterion, at least 1."""
    low = F.lower(answer)
    disclaimers = sum((low.contains(p).cast("int") for p in DISCLAIMERS[1:]), low.contains(DISCLAIMERS[0]).cast("int"))
    score = (
        F.lit(5)
        - (word_overlap(question, answer) < 0.2).cast("int")
        - (~_specific(answer)).cast("int")
        - (F.size(split_words(answer)) < 20).cast("int")
        - (disclaimers >= 2).cast("int")
    )
    clamped = F.greatest(F.lit(1), F.least(F.lit(5), score))
    return F.when(answer.isNull() | (answer == ""), 5).otherwise(clamped)


def passes_gate(evidence: Column, rubric: Column) -> Column:
    return (evidence >= 0.5) & (rubric >= 3)


def gate_issues(question: Column, answer: Column, n_hits: Column) -> Column:
    """Every reason for which an answer lost points."""
    low = F.lower(answer)
    has_hits = n_hits > 0
    disclaimers = sum((low.contains(p).cast("int") for p in DISCLAIMERS[1:]), low.contains(DISCLAIMERS[0]).cast("int"))
    return F.array_compact(
        F.array(
            F.when(F.length(strip(answer)) < 40, "short"),
            F.when(contains_any(low, REFUSALS), "refusal"),
            F.when(~_has_number(answer) & has_hits, "no numbers"),
            F.when(has_hits & ~_specific(answer), "no reference"),
            F.when(word_overlap(question, answer) < 0.2, "low relevance"),
            F.when(~_specific(answer), "not specific"),
            F.when(F.size(split_words(answer)) < 20, "too brief"),
            F.when(disclaimers >= 2, "disclaimers"),
        )
    )
