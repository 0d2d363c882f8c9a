"""Text validation, masking, routing and scoring."""

from pyspark.sql import functions as F

from ..operators import guard
from ..operators.aggregates import metric_means
from ..sources.bindings import chat, corpus, pairs, table, tel
from . import query
from .function_checks import OVERLAP_SQL, WORDS_SQL


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_lit(w)})" for w in words) + ")"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def first_sql(text: str, words, spaced: bool = False) -> str:
    out = "CASE"
    for w in words:
        cond = f"contains(lower({text}), {_lit(w)})"
        if spaced and "_" in w:
            cond += f" OR contains(lower({text}), {_lit(w.replace('_', ' '))})"
        out += f" WHEN {cond} THEN {_lit(w)}"
    return out + " END"


FORMAT_SQL = f"""CASE WHEN length({strip_sql('text')}) = 0 THEN {_lit(guard.EMPTY)}
    WHEN length({strip_sql('text')}) < 5 THEN {_lit(guard.SHORT)} WHEN length(text) > 1000 THEN {_lit(guard.LONG)} END"""
HARM_SQL = "coalesce(" + ", ".join(
    f"nullif({strip_sql(f'regexp_extract(lower(text), {_lit(p)}, 0)')}, '')" for p in guard.HARMFUL_PATTERNS) + ")"
# Word borders of accented letters differ between the engines, so the SQL spells them out
# and masks twice, because a border character is consumed by the match before it.
B0, B1 = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def mask_sql(text: str, pattern: str, mark: str) -> str:
    core = _lit(B0 + "(?:" + pattern.removeprefix(r"\b").removesuffix(r"\b") + ")" + B1)
    once = f"regexp_replace({text}, {core}, {_lit(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"
    return f"regexp_replace({once}, {core}, {_lit(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"


def contacts_sql(text: str) -> str:
    return mask_sql(mask_sql(text, guard.GPS_LOOSE, "<GPS_MASKED>"), guard.EMAIL, "<EMAIL_MASKED>")


def ids_sql(text: str) -> str:
    for pattern, mark in guard.ID_MASKS:
        text = mask_sql(text, pattern, mark)
    return text


@query("g01_format_check", f"SELECT conv_id, turn, {FORMAT_SQL} AS reason FROM chat", views="chat")
def format_check(spark, d):
    return chat(spark, d).select("conv_id", "turn", guard.format_error(F.col("text")).alias("reason"))


@query("g02_harmful_match", f"SELECT conv_id, turn, {HARM_SQL} AS matched FROM chat", views="chat")
def harmful_match(spark, d):
    return chat(spark, d).select("conv_id", "turn", guard.harmful_match(F.col("text")).alias("matched"))


@query("g03_domain_relevance",
       f"SELECT conv_id, turn, {any_sql('text', guard.DOMAIN_KEYWORDS)} AS in_domain FROM chat", views="chat")
def domain_relevance(spark, d):
    return chat(spark, d).select("conv_id", "turn", guard.in_domain(F.col("text")).alias("in_domain"))


@query(
    "g04_mask_contacts",
    f"""SELECT doc_id, md5(m) AS masked_md5, m <> text AS pii_detected, CASE WHEN m <> text THEN 'regex_fallback'
        ELSE '' END AS entities FROM (SELECT doc_id, text, {contacts_sql('text')} AS m FROM documents)""",
)
def mask_contacts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", guard.mask_contacts(F.col("text")).alias("m"))
    found = F.col("m") != F.col("text")
    return rows.select("doc_id", F.md5("m").alias("masked_md5"), found.alias("pii_detected"),
                       F.when(found, "regex_fallback").otherwise("").alias("entities"))


@query("g05_mask_ids", f"SELECT doc_id, md5({ids_sql('text')}) AS masked_md5 FROM documents")
def mask_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(guard.mask_ids(F.col("text"))).alias("masked_md5"))


@query(
    "g06_validate",
    f"""SELECT conv_id, turn, blocked_by, CASE blocked_by WHEN 'format' THEN fmt WHEN 'harmful' THEN 'Unsafe keyword: ' || harm
        WHEN 'domain' THEN 'Query is outside the grid domain.' END AS reason, blocked_by IS NULL AS is_valid,
        CASE WHEN blocked_by IS NULL THEN {strip_sql(ids_sql('masked'))} END AS sanitised,
        blocked_by IS NULL AND masked <> text AS pii_detected FROM
        (SELECT *, CASE WHEN fmt IS NOT NULL THEN 'format' WHEN harm IS NOT NULL THEN 'harmful'
         WHEN NOT {any_sql('text', guard.DOMAIN_KEYWORDS)} THEN 'domain' END AS blocked_by FROM
         (SELECT *, {FORMAT_SQL} AS fmt, {HARM_SQL} AS harm, {contacts_sql('text')} AS masked FROM chat))""",
    views="chat",
)
def validate(spark, d):
    out = guard.validate(chat(spark, d), "text")
    return out.select("conv_id", "turn", "blocked_by", "reason", "is_valid", "sanitised", "pii_detected")


@query("g07_greeting", f"SELECT conv_id, turn, regexp_matches(text, {_lit('(?i)' + guard.GREETING)}) AS greeting FROM chat",
       views="chat")
def greeting(spark, d):
    return chat(spark, d).select("conv_id", "turn", guard.is_greeting(F.col("text")).alias("greeting"))


QUESTION = """concat('Find ', severity, ' incidents for the ', CASE WHEN doc_id % 3 = 0 THEN 'smart meter bank'
    WHEN doc_id % 3 = 1 THEN 'transmission_line' ELSE 'Transformer' END, ' in zone', CASE WHEN doc_id % 2 = 0 THEN '_'
    ELSE ' ' END, CASE region WHEN 'en' THEN 'a' WHEN 'de' THEN 'B' WHEN 'fr' THEN 'c' ELSE 'x' END, ', seen from ',
    equipment)"""


@query(
    "g08_extract_filters",
    f"""SELECT doc_id, CASE WHEN z <> '' THEN 'Zone_' || z END AS region,
        {first_sql('question', guard.SEVERITY_WORDS)} AS severity,
        {first_sql('question', guard.EQUIPMENT_WORDS, True)} AS equipment
        FROM (SELECT *, upper(regexp_extract(question, {_lit('(?i)' + guard.ZONE)}, 1)) AS z
        FROM (SELECT doc_id, {QUESTION} AS question FROM corpus))""",
    views="corpus",
)
def extract_filters(spark, d):
    rows = corpus(spark, d).select("doc_id", F.expr(QUESTION).alias("question"))
    return rows.select("doc_id", *[c.alias(n) for n, c in guard.extract_filters(F.col("question")).items()])


def route_sql(text: str) -> str:
    """Subquery columns s, m, i of the routing flags."""
    m, i = any_sql(text, guard.METER_WORDS), any_sql(text, guard.INCIDENT_WORDS)
    s = f"({any_sql(text, guard.STABILITY_WORDS)} OR ({any_sql(text, guard.FREQUENCY_WORDS)} AND NOT {m}))"
    none = f"(NOT {s} AND NOT {m} AND NOT {i})"
    return f"{s} OR {none} AS s, {m} OR {none} AS m, {i} OR {none} AS i"


ROUTE_LIST_SQL = """concat_ws('+', CASE WHEN s THEN 'DS1-Stability' END, CASE WHEN m THEN 'DS2-SmartMeter' END,
    CASE WHEN i THEN 'Incidents-RAG' END)"""


@query("g09_route_flags", f"SELECT conv_id, turn, s AS wants_stability, m AS wants_meter, i AS wants_incidents, {ROUTE_LIST_SQL} AS route "
       f"FROM (SELECT *, {route_sql('text')} FROM chat)", views="chat")
def route_flags(spark, d):
    flags = guard.route_flags(F.col("text"))
    return chat(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in flags.items()],
                                 F.array_join(guard.route_list(flags), "+").alias("route"))


@query(
    "g10_raw_rows_request",
    f"""SELECT conv_id, turn, {any_sql('text', guard.RAW_WORDS)} AS wants_rows,
        CAST(least(coalesce(TRY_CAST(regexp_extract(text, '(^|[^\\p{{L}}\\p{{N}}_])(\\d+)($|[^\\p{{L}}\\p{{N}}_])', 2) AS DOUBLE), 10.0),
        20.0) AS INT) AS n_rows, CASE WHEN {any_sql('text', ['last', 'recent'])} THEN 'last' ELSE 'first' END AS mode FROM chat""",
    views="chat",
)
def raw_rows_request(spark, d):
    parts = guard.raw_rows_request(F.col("text"))
    return chat(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in parts.items()])


@query(
    "g11_output_filter",
    f"""SELECT conv_id, turn, {mask_sql(mask_sql('a3', guard.OUTPUT_EMAIL, '[EMAIL]'), guard.OUTPUT_PHONE, '[PHONE]')} AS final_answer,
        concat_ws('; ', CASE WHEN inj THEN 'Harmful content detected and blocked' END, CASE WHEN leak THEN
        'System prompt fragments removed' END, CASE WHEN short THEN 'Response too short — replaced with fallback' END) AS issues
        FROM (SELECT *, CASE WHEN short THEN {_lit(guard.FALLBACK_ANSWER)} ELSE a2 END AS a3 FROM
        (SELECT *, length({strip_sql('a2')}) < 20 AS short FROM
        (SELECT *, CASE WHEN leak THEN {strip_sql("regexp_replace(a1, '(?s)===.*?===', '', 'g')")} ELSE a1 END AS a2 FROM
        (SELECT *, contains(a1, '=== ') AS leak FROM (SELECT *, CASE WHEN inj THEN {_lit(guard.BLOCKED_ANSWER)} ELSE text END AS a1
        FROM (SELECT *, {any_sql('text', guard.INJECTIONS)} AS inj FROM chat WHERE role = 'assistant'))))))""",
    views="chat",
)
def output_filter(spark, d):
    out = guard.output_filter(chat(spark, d).filter("role = 'assistant'"), "text")
    return out.select("conv_id", "turn", "final_answer", F.array_join("issues", "; ").alias("issues"))


NUMBER_SQL = "regexp_matches(answer, '\\d+\\.?\\d*')"
SPECIFIC_SQL = (f"({NUMBER_SQL} OR regexp_matches(answer, 'INC-\\d+') OR "
                + " OR ".join(f"contains(answer, '{z}')" for z in guard.ZONES) + ")")
EVIDENCE_SQL = f"""greatest(0.0, round(least(1.0, 1.0::DOUBLE - CASE WHEN length({strip_sql('answer')}) < 40 THEN 0.40::DOUBLE ELSE 0 END
    - CASE WHEN {any_sql('answer', guard.REFUSALS)} THEN 0.35::DOUBLE ELSE 0 END
    - CASE WHEN NOT {NUMBER_SQL} THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN NOT {SPECIFIC_SQL} THEN 0.10::DOUBLE ELSE 0 END), 2))"""
RUBRIC_SQL = f"""greatest(1, least(5, 5 - CAST({OVERLAP_SQL} < 0.2 AS INT) - CAST(NOT {SPECIFIC_SQL} AS INT)
    - CAST(len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) < 20 AS INT)
    - CAST({' + '.join(f"CAST(contains(lower(answer), {_lit(p)}) AS INT)" for p in guard.DISCLAIMERS)} >= 2 AS INT)))"""


@query("g12_evidence_score", f"SELECT conv_id, turn, {EVIDENCE_SQL} AS evidence FROM pairs", views="pairs")
def evidence_score(spark, d):
    return pairs(spark, d).select("conv_id", "turn", guard.evidence_score(F.col("answer"), F.lit(1)).alias("evidence"))


@query("g13_answer_rubric", f"SELECT conv_id, turn, {RUBRIC_SQL} AS rubric FROM w", views="pairs", ctes=WORDS_SQL)
def answer_rubric(spark, d):
    return pairs(spark, d).select("conv_id", "turn", guard.answer_rubric(F.col("question"), F.col("answer")).alias("rubric"))


@query(
    "g14_gate",
    f"""SELECT conv_id, turn, evidence >= 0.5 AND rubric >= 3 AS passed, evidence, rubric FROM
        (SELECT *, {EVIDENCE_SQL} AS evidence, {RUBRIC_SQL} AS rubric FROM w)""",
    views="pairs",
    ctes=WORDS_SQL,
)
def gate(spark, d):
    q, a = F.col("question"), F.col("answer")
    scored = pairs(spark, d).select("conv_id", "turn", guard.evidence_score(a, F.lit(1)).alias("evidence"),
                                    guard.answer_rubric(q, a).alias("rubric"))
    return scored.withColumn("passed", guard.passes_gate(F.col("evidence"), F.col("rubric")))


# Labelled questions, one per outage class of a reading, and the dataset each must reach.
LABELLED = {
    "voltage_deviation": ("Analyse voltage instability in {z} transformers", "Incidents-RAG"),
    "no_event": ("What is the current grid stability and health score?", "DS1-Stability"),
    "meter_dropout": ("Detect smart meter consumption anomalies", "DS2-SmartMeter"),
    "partial_outage": ("Find similar incidents to {z} partial outage with critical transformer status", "Incidents-RAG"),
    "frequency_excursion": ("Why did the grid frequency deviate last week and what should we do?", "DS1-Stability"),
    "full_outage": ("Explain transformer overload causes and provide mitigation in {z}", "Incidents-RAG"),
    "high_demand_event": ("What is the demand forecast and anomaly count for smart meters?", "DS2-SmartMeter"),
    "renewable_variability": ("Full grid assessment: stability, incidents, and smart meter status", "DS2-SmartMeter"),
}
_QUESTION_SQL = "CASE outage " + " ".join(
    f"WHEN '{k}' THEN replace({_lit(q)}, '{{z}}', zone)" for k, (q, _) in LABELLED.items()) + " END"
_EXPECTED_SQL = "CASE outage " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, (_, e) in LABELLED.items()) + " END"


@query(
    "g15_routing_accuracy",
    f"""SELECT outage AS metric, round(avg(CAST(contains({ROUTE_LIST_SQL}, expected) AS INT)), 4) AS mean_score,
        max({ROUTE_LIST_SQL}) AS route FROM (SELECT *, {route_sql('question')} FROM
        (SELECT outage, {_QUESTION_SQL} AS question, {_EXPECTED_SQL} AS expected FROM tel)) GROUP BY outage""",
    views="tel",
)
def routing_accuracy(spark, d):
    rows = tel(spark, d).select("outage", F.expr(_QUESTION_SQL).alias("question"), F.expr(_EXPECTED_SQL).alias("expected"))
    route = guard.route_list(guard.route_flags(F.col("question")))
    scored = rows.select(F.col("outage").alias("metric"), F.array_join(route, "+").alias("route"),
                         F.array_contains(route, F.col("expected")).cast("double").alias("score"))
    routes = scored.groupBy("metric").agg(F.max("route").alias("route"))
    return metric_means(scored).join(routes, "metric")
