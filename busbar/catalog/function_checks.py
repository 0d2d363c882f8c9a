"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.spread import top_per_group
from ..sources.bindings import FEATURES, corpus, feat, met, table, tel
from . import query


@query(
    "x01_tokens",
    """SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM
       (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS t FROM documents)""",
)
def tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "x02_contains_any",
    """SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'load') OR contains(lower(text), '@') AS hit
       FROM documents""",
)
def contains_any(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.contains_any(F.col("text"), ["the", "load", "@"]).alias("hit"))


@query(
    "x03_regex_match",
    r"""SELECT page_id, regexp_matches(url, '^https?://') AS is_web, regexp_extract(url, '://([^/]+)', 1) AS host,
        array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers FROM pages""",
)
def regex_match(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.col("url").rlike("^https?://").alias("is_web"),
        F.regexp_extract("url", "://([^/]+)", 1).alias("host"),
        F.array_join(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0)), ",").alias("numbers"))


@query(
    "x04_replace_chain",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(?s)===.*?===', '', 'g'))
       AS cleaned_md5 FROM documents""",
)
def replace_chain(spark, d):
    out = tx.replace_chain(F.col("text"), [("[0-9]+", "#"), ("(?s)===.*?===", "")])
    return table(spark, d, "documents").select("doc_id", F.md5(out).alias("cleaned_md5"))


@query("x05_truncate", "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents")
def truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview"))


@query("x06_index_text", "SELECT doc_id, md5(concat_ws(' ', text, region, equipment, severity)) AS full_md5 FROM corpus",
       views="corpus")
def index_text(spark, d):
    return corpus(spark, d).select("doc_id", F.md5(F.concat_ws(" ", "text", "region", "equipment", "severity")).alias("full_md5"))


@query(
    "x07_row_sentence",
    """SELECT row_id, printf('Group: %s | Quantity: %.0f | Price: %.2f | Tax: %.4f | Stability: %s', grp, l_quantity,
       l_extendedprice, l_tax, CASE WHEN unstable THEN 'unstable' ELSE 'stable' END) AS sentence FROM feat""",
    views="feat",
)
def row_sentence(spark, d):
    label = F.when(F.col("unstable"), "unstable").otherwise("stable")
    template = "Group: {grp} | Quantity: {l_quantity:.0f} | Price: {l_extendedprice:.2f} | Tax: {l_tax:.4f} | Stability: {label}"
    rows = feat(spark, d).withColumn("label", label)
    return rows.select("row_id", tx.render(template, rows.columns).alias("sentence"))


TEL_NAMES = {"equipment_type": "equipment", "region": "zone", "transformer_status": "'normal'", "voltage": "v",
             "current": "i", "power_consumption": "value", "demand_load": "value", "grid_frequency": "freq"}


def template_sql(cls: str, names: dict[str, str]) -> str:
    """SQL of one event template; `names` maps its fields to columns, others show 0."""
    import string

    fmt, args = "", []
    for literal, name, spec, _ in string.Formatter().parse(tx.TEMPLATES[cls]):
        fmt += literal.replace("%", "%%").replace("'", "''")
        if name is not None:
            fmt += f"%{spec}" if spec else "%s"
            args.append(names.get(name, "0.0::DOUBLE"))
    return f"printf('{fmt}', {', '.join(args)})"


@query(
    "x08_render_by_class",
    "SELECT reading_id, CASE outage "
    + " ".join(f"WHEN '{c}' THEN {template_sql(c, TEL_NAMES)}" for c in tx.TEMPLATES)
    + " END AS description FROM (SELECT *, 220 + value / 20 AS v, value / 10 AS i FROM tel)",
    views="tel",
)
def render_by_class(spark, d):
    rows = tel(spark, d).selectExpr(
        "reading_id", "outage", "equipment AS equipment_type", "zone AS region", "'normal' AS transformer_status",
        "220 + value / 20 AS voltage", "value / 10 AS current", "value AS power_consumption", "value AS demand_load",
        "freq AS grid_frequency")
    return rows.select("reading_id", tx.render_by_class(F.col("outage"), rows.columns).alias("description"))


@query(
    "x09_summary_sentence",
    """SELECT 'Smart meter analysis over ' || format('{:,}', count(*)) || ' readings: ' ||
       printf('Mean demand %.2f kW, peak %.2f kW.', round(avg(power), 3), max(power)) AS summary FROM met""",
    views="met",
)
def summary_sentence(spark, d):
    return met(spark, d).agg(
        F.concat(
            F.lit("Smart meter analysis over "), F.format_number(F.count("*"), 0), F.lit(" readings: "),
            F.lit("Mean demand "), tx.fixed(F.round(F.avg("power"), 3), 2), F.lit(" kW, peak "), tx.fixed(F.max("power"), 2),
            F.lit(" kW."),
        ).alias("summary"))


@query("x10_text_key", "SELECT doc_id, md5(text) AS cache_id FROM documents")
def text_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("cache_id"))


@query(
    "x11_text_measures",
    """SELECT doc_id, length(trim(text)) AS n_chars, md5(lower(text)) AS low, md5(upper(replace(text, 'ß', 'SS'))) AS up,
       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words FROM documents""",
)
def text_measures(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.length(F.trim("text")).cast("bigint").alias("n_chars"), F.md5(F.lower("text")).alias("low"),
        F.md5(F.upper("text")).alias("up"), F.size(tx.split_words(F.col("text"))).cast("bigint").alias("n_words"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.QUESTION_STOP_WORDS) + "]"
OVERLAP_SQL = f"""(len(list_intersect(asked, said)) / greatest(len(asked), 1))"""
WORDS_SQL = f"""w AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(question), '\\s+')),
    lambda x: x <> '' AND NOT list_contains({STOP_SQL}, x)) AS asked,
    list_filter(list_distinct(regexp_split_to_array(lower(answer), '\\s+')), lambda x: x <> '') AS said FROM pairs)"""


@query("x12_word_overlap", f"SELECT conv_id, turn, round({OVERLAP_SQL}, 4) AS overlap FROM w", views="pairs",
       ctes=WORDS_SQL)
def word_overlap(spark, d):
    from ..sources.bindings import pairs

    overlap = F.round(tx.word_overlap(F.col("question"), F.col("answer")), 4)
    return pairs(spark, d).select("conv_id", "turn", overlap.alias("overlap"))


@query(
    "x13_parse_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
       CASE WHEN json_extract_string(props, '$.zone') IS NULL THEN 1 ELSE 2 END AS n_entries FROM events""",
)
def parse_json(spark, d):
    parsed = F.from_json("props", "struct<k:int, zone:string>")
    rows = table(spark, d, "events").select("event_id", parsed.alias("p"))
    entries = F.create_map(F.lit("k"), F.col("p.k").cast("string"), F.lit("zone"), F.col("p.zone"))
    kept = F.map_filter(entries, lambda _, v: v.isNotNull())
    return rows.select("event_id", F.col("p.k").alias("k"), F.size(kept).alias("n_entries"))


@query(
    "x14_map_text",
    "SELECT c_custkey, '  name: ' || c_name || chr(10) || '  segment: ' || c_mktsegment AS block FROM customer",
)
def map_text(spark, d):
    m = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")
    return table(spark, d, "customer").select("c_custkey", tx.map_text(m).alias("block"))


@query(
    "x15_array_slice",
    """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS top_orders FROM
       (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
        AS rn FROM orders) WHERE rn <= 3 GROUP BY o_custkey""",
)
def array_slice(spark, d):
    # The three best orders are cut out first, so the list per customer stays short.
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    listed = F.slice(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))), 1, 3)
    return top.groupBy("o_custkey").agg(
        F.array_join(F.transform(listed, lambda s: s["o_orderkey"].cast("string")), ",").alias("top_orders"))


@query(
    "x16_ranked_features",
    """SELECT row_id, array_to_string(list_transform(list_sort(list_transform(
       [{'feature': 'l_discount', 'v': l_discount - 0.05}, {'feature': 'l_quantity', 'v': (l_quantity - 25) / 25},
        {'feature': 'l_tax', 'v': l_tax - 0.04}], lambda s: {'k': -abs(s.v), 'feature': s.feature})), lambda s: s.feature), ',')
       AS ranked FROM feat""",
    views="feat",
)
def ranked_features(spark, d):
    names = F.array(F.lit("l_discount"), F.lit("l_quantity"), F.lit("l_tax"))
    values = F.array(F.col("l_discount") - 0.05, (F.col("l_quantity") - 25) / 25, F.col("l_tax") - 0.04)
    zipped = F.arrays_zip(names.alias("feature"), values.alias("v"))
    keyed = F.transform(zipped, lambda s: F.struct((-F.abs(s["v"])).alias("k"), s["feature"].alias("feature")))
    return feat(spark, d).select(
        "row_id", F.array_join(F.transform(F.array_sort(keyed), lambda s: s["feature"]), ",").alias("ranked"))


@query("x17_row_mean", "SELECT row_id, round((l_quantity + l_discount + l_tax) / 3, 4) AS m, abs(l_discount - 0.05) AS dist FROM feat",
       views="feat")
def row_mean(spark, d):
    mean = (F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")) / 3
    return feat(spark, d).select("row_id", F.round(mean, 4).alias("m"), F.abs(F.col("l_discount") - 0.05).alias("dist"))


@query(
    "x18_minute_window",
    """SELECT event_id, CAST(epoch_us(ts) // 1000000 // 60 AS BIGINT) AS window_id,
       CAST(60 - epoch_us(ts) // 1000000 % 60 AS INT) AS next_in FROM events""",
)
def minute_window(spark, d):
    rows = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return rows.select("event_id", F.floor(F.col("s") / 60).alias("window_id"),
                       (60 - F.col("s") % 60).cast("int").alias("next_in"))


@query(
    "x19_similarity",
    """SELECT vec_id, round(1 - (1 - embedding[1]::DOUBLE), 4) AS score FROM embeddings""",
)
def similarity(spark, d):
    distance = 1 - F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(1 - distance, 4).alias("score"))


@query("x20_formats", "SELECT row_id, printf('%.1f%%', l_discount * 100) AS pct, printf('%+.3f', l_tax - 0.04) AS delta FROM feat",
       views="feat")
def formats(spark, d):
    return feat(spark, d).select("row_id", tx.percent(F.col("l_discount")).alias("pct"),
                                 tx.signed(F.col("l_tax") - 0.04).alias("delta"))
