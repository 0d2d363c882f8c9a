"""Projections, cleaning and filters."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean
from ..sources.bindings import corpus, met, table, tel
from . import query


@query("p01_rename", "SELECT c_custkey AS meter_id, c_name AS meter_name, c_acctbal AS balance FROM customer")
def rename(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return clean.rename(rows, {"c_custkey": "meter_id", "c_name": "meter_name", "c_acctbal": "balance"})


@query("p02_alias_column", "SELECT reading_id, power, power AS demand_load FROM met", views="met")
def alias_column(spark, d):
    return met(spark, d).select("reading_id", "power").withColumn("demand_load", F.col("power"))


@query(
    "p03_constant_column",
    "SELECT reading_id, 'Zone_A_Residential' AS region, 'smart_meter' AS equipment_type FROM met",
    views="met",
)
def constant_column(spark, d):
    rows = met(spark, d).select("reading_id")
    return rows.withColumns({"region": F.lit("Zone_A_Residential"), "equipment_type": F.lit("smart_meter")})


@query(
    "p04_clean_numeric",
    """SELECT reading_id, TRY_CAST(trim(trim(CASE WHEN equipment = 'error' THEN 'n/a'
       ELSE ' [' || value || '] ' END), '[]') AS DOUBLE) AS cleaned FROM tel""",
    views="tel",
)
def clean_numeric(spark, d):
    raw = F.when(F.col("equipment") == "error", "n/a").otherwise(F.concat(F.lit(" ["), "value", F.lit("] ")))
    return tel(spark, d).select("reading_id", clean.clean_numeric(raw).alias("cleaned"))


@query(
    "p05_parse_ts",
    """SELECT o_orderkey, try_strptime(CASE WHEN o_orderstatus = 'P' THEN '31/02/2007' ELSE
       strftime(o_orderdate, '%d/%m/%Y') END || ' 00:00:00', '%d/%m/%Y %H:%M:%S') AS parsed FROM orders""",
)
def parse_ts(spark, d):
    date = F.when(F.col("o_orderstatus") == "P", "31/02/2007").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    parsed = clean.parse_ts(date, F.lit("00:00:00")).cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("parsed"))


@query("p06_drop_null", "SELECT reading_id, power FROM met WHERE power IS NOT NULL", views="met")
def drop_null(spark, d):
    return clean.drop_null(met(spark, d), ["power"]).select("reading_id", "power")


@query(
    "p07_drop_null_any",
    """SELECT reading_id, meter_id, ts, power, k FROM met WHERE reading_id IS NOT NULL AND meter_id IS NOT NULL
       AND ts IS NOT NULL AND power IS NOT NULL AND k IS NOT NULL""",
    views="met",
)
def drop_null_any(spark, d):
    return clean.drop_null_any(met(spark, d))


@query("p08_fill_zero", "SELECT reading_id, coalesce(power, 0.0) AS power FROM met", views="met")
def fill_zero(spark, d):
    return clean.fill_zero(met(spark, d).select("reading_id", "power"), ["power"])


@query(
    "p09_default_missing_features",
    "SELECT reading_id, power, CAST(0 AS DOUBLE) AS tau1, CAST(0 AS DOUBLE) AS g1 FROM met",
    views="met",
)
def default_missing_features(spark, d):
    return clean.default_missing_features(met(spark, d).select("reading_id", "power"), ["power", "tau1", "g1"])


@query(
    "p10_flag_missing",
    """SELECT reading_id, coalesce(power, 0.0) AS power,
       CASE WHEN power IS NULL THEN 'meter_dropout' ELSE 'no_event' END AS event FROM met""",
    views="met",
)
def flag_missing(spark, d):
    rows = clean.flag_missing(met(spark, d).select("reading_id", "power"), "power")
    rows = clean.fill_zero(rows, ["power"])
    event = F.when(F.col("is_missing"), "meter_dropout").otherwise("no_event")
    return rows.withColumn("event", event).drop("is_missing")


@query("p11_clamp", "SELECT reading_id, greatest(20.0, least(260.0, value)) AS clamped FROM tel", views="tel")
def clamp(spark, d):
    return tel(spark, d).select("reading_id", clean.clamp(F.col("value"), 20.0, 260.0).alias("clamped"))


@query(
    "p12_map_values",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Zone_A' WHEN 'MACHINERY' THEN 'Zone_B'
       WHEN 'HOUSEHOLD' THEN 'Zone_C' ELSE 'Zone_D' END AS zone FROM customer""",
)
def map_values(spark, d):
    zones = {"BUILDING": "Zone_A", "MACHINERY": "Zone_B", "HOUSEHOLD": "Zone_C"}
    zone = clean.map_values(F.col("c_mktsegment"), zones, F.lit("Zone_D"))
    return table(spark, d, "customer").select("c_custkey", zone.alias("zone"))


@query("p13_topic_select", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem")
def topic_select(spark, d):
    return clean.topic_select(table(spark, d, "lineitem"), "show the price levels")


@query("p14_nest_meta", "SELECT doc_id, n, region, equipment, severity FROM (SELECT *, length(text) AS n FROM corpus)",
       views="corpus")
def nest_meta(spark, d):
    nested = clean.nest_meta(corpus(spark, d), "doc_id", "text", ["region", "equipment", "severity"])
    return nested.select("doc_id", F.length("text").cast("bigint").alias("n"), "meta.*")


@query("p15_hide_truth", "SELECT reading_id, value, CAST(NULL AS VARCHAR) AS outage, CAST(NULL AS DOUBLE) AS prob FROM tel",
       views="tel")
def hide_truth(spark, d):
    rows = tel(spark, d).select("reading_id", "value", "outage", "prob")
    return clean.hide_truth(rows, ["outage", "prob"])


@query("p16_conform", "SELECT zone, reading_id, CAST(value AS FLOAT) AS value, CAST(NULL AS VARCHAR) AS stabf FROM tel",
       views="tel")
def conform(spark, d):
    schema = T.StructType(
        [
            T.StructField("zone", T.StringType()),
            T.StructField("reading_id", T.LongType()),
            T.StructField("value", T.FloatType()),
            T.StructField("stabf", T.StringType()),
        ]
    )
    return clean.conform(tel(spark, d), schema)


@query("f01_filter_meta", "SELECT doc_id, region, severity FROM corpus WHERE region = 'en' AND severity = 'low'",
       views="corpus")
def filter_meta(spark, d):
    rows = corpus(spark, d).select("doc_id", "region", "severity", "equipment")
    return clean.filter_meta(rows, {"region": "en", "severity": "low", "equipment": None}).drop("equipment")


@query("f02_filter_region", "SELECT reading_id, zone, value FROM tel WHERE zone = 'Zone_B'", views="tel")
def filter_region(spark, d):
    return clean.filter_region(tel(spark, d), "Zone_B").select("reading_id", "zone", "value")


@query("f03_quantile_filter_high",
       "SELECT reading_id, value FROM tel WHERE value >= (SELECT quantile_cont(value, 0.85) FROM tel)", views="tel")
def quantile_filter_high(spark, d):
    return clean.filter_quantile(tel(spark, d).select("reading_id", "value"), "value", hi=0.85)


@query("f03_quantile_filter_two_sided",
       """SELECT reading_id, value FROM tel WHERE value <= (SELECT quantile_cont(value, 0.02) FROM tel)
          OR value >= (SELECT quantile_cont(value, 0.97) FROM tel)""", views="tel")
def quantile_filter_two_sided(spark, d):
    return clean.filter_quantile(tel(spark, d).select("reading_id", "value"), "value", lo=0.02, hi=0.97)


@query("f04_filter_or_all", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#2'")
def filter_or_all(spark, d):
    return clean.filter_or_all(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_brand") == "Brand#2")


@query("f04_filter_or_all_empty", "SELECT p_partkey, p_brand FROM part")
def filter_or_all_empty(spark, d):
    return clean.filter_or_all(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_brand") == "none")


@query("f05_same_id",
       """SELECT c_custkey, upper(lower(c_name)) = upper(c_name) AS same FROM customer""")
def same_id(spark, d):
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", clean.same_id(F.lower("c_name"), F.col("c_name")).alias("same"))
