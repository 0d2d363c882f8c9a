"""Sorts, limits, samples and set operations."""

from pyspark.sql import functions as F

from ..functions.hashing import gaussian, uniform
from ..operators import sampling
from ..session import work_path
from ..sources import merging
from ..sources.bindings import feat, met, table, tel
from . import query
from .join_checks import RANKINGS_SQL, rankings


def hex32(expr: str) -> str:
    """SQL for the first 32 bits of an md5."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


@query("t01_full_sort", "SELECT reading_id, zone, value FROM tel ORDER BY value, reading_id", views="tel")
def full_sort(spark, d):
    return sampling.full_sort(tel(spark, d).select("reading_id", "zone", "value"), ["value", "reading_id"])


@query(
    "t02_n_largest",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 5""",
)
def n_largest(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sampling.n_largest(rows, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 5)


@query(
    "t03_phrase_sort",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def phrase_sort(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    return sampling.phrase_sort(rows, "Show the highest quantity rows", tie, 20)


@query(
    "t04_head_tail",
    """(SELECT 'head' AS side, reading_id, ts FROM tel ORDER BY ts, reading_id LIMIT 10) UNION ALL
       (SELECT 'tail', reading_id, ts FROM tel ORDER BY ts DESC, reading_id DESC LIMIT 10)""",
    views="tel",
)
def head_tail(spark, d):
    rows = tel(spark, d).select("reading_id", "ts")
    head = sampling.head_n(rows, ["ts", "reading_id"], 10).withColumn("side", F.lit("head"))
    return head.unionByName(sampling.tail_n(rows, ["ts", "reading_id"], 10).withColumn("side", F.lit("tail")))


@query(
    "t06_top_k_per_query",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem
       QUALIFY rank <= 20""",
)
def top_k_per_query(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return sampling.top_per_group(rows, ["l_suppkey"], order, 20).drop("l_partkey")


@query(
    "t07_seeded_shuffle",
    "SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '42'), p_partkey) AS place FROM part",
)
def seeded_shuffle(spark, d):
    return sampling.shuffle_rows(table(spark, d, "part").select("p_partkey"), "p_partkey")


@query(
    "m01_quota_sample",
    """SELECT reading_id, outage FROM tel QUALIFY row_number() OVER (PARTITION BY outage
       ORDER BY md5(reading_id || '42'), reading_id) <= CASE outage WHEN 'frequency_excursion' THEN 27
       WHEN 'meter_dropout' THEN 20 WHEN 'no_event' THEN 18 WHEN 'full_outage' THEN 30
       WHEN 'renewable_variability' THEN 30 ELSE 25 END""",
    views="tel",
)
def quota_sample(spark, d):
    rows = tel(spark, d).select("reading_id", "outage")
    return sampling.quota_sample(rows, "outage", "reading_id", sampling.INCIDENT_QUOTAS)


@query("m02_sample_n", "SELECT reading_id, value FROM tel ORDER BY md5(reading_id || '42'), reading_id LIMIT 1000",
       views="tel")
def sample_n(spark, d):
    return sampling.sample_n(tel(spark, d).select("reading_id", "value"), "reading_id", 1000)


@query(
    "m03_stratified_split",
    """SELECT row_id, unstable, CASE WHEN row_number() OVER (PARTITION BY unstable ORDER BY md5(row_id || '42'), row_id)
       <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY unstable)) THEN 'train' ELSE 'test' END AS part FROM feat""",
    views="feat",
)
def stratified_split(spark, d):
    return sampling.stratified_split(feat(spark, d).select("row_id", "unstable"), "unstable", "row_id")


@query(
    "m04_weighted_draw",
    f"""SELECT row_id, CASE WHEN unstable THEN CASE WHEN u <= 0.15 THEN 'Zone_A' WHEN u <= 0.5 THEN 'Zone_B'
        WHEN u <= 0.85 THEN 'Zone_C' ELSE 'Zone_D' END ELSE CASE WHEN u <= 0.25 THEN 'Zone_A' WHEN u <= 0.5
        THEN 'Zone_B' WHEN u <= 0.75 THEN 'Zone_C' ELSE 'Zone_D' END END AS zone
        FROM (SELECT *, {hex32("row_id || 'zone'")} / 4294967296.0 AS u FROM feat)""",
    views="feat",
)
def weighted_draw(spark, d):
    zone = sampling.draw_zone(F.col("unstable"), uniform(F.col("row_id"), "zone"))
    return feat(spark, d).select("row_id", zone.alias("zone"))


@query(
    "m05_gaussian_noise",
    f"""SELECT reading_id, round(value + 0.0 + 0.05 * (sqrt(-2.0 * ln(({hex32("reading_id || '7a'")} + 1) / 4294967296.0))
        * cos(2 * pi() * ({hex32("reading_id || '7b'")} / 4294967296.0))), 4) AS noisy FROM tel""",
    views="tel",
)
def gaussian_noise(spark, d):
    noise = gaussian(F.col("reading_id"), "7", 0.0, 0.05)
    return tel(spark, d).select("reading_id", F.round(F.col("value") + noise, 4).alias("noisy"))


@query(
    "u01_union_all",
    """SELECT reading_id, zone, value, CAST(NULL AS BIGINT) AS meter_id, CAST(NULL AS DOUBLE) AS power FROM tel
       UNION ALL SELECT reading_id, NULL, NULL, meter_id, power FROM met""",
    views="tel met",
)
def union_all(spark, d):
    return sampling.union_all(
        tel(spark, d).select("reading_id", "zone", "value"), met(spark, d).select("reading_id", "meter_id", "power"))


@query(
    "u02_dedupe_first",
    """SELECT query_id, doc_id, src, rank FROM (SELECT 0 AS src, * FROM a UNION ALL SELECT 1, * FROM b)
       QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY src, rank) = 1""",
    ctes=RANKINGS_SQL,
)
def dedupe_first(spark, d):
    a, b = rankings(spark, d)
    both = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    return sampling.dedupe_first(both, ["query_id", "doc_id"], ["src", "rank"])


UPSERT_SQL = """SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS version FROM customer"""


@query("u03_upsert", UPSERT_SQL)
def upsert(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(0).alias("version"))
    changes = base.filter("c_acctbal < 0").withColumns({"c_acctbal": F.lit(0.0), "version": F.lit(1)})
    return sampling.upsert(base, changes, ["c_custkey"], "version")


@query("u03_stored_upsert", UPSERT_SQL)
def stored_upsert(spark, d):
    """The same changes taken in by a stored table in two batches, the second one twice, with a compaction in between."""
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(0).alias("version"))
    changes = base.filter("c_acctbal < 0").withColumns({"c_acctbal": F.lit(0.0), "version": F.lit(1)})
    stored = merging.create_table(base, work_path(spark, "customers"), ["c_custkey"], "version")
    stored.upsert(changes.filter("c_custkey % 2 = 0"), 1)
    stored.compact()
    for _ in range(2):
        stored.upsert(changes.filter("c_custkey % 2 <> 0"), 2)
    return stored.read()
