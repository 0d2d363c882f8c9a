"""Sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key
from ..session import work_path
from ..sources import files, merging
from ..sources.bindings import corpus, evalm, fb, met, table, tel
from . import query

_CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
_METER = T.StructType(
    [
        T.StructField("reading_id", T.LongType()),
        T.StructField("meter_id", T.LongType()),
        T.StructField("power", T.DoubleType()),
        T.StructField("k", T.IntegerType()),
    ]
)


@query("s01_scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    path = work_path(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.scan_csv(spark, path, _CUSTOMER)


@query("s02_scan_delimited", "SELECT reading_id, meter_id, power, k FROM met", views="met")
def scan_delimited(spark, d):
    path = work_path(spark, "delimited")
    rows = met(spark, d).select("reading_id", "meter_id", "power", "k")
    rows.write.option("header", True).option("sep", ";").option("nullValue", "?").csv(path)
    return files.scan_delimited(spark, path, _METER)


@query(
    "s03_out_of_core_scan",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1",
)
def out_of_core_scan(spark, d):
    rows = files.scan_splits(spark, f"{d}/lineitem.parquet")
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity")
    )


@query("s04_scan_available", "SELECT reading_id, zone, value FROM tel", views="tel")
def scan_available(spark, d):
    return files.scan_available(tel(spark, d), ["reading_id", "zone", "stab_score", "value", "phase"])


@query("s05_scan_head", "SELECT reading_id, ts, value FROM tel ORDER BY ts, reading_id LIMIT 500", views="tel")
def scan_head(spark, d):
    return files.scan_head(tel(spark, d).select("reading_id", "ts", "value"), ["ts", "reading_id"], 500)


@query("s06_write_once", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_once(spark, d):
    path = work_path(spark, "once")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    files.write_once(rows, path)
    return files.write_once(rows.withColumn("s_acctbal", F.lit(0.0)), path)  # skipped: the target exists


@query("s07_append_rows", "SELECT feedback_id, rating, helpful, comment FROM fb", views="fb")
def append_rows(spark, d):
    path = work_path(spark, "append")
    rows = fb(spark, d).select("feedback_id", "rating", "helpful", "comment")
    files.append_rows(rows.filter("helpful"), path)
    files.append_rows(rows.filter("NOT helpful"), path)
    return spark.read.parquet(path)


@query("s08_snapshot_raw", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def snapshot_raw(spark, d):
    path = work_path(spark, "raw")
    rows = table(spark, d, "supplier")
    files.snapshot_raw(rows, path)
    return files.snapshot_raw(rows.limit(0), path)


@query(
    "s09_audit_sink",
    """SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS event, 'ingest' AS stage,
       json_extract_string(props, '$.k') AS k FROM events""",
)
def audit_sink(spark, d):
    path = work_path(spark, "audit")
    rows = table(spark, d, "events")
    details = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    files.audit_sink(
        rows, path, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id").cast("string"),
        F.lit("ingest"), F.col("event_type"), details,
    )
    back = files.audit_scan(spark, path)
    return back.select("request_id", "event", "stage", F.col("details")["k"].alias("k"))


@query("s10_report_sink", "SELECT doc_id, metric, score, passed FROM evalm", views="evalm")
def report_sink(spark, d):
    path = work_path(spark, "report")
    files.report_sink(evalm(spark, d), "doc_id", ["metric", "score", "passed"], path)
    schema = "doc_id bigint, metrics array<struct<metric:string, score:double, passed:boolean>>"
    return spark.read.schema(schema).json(path).select("doc_id", F.inline("metrics"))


@query(
    "s12_build_collection",
    """SELECT doc_id AS id, md5(text) AS text_md5, region, equipment, severity FROM corpus""",
    views="corpus",
)
def build_collection(spark, d):
    path = work_path(spark, "collection")
    docs = corpus(spark, d)
    for _ in range(2):  # the second call finds the collection and keeps it
        out = files.build_collection(docs, path, "doc_id", "text", ["region", "equipment", "severity"], "severity")
    return out.select("id", hash_key(F.col("text")).alias("text_md5"), "meta.*")


@query(
    "s12_add_documents",
    """SELECT doc_id AS id, md5(text) AS text_md5, region, equipment, severity FROM corpus""",
    views="corpus",
)
def add_documents(spark, d):
    """A stored collection of every third document takes in all of them; those it has are replaced by themselves."""
    docs = corpus(spark, d).select("doc_id", "text", "region", "equipment", "severity", F.lit(0).alias("version"))
    stored = merging.create_table(docs.filter(F.col("doc_id") % 3 == 0), work_path(spark, "documents"), ["doc_id"], "version")
    stored.upsert(docs, 1)
    stored.compact()
    return stored.read().select(F.col("doc_id").alias("id"), hash_key(F.col("text")).alias("text_md5"), "region", "equipment", "severity")
