"""Grid-data views over the driver's tables, on the Spark and on the SQL side.

Every view exists twice with the same definition: a function returning a lazy
DataFrame, and a common table expression in `VIEWS_SQL` for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

# The eight outage classes of an incident.
OUTAGES = [
    "frequency_excursion",
    "partial_outage",
    "high_demand_event",
    "voltage_deviation",
    "meter_dropout",
    "no_event",
    "full_outage",
    "renewable_variability",
]

SPLIT_BYTES = 128 << 20

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that is heavy per row.

    One small file is one split, and one task would do all of it, so such a file
    is dealt out to all cores. A table of many or large files is left as it is.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isFile() and status.getLen() < cores * SPLIT_BYTES:
        return rows.repartition(cores)
    return rows


def tel(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry readings per zone."""
    outages = ",".join(f"'{o}'" for o in OUTAGES)
    return table(spark, d, "events").selectExpr(
        "event_id AS reading_id",
        "ts",
        "concat('Zone_', char(65 + user_id % 4)) AS zone",
        "event_type AS equipment",
        "value",
        "value / 500 AS prob",
        "50 + (value - 50) / 100 AS freq",
        f"element_at(array({outages}), CAST(user_id % 8 AS INT) + 1) AS outage",
    )


def met(spark: SparkSession, d: str) -> DataFrame:
    """Smart-meter readings with gaps."""
    return table(spark, d, "events").selectExpr(
        "event_id AS reading_id",
        "user_id AS meter_id",
        "ts",
        "CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS power",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )


def feat(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows for the models."""
    return spread_table(spark, d, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) AS row_id",
        *FEATURES,
        "l_returnflag = 'R' AS unstable",
        "l_linestatus AS grp",
        "l_shipdate AS ts",
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Incident reports with their dimensions."""
    docs = spread_table(spark, d, "documents")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").selectExpr(
        "doc_id",
        "text",
        "lang AS region",
        "source AS equipment",
        "CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'high' "
        "WHEN quality = 1 THEN 'low' ELSE 'medium' END AS severity",
    )


def qset(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval queries."""
    return table(spark, d, "benchmark").selectExpr("item_id AS query_id", "text")


def chat(spark: SparkSession, d: str) -> DataFrame:
    """All turns: users ask, assistants answer."""
    return spread_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn joined to the turn it follows in its conversation."""
    turns = chat(spark, d)
    asked = turns.filter("role = 'user'").selectExpr("conv_id", "turn + 1 AS turn", "text AS question")
    said = turns.filter("role = 'assistant'").selectExpr("conv_id", "turn", "text AS answer")
    return said.join(asked, ["conv_id", "turn"])


def vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def fb(spark: SparkSession, d: str) -> DataFrame:
    """Feedback rows; the rating is kept as text, as it arrives."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS feedback_id",
        "o_custkey AS session_id",
        "o_orderdate AS ts",
        "substring(o_orderpriority, 1, 1) AS rating",
        "o_orderstatus = 'F' AS helpful",
        "concat_ws(' ', 'order', o_orderkey, o_orderpriority) AS comment",
    )


def evalm(spark: SparkSession, d: str) -> DataFrame:
    """Three scored metrics per document; unlabelled documents have null scores."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    wide = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return wide.selectExpr(
        "doc_id",
        "stack(3, 'quality', CAST(quality AS DOUBLE), quality = 1, "
        "'toxic', CAST(1 - toxic AS DOUBLE), toxic = 0, "
        "'length', CAST(n_chars AS DOUBLE), n_chars >= 200) AS (metric, score, passed)",
    )


_OUTAGE_LIST = ",".join(f"'{o}'" for o in OUTAGES)

VIEWS_SQL = {
    "tel": f"""tel AS (SELECT event_id AS reading_id, ts, concat('Zone_', chr(CAST(65 + user_id % 4 AS INT))) AS zone,
        event_type AS equipment, value, value / 500 AS prob, 50 + (value - 50) / 100 AS freq,
        ([{_OUTAGE_LIST}])[CAST(user_id % 8 AS INT) + 1] AS outage FROM events)""",
    "met": """met AS (SELECT event_id AS reading_id, user_id AS meter_id, ts,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS power,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "feat": """feat AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
        strftime(l_shipdate, '%Y%m%d')) AS row_id, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag = 'R' AS unstable, l_linestatus AS grp, l_shipdate AS ts FROM lineitem)""",
    "corpus": """corpus AS (SELECT doc_id, text, lang AS region, source AS equipment,
        CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'high'
             WHEN quality = 1 THEN 'low' ELSE 'medium' END AS severity
        FROM documents LEFT JOIN labels USING (doc_id))""",
    "qset": "qset AS (SELECT item_id AS query_id, text FROM benchmark)",
    "chat": "chat AS (SELECT conv_id, turn, role, text FROM conversations)",
    "pairs": """pairs AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question
        FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
        WHERE a.role = 'assistant' AND q.role = 'user')""",
    "fb": """fb AS (SELECT o_orderkey AS feedback_id, o_custkey AS session_id, o_orderdate AS ts,
        substr(o_orderpriority, 1, 1) AS rating, o_orderstatus = 'F' AS helpful,
        concat_ws(' ', 'order', o_orderkey, o_orderpriority) AS comment FROM orders)""",
    "evalm": """evalm AS (
        SELECT doc_id, 'quality' AS metric, CAST(quality AS DOUBLE) AS score, quality = 1 AS passed
            FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT doc_id, 'toxic', CAST(1 - toxic AS DOUBLE), toxic = 0
            FROM documents LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT doc_id, 'length', CAST(n_chars AS DOUBLE), n_chars >= 200 FROM documents)""",
}
