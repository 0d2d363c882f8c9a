"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", null_token: str = "?"
) -> DataFrame:
    """Delimited text with a null token."""
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", null_token).csv(path)
    )


def scan_splits(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of any size: Spark cuts the files into splits (`spark.sql.files.maxPartitionBytes`)
    and streams them through the tasks, so no chunk loop is needed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist; the scan reads no others."""
    return df.select(*[c for c in wanted if c in df.columns])


def scan_head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first `n` rows under an explicit order."""
    return df.orderBy(*order).limit(n)


def write_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write unless the target exists; `force` replaces it."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def snapshot_raw(df: DataFrame, path: str) -> DataFrame:
    """Keep an untouched copy of the input; a copy that exists stays as it is."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def audit_sink(df: DataFrame, path: str, ts: Column, request_id: Column, stage: Column, event: Column,
               details: Column) -> None:
    """One JSON line per stage event."""
    record = F.struct(
        ts.alias("ts"), request_id.alias("request_id"), stage.alias("stage"), event.alias("event"),
        details.alias("details"),
    )
    df.select(F.to_json(record).alias("value")).write.mode("append").text(path)


def audit_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", AUDIT_SCHEMA).alias("r")).select("r.*")


def report_sink(df: DataFrame, case_col: str, entry_cols: Sequence[str], path: str) -> None:
    """Nested JSON report: one object per case with its list of metric entries.

    A case holds one entry per metric, so the list is as short as the metric set.
    """
    entries = F.sort_array(F.collect_list(F.struct(*entry_cols))).alias("metrics")
    df.groupBy(case_col).agg(entries).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def build_collection(
    df: DataFrame, path: str, id_col: str, text_col: str, meta_cols: Sequence[str], partition_col: str,
    force: bool = False, vec_col: str | None = None,
) -> DataFrame:
    """Document collection `(id, text, vec, meta, <partition>)`, laid out by a filter dimension.

    With `vec_col` the vectors are stored beside the texts, so a search reads them
    instead of embedding the corpus again. Building twice is harmless: without
    `force` an existing collection is kept.
    """
    out = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        *([F.col(vec_col).alias("vec")] if vec_col else []),
        F.struct(*meta_cols).alias("meta"),
        F.col(partition_col).alias(f"by_{partition_col}"),
    )
    out.write.mode("overwrite" if force else "ignore").partitionBy(f"by_{partition_col}").parquet(path)
    return df.sparkSession.read.parquet(path)
