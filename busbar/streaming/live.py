"""Structured Streaming over live readings.

Every query has its own checkpoint in the shared folder and a sink that can
repeat a batch without doubling rows: the file sink commits by batch, and the
`foreachBatch` sinks write to a folder named after the batch number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import live_summary
from ..operators.clean import hide_truth
from ..operators.rules import OUTAGE_BY_PROB, STATUS_BY_PROB, by_threshold
from ..operators.stability import predict_batch

BUFFER_ROWS = 500
# What a reading gets where the sender left a field out.
DEFAULTS = {"freq": 50.0, "zone": "Zone_A", "equipment": "transformer", "source_id": "SCADA-RTU-001"}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


_MINUTES = "window_id long, n long, unstable long, total double, known long, newest timestamp"


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, per_trigger: int = 64) -> DataFrame:
    """File stream with a given schema; `pattern` picks the files of one table."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def ingest(stream: DataFrame, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """Fill the optional fields; a field the schema lacks is added."""
    return stream.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in stream.columns else F.lit(v) for c, v in defaults.items()}
    )


def keep_running(writer, path_checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Start a query that stays up and works through new files at an interval; the caller stops it."""
    return writer.option("checkpointLocation", path_checkpoint).trigger(processingTime=every).start()


def run_available(writer, path_checkpoint: str) -> None:
    """Process everything that is there, then stop. Raises if the query failed."""
    query: StreamingQuery = (
        writer.option("checkpointLocation", path_checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str) -> DataFrame:
    """Append-only table written by the file sink (readings, feedback, audit events)."""
    run_available(stream.writeStream.format("parquet").option("path", path).outputMode("append"), f"{path}-checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def score_stream(stream: DataFrame, classifier: PipelineModel, regressor: PipelineModel | None,
                 features: Sequence[str], truth: Sequence[str]) -> DataFrame:
    """Score each reading in flight, derive status and outage, and blank the labels."""
    scored = predict_batch(stream, classifier, regressor, features)
    p = F.col("pred_prob_unstable")
    scored = scored.withColumns(
        {"transformer_status": by_threshold(p, STATUS_BY_PROB), "outage_event": by_threshold(p, OUTAGE_BY_PROB),
         "pred_prob_unstable": F.round(p, 4), "pred_stab_score": F.round("pred_stab_score", 6)}
    )
    return hide_truth(scored, list(truth))


def _batches(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            done.append(int(name[1:]))
    return sorted(done)


def _drop_versions(spark: SparkSession, path: str, versions: Sequence[int]) -> None:
    jvm = spark.sparkContext._jvm
    for v in versions:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def bounded_buffer(stream: DataFrame, path: str, order: Sequence[Column], rows: int = BUFFER_ROWS) -> None:
    """Keep the newest `rows` readings: each batch writes a new version from the one before it.

    A repeated batch rebuilds its version from the same predecessor, so nothing doubles.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        older = [b for b in _batches(spark, path) if b < number]
        newest = batch.orderBy(*order).limit(rows)
        if older:
            kept = batch.sparkSession.read.schema(schema).parquet(f"{path}/v{older[-1]}")
            newest = kept.unionByName(newest).orderBy(*order).limit(rows)
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")
        # This version, the one it was made from and the one before that stay for readers and for a repeated batch.
        _drop_versions(spark, path, older[:-2])

    run_available(stream.writeStream.foreachBatch(merge), f"{path}-checkpoint")


def read_buffer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version; no rows before the first batch."""
    versions = _batches(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{versions[-1]}")


def delta_log(result: DataFrame, path: str) -> None:
    """Update-mode sink: every batch adds the rows it changed under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/v{number}")

    run_available(result.writeStream.outputMode("update").foreachBatch(write), f"{path}-checkpoint")


def read_delta_log(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Current rows of a delta log: the newest change per key, combined before the shuffle."""
    full = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
    versions = _batches(spark, path)
    rows = spark.read.schema(full).parquet(*[f"{path}/v{b}" for b in versions]) if versions else spark.createDataFrame([], full)
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = F.max_by(F.struct(*rest), F.col("_batch")).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def minute_windows(stream: DataFrame, ts: str, prob: str, freq: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute indicators. The watermark bounds the state; readings behind it are lost here, `minute_log` keeps them."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return (
        timed.groupBy(F.window("_t", "1 minute"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(prob) >= 0.5).alias("unstable"),
            F.round(F.avg(freq), 6).alias("mean_freq"),
        )
        .select(F.floor(F.unix_seconds("window.start") / 60).alias("window_id"), "n", "unstable", "mean_freq")
    )


def minute_log(stream: DataFrame, path: str, ts: str, prob: str, freq: str, late: str = "10 minutes") -> None:
    """One-minute indicators that lose no reading: what is behind the watermark goes to a side table.

    The watermark of a batch is the newest time of the batches before it, less `late`,
    as in Spark. A reading whose minute has ended by then, or that has no time,
    is written to `late`; all others are added to the windows.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = [b for b in _batches(spark, f"{path}/marks") if b < number]
        seen = spark.read.schema("seen timestamp").parquet(f"{path}/marks/v{older[-1]}").first()["seen"] if older else None
        seen = F.lit(seen).cast("timestamp")
        timed = batch.withColumn("_t", F.col(ts).cast("timestamp"))
        minute = F.floor(F.unix_seconds("_t") / 60)
        ended = F.timestamp_seconds((minute + 1) * 60) <= seen - F.expr(f"INTERVAL '{late}'")
        behind = F.col("_t").isNull() | F.coalesce(ended, F.lit(False))
        timed.filter(behind).drop("_t").write.mode("overwrite").parquet(f"{path}/late/v{number}")
        timed.filter(~behind).groupBy(minute.alias("window_id")).agg(
            F.count("*").alias("n"), F.count_if(F.col(prob) >= 0.5).alias("unstable"), F.sum(freq).alias("total"),
            F.count(freq).alias("known"), F.max("_t").alias("newest"),
        ).write.mode("overwrite").parquet(f"{path}/windows/v{number}")
        newest = spark.read.schema(_MINUTES).parquet(f"{path}/windows/v{number}").agg(F.max("newest").alias("newest"))
        newest.select(F.greatest("newest", seen).alias("seen")).write.mode("overwrite").parquet(f"{path}/marks/v{number}")

    run_available(stream.writeStream.foreachBatch(split), f"{path}-checkpoint")


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """The windows of a minute log; no rows before the first batch."""
    versions = [f"{path}/windows/v{b}" for b in _batches(spark, f"{path}/windows")]
    rows = spark.read.schema(_MINUTES).parquet(*versions) if versions else spark.createDataFrame([], _MINUTES)
    mean = F.round(F.sum("total") / F.nullif(F.sum("known"), F.lit(0)), 6)
    return rows.groupBy("window_id").agg(F.sum("n").alias("n"), F.sum("unstable").alias("unstable"), mean.alias("mean_freq"))


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The readings of a minute log that came too late for their window, or without a time."""
    versions = [f"{path}/late/v{b}" for b in _batches(spark, f"{path}/late")]
    return spark.read.schema(schema).parquet(*versions) if versions else spark.createDataFrame([], schema)


def last_known(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Newest reading per key; the state is one row per key."""
    newest = F.max_by(F.struct(ts, tie, *cols), F.struct(ts, tie)).alias("_r")
    return stream.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def buffer_summary(buffer: DataFrame, prob: str, freq: str, dims: Sequence[str]) -> DataFrame:
    """Summary of what the buffer holds now."""
    return live_summary(buffer, prob, freq, dims)


