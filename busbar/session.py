"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python task is given at a time, at least one row.
BATCH_BYTES = "4m"

_local_dir: str | None = None


def build_session(app: str = "busbar", cores: int | None = None) -> SparkSession:
    """A local session with the settings the library expects.

    On a cluster the session comes from spark-submit and only the time zone is
    set here (see `prepare`).
    """
    n = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results and plans rely on.

    Telemetry timestamps carry no zone, so they are read as UTC everywhere. A rank
    that is cut at n is cut inside every task before the shuffle also for large n.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that every executor can reach.

    The cluster names that folder in `spark.checkpoint.dir`. Only a local
    master may fall back to a folder of this machine.
    """
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_dir is None:
            _local_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        base = _local_dir
    app = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/busbar/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a later step must see the very same rows and partition numbers
    even if executors are lost and tasks re-run; it also cuts the lineage.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application left in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_dir
    if not base:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{base.rstrip('/')}/busbar/{spark.sparkContext.applicationId}"
    )
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
