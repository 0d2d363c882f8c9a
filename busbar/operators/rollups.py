"""Roll-ups that can be merged: statistics of any span and zone without the readings.

For every key and time slice one row is kept: how many readings there were,
their mean and squared deviations, extremes and last reading, a KLL sketch of
their values and an HLL sketch of what is counted distinct. Rows of one slice
from several batches, and rows of several slices, merge into the same statistics
as if they had been taken of all readings at once; quantiles and distinct counts
come with the sketches' errors, all else exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Size of a KLL sketch: with it the rank of a quantile is off by some 1.7 % at most, nearly always. Log of the HLL's registers: 1.6 %.
KLL_SIZE, RANK_ERROR = 200, 0.02
HLL_LOG, COUNT_ERROR = 12, 0.05


def roll_up(rows: DataFrame, keys: Sequence[str], ts: str, every: str, values: Sequence[str], distinct: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """A row for each of `keys` and time slice `every` (such as "1 hour").

    Null values are in no statistic but `n_rows`. Readings without a time are in
    a slice of their own, which has a null start. With `tie` the last reading's
    values are kept, of equal times the one with the largest `tie`.
    """
    aggs: list[Column] = [F.count("*").alias("n_rows")]
    for v in values:
        x = F.col(v).cast("double")
        aggs += [
            F.count(x).alias(f"{v}_n"), F.avg(x).alias(f"{v}_mean"), (F.var_pop(x) * F.count(x)).alias(f"{v}_m2"),
            F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"), F.kll_sketch_agg_double(x, KLL_SIZE).alias(f"{v}_kll"),
        ]
        if tie:
            newest = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
            aggs.append(F.max(F.when(x.isNotNull(), F.struct(newest.alias("at"), x.alias("x")))).alias(f"{v}_last"))
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), HLL_LOG).alias(f"{c}_hll") for c in distinct]
    slices = F.window(ts, every)["start"]
    timed = rows.filter(F.col(ts).isNotNull()).groupBy(*keys, slices.alias("slice")).agg(*aggs)
    untimed = rows.filter(F.col(ts).isNull()).groupBy(*keys).agg(*aggs).withColumn("slice", F.lit(None).cast("timestamp"))
    return timed.unionByName(untimed)


def merge(rolled: DataFrame, by: Sequence[str], values: Sequence[str], distinct: Sequence[str] = (), last: bool = False) -> DataFrame:
    """The same kind of rows over larger groups. Any order, and any split of the readings into rows, gives the same."""
    aggs: list[Column] = [F.sum("n_rows").alias("n_rows")]
    for v in values:
        n, mean, m2 = (F.col(f"{v}_{c}") for c in ("n", "mean", "m2"))
        total = F.sum(n * mean)
        aggs += [
            F.sum(n).alias(f"{v}_n"), (total / F.nullif(F.sum(n), F.lit(0))).alias(f"{v}_mean"),
            (F.sum(m2) + F.sum(n * mean * mean) - total * total / F.nullif(F.sum(n), F.lit(0))).alias(f"{v}_m2"),
            F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max"), F.kll_merge_agg_double(f"{v}_kll").alias(f"{v}_kll"),
        ]
        if last:
            aggs.append(F.max(f"{v}_last").alias(f"{v}_last"))
    aggs += [F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in distinct]
    return rolled.groupBy(*by).agg(*aggs)


def statistics(rolled: DataFrame, by: Sequence[str], values: Sequence[str], quantiles: Mapping[str, float] | None = None, distinct: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes, estimated quantiles and distinct counts by any columns of a roll-up; without any, of all."""
    merged = merge(rolled, by, values, distinct)
    out = [*by, "n_rows"]
    for v in values:
        n = F.col(f"{v}_n")
        out += [
            n, F.col(f"{v}_mean"), F.when(n > 1, F.sqrt(F.greatest(F.col(f"{v}_m2"), F.lit(0.0)) / (n - 1))).alias(f"{v}_std"),
            F.col(f"{v}_min"), F.col(f"{v}_max"),
        ]
        out += [F.when(n > 0, F.kll_sketch_get_quantile_double(f"{v}_kll", F.lit(q))).alias(f"{v}_{name}") for name, q in (quantiles or {}).items()]
    out += [F.hll_sketch_estimate(f"{c}_hll").alias(f"{c}_distinct") for c in distinct]
    return merged.select(*out)


def keep_batch(rolled: DataFrame, path: str, batch: int) -> None:
    """Store the roll-up of one batch of readings; the same batch again replaces itself."""
    rolled.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All that is kept: rows of several batches may be for one slice."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def compact(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str], distinct: Sequence[str] = (), last: bool = False, below: int | None = None) -> None:
    """Merge the batches up to `below` (all) into the latest of them, a row for each slice."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch="))
    numbers = [n for n in numbers if below is None or n <= below]
    if len(numbers) < 2:
        return
    rows = spark.read.parquet(*(f"{path}/batch={n}" for n in numbers))
    whole = materialize(merge(rows, [*keys, "slice"], values, distinct, last), "rolled")
    # the merged rows stand under a name that readers pass over until the single batches are gone
    whole.write.mode("overwrite").parquet(f"{path}/_merged")
    for n in numbers:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}"), True)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_merged"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={numbers[-1]}"))


def maintain(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str, every: str, values: Sequence[str], distinct: Sequence[str] = (), tie: str | None = None):
    """Keep the roll-up of a stream of readings: every micro-batch adds its slices, however late they are."""

    def take(batch: DataFrame, number: int) -> None:
        keep_batch(roll_up(batch, keys, ts, every, values, distinct, tie), path, number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
