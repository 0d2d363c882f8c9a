"""Gap filling, time spreading, last-n rows and sequence ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import fill_gaps, global_rank, top_per_group

SPREAD_START = "2020-01-01 00:00:00"
SPREAD_END = "2023-12-31 23:00:00"


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return fill_gaps(df, keys, order, cols, forward=True, backward=False)


def back_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return fill_gaps(df, keys, order, cols, forward=False, backward=True)


def block_fill(df: DataFrame, order: Sequence[str], cols: Sequence[str], block: int = 200_000) -> DataFrame:
    """Forward then backward fill that never crosses a block of `block` consecutive rows.

    A block is one window group, so no task holds more than `block` rows of it.
    """
    ranked = global_rank(df, order, "_row").withColumn("_block", F.floor((F.col("_row") - 1) / block))
    # Two running frames, one per direction; both are linear in the block's rows.
    past = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy("_block").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.last(c, ignorenulls=True).over(future)) for c in cols
    }
    return ranked.withColumns(filled).select(*df.columns)


def spread_timestamps(
    df: DataFrame, order: Sequence[str | Column], out: str = "timestamp", start: str = SPREAD_START,
    end: str = SPREAD_END,
) -> DataFrame:
    """Spread the rows evenly over [start, end] in sort order, both ends included."""
    ranked = global_rank(df, order, "_row")
    total = ranked.agg(F.max("_row").alias("n")).scalar()
    first, last = (F.unix_micros(F.to_timestamp(F.lit(t))) for t in (start, end))
    step = (F.col("_row") - 1) / F.greatest(total - 1, F.lit(1))
    micros = first + F.floor((last - first) * step)
    return ranked.withColumn(out, F.timestamp_micros(micros).cast("timestamp_ntz")).drop("_row")


def last_n(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int = 500) -> DataFrame:
    """The newest `n` rows per key; `age_rank` 1 is the newest."""
    return top_per_group(df, keys, [F.desc(ts), F.desc(tie)], n, name="age_rank")


def last_hours(df: DataFrame, keys: Sequence[str], ts: str, hours: int = 24) -> DataFrame:
    """Rows within `hours` of the newest row of their key (an aggregate and a join, no window)."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_max"))
    joined = df.join(newest, list(keys))
    return joined.filter(F.col(ts) > F.col("_max") - F.expr(f"INTERVAL {hours} HOURS")).drop("_max")


def sequence_ids(df: DataFrame, order: Sequence[str | Column], fmt: str = "INC-%04d", out: str = "incident_id"):
    """Formatted running ids in sort order."""
    ranked = global_rank(df, order, "_row")
    return ranked.withColumn(out, F.format_string(fmt, "_row")).drop("_row")
