"""Ranks, fills and order statistics that never put a whole group in one task.

A plain `Window.partitionBy(zone)` sends every row of a zone to one task. Here
rows are range-partitioned on (group, order), so a hot group is cut into many
chunks; each chunk is worked on by itself and a table with at most one row per
chunk carries counts or values across chunk borders. The chunked rows are
written once, because range borders are sampled and the two readers of a chunk
number must agree on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _cols(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Rows sorted by (keys, order) with `_chunk` (range number) and `_pos` (place in it)."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k).asc_nulls_first() for k in keys] + _cols(order)
    spread = (
        df.repartitionByRange(n, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    return materialize(spread, "chunk")


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left-join a carry table; it holds at most one row per chunk, so it is broadcast."""
    on = [*keys, "_chunk"]
    right = carry.select(*[F.col(c).alias(f"_r_{c}") for c in on], *values)
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(F.broadcast(right), cond, "left").drop(*[f"_r_{c}" for c in on])


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table, without a single-task window."""
    rows = chunk(df, [], order)
    sizes = rows.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_chunk", F.sum("_n").over(before).alias("_off"))
    out = _attach(rows, carry, [], ["_off"])
    return out.withColumn(name, F.coalesce("_off", F.lit(0)) + F.col("_pos") + 1).drop("_off", "_pos", "_chunk")


def group_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based rank inside each group; a group may be far larger than one task.

    `total` adds the group's row count.
    """
    rows = chunk(df, keys, order)
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("_pos")))
    counts = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.withColumn("_off", F.sum("_n").over(before)).filter("_off > 0")
    out = _attach(local, carry, keys, ["_off"])
    out = out.withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint"))
    out = out.drop("_off", "_local", "_pos", "_chunk")
    if total:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias(total))
        right = sizes.select(*[F.col(k).alias(f"_r_{k}") for k in keys], total)
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        out = out.join(right, cond).drop(*[f"_r_{k}" for k in keys])
    return out


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    cols: Sequence[str],
    forward: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Replace nulls by the last known value, then (optionally) by the next one."""
    rows = chunk(df, keys, order)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards as a running frame over the reversed order: a frame that ends at
    # "unbounded following" is evaluated anew for every row.
    back = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_pos"))
    from_here = back.rowsBetween(Window.unboundedPreceding, 0)
    aggs = []
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.col("_pos"))
        aggs += [F.max_by(c, known).alias(f"_last_{c}"), F.min_by(c, known).alias(f"_first_{c}")]
    ends = rows.groupBy(*keys, "_chunk").agg(*aggs)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    past = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
    future = later.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for c in cols:
        if forward:
            ends = ends.withColumn(f"_prev_{c}", F.last(f"_last_{c}", ignorenulls=True).over(past))
            carried.append(f"_prev_{c}")
        if backward:
            ends = ends.withColumn(f"_next_{c}", F.last(f"_first_{c}", ignorenulls=True).over(future))
            carried.append(f"_next_{c}")
    # Only chunks that continue a group from (or into) another chunk keep a row.
    ends = ends.filter(reduce(or_, [F.col(c).isNotNull() for c in carried]))
    out = rows
    local: dict[str, Column] = {}
    for c in cols:
        if forward:
            local[f"_f_{c}"] = F.last(c, ignorenulls=True).over(to_here)
        if backward:
            local[f"_b_{c}"] = F.last(c, ignorenulls=True).over(from_here)
    out = _attach(out.withColumns(local), ends, keys, carried)
    for c in cols:
        picks = []
        if forward:
            picks += [F.col(f"_f_{c}"), F.col(f"_prev_{c}")]
        if backward:
            picks += [F.col(f"_b_{c}"), F.col(f"_next_{c}")]
        out = out.withColumn(c, F.coalesce(*picks))
    return out.select(*df.columns)


def order_statistics(df: DataFrame, col: str, picks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Values at given 0-based sorted places, exact, one row per group.

    `picks` maps an output name to a place written in terms of `_total`, the
    group's count of non-null values. Equal values are combined before the
    shuffle, so a value that makes up a third of the rows costs one row.
    """
    by = list(by)
    hist = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    rows = chunk(hist, by, [col])
    inside = Window.partitionBy(*by, "_chunk").orderBy("_pos")
    sums = rows.groupBy(*by, "_chunk").agg(F.sum("_n").alias("_c"))
    # `sums` has one row per chunk plus one per further group, never one per reading.
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    sums = sums.withColumn(
        "_off", F.coalesce(F.sum("_c").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_c").over(Window.partitionBy(*by)))
    right = sums.select(*[F.col(c).alias(f"_r_{c}") for c in [*by, "_chunk"]], "_off", "_total")
    cond = F.lit(True)
    for c in [*by, "_chunk"]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    cum = (
        rows.withColumn("_cum", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(right if by else F.broadcast(right), cond)
        .withColumn("_hi", F.col("_off") + F.col("_cum"))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    aggs = [
        F.max(F.when((F.col("_lo") <= place) & (place < F.col("_hi")), F.col(col))).alias(name)
        for name, place in picks.items()
    ]
    return cum.groupBy(*by).agg(*aggs, F.max("_total").alias("_total"))


def exact_quantiles(df: DataFrame, col: str, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of `qs`."""
    total = F.col("_total")
    picks: dict[str, Column] = {}
    for name, q in qs.items():
        at = F.lit(q) * (total - 1)
        picks[f"_a_{name}"] = F.floor(at)
        picks[f"_b_{name}"] = F.ceil(at)
    stats = order_statistics(df, col, picks, by)
    out = []
    for name, q in qs.items():
        at = F.lit(q) * (total - 1)
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        out.append((a + (b - a) * (at - F.floor(at))).alias(name))
    return stats.select(*by, *out)


def quantile_by_buckets(df: DataFrame, col: str, q: float, bucket: Column) -> float | None:
    """Linearly interpolated quantile over all rows, of which only those of one or two buckets are moved.

    `bucket` rises with `col` and has a bounded number of values. Rows are counted
    by it, and the counts tell in which buckets the wanted places are.
    """
    rows = materialize(df.filter(F.col(col).isNotNull()).select(col), "quantile")
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_k"))
    counts = counts.withColumns({"_upto": F.sum("_k").over(Window.orderBy("_bucket")), "_n": F.sum("_k").over(Window.partitionBy())})
    at = F.lit(q) * (F.col("_n") - 1)
    here = counts.filter((F.col("_upto") > F.floor(at)) & (F.col("_upto") - F.col("_k") <= F.ceil(at)))
    found = here.select("_bucket", (F.floor(at) - F.col("_upto") + F.col("_k")).alias("_a"), (F.ceil(at) - F.floor(at)).alias("_step"),
                        (at - F.floor(at)).alias("_part")).orderBy("_bucket").collect()  # two rows at most
    if not found:
        return None
    first = found[0]
    few = rows.filter(bucket.between(first["_bucket"], found[-1]["_bucket"]))
    ends = order_statistics(few, col, {"_a": F.lit(first["_a"]), "_b": F.lit(first["_a"] + first["_step"])}).first()
    return ends["_a"] + (ends["_b"] - ends["_a"]) * first["_part"]


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    name: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """First `n` rows of each group under a total order.

    Two cuts. Before the first shuffle every task already drops all but its own
    best `n` rows of a group; those meet by (group, salt), the salt being the
    task's number, so the survivors of a hot group are spread over `salts`
    tasks and only `n * salts` of its rows reach the final cut. Any assignment
    of salts gives the same result.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= n)
