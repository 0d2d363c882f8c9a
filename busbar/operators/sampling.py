"""Sorts, samples, splits, draws and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, weighted_choice
from ..session import materialize
from .spread import global_rank, group_rank, top_per_group

# Incidents wanted per event class, and the zone weights of unstable rows.
INCIDENT_QUOTAS = {
    "frequency_excursion": 27,
    "partial_outage": 25,
    "high_demand_event": 25,
    "voltage_deviation": 25,
    "meter_dropout": 20,
    "no_event": 18,
    "full_outage": 30,
    "renewable_variability": 30,
}
STABLE_ZONES = {"Zone_A": 0.25, "Zone_B": 0.25, "Zone_C": 0.25, "Zone_D": 0.25}
UNSTABLE_ZONES = {"Zone_A": 0.15, "Zone_B": 0.35, "Zone_C": 0.35, "Zone_D": 0.15}

SORT_PHRASES = [
    ("highest price", "l_extendedprice", False),
    ("lowest price", "l_extendedprice", True),
    ("highest quantity", "l_quantity", False),
    ("highest tax", "l_tax", False),
]


def full_sort(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order)


def n_largest(df: DataFrame, col: str, tie: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(col), *tie).limit(n)


def phrase_sort(df: DataFrame, phrase: str, tie: Sequence[str], n: int, recent: str | None = None) -> DataFrame:
    """Head of the table under the order that the request's wording asks for."""
    words = phrase.lower()
    for key, col, ascending in SORT_PHRASES:
        if key in words and col in df.columns:
            return df.orderBy(F.asc(col) if ascending else F.desc(col), *tie).limit(n)
    if recent and ("last" in words or "recent" in words):
        return df.orderBy(F.desc(recent), *tie).limit(n)
    return df.orderBy(*tie).limit(n)


def head_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.asc(c) for c in order]).limit(n)


def tail_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def shuffle_rows(df: DataFrame, key: str, seed: str = "42", out: str = "place") -> DataFrame:
    """Seeded random order as a 1-based place; the same on every run and cluster size."""
    return global_rank(df, [hash_key(F.col(key), seed), F.col(key)], out)


def quota_sample(df: DataFrame, stratum: str, key: str, quotas: Mapping[str, int], seed: str = "42") -> DataFrame:
    """At most `quotas[v]` rows of each stratum, drawn by hash without replacement.

    A salted first cut at the largest quota keeps every stratum small before the
    per-stratum quota applies.
    """
    wanted = F.explode(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]))
    table = df.sparkSession.range(1).select(wanted.alias(stratum, "_quota"))
    order = [hash_key(F.col(key), seed), F.col(key)]
    wanted_rows = df.filter(F.col(stratum).isin(list(quotas)))
    cut = top_per_group(wanted_rows, [stratum], order, max(quotas.values()), name="_rn")
    return cut.join(F.broadcast(table), stratum).filter("_rn <= _quota").drop("_rn", "_quota")


def sample_n(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    return df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def stratified_split(
    df: DataFrame, stratum: str, key: str, train_share: float = 0.8, seed: str = "42", out: str = "part"
) -> DataFrame:
    """Mark each row `train` or `test` so that every class is split at the same share, exactly.

    Rows are counted by class and by the first digits of their hash. The counts tell
    on which side all rows with the same digits are, but for one set of digits in each
    class, and only its rows are ranked. `df` is read once and stored with the digits.
    """
    digest = hash_key(F.col(key), seed)
    rows = materialize(df.withColumn("_digits", F.coalesce(F.substring(digest, 1, 4), F.lit(""))), "digits")  # a null key ranks first
    ascending = Window.partitionBy("_class").orderBy("_digits")
    counts = rows.groupBy(F.col(stratum).alias("_class"), "_digits").agg(F.count("*").alias("_k"))
    counts = counts.withColumns({"_upto": F.sum("_k").over(ascending), "_n": F.sum("_k").over(Window.partitionBy("_class"))})
    counts = counts.withColumn("_room", F.floor(F.lit(train_share) * F.col("_n")) - F.col("_upto") + F.col("_k"))
    divided = (F.col("_room") > 0) & (F.col("_room") < F.col("_k"))
    cuts = materialize(counts.groupBy("_class").agg(
        F.max(F.when(F.col("_room") >= F.col("_k"), F.col("_digits"))).alias("_whole"),
        F.max(F.when(divided, F.col("_digits"))).alias("_divided"), F.max(F.when(divided, F.col("_room"))).alias("_left")), "cuts")
    rows = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_class")))
    known = rows.filter(~F.col("_digits").eqNullSafe(F.col("_divided")))
    known = known.select(*df.columns, F.when(F.col("_digits") <= F.col("_whole"), "train").otherwise("test").alias(out))
    few = materialize(rows.filter(F.col("_digits") == F.col("_divided")).drop("_class"), "divided")
    ranked = group_rank(few, [stratum], [digest, F.col(key)], "_rn")
    return known.unionAll(ranked.select(*df.columns, F.when(F.col("_rn") <= F.col("_left"), "train").otherwise("test").alias(out)))


def draw_zone(unstable: Column, u: Column) -> Column:
    """Zone drawn with weights that depend on the stability label."""
    return F.when(unstable, weighted_choice(u, UNSTABLE_ZONES)).otherwise(weighted_choice(u, STABLE_ZONES))


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe_first(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """First row per key by priority, as a map-side combined `min_by` rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*priority)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row per key over both inputs; one shuffle, combined before it."""
    both = union_all(base, changes)
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("_r")
    return both.groupBy(*keys).agg(newest).select(*keys, "_r.*")
