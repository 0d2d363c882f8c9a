"""Id lookups, anti and semi joins, comparisons and side-by-side reports.

No broadcast is forced on a table that grows: Spark broadcasts a side it has
measured as small, and splits skewed partitions of a sort-merge join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def join_measured(big: DataFrame, small: DataFrame, on: str | list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a large table with a stored one that is probably small.

    The stored side is counted (up to `rows`) first. If it is small it is
    broadcast and the large table is scanned where it lies; otherwise both are
    shuffled, and adaptive execution splits the partitions of hot keys.
    """
    fits = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if fits else small, on)


def extract_ids(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Distinct upper-cased ids named in each text."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.upper))
    # Outer, so that no filter on the id count is pushed down and the pattern runs once per text.
    return df.select(key, F.explode_outer(ids).alias("asked_id")).filter("asked_id IS NOT NULL")


def lookup_ids(asked: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Rows of `table` whose id was asked for."""
    return asked.join(table, asked["asked_id"] == F.upper(table[id_col]))


def missing_ids(asked: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Asked ids that the table does not hold."""
    return asked.join(table.select(F.upper(id_col).alias("asked_id")), "asked_id", "left_anti")


def add_unseen(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of `first`, then the rows of `second` whose key is not in it."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def compare_expected(df: DataFrame, expected: DataFrame, key: str, want: Column, got: Column) -> DataFrame:
    """Null-safe equality as a score of 1.0 or 0.0."""
    same = want.eqNullSafe(got)
    return df.join(expected, key).select(
        key, F.when(same, 1.0).otherwise(0.0).alias("score"), same.alias("passed")
    )


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of small per-key aggregates."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "full_outer")
    return out
