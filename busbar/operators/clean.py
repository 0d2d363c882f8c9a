"""Projections, cleaning and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import exact_quantiles

TOPIC_COLUMNS = {
    "quantity": ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"],
    "price": ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "unit_cost"],
    "tax": ["l_orderkey", "l_linenumber", "l_tax", "l_returnflag"],
}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def clean_numeric(c: Column, default: Column | None = None) -> Column:
    """Trim blanks and square brackets; text that is no number becomes null (or `default`)."""
    value = F.trim(F.trim(c.cast("string")), F.lit("[]")).try_cast("double")
    return value if default is None else F.coalesce(value, default)


def parse_ts(date: Column, time: Column, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Timestamp from two text columns, null where the text is no valid time."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt))


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def drop_null_any(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))


def default_missing_features(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Add the named feature columns that are absent."""
    return df.withColumns({c: F.lit(value) for c in cols if c not in df.columns})


def flag_missing(df: DataFrame, col: str, flag: str = "is_missing") -> DataFrame:
    """Flag nulls; call it before any fill."""
    return df.withColumn(flag, F.col(col).isNull())


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def map_values(c: Column, mapping: Mapping[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), default)


def topic_select(df: DataFrame, topic: str, topics: Mapping[str, Sequence[str]] = TOPIC_COLUMNS) -> DataFrame:
    """Columns shown for the first topic word found in the request, cut to the schema."""
    wanted = next((cols for word, cols in topics.items() if word in topic.lower()), df.columns)
    return df.select(*[c for c in wanted if c in df.columns])


def nest_meta(df: DataFrame, id_col: str, text_col: str, meta_cols: Sequence[str]) -> DataFrame:
    return df.select(id_col, text_col, F.struct(*meta_cols).alias("meta"))


def hide_truth(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank the label columns, keeping their types."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed column order; extra columns are dropped and absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def filter_meta(df: DataFrame, filters: Mapping[str, object | None]) -> DataFrame:
    """Conjunction of equalities; entries without a value are skipped."""
    conds = [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None]
    return df.filter(reduce(and_, conds)) if conds else df


def filter_region(df: DataFrame, region: str | None, col: str = "zone") -> DataFrame:
    return df.filter(F.col(col) == region) if region and col in df.columns else df


def filter_quantile(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows at or below quantile `lo`, or at or above quantile `hi` (either may be absent).

    The bounds are one row and become literals, so the comparison reaches the scan.
    """
    qs = {n: q for n, q in (("lo", lo), ("hi", hi)) if q is not None}
    bounds = exact_quantiles(df, col, qs).first()
    conds = []
    if lo is not None:
        conds.append(F.col(col) <= F.lit(bounds["lo"]))
    if hi is not None:
        conds.append(F.col(col) >= F.lit(bounds["hi"]))
    return df.filter(reduce(or_, conds)) if conds else df


def filter_or_all(df: DataFrame, cond: Column) -> DataFrame:
    """Rows that satisfy `cond`, or every row when none does."""
    found = df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("found"))
    return df.filter(cond | ~found.scalar())


def same_id(a: Column, b: Column) -> Column:
    """Case-insensitive id equality."""
    return F.upper(a) == F.upper(b)
