"""Seeded pseudo-random columns that do not depend on how rows are partitioned.

`rand(seed)` changes when a task re-runs on other partitions; a hash of the row
key does not, so samples and draws survive lost executors unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0  # 2^32


def hash_key(key: Column, seed: str = "") -> Column:
    """32-character hexadecimal sort key."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def hash_int(key: Column, seed: str = "") -> Column:
    """First 32 bits of the md5 as a bigint."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed: str = "") -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int(key, seed) / F.lit(SPAN)


def gaussian(key: Column, seed: str = "", mean: float = 0.0, std: float = 1.0) -> Column:
    """Normal draw by the Box-Muller transform of two uniforms."""
    u1 = (hash_int(key, seed + "a") + 1) / F.lit(SPAN)
    u2 = uniform(key, seed + "b")
    return F.lit(mean) + F.lit(std) * F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """Category whose cumulative weight first reaches `u`; the last one catches the rest."""
    names = list(weights)
    cumulative, out = 0.0, None
    for name in names[:-1]:
        cumulative += weights[name]
        cond = u <= F.lit(round(cumulative, 10))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
