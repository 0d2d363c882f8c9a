"""Isolation forest: trees are grown in parallel tasks, rows are scored where they are.

Follows the isolation forest of Liu, Ting and Zhou (2008). A tree needs 256
rows, so the training sample is bounded by the number of trees and not by the
data; scoring is one narrow pass with the forest broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import hash_key
from ..session import materialize
from .clean import fill_zero, filter_region
from .spread import quantile_by_buckets

PSI = 256
#: Scores are counted by so many equal ranges, to find the one that holds their threshold.
SCORE_BUCKETS = 65_536
NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("lo", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("path", T.DoubleType()),
    ]
)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among `n` rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    c = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


@dataclass
class IsolationForest:
    features: list[str]
    nodes: DataFrame
    sample_size: int
    n_trees: int
    threshold: float = field(default=float("nan"))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Node rows of one tree over a sample."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, depth, parent, right = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if right else 2] = me
        span = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(expected_path(len(rows)))])
            continue
        f = int(rng.choice(usable))
        lo = x[rows, f].min()
        cut = lo + rng.random() * span[f]
        nodes.append([f, float(cut), -1, -1, 0.0])
        left = x[rows, f] <= cut
        stack.append((rows[~left], depth + 1, me, True))
        stack.append((rows[left], depth + 1, me, False))
    return [(i, *n) for i, n in enumerate(nodes)]


def sample_for_trees(df: DataFrame, key: str, features: Sequence[str], n_trees: int, psi: int, seed: str) -> DataFrame:
    """`(tree, _key, features)` with `psi` rows per tree, drawn without replacement inside a tree.

    The pool is the head of a hash order of at most `n_trees * psi` rows, and every
    tree draws from it anew, whatever the size of the table.
    """
    want = n_trees * psi
    pool = df.select(F.col(key).alias("_key"), *features).withColumn("_h", hash_key(F.col("_key"), seed))
    pool = materialize(pool.orderBy("_h", "_key").limit(want), "sample")  # bounded by the forest's size
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_trees - 1).cast("bigint"))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("_h", "tree"), "_key")
    return each.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= psi).drop("_rn", "_h")


def fit_forest(
    df: DataFrame, key: str, features: Sequence[str], n_trees: int = 100, contamination: float = 0.05,
    psi: int = PSI, seed: int = 42, incomplete: str = "fill",
) -> IsolationForest:
    """Grow the trees, then set the threshold at the contamination quantile of the training scores.

    Rows with an unknown feature count as 0 there, or with `incomplete="drop"` stay
    out of the training. Scaling the features first would change nothing: a
    threshold splits a scaled feature where it splits the feature.
    """
    cols = list(features)
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = rows.dropna(subset=cols) if incomplete == "drop" else fill_zero(rows, cols)
    sample = sample_for_trees(rows, key, cols, n_trees, psi, str(seed))
    arrow = to_arrow_schema(NODE_SCHEMA)

    def grow(key_, table):
        tree = key_[0].as_py()
        order = np.argsort(np.array(table.column("_key").to_pylist(), dtype=object), kind="stable")
        x = np.column_stack([np.asarray(table.column(c)) for c in cols])[order]
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        return pa.Table.from_arrays(
            [pa.array([tree] * len(nodes), pa.int64())]
            + [pa.array([n[i] for n in nodes], arrow.field(i + 1).type) for i in range(6)],
            schema=arrow,
        )

    nodes = materialize(sample.groupBy("tree").applyInArrow(grow, NODE_SCHEMA), "forest")
    used = sample.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    forest = IsolationForest(cols, nodes, int(used), n_trees)
    scores = raw_scores(rows, forest, cols[0]).select("_score")  # no key is moved
    found = quantile_by_buckets(scores, "_score", contamination, F.floor(F.col("_score") * SCORE_BUCKETS))
    forest.threshold = 0.0 if found is None else found
    return forest


def _pack(trees: list[list[tuple]]) -> tuple[list[tuple], int]:
    """Arrays per tree; a leaf leads to itself, so every walk takes the same number of steps."""
    packed, deepest = [], 0
    for nodes in trees:
        feature, threshold, lo, hi, path = (np.array(col) for col in zip(*nodes))
        leaf = feature < 0
        me = np.arange(len(feature))
        child = np.empty(2 * len(feature), dtype=np.int32)
        child[0::2], child[1::2] = np.where(leaf, me, lo), np.where(leaf, me, hi)
        level = np.zeros(len(feature), dtype=np.int64)
        for i in np.flatnonzero(~leaf):  # a parent is stored before its children
            level[[lo[i], hi[i]]] = level[i] + 1
        deepest = max(deepest, int(level.max()))
        packed.append((np.maximum(feature, 0).astype(np.int32), np.where(leaf, np.inf, threshold), child, path))
    return packed, deepest


def raw_scores(df: DataFrame, forest: IsolationForest, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """`key`, the columns of `keep` and `_score` in (-1, 0): minus two to the power of minus the scaled path length."""
    spark: SparkSession = df.sparkSession
    trees: dict[int, list] = {}
    for r in forest.nodes.orderBy("tree", "node").collect():  # at most 2 * psi nodes per tree
        trees.setdefault(r["tree"], []).append((r["feature"], r["threshold"], r["lo"], r["hi"], r["path"]))
    packed, depth = _pack(list(trees.values()))
    scale = float(expected_path(forest.sample_size)) or 1.0
    shared = spark.sparkContext.broadcast(packed)
    cols = forest.features
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)],
                     key, *[c for c in keep if c != key])
    schema = T.StructType([*rows.schema.fields[len(cols):], T.StructField("_score", T.DoubleType())])
    names = schema.names

    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = np.column_stack([np.asarray(batch.column(i)) for i in range(len(cols))]).ravel()
            first = np.arange(0, n * len(cols), len(cols), dtype=np.int32)
            total = np.zeros(n)
            for feature, threshold, child, path in shared.value:
                node = np.zeros(n, dtype=np.int32)
                for _ in range(depth):
                    right = x.take(first + feature.take(node)) > threshold.take(node)
                    node = child.take(2 * node + right)
                total += path.take(node)
            score = -np.exp2(-(total / len(shared.value)) / scale)
            yield pa.RecordBatch.from_arrays([*batch.columns[len(cols):], pa.array(score)], names)

    return rows.mapInArrow(scan, schema)


def score_forest(df: DataFrame, forest: IsolationForest, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """`key`, the columns of `keep`, `anomaly_score` (below 0 is an anomaly) and `is_anomaly`."""
    scored = raw_scores(df, forest, key, keep)
    score = F.col("_score") - F.lit(forest.threshold)
    return scored.select(*scored.columns[:-1], score.alias("anomaly_score"), (score < 0).alias("is_anomaly"))


def detect(df: DataFrame, forest: IsolationForest, key: str, region: str | None = None, region_col: str = "zone",
           top: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Anomalies only, most anomalous first, with the columns of `keep`; `top` keeps the worst ones."""
    bad = score_forest(filter_region(df, region, region_col), forest, key, keep).filter("is_anomaly")
    ordered = bad.orderBy("anomaly_score", key)
    return ordered.limit(top) if top else ordered


def anomaly_share(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"),
        F.round(F.try_divide(F.count_if("is_anomaly"), F.count("*")) * 100, 2).alias("anomaly_pct"),
    )


def save_forest(forest: IsolationForest, path: str) -> None:
    meta = forest.nodes.sparkSession.createDataFrame(
        [(forest.features, forest.sample_size, forest.n_trees, forest.threshold)],
        "features array<string>, sample_size int, n_trees int, threshold double",
    )
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_forest(spark: SparkSession, path: str) -> IsolationForest:
    m = spark.read.parquet(f"{path}/meta").first()
    return IsolationForest(list(m["features"]), spark.read.parquet(f"{path}/nodes"), m["sample_size"], m["n_trees"],
                           m["threshold"])
