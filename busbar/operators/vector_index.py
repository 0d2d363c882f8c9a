"""An inverted file over vectors: approximate search that reads a part of the collection.

Directions are put into cells around centres that are found on a bounded sample.
The rows are stored as Parquet, one folder for each cell, so a search reads the
cells whose centres are nearest to its queries and no others. Inside them every
row is scored exactly. How many cells a query probes is found when the index is
built: the fewest with which sampled queries get the recall that was asked for,
held against the exact search over all rows. More rows are appended to their
cells; rows that go or change rewrite the cells they are in.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, work_path
from .clean import filter_meta
from .retrieval import QUERY_BLOCK, SCORES_AT_ONCE, _best, _matrix, _unit, vector_search
from .spread import top_per_group

#: The centres are fitted on at most so many rows, whatever the size of the collection.
SAMPLE_ROWS = 50_000
MOST_CELLS = 4096
ROUNDS = 12
#: Queries that measure the recall, and the recall an index aims at.
TRIAL_QUERIES = 200
RECALL = 0.95


@dataclass
class VectorIndex:
    """Where the cells are stored, their centres, and the number of cells that a query probes."""

    path: str
    centres: np.ndarray
    probes: int
    kept: list[str]

    def rows(self, spark: SparkSession, cells: Sequence[int] | None = None) -> DataFrame:
        """`(doc_id, v, ..., cell)`; of some cells, if they are named, and then no other file is read."""
        stored = spark.read.parquet(f"{self.path}/cells")
        return stored if cells is None else stored.filter(F.col("cell").isin([int(c) for c in cells]))


def _order(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit("centres"))


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Directions that the unit vectors gather around; an empty cell starts again at a vector that is badly served."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.permutation(len(vectors))[:cells]]
    for _ in range(rounds):
        near = vectors @ centres.T
        own = near.argmax(axis=1)
        served = near[np.arange(len(vectors)), own]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = vectors[np.argsort(served, kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _cells_of(spark: SparkSession, centres: np.ndarray, vector: str, n: int) -> Column:
    """The `n` nearest cells of a vector, the nearest first; null if it has no direction or another length."""
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS directions

    def nearest(column: pa.Array) -> pa.Array:
        cells, dim = shared.value.shape
        known = np.array([v is not None and len(v) == dim and None not in v for v in column.to_pylist()], bool)
        rows, step, parts = np.flatnonzero(known), max(1, SCORES_AT_ONCE // cells), []
        for first in range(0, len(rows), step):
            scores = _matrix(column.take(pa.array(rows[first : first + step])), dim) @ shared.value.T
            parts.append(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32))
        ends = np.concatenate([[0], np.cumsum(known * min(n, cells))]).astype(np.int32)
        places = pa.array(np.concatenate(parts).ravel() if parts else [], pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), places)  # a null place is a null list

    return F.arrow_udf(_hinted(nearest), T.ArrayType(T.IntegerType()))(F.col(vector))


def _hinted(fn):
    fn.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return fn


def _store(index_path: str, rows: DataFrame, mode: str) -> None:
    """Write rows to their cells. A cell with very many rows is spread over several tasks by its ids."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "cell", F.xxhash64("doc_id")).sortWithinPartitions("cell")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{index_path}/cells")


def build_vector_index(
    coll: DataFrame, id_col: str, vec_col: str, path: str | None = None, keep: Sequence[str] = (), cells: int | None = None,
    recall: float = RECALL, k: int = 10,
) -> VectorIndex:
    """Store the collection by cells. Rows without a vector are left out, as by the exact search."""
    spark = coll.sparkSession
    path = path or work_path(spark, "vector-index")
    rows = coll.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vec_col).alias("v"), *keep)
    n = rows.count()
    cells = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
    sample = rows.select("doc_id", "v").orderBy(_order("doc_id"), "doc_id").limit(SAMPLE_ROWS).toArrow()
    dim = len(sample.column("v")[0]) if len(sample) else 1
    unit = _matrix(sample.column("v"), dim) if len(sample) else np.zeros((0, dim))
    centres = fit_centres(unit, cells) if len(unit) else np.zeros((1, dim))
    placed = rows.withColumn("cell", F.coalesce(F.get(_cells_of(spark, centres, "v", 1), F.lit(0)), F.lit(0)))
    _store(path, placed, "overwrite")
    index = VectorIndex(path, centres, len(centres), list(keep))
    if len(sample):
        index.probes = _calibrate(spark, index, recall, k)
    _remember(spark, index)
    return index


def _remember(spark: SparkSession, index: VectorIndex) -> None:
    about = json.dumps({"probes": index.probes, "kept": index.kept, "dim": index.centres.shape[1]})
    rows = [(k, about if k == 0 else None, c) for k, c in enumerate(index.centres.tolist())]
    spark.createDataFrame(rows, "cell int, about string, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centres")


def load_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    about = json.loads(rows[0]["about"])
    return VectorIndex(path, np.array([r["centre"] for r in rows]), about["probes"], about["kept"])


def _calibrate(spark: SparkSession, index: VectorIndex, recall: float, k: int) -> int:
    """The fewest probes with which sampled rows, asked for their neighbours among all rows, get the recall.

    The cell of every true neighbour is known, so its place among the query's
    cells says from how many probes on it is found.
    """
    stored = index.rows(spark)
    asks = stored.select("doc_id", "v").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("trial")), "doc_id").limit(TRIAL_QUERIES)
    asks = materialize(asks.withColumnsRenamed({"doc_id": "query_id", "v": "q"}), "trial")
    true = vector_search(stored, "doc_id", "v", asks, "query_id", "q", k + 1)
    order = asks.select("query_id", _cells_of(spark, index.centres, "q", len(index.centres)).alias("order"))
    found = true.join(F.broadcast(order), "query_id").join(stored.select("doc_id", "cell"), "doc_id")
    found = found.filter("doc_id <> query_id").select(F.array_position("order", F.col("cell")).alias("place"))  # a row finds itself anyway
    places = sorted(r["place"] for r in found.collect())  # at most TRIAL_QUERIES * k numbers
    if not places:
        return len(index.centres)
    return int(max(places[min(int(np.ceil(recall * len(places))), len(places)) - 1], 1))


def indexed_search(
    index: VectorIndex, queries: DataFrame, query_id: str, query_vec: str, k: int = 10, probes: int | None = None,
    filters: Mapping[str, object | None] | None = None,
) -> DataFrame:
    """Cosine top `k` among the probed cells: `(query_id, doc_id, score, rank)`.

    With as many probes as cells the result is that of the exact search. Queries
    go in blocks of neighbours, and a block reads the cells that it probes. A
    query without a direction of the right length finds nothing.
    """
    spark = queries.sparkSession
    n = min(probes or index.probes, len(index.centres))
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("q")).filter("q IS NOT NULL")
    asks = asks.withColumn("cells", _cells_of(spark, index.centres, "q", n)).filter("cells IS NOT NULL")
    asks = materialize(asks, "asks")
    id_type = asks.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    block: list = []
    blocks = 0
    for row in asks.orderBy(F.get("cells", F.lit(0)), F.get("cells", F.lit(1))).toLocalIterator():
        block.append(row)
        if len(block) >= QUERY_BLOCK:
            out = out.unionByName(_search_block(spark, index, block, schema, k, filters))
            block, blocks = [], blocks + 1
    if block:
        out = out.unionByName(_search_block(spark, index, block, schema, k, filters))
    return out


def _search_block(spark: SparkSession, index: VectorIndex, block: list, schema: T.StructType, k: int, filters) -> DataFrame:
    by_cell: dict[int, list[int]] = {}
    for j, r in enumerate(block):
        for c in r["cells"]:
            by_cell.setdefault(c, []).append(j)
    asked = _unit(np.array([r["q"] for r in block], dtype=np.float64))
    shared = spark.sparkContext.broadcast(([r["query_id"] for r in block], asked, {c: np.array(js) for c, js in by_cell.items()}))
    rows = filter_meta(index.rows(spark, sorted(by_cell)), filters or {}).select("doc_id", "v", "cell")
    arrow, dim = to_arrow_schema(schema), index.centres.shape[1]

    def scan(batches):
        names, q, probing = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells = np.asarray(batch.column(2))
            for cell in np.unique(cells).tolist():
                own = batch.filter(pa.array(cells == cell))
                ids, js = np.asarray(own.column(0), dtype=np.int64), probing[cell]
                scores = np.round(_matrix(own.column(1), dim) @ q[js].T, 6)
                for at, j in enumerate(js.tolist()):
                    s, i = best.get(j, (np.empty(0), np.empty(0, dtype=np.int64)))
                    s, i = np.concatenate([s, scores[:, at]]), np.concatenate([i, ids])
                    keep = _best(s, i, k)
                    best[j] = s[keep], i[keep]
        names = [names[j] for j, (s, _) in best.items() for _ in range(len(s))]
        ids = np.concatenate([i for _, i in best.values()]) if best else []
        scores = np.concatenate([s for s, _ in best.values()]) if best else []
        yield pa.RecordBatch.from_arrays([pa.array(names, arrow.field(0).type), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], schema=arrow)

    return top_per_group(rows.mapInArrow(scan, schema), ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def add_vectors(index: VectorIndex, more: DataFrame, id_col: str, vec_col: str) -> None:
    """Append rows to their cells; the centres stay as they are. Ids that are there already: see `replace_vectors`."""
    spark = more.sparkSession
    rows = more.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vec_col).alias("v"), *index.kept)
    placed = rows.withColumn("cell", F.coalesce(F.get(_cells_of(spark, index.centres, "v", 1), F.lit(0)), F.lit(0)))
    _store(index.path, materialize(placed, "more-vectors"), "append")


def replace_vectors(index: VectorIndex, changed: DataFrame, id_col: str, vec_col: str) -> list[int]:
    """Upsert by id; a null vector deletes. Only the cells that lose or get a row are rewritten; they are returned."""
    spark = changed.sparkSession
    rows = changed.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vec_col).alias("v"), *index.kept)
    new_cell = F.when(F.col("v").isNotNull(), F.coalesce(F.get(_cells_of(spark, index.centres, "v", 1), F.lit(0)), F.lit(0)))
    rows = materialize(rows.withColumn("cell", new_cell), "changed-vectors")
    stored = index.rows(spark)
    ids = rows.select("doc_id").distinct()
    old = stored.select("doc_id", "cell").join(ids, "doc_id", "left_semi").select("cell").distinct()
    touched = [r["cell"] for r in old.unionByName(rows.select("cell").filter("cell IS NOT NULL")).distinct().collect()]  # at most MOST_CELLS
    if touched:
        left = index.rows(spark, touched).join(ids, "doc_id", "left_anti")
        new = rows.filter("cell IS NOT NULL").select(*left.columns)
        after = materialize(left.unionByName(new), "rewritten-cells")
        _store(index.path, after, "overwrite")
        gone = sorted(set(touched) - {r["cell"] for r in after.select("cell").distinct().collect()})
        _drop_cells(spark, index, gone)  # a dynamic overwrite leaves a folder as it is if no row goes there
    return sorted(touched)


def _drop_cells(spark: SparkSession, index: VectorIndex, cells: Sequence[int]) -> None:
    for c in cells:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.path}/cells/cell={c}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def measured_recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """Share of the exact search's hits that were found, over all queries; hits with the same score stand for each other."""
    worst = true.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    good = found.join(worst, "query_id").filter("score >= worst").groupBy("query_id").agg(F.count("*").alias("hits"))
    both = worst.join(good, "query_id", "left").select("n", F.least(F.coalesce("hits", F.lit(0)), "n").alias("hits"))
    return both.agg(F.count("*").alias("n_queries"), (F.sum("hits") / F.sum("n")).alias("recall"))
