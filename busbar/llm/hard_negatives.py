"""Hard negatives of anchor vectors, mined with bounds along a spanning tree of the anchors.

Anchors that lie near each other are put into blocks of a bounded size, and each
block gets a minimum spanning tree. A row's score with an anchor differs from
that with the anchor's parent by at most the length of the edge times the
length of the row. So a row that has been scored at the root has an interval
at every anchor below, and only where the interval meets the anchor's window
is it scored again, which makes the interval a point for all anchors below.

There are two passes over the rows. The first looks for positives: the window
reaches from the score of the k-th best known row upwards. The second looks for
negatives: the windows follow from the positives' scores. The anchors of a
block know each other's scores, which gives first lower ends for both, so a
task hands on little more than the rows that are looked for.

Blocks are files in the shared folder. A task holds a chunk of rows and one
block at a time, so neither the rows nor the anchors have to fit anywhere.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import Scratch, SharedFolder, table

ANCHOR_EVERY, NOISE_EVERY, CLASSES = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these parts of the positive's score, in per cent.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Anchors in a block, and bytes of rows that a task holds.
BLOCK_ANCHORS = 1024
CHUNK_BYTES = 16 << 20
#: Above this share of rows to be scored again, a whole level of the tree is multiplied at once.
DENSE_SHARE = 0.1

_NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last among equal scores
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers held as doubles; beyond 64 bits the nearest 64-bit number."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(anchors).max()) * rows.shape[1] < 2**53:
        return (rows @ anchors.T).astype(np.int64)
    a = np.array([[int(x) for x in r] for r in rows.tolist()], object)
    b = np.array([[int(x) for x in r] for r in anchors.tolist()], object)
    return np.clip(a @ b.T, _LOW, _HIGH).astype(np.int64)


def pair_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The inner product of each row with the anchor beside it."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(anchors).max()) * rows.shape[1] < 2**53:
        return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)
    return np.array([products(r[None], a[None])[0, 0] for r, a in zip(rows, anchors)], np.int64)


def share_of(scores: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """`percent` per cent of whole numbers, rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(scores, 100)
    rest = rest * percent
    return whole * percent + (-(-rest // 100) if up else rest // 100)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points from the root on, the parent of each (-1 at the root), and the distance to it (Prim)."""
    n = len(points)
    with np.errstate(over="ignore", invalid="ignore"):
        best = np.full(n, np.inf)
        parent, order = np.full(n, -1), np.empty(n, np.int64)
        free = np.ones(n, bool)
        new = int(np.argmin((points * points).sum(axis=1)))
        for k in range(n):
            order[k] = new
            free[new] = False
            gap = points - points[new]
            length = np.sqrt((gap * gap).sum(axis=1))
            nearer = free & ~(length >= best)
            best[nearer], parent[nearer] = length[nearer], new
            if k < n - 1:
                new = int(np.flatnonzero(free)[np.argmin(best[free])])
    distance = np.where(parent >= 0, best, 0.0)
    return order, parent, distance


@dataclass
class Block:
    """Anchors in an order in which parents come first; parents are places in it, -1 for the root."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray
    floors: np.ndarray  # no positive scores less
    positives: np.ndarray | None = None  # ids and scores, and how many there are
    scores: np.ndarray | None = None
    counts: np.ndarray | None = None
    least: np.ndarray | None = None  # windows of the negatives
    most: np.ndarray | None = None

    def save(self, folder: SharedFolder, name: str) -> None:
        sink = io.BytesIO()
        np.savez(sink, **{k: v for k, v in self.__dict__.items() if v is not None})
        with folder.create(name) as out:
            out.write(sink.getbuffer())

    @staticmethod
    def load(folder: SharedFolder, name: str) -> Block:
        with folder.open(name) as f:
            got = np.load(io.BytesIO(f.read()))
            return Block(**{k: got[k] if got[k].ndim else got[k].item() for k in got.files})


def build_block(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: int) -> Block:
    order, parent, edge = spanning_tree(vectors)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parent = np.where(parent[order] >= 0, rank[parent[order]], -1)
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    known = products(vectors, vectors)
    usable = (labels[:, None] == labels[None, :]) & (ids[:, None] != ids[None, :])
    return Block(ids, labels, vectors, parent, edge[order], _kth_best(np.where(usable, known, _LOW), positives))


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row, the least number if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _LOW)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def levels(parents: np.ndarray) -> list[np.ndarray]:
    """The tree's nodes by their distance from the root in edges."""
    depth = np.zeros(len(parents), np.int64)
    for k, p in enumerate(parents.tolist()):
        depth[k] = depth[p] + 1 if p >= 0 else 0
    return [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if len(parents) else []


def bounded_scores(vectors: np.ndarray, block: Block, least: np.ndarray, most: np.ndarray, usable: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores of rows with all anchors of a block, and where they lie in the anchor's window; elsewhere they may be missing.

    `usable` gives for some anchors the rows that may count for each. The third
    result is the number of scores that were computed.
    """
    n, m = len(vectors), len(block.ids)
    with np.errstate(over="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9) + 1e-9
    low, high = np.full((n, m), -np.inf), np.full((n, m), np.inf)
    scores, inside = np.zeros((n, m), np.int64), np.zeros((n, m), bool)
    computed = 0
    for depth, nodes in enumerate(levels(block.parents)):
        allowed = usable(nodes)
        if depth == 0:
            again = np.ones((n, len(nodes)), bool)
        else:
            slack = norms[:, None] * (block.edges[nodes] * (1 + 1e-9) + 1e-9)[None, :] + 1
            up = block.parents[nodes]
            with np.errstate(invalid="ignore", over="ignore"):
                low[:, nodes], high[:, nodes] = low[:, up] - slack, high[:, up] + slack
                again = allowed & ~(high[:, nodes] < least[nodes]) & ~(low[:, nodes] > most[nodes])
        share = again.mean() if again.size else 0.0
        if share > DENSE_SHARE:
            got = products(vectors, block.vectors[nodes])
            scores[:, nodes] = got
            low[:, nodes], high[:, nodes] = _interval(got)
            computed += got.size
        elif share:
            r, c = np.nonzero(again)
            c = nodes[c]
            got = np.concatenate([pair_products(vectors[r[k : k + 100_000]], block.vectors[c[k : k + 100_000]]) for k in range(0, len(r), 100_000)])
            scores[r, c] = got
            low[r, c], high[r, c] = _interval(got)
            computed += len(r)
        found = scores[:, nodes]
        inside[:, nodes] = again & allowed & (found >= least[nodes]) & (found <= most[nodes])
    return scores, inside, computed


def _interval(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the true values of some scores lie between, as doubles."""
    slack = np.abs(scores.astype(np.float64)) * 1e-15
    cut = (scores == _LOW) | (scores == _HIGH)
    return np.where(cut, -np.inf, scores - slack), np.where(cut, np.inf, scores + slack)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -np.maximum(scores[near], -_HIGH)))[:k]]
    return np.lexsort((ids, -np.maximum(scores, -_HIGH)))[:k]


def _valid(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and scaled vectors of the rows that take part; short vectors are filled up with zeros."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    bounds = lists.offsets.to_numpy()
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)  # nulls turn into NaN
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    broken = np.append(0, np.cumsum(~np.isfinite(flat)))
    keep = lists.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
    keep &= broken[bounds[1:]] == broken[bounds[:-1]]
    at = np.flatnonzero(keep)
    wide = int(size[at].max()) if len(at) else 0
    out = np.zeros((len(at), wide))
    if len(at) and (size[at] == wide).all():
        out[:] = flat[(bounds[at][:, None] + np.arange(wide)).ravel()].reshape(len(at), wide)
    else:
        for k, r in enumerate(at.tolist()):
            out[k, : size[r]] = flat[bounds[r] : bounds[r + 1]]
    with np.errstate(over="ignore"):
        out = np.floor(np.clip(out * SCALE, -np.finfo(np.float64).max, np.finfo(np.float64).max))
    number = ids.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)[at]
    label = labels.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[at]
    noisy = (number != _NO_ID) & (number % NOISE_EVERY == 0)
    return number, np.where(noisy, (label + 1) % CLASSES, label), out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that take part, so many at a time that they stay below CHUNK_BYTES, or `rows` of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joined():
        width = max(v.shape[1] for _, _, v in held)
        return np.concatenate([i for i, _, _ in held]), np.concatenate([x for _, x, _ in held]), np.concatenate([_widen(v, width) for _, _, v in held])

    n = size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            got = _valid(part.column(0), part.column(1), part.column(2))
            if not len(got[0]):
                continue
            held.append(got)
            n, size = n + len(got[0]), size + got[2].nbytes
            while rows and n >= rows:
                ids, labels, vectors = joined()
                yield ids[:rows], labels[:rows], vectors[:rows]
                held, n = [(ids[rows:], labels[rows:], vectors[rows:])], n - rows
                size = held[0][2].nbytes
            if not rows and size >= CHUNK_BYTES:
                yield joined()
                held, n, size = [], 0, 0
    if n:
        yield joined()


def _blocks_task(folder: SharedFolder, positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for k, (ids, labels, vectors) in enumerate(_chunks(batches, BLOCK_ANCHORS)):
            name = f"anchors-{attempt}-{k}"
            build_block(ids, labels, vectors, positives).save(folder, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["name", "n"])

    return run


def _search_task(folder: SharedFolder, names: list[str], firsts: list[int], pick: Callable):
    """For every chunk of rows and every block: the rows (anchor, place, id, score and block) that `pick` takes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _chunks(batches):
            for number, (name, first) in enumerate(zip(names, firsts)):
                block = Block.load(folder, name)
                width = max(vectors.shape[1], block.vectors.shape[1])
                block.vectors = _widen(block.vectors, width)
                rows = _widen(vectors, width)
                step = max(1, (16 << 20) // (8 * max(len(block.ids), 1)))
                for lo in range(0, len(ids), step):
                    found = pick(block, ids[lo : lo + step], labels[lo : lo + step], rows[lo : lo + step])
                    if found:
                        anchor, place, own, scores = (np.concatenate(x) for x in zip(*found))
                        arrays = [anchor + first, place.astype(np.int32), own, scores, np.full(len(own), number)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "place", "id", "score", "block"])

    return run


_FOUND = "anchor long, place int, id long, score long, block long"


def _pick_positives(k: int):
    def pick(block: Block, ids, labels, vectors) -> list[tuple]:
        usable = lambda nodes: (labels[:, None] == block.labels[nodes]) & (ids[:, None] != block.ids[nodes])
        scores, inside, _ = bounded_scores(vectors, block, block.floors, np.full(len(block.ids), _HIGH), usable)
        out = []
        for a in np.flatnonzero(inside.any(axis=0)).tolist():
            own = np.flatnonzero(inside[:, a])
            own = own[_best(scores[own, a], ids[own], k)]
            out.append((np.full(len(own), a), np.zeros(len(own), np.int32), ids[own], scores[own, a]))
        return out

    return pick


def _pick_negatives(k: int):
    def pick(block: Block, ids, labels, vectors) -> list[tuple]:
        real = np.arange(block.scores.shape[1])[None, :] < block.counts[:, None]
        least = np.where(real, block.least, _HIGH).min(axis=1, initial=_HIGH)
        most = np.where(real, block.most, _LOW).max(axis=1, initial=_LOW)
        usable = lambda nodes: labels[:, None] != block.labels[nodes]
        scores, inside, _ = bounded_scores(vectors, block, least, most, usable)
        out = []
        for a in np.flatnonzero(inside.any(axis=0)).tolist():
            near = np.flatnonzero(inside[:, a])
            got = scores[near, a]
            for p in range(block.counts[a]):
                own = near[(got >= block.least[a, p]) & (got <= block.most[a, p])]
                own = own[_best(scores[own, a], ids[own], k)]
                if len(own):
                    out.append((np.full(len(own), a), np.full(len(own), p, np.int32), ids[own], scores[own, a]))
        return out

    return pick


def _windows_task(folder: SharedFolder, names: list[str], firsts: list[int], positives: int, negatives: int):
    """For a block and its positives: the block once more, with the windows of the negatives."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        block, name = Block.load(folder, names[k]), f"windows-{names[k]}-{TaskContext.get().taskAttemptId()}"
        n = len(block.ids)
        block.positives, block.scores, block.counts = np.full((n, positives), _NO_ID), np.zeros((n, positives), np.int64), np.zeros(n, np.int64)
        for anchor, place, i, score in zip(*(rows.column(c).to_pylist() for c in ("anchor", "place", "id", "score"))):
            a = anchor - firsts[k]
            block.positives[a, place], block.scores[a, place] = i, score
            block.counts[a] = max(block.counts[a], place + 1)
        block.least, block.most = share_of(block.scores, LEAST_SHARE, True), share_of(block.scores, MOST_SHARE, False)
        known = products(block.vectors, block.vectors)  # other anchors are rows too: the lower ends can be raised
        other = block.labels[:, None] != block.labels[None, :]
        for p in range(positives):
            fits = other & (known >= block.least[:, p, None]) & (known <= block.most[:, p, None])
            block.least[:, p] = np.maximum(block.least[:, p], _kth_best(np.where(fits, known, _LOW), negatives))
        block.save(folder, name)
        return pa.table({"block": pa.array([k], pa.int64()), "name": pa.array([name]), "pairs": pa.array([int(block.counts.sum())], pa.int64())})

    return run


def _ids(column: str):
    """The number that stands for a null id is one again."""
    return F.when(F.col(column) != _NO_ID, F.col(column))


def _first(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n best rows for each of `keys`, numbered from 0 in `rank`."""
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < n)


def hard_negatives(
    rows: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of every hard negative.

    Anchors are the rows whose id is divisible by `anchor_every`. Rows with a
    null label, vector or component, or one that is not finite, take no part. A
    row without an id is no anchor and its label is never changed; it can be a
    positive or negative and comes last among equal scores. Each repeated row
    counts: as an anchor, and as a candidate, but rows with the anchor's own id
    are no positives of it. Vectors of different lengths are filled up with
    zeros. Scores beyond 64 bits become the nearest 64-bit number. An anchor
    without positives, or a positive without negatives, has no rows. Other
    columns, whatever their names, are not looked at.
    """
    spark = rows.sparkSession
    folder, scratch = SharedFolder(work_path(spark, "anchor-blocks")), Scratch()
    used = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    anchors = scratch.keep(used.filter((F.col("id") % anchor_every == 0) & F.col("label").isNotNull() & F.col("vector").isNotNull()), "anchors")
    n = anchors.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    # near anchors stand together: by label, then by the sides of some planes on which they lie
    signs = [F.when(F.get("vector", F.lit(k)) > 0, 1 << k).otherwise(0) for k in range(8)]
    order = "label", "code", "id"
    near = anchors.withColumn("code", sum(signs[1:], signs[0])).repartitionByRange(-(-n // BLOCK_ANCHORS), *order).sortWithinPartitions(*order)
    stored = scratch.keep(near.select("id", "label", "vector").mapInArrow(_blocks_task(folder, positives), "name string, n long"), "blocks")
    found = stored.orderBy("name").collect()  # a name for every BLOCK_ANCHORS anchors
    names, firsts = [r.name for r in found], np.cumsum([0, *(r.n for r in found)]).tolist()
    if not names:
        return empty

    near_rows = used.mapInArrow(_search_task(folder, names, firsts, _pick_positives(positives)), _FOUND)
    best = scratch.keep(_first(near_rows, positives, "anchor").withColumn("place", F.col("rank").cast("int")).drop("rank"), "positives")
    windows = best.groupBy("block").applyInArrow(_windows_task(folder, names, firsts, positives, negatives), "block long, name string, pairs long")
    ready = scratch.keep(windows, "windows").orderBy("block").collect()
    if not ready:
        return empty

    search = _search_task(folder, [r.name for r in ready], [firsts[r.block] for r in ready], _pick_negatives(negatives))
    chosen = _first(used.mapInArrow(search, _FOUND), negatives, "anchor", "place")
    chosen = chosen.select("anchor", "place", (F.col("rank") + 1).alias("rank"), F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    pairs = best.select("anchor", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    listed = spark.createDataFrame([(r.block, r.name, firsts[r.block]) for r in ready], "block long, name string, start long")
    anchor_ids = listed.mapInArrow(_anchor_ids_task(folder), "anchor long, anchor_id long")
    out = chosen.join(pairs, ["anchor", "place"]).join(anchor_ids, "anchor")
    return out.select(
        "anchor_id", _ids("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), _ids("negative").alias("negative_id"), "positive_score", "negative_score",
    )


def _anchor_ids_task(folder: SharedFolder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = Block.load(folder, name).ids
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(ids))), pa.array(ids)], ["anchor", "anchor_id"])

    return run


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % {NOISE_EVERY} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label,
    [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, r.vec_id AS i, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM r AS a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT a, i, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, i) <= {POSITIVES})
SELECT p.a AS anchor_id, p.i AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.i ORDER BY s.score DESC, s.i) AS INTEGER) AS rank,
    s.i AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LEAST_SHARE} * p.score <= 100 * s.score AND 100 * s.score <= {MOST_SHARE} * p.score
QUALIFY rank <= {NEGATIVES}"""
}
