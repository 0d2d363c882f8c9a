"""Second-order gradient boosting over binned features.

Features are binned once at their quantiles, one byte each, and stored. Rows
with the same bins come to the same leaf of every tree, so they are sorted into
cells, and a cell is kept as its bins, number of rows, mean targets and margin.
A tree is grown level by level: every task sums gradients and curvatures of its
cells by (node, feature, bin), the sums of all tasks are added, and the driver,
which sees nothing but those sums, takes the split with the largest regularised
gain in each node. Their size depends on features, bins and depth, not on the
rows. Several models over the same rows are grown in the same jobs. Where a tree
sees a sample of the rows, each row is drawn and its cell counted once a tree.

Where the shared folder is a mounted one, all trees grow in one barrier stage:
its tasks run at the same time and keep their cells, each writes its sums for the
others to read, and all take the same splits. Otherwise each level is a job, and
the cells, the only state, are kept from tree to tree and written to the shared
folder every CHECKPOINT_TREES trees.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, work_path

BINS = 256
CHECKPOINT_TREES = 20
#: Up to so many partitions send their sums to the driver; more add them up among themselves first.
DIRECT_PARTITIONS = 64
#: Bytes of sums that a task of a barrier stage reads for one level at most, and seconds it waits for another's.
SUMS_BYTES, SUMS_WAIT = 64 << 20, 900
_QUANTILE_ACCURACY = 10_000
#: Rows of a task: no fewer, as each tree needs a job for each of its levels, and no more.
LEAST_ROWS, MOST_ROWS = 100_000, 3_000_000
#: Rows drawn at a time, so that they stay in a core's cache.
_DRAWN_AT_ONCE = 32_768


@dataclass
class Spec:
    """One model: its target column, `logistic` or `squared` loss, and how its trees grow."""

    target: str
    loss: str
    depth: int
    trees: int = 200
    rate: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    smoothing: float = 1.0  # added to the curvature of a leaf
    least_weight: float = 1.0  # curvature that each side of a split has at least
    seed: int = 42


@dataclass
class BoostedTrees:
    """A fitted model: nodes of all trees behind one another. A row goes left if its value is not above the threshold."""

    features: list[str]
    loss: str
    base: float
    roots: np.ndarray
    feature: np.ndarray  # -1 in a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # what a leaf adds to the margin
    cover: np.ndarray  # curvature of the training rows in a node
    gain: np.ndarray
    _shared: object = field(default=None, repr=False, compare=False)
    _masks: object = field(default=None, repr=False, compare=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The margin of every row of `x` (rows, features)."""
        if self._masks is None:
            self._masks = leaf_masks(self)
        if self._masks:
            return self.base + self._masked(x)
        out = np.full(len(x), self.base)
        columns = [np.ascontiguousarray(x[:, k]) for k in range(x.shape[1])]
        for first, last in zip(self.roots, [*self.roots[1:], len(self.feature)]):
            out += self._walk(columns, int(first), int(last))
        return out

    def _masked(self, x: np.ndarray) -> np.ndarray:
        """All trees at once: of the leaves that no split has closed to a row, it is in the first."""
        ends, masks, values = self._masks
        places = [np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], "left")) for f, e in ends]
        out, first = np.empty(len(x)), np.arange(values.shape[0]) * 64
        for k in range(0, len(x), 512):  # so that a core's cache holds them
            leaves = masks[0].take(places[0][k : k + 512], axis=0)
            for place, mask in zip(places[1:], masks[1:]):
                leaves &= mask.take(place[k : k + 512], axis=0)
            leaves &= np.negative(leaves)  # the lowest bit; a double's exponent tells which it is
            at = (leaves.astype(float).view(np.int64) >> 52) - 1023
            at += first
            out[k : k + 512] = values.take(at).sum(axis=1)
        return out

    def _walk(self, columns: list[np.ndarray], first: int, last: int) -> np.ndarray:
        """One tree, split by split: the rows of a node are handed on to its children."""
        values = np.empty(len(columns[0]))
        todo = [(first, None)]
        while todo:
            node, rows = todo.pop()
            f = self.feature[node]
            if f < 0:
                values[slice(None) if rows is None else rows] = self.value[node]
                continue
            own = columns[f] if rows is None else columns[f][rows]
            goes_left = ~(own > self.threshold[node])
            if rows is None:
                todo += [(self.left[node], np.flatnonzero(goes_left)), (self.right[node], np.flatnonzero(~goes_left))]
            else:
                todo += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return values

    def margin_column(self, spark: SparkSession) -> Column:
        """The margin as a column over the feature columns, in batches of arrays."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self.bare())
        shared = self._shared

        def margin(rows: pa.Array) -> pa.Array:
            x = np.column_stack([np.asarray(c.fill_null(0.0)) for c in rows.flatten()])
            return pa.array(shared.value.margins(x), pa.float64())

        # Arrow in, Arrow out: no row is a Python object
        columns = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.features)]
        return F.arrow_udf(margin, T.DoubleType())(F.struct(*columns))

    def bare(self) -> BoostedTrees:
        return BoostedTrees(**{k: v for k, v in self.__dict__.items() if k not in ("_shared", "_masks")})

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], len(self.features))
        return total / total.sum() if total.sum() > 0 else total

    def trees(self) -> list[tuple[float, dict[int, dict]]]:
        """`(weight, nodes by id)` per tree, ids from 0."""
        out = []
        for first, last in zip(self.roots.tolist(), [*self.roots.tolist()[1:], len(self.feature)]):
            nodes = {}
            for k in range(first, last):
                inner = self.feature[k] >= 0
                nodes[k - first] = {
                    "id": k - first, "value": float(self.value[k]), "cover": float(self.cover[k]), "feature": int(self.feature[k]),
                    "threshold": float(self.threshold[k]), "lo": int(self.left[k]) - first if inner else -1, "hi": int(self.right[k]) - first if inner else -1,
                }
            out.append((1.0, nodes))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as one table, all else in its one-row neighbour; an older model at `path` is replaced."""
        rows = zip(*(x.tolist() for x in (self.feature, self.threshold, self.left, self.right, self.value, self.cover, self.gain)))
        names = "id long, feature int, threshold double, left int, right int, value double, cover double, gain double"
        spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], names).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"features": self.features, "loss": self.loss, "base": self.base, "roots": self.roots.tolist()})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        rows = spark.read.parquet(f"{path}/nodes").orderBy("id").collect()
        cols = [np.array([r[c] for r in rows]) for c in ("feature", "threshold", "left", "right", "value", "cover", "gain")]
        return BoostedTrees(about["features"], about["loss"], about["base"], np.array(about["roots"]), *cols)


#: Bytes of a model's leaf masks at most; beyond, and with more than 64 leaves in a tree, rows are handed down split by split.
MASK_BYTES = 64 << 20


def leaf_masks(model: BoostedTrees) -> tuple:
    """For each feature its thresholds, and for each place between them the leaves of every tree that stay open; the leaves' values.

    After QuickScorer (Lucchese et al., 2015): a split that sends a row to the
    right closes the leaves on its left, whatever the splits above it did. Empty
    if the masks would not fit.
    """
    inner = model.feature >= 0
    used = [(int(f), np.unique(model.threshold[inner & (model.feature == f)])) for f in np.unique(model.feature[inner])]
    n_trees = len(model.roots)
    if not used or 8 * n_trees * sum(len(e) + 1 for _, e in used) > MASK_BYTES:
        return ()
    row_of = {f: k for k, (f, _) in enumerate(used)}
    masks = [np.full((len(e) + 1, n_trees), np.uint64(2**64 - 1)) for _, e in used]
    values = np.zeros((n_trees, 64))
    for t, root in enumerate(model.roots.tolist()):
        n_leaves, closed, todo = 0, [], [(root, -1)]
        while todo:  # leaves from left to right; a node comes again after its left side
            node, before = todo.pop()
            if before >= 0:
                closed.append((node, ((1 << n_leaves) - 1) ^ ((1 << before) - 1)))
            elif model.feature[node] < 0:
                if n_leaves == 64:
                    return ()
                values[t, n_leaves] = model.value[node]
                n_leaves += 1
            else:
                todo += [(int(model.right[node]), -1), (node, n_leaves), (int(model.left[node]), -1)]
        for node, left in closed:
            k = row_of[int(model.feature[node])]
            place = int(np.searchsorted(used[k][1], model.threshold[node], "left")) + 1
            masks[k][place, t] &= np.uint64(left ^ (2**64 - 1))
    return used, [np.bitwise_and.accumulate(m, axis=0) for m in masks], values


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper ends of each feature's bins but the last: its quantiles over all rows."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c), shares, _QUANTILE_ACCURACY).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q else [], float)) for q in found]


def bin_values(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value: how many edges are below it."""
    return np.searchsorted(edges, x, "left").astype(np.uint8)


def gradients(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    return margin - y, np.ones(len(y))


def best_splits(grad: np.ndarray, curve: np.ndarray, allowed: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """For sums of shape (nodes, features, bins): gain, feature and last bin on the left of each node's best split.

    Of equal gains the first feature's first bin is taken; a gain of 0 means
    that the node is not split.
    """
    gl, hl = np.cumsum(grad, axis=2)[:, :, :-1], np.cumsum(curve, axis=2)[:, :, :-1]
    g, h = grad[:, :1].sum(axis=2)[:, :, None], curve[:, :1].sum(axis=2)[:, :, None]
    gr, hr = g - gl, h - hl
    s = spec.smoothing
    gain = gl**2 / (hl + s) + gr**2 / (hr + s) - g**2 / (h + s)
    fits = (hl >= spec.least_weight) & (hr >= spec.least_weight) & allowed[None, :, None]
    gain = np.where(fits, gain, 0.0).reshape(len(grad), -1)
    at = gain.argmax(axis=1)
    best = gain[np.arange(len(gain)), at]
    return np.where(best > 1e-9, best, 0.0), at // gl.shape[2], at % gl.shape[2]


class Growing:
    """One tree while it grows, and what is kept of it afterwards."""

    def __init__(self, spec: Spec, n_features: int, number: int):
        self.spec, self.number = spec, number
        rng = np.random.default_rng((spec.seed, number))
        take = max(1, int(spec.column_share * n_features))
        self.allowed = np.zeros(n_features, bool)
        self.allowed[rng.permutation(n_features)[:take]] = True
        self.feature, self.cut, self.left, self.right = [-1], [0], [-1], [-1]
        self.value, self.cover, self.gain = [0.0], [0.0], [0.0]
        self.open = [0]
        self.place = [0]  # where the node lies when the levels of a full tree stand behind one another
        self.level = 0

    def splits(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature and cut by place, and the number of levels; a node that is not split hands all its rows to the left."""
        levels = min(self.level, self.spec.depth)
        feature, cut = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, BINS - 1, np.uint8)
        for f, c, place in zip(self.feature, self.cut, self.place):
            if f >= 0:
                feature[place], cut[place] = f, c
        return feature, cut, levels

    def shape(self) -> tuple:
        """What a task needs to sum up the open nodes: splits so far, and the place of each open node in its level."""
        return *self.splits(), [self.place[k] - (1 << self.level) + 1 for k in self.open]

    def values(self) -> tuple:
        """What a task needs to add the finished tree: its splits, and a value for each place in the level below them."""
        feature, cut, levels = self.splits()
        out = np.zeros(1 << levels)
        for f, v, place in zip(self.feature, self.value, self.place):
            if f < 0:
                depth = (place + 1).bit_length() - 1
                out[((place + 1 - (1 << depth)) << (levels - depth))] = v
        return feature, cut, levels, out

    def add_level(self, sums: np.ndarray) -> None:
        """`sums` of shape (2, open nodes, features, bins): split the open nodes."""
        spec = self.spec
        grad, curve = sums
        gain, feature, cut = best_splits(grad, curve, self.allowed, spec)
        fresh = []
        for k, node in enumerate(self.open):
            g, h = grad[k, 0].sum(), curve[k, 0].sum()
            if self.level == 0:
                self.cover[node], self.value[node] = h, -spec.rate * g / (h + spec.smoothing)
            if gain[k] <= 0 or self.level >= spec.depth:
                continue
            f, b = int(feature[k]), int(cut[k])
            gl, hl = grad[k, f, : b + 1].sum(), curve[k, f, : b + 1].sum()
            self.feature[node], self.cut[node], self.gain[node] = f, b, float(gain[k])
            for side, (gs, hs) in enumerate(((gl, hl), (g - gl, h - hl))):
                child = len(self.feature)
                (self.left if side == 0 else self.right)[node] = child
                for column, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.gain, 0.0)):
                    column.append(v)
                self.place.append(2 * self.place[node] + 1 + side)
                self.cover.append(float(hs))
                self.value.append(float(-spec.rate * gs / (hs + spec.smoothing)))
                fresh.append(child)
        self.level += 1
        self.open = fresh if self.level < spec.depth else []


def place_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The place in the level below the splits that each row (columns of `bins`) comes to."""
    n = bins.shape[1]
    flat, rows, at = bins.ravel(), np.arange(n), np.zeros(n, np.int64)
    for level in range(levels):
        first = (1 << level) - 1
        own_feature, own_cut = feature[first : 2 * first + 1] * n, cut[first : 2 * first + 1]
        right = flat.take(own_feature.take(at) + rows) > own_cut.take(at)
        at = 2 * at + right
    return at


def level_sums(bins: np.ndarray, grad: np.ndarray, curve: np.ndarray, at: np.ndarray, open_places: Sequence[int], width: int) -> np.ndarray:
    """Sums of shape (2, open nodes, features, BINS); `width` places are in the level."""
    out = np.zeros((2, len(open_places), len(bins), BINS))
    cell = at * BINS
    for f in range(len(bins)):
        own = cell + bins[f]
        for k, w in enumerate((grad, curve)):
            out[k, :, f] = np.bincount(own, w, width * BINS).reshape(width, BINS)[open_places]
    return out


def sampled(spec: Spec, number: int, draw: np.ndarray) -> np.ndarray | None:
    """Which rows the tree sees. The draw depends on the row's values alone, so rows that are alike are drawn together."""
    if spec.row_share >= 1:
        return None
    x = draw + np.uint64((spec.seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(spec.row_share * 2**64))


def _bin(features: Sequence[str], targets: Sequence[str], edges: list[np.ndarray]):
    """Rows as `(cell, targets, draw, salt)`; a cell is one byte for each feature."""

    def run(batches):
        for batch in batches:
            x = np.stack([bin_values(np.asarray(batch.column(c)), e) for c, e in zip(features, edges)], axis=1)
            cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())])
            rest = [*targets, "draw", "salt"]
            yield pa.RecordBatch.from_arrays([cell.cast(pa.binary()), *(batch.column(c) for c in rest)], ["cell", *rest])

    return run


def _pack(n_features: int, targets: Sequence[str]):
    """The rows of a task as one block, sorted by cell: bins and number of rows of each cell, targets and draw of each row."""

    def run(batches):
        cells, ys, draws, task = [], [[] for _ in targets], [], 0
        for batch in batches:
            if batch.num_rows:
                task = batch.column("task")[0].as_py()
                cells.append(np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(-1, n_features))
                for y, c in zip(ys, targets):
                    y.append(np.asarray(batch.column(c)))
                draws.append(np.asarray(batch.column("draw")))
        if not cells:
            return
        x, y, draw = np.concatenate(cells), np.stack([np.concatenate(v) for v in ys]), np.concatenate(draws).view(np.uint64)
        order = np.lexsort((draw, *x.T[::-1]))  # sums come out alike in whatever order the rows arrive
        x, y, draw = x[order], y[:, order], draw[order]
        starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
        block = np.ascontiguousarray(x[starts].T), starts, y, draw
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (task, len(starts), len(draw))] + [pa.array([v.tobytes()], pa.binary()) for v in block],
            ["task", "n_cells", "n", "bins", "starts", "targets", "draws"])

    return run


def _load(n_features: int, n_targets: int):
    """A stored block as arrays: bins of the cells, the first row of each, targets and draws of the rows."""

    def run(pair):
        r = pair[1]
        return (np.frombuffer(r["bins"], np.uint8).reshape(n_features, r["n_cells"]), np.frombuffer(r["starts"], np.int64),
                np.frombuffer(r["targets"]).reshape(n_targets, r["n"]), np.frombuffer(r["draws"], np.uint64))

    return run


def _weights(spec: Spec, number: int, starts: np.ndarray, y: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell that the tree sees, and the mean of their target."""
    sizes = np.diff(starts, append=len(draw))
    first = y.take(starts)  # sums are of differences to it, so cells with one value have exactly that
    apart = y - np.repeat(first, sizes)
    if spec.row_share >= 1:
        count = sizes.astype(float)
    else:
        drawn = np.concatenate([sampled(spec, number, draw[k : k + _DRAWN_AT_ONCE]) for k in range(0, len(draw), _DRAWN_AT_ONCE)])
        count = np.add.reduceat(drawn, starts, dtype=np.int64).astype(float)
        apart *= drawn
    return count, first + np.add.reduceat(apart, starts) / np.maximum(count, 1)


def _start(specs: list[Spec], bases: Sequence[float]):
    """The cells before the first tree: bins, margins, and what that tree sees of each."""

    def step(block):
        x, starts, targets, draw = block
        return x, [np.full(x.shape[1], b) for b in bases], [_weights(s, 0, starts, y, draw) for s, y in zip(specs, targets)]

    return step


def _advance(trees: list):
    """Adds the values of finished trees to the margins."""

    def step(state):
        x, margins, weights = state
        return x, [m if t is None else m + t[3].take(place_of(x, *t[:3])) for m, t in zip(margins, trees)], weights

    return step


def _draw_again(specs: list[Spec], number: int):
    """What the next tree sees of each cell."""

    def step(pair):
        (x, margins, weights), (_, starts, targets, draw) = pair
        fresh = [_weights(s, number, starts, y, draw) if s.row_share < 1 and number < s.trees else w for s, w, y in zip(specs, weights, targets)]
        return x, margins, fresh

    return step


def _sum_level(specs: list[Spec], shapes: list):
    def step(state):
        x, margins, weights = state
        out = []
        for spec, shape, margin, (count, target) in zip(specs, shapes, margins, weights):
            if shape is None:
                out.append(None)
                continue
            *splits, open_places = shape
            grad, curve = gradients(spec.loss, margin, target)
            out.append(level_sums(x, count * grad, count * curve, place_of(x, *splits), open_places, 1 << splits[2]))
        return out

    return step


def _add(a: list, b: list) -> list:
    return [x if y is None else y if x is None else x + y for x, y in zip(a, b)]


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _cores_at_once(spark: SparkSession) -> int:
    """Tasks that surely run at the same time; 0 if executors may come and go."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    scala = context._jsc.sc()
    return scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())


def _mounted(path: str) -> str | None:
    """The path as Python opens it, if it is one of a mounted folder."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") and "://" not in path else None


def _level_bytes(specs: list[Spec], edges: list[np.ndarray]) -> int:
    """Bytes of one task's sums of the widest level."""
    return sum(1 << max(s.depth - 1, 0) for s in specs) * sum(len(e) + 1 for e in edges) * 2 * 8


class _Sums:
    """The sums of the tasks of a barrier stage, a folder for each level; those of two levels are kept."""

    def __init__(self, folder: str, task: int, tasks: int, edges: list[np.ndarray]):
        self.folder, self.task, self.tasks, self.level = folder, task, tasks, 0
        self.widths = [len(e) + 1 for e in edges]  # a feature's further bins are empty

    def added(self, own: list | None, shapes: list) -> list:
        """This task's sums and those of all others, added up in the tasks' order."""
        at = f"{self.folder}/{self.level}"
        os.makedirs(at, exist_ok=True)
        flat = [] if own is None else [s[:, :, f, :w].ravel() for s in own if s is not None for f, w in enumerate(self.widths)]
        with open(f"{at}/{self.task}.part", "wb") as out:
            out.write(np.concatenate(flat).tobytes() if flat else b"")
        os.rename(f"{at}/{self.task}.part", f"{at}/{self.task}")
        total = None
        for task in range(self.tasks):
            if len(data := self._read(f"{at}/{task}")):
                sums = self._sums(data, shapes)
                total = sums if total is None else _add(total, sums)
        if self.task == 0 and self.level > 1:  # who has written a level has read the one before
            shutil.rmtree(f"{self.folder}/{self.level - 2}", ignore_errors=True)
        self.level += 1
        return total

    def _read(self, path: str) -> np.ndarray:
        until, pause = time.monotonic() + SUMS_WAIT, 0.0005
        while True:
            try:
                with open(path, "rb") as f:
                    return np.frombuffer(f.read())
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no sums in {path}") from None
            time.sleep(pause)
            pause = min(2 * pause, 0.01)

    def _sums(self, flat: np.ndarray, shapes: list) -> list:
        out, at = [], 0
        for shape in shapes:
            if shape is None:
                out.append(None)
                continue
            n = len(shape[-1])
            sums = np.zeros((2, n, len(self.widths), BINS))
            for f, w in enumerate(self.widths):
                sums[:, :, f, :w] = flat[at : at + 2 * n * w].reshape(2, n, w)
                at += 2 * n * w
            out.append(sums)
        return out


def _grow(specs: list[Spec], n_features: int, sum_up: Callable, advance: Callable) -> list[list[Growing]]:
    """The trees of all models. `sum_up` gives a level's sums over all cells, `advance` adds finished trees to the margins."""
    done: list[list[Growing]] = [[] for _ in specs]
    for number in range(max(s.trees for s in specs)):
        growing = [Growing(s, n_features, number) if number < s.trees else None for s in specs]
        while any(g is not None and g.open for g in growing):
            shapes = [g.shape() if g is not None and g.open else None for g in growing]
            for g, s in zip(growing, sum_up(shapes)):
                if s is not None:
                    g.add_level(s)
        for trees, g in zip(done, growing):
            if g is not None:
                trees.append(g)
        advance(number, [None if g is None else g.values() for g in growing])
    return done


def _grow_in_step(specs: list[Spec], bases: Sequence[float], edges: list[np.ndarray], folder: str):
    """One task of the barrier stage: its blocks stay with it, and all tasks grow the same trees. The first hands them on."""

    def run(pairs):
        context, load = BarrierTaskContext.get(), _load(len(edges), len(specs))
        blocks = [load(p) for p in pairs]
        states = [_start(specs, bases)(b) for b in blocks]
        drawing = any(s.row_share < 1 for s in specs)
        names = context.allGather(uuid.uuid4().hex)  # a stage that is tried again takes another folder
        shared = _Sums(f"{folder}/{names[0]}", context.partitionId(), len(names), edges)

        def sum_up(shapes):
            own = None
            for state in states:
                sums = _sum_level(specs, shapes)(state)
                own = sums if own is None else _add(own, sums)
            return shared.added(own, shapes)

        def advance(number, trees):
            states[:] = map(_advance(trees), states)
            if drawing:
                states[:] = map(_draw_again(specs, number + 1), zip(states, blocks))

        done = _grow(specs, len(edges), sum_up, advance)
        if context.partitionId() == 0:
            yield done

    return run


def _grow_by_jobs(spark: SparkSession, blocks: RDD, specs: list[Spec], bases: Sequence[float], n_features: int) -> list[list[Growing]]:
    """A job for every level, with as many tasks as there are blocks."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    states = [blocks.map(_start(specs, bases)).persist(StorageLevel.MEMORY_AND_DISK)]  # and the one before, which the next job still reads
    parts, drawing = blocks.getNumPartitions(), any(s.row_share < 1 for s in specs)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_path(spark, "boost-margins"))

    def sum_up(shapes):
        sums = states[-1].map(_sum_level(specs, shapes))
        if parts > DIRECT_PARTITIONS:
            return sums.treeReduce(_add, depth=2)
        total = None
        for s in sums.collect():  # a bounded number of sums, whose size does not depend on the rows
            total = s if total is None else _add(total, s)
        return total

    def advance(number, trees):
        following = states[-1].map(_advance(trees))
        if drawing:
            following = following.zip(blocks).map(_draw_again(specs, number + 1))
        following = following.persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT_TREES == CHECKPOINT_TREES - 1:
            following.checkpoint()
            following.count()
        states.append(following)
        if len(states) > 2:
            states.pop(0).unpersist()

    done = _grow(specs, n_features, sum_up, advance)
    for rdd in (*states, blocks):
        rdd.unpersist()
    return done


def fit_boosted(train: DataFrame, features: Sequence[str], specs: Sequence[Spec], edges: list[np.ndarray] | None = None) -> list[BoostedTrees]:
    """Fit one model for each of `specs`, all in the same jobs.

    Null features count as 0; rows without a target take no part in any model.
    Without rows every model is its base value.
    """
    spark, features, specs = train.sparkSession, list(features), list(specs)
    targets = [s.target for s in specs]
    rows = train.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)],
        *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(targets)],
    ).na.drop()
    rows = rows.withColumn("draw", F.xxhash64(*rows.columns))
    xs, ys = [f"x{k}" for k in range(len(features))], [f"y{k}" for k in range(len(targets))]
    rows = materialize(rows, "boost-rows")
    means = rows.agg(*[F.avg(y) for y in ys], F.count("*")).first()
    n = means[-1]
    tasks = max(-(-n // MOST_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    bases = [0.0 if m is None else _log_odds(m) if s.loss == "logistic" else float(m) for m, s in zip(means, specs)]
    if means[0] is None:
        return [_assemble([], features, s, b, edges or []) for s, b in zip(specs, bases)]
    edges = edges or bin_edges(rows, xs)
    columns = ", ".join(f"{y} double" for y in ys)
    binned = rows.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(_bin(xs, ys, edges), f"cell binary, {columns}, draw long, salt long")
    # a cell lies in one task, or in neighbours; even equal rows, however many, are dealt out
    dealt = binned.repartitionByRange(tasks, "cell", "draw", "salt").withColumn("task", F.spark_partition_id().cast("long"))
    kinds = "task long, n_cells long, n long, bins binary, starts binary, targets binary, draws binary"
    packed = materialize(dealt.mapInArrow(_pack(len(features), ys), kinds), "boost-bins")
    placed = packed.rdd.map(lambda r: (r["task"], r))
    at_once, folder = min(tasks, _cores_at_once(spark)), _mounted(work_path(spark, "boost-sums"))
    if folder and at_once and at_once * _level_bytes(specs, edges) <= SUMS_BYTES:
        grown = placed.partitionBy(at_once, lambda task: task).barrier().mapPartitions(_grow_in_step(specs, bases, edges, folder))
        done = grown.collect()[0]
        shutil.rmtree(folder, ignore_errors=True)
    else:
        done = _grow_by_jobs(spark, placed.partitionBy(tasks, lambda task: task).map(_load(len(features), len(targets))), specs, bases, len(features))
    return [_assemble(trees, features, s, b, edges) for trees, s, b in zip(done, specs, bases)]


def _assemble(trees: list[Growing], features: list[str], spec: Spec, base: float, edges: list[np.ndarray]) -> BoostedTrees:
    roots, columns, at = [], [[] for _ in range(7)], 0
    for t in trees:
        roots.append(at)
        threshold = [float(edges[f][c]) if f >= 0 and c < len(edges[f]) else np.inf for f, c in zip(t.feature, t.cut)]
        shifted = [[x + at if x >= 0 else -1 for x in side] for side in (t.left, t.right)]
        for column, values in zip(columns, (t.feature, threshold, *shifted, t.value, t.cover, t.gain)):
            column += values
        at += len(t.feature)
    kinds = np.int32, float, np.int32, np.int32, float, float, float
    return BoostedTrees(list(features), spec.loss, base, np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds)))
