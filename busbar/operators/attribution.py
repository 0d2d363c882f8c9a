"""Per-row feature contributions of a boosted-tree model.

Path-dependent Shapley values, computed leaf by leaf. A leaf with m distinct
features is a product game: feature j either keeps the row on the path (0 or 1)
or, when unknown, lets the share of training rows through that the path keeps.
Its Shapley values are sums over polynomials with m factors. A leaf of few
features has few outcomes, whose values are worked out once on the driver and
added up over the grid of a tree's thresholds, and of many trees' where they
split in the same places; a task turns each row into the number of its cell in
such a grid and adds table rows, so a row takes a lookup for each tree at most
where a tree splits few features, not one for each leaf. For leaves of many
features the polynomials are worked out for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .boosting import BoostedTrees


def _leaf(value: float, path: list[tuple[int, float, bool, float]], tree: int):
    """Bounds of one leaf, and for each of its features the share of training rows that the path lets through: `(features, lower, upper, shares, value, tree)`."""
    feats: list[int] = []
    lower: dict[int, float] = {}
    upper: dict[int, float] = {}
    share: dict[int, float] = {}
    for f, threshold, left, kept in path:
        if f not in share:
            feats.append(f)
            lower[f], upper[f], share[f] = -np.inf, np.inf, 1.0
        if left:
            upper[f] = min(upper[f], threshold)
        else:
            lower[f] = max(lower[f], threshold)
        share[f] *= kept
    return feats, [lower[f] for f in feats], [upper[f] for f in feats], np.array([share[f] for f in feats]), value, tree


def shapley(on: np.ndarray, shares: np.ndarray, value: float | np.ndarray) -> np.ndarray:
    """Shapley values of one leaf's features, (features, rows), from whether each keeps a row on the path.

    Coefficient s of the product over j != i of (on_j z + share_j) sums up all
    coalitions of s features without i, so the work is a power of the number of
    features, not their number of subsets. Leaves of as many features go together
    as (features, leaves, rows): `on` then has one leaf, `shares` one row.
    """
    m, shape = len(on), np.broadcast_shapes(on.shape[1:], shares.shape[1:])
    weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    out = np.empty((m, *shape))
    for i in range(m):
        coef = np.zeros((m, *shape))
        coef[0] = 1
        for j in range(m):
            if j != i:
                grown = coef * shares[j]
                grown[1:] += coef[:-1] * on[j]
                coef = grown
        out[i] = value * (on[i] - shares[i]) * np.tensordot(weight, coef, 1)
    return out


def leaf_tables(trees: list[tuple[float, dict[int, dict]]]):
    """All leaves of the ensemble and the expected margin."""
    leaves, base = [], 0.0
    for tree, (weight, nodes) in enumerate(trees):
        stack = [(0, [])]
        while stack:
            i, path = stack.pop()
            n = nodes[i]
            if n["lo"] < 0:
                leaf = _leaf(weight * n["value"], path, tree)
                base += leaf[4] * float(np.prod(leaf[3]))
                if leaf[0]:
                    leaves.append(leaf)
                continue
            for child, left in ((n["lo"], True), (n["hi"], False)):
                kept = nodes[child]["cover"] / n["cover"]
                stack.append((child, [*path, (n["feature"], n["threshold"], left, kept)]))
    return leaves, base


#: Leaves with at most so many features have their outcomes tabled; others are worked out row by row.
TABLE_FEATURES = 8
#: Bytes of a model's tables at most, if single leaves do not need more.
TABLE_BYTES = 64 << 20
#: Rows looked up at a time, so that they stay in a core's cache.
_ROWS_AT_ONCE = 4096


class Block:
    """Leaves that are looked up together: for each feature the class of every place, and the leaves' sum in every cell.

    Places in which every leaf of the block has the same answer are one class,
    and a cell is one class of each feature.
    """

    def __init__(self, feats: list[int], classes: list[np.ndarray], table: np.ndarray, leaves: int):
        self.feats, self.classes, self.table, self.leaves = feats, classes, table, leaves

    def offsets(self) -> list[np.ndarray]:
        """What each place of a feature adds to the number of a row's cell."""
        steps = np.cumprod([1, *self.table.shape[:0:-1]])[-2::-1]
        return [(c * step).astype(np.intp) for c, step in zip(self.classes, steps)]


def _classes(answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one number for each place: a place of each different number, and for each place which of them it has."""
    _, where, of_place = np.unique(answers, return_index=True, return_inverse=True)
    return where, of_place


def _entries(classes: Sequence[tuple[np.ndarray, np.ndarray]]) -> int:
    return len(classes) * prod(len(where) for where, _ in classes)


def _tabled(run: list[tuple], places: list[int], entries_a_leaf: float) -> list[Block]:
    """Neighbouring leaves, 64 at most, as few blocks, each of at most so many entries a leaf; a single leaf may have more."""
    answers = {f: np.zeros(places[f], np.uint64) for leaf in run for f in leaf[0]}  # bit k tells whether leaf k is open to the place
    for k, (own, first, last, _) in enumerate(run):
        bounds = dict(zip(own, zip(first, last)))
        for f, answer in answers.items():
            start, end = bounds.get(f, (0, len(answer) - 1))
            answer[start : end + 1] |= np.uint64(1 << k)
    out, todo = [], [(0, len(run))]
    while todo:
        start, end = todo.pop()
        feats = sorted({f for leaf in run[start:end] for f in leaf[0]})
        bits = np.uint64((1 << end) - (1 << start))
        classes = [_classes(answers[f] & bits) for f in feats]
        if end - start > 1 and _entries(classes) > entries_a_leaf * (end - start):
            half = (start + end) // 2
            todo += [(half, end), (start, half)]
            continue
        table = np.zeros((len(feats), *(len(where) for where, _ in classes)))
        for k in range(start, end):
            own, _, _, outcomes = run[k]
            axes, code = [feats.index(f) for f in own], np.zeros([1] * len(feats), np.intp)
            for bit, (f, axis) in enumerate(zip(own, axes)):
                is_open = (answers[f][classes[axis][0]] >> np.uint64(k)) & np.uint64(1)
                code = code | (is_open.astype(np.intp) << bit).reshape([-1 if j == axis else 1 for j in range(len(feats))])
            for axis, column in zip(axes, outcomes):
                table[axis] += column.take(code)
        out.append(Block(feats, [of_place for _, of_place in classes], table, end - start))
    return out


def _union(blocks: list[Block]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each feature the classes of all blocks together."""
    out = []
    for classes in zip(*(b.classes for b in blocks)):
        where, together = _classes(classes[0])
        for c in classes[1:]:
            where, together = _classes(together * (int(c.max()) + 1) + c)
        out.append((where, together))
    return out


def _sum(blocks: list[Block]) -> Block:
    """One block for those of the same features."""
    if len(blocks) == 1:
        return blocks[0]
    halves = [_sum(blocks[: len(blocks) // 2]), _sum(blocks[len(blocks) // 2 :])]
    classes = _union(halves)
    table = sum(h.table[np.ix_(range(len(h.feats)), *(c[where] for c, (where, _) in zip(h.classes, classes)))] for h in halves)
    return Block(halves[0].feats, [of_place for _, of_place in classes], table, sum(h.leaves for h in halves))


def _joined(blocks: list[Block], entries_a_leaf: float) -> list[Block]:
    """Blocks of the same features as few blocks, each of at most so many entries a leaf."""
    if len(blocks) == 1:
        return blocks
    if _entries(_union(blocks)) <= entries_a_leaf * sum(b.leaves for b in blocks):
        return [_sum(blocks)]
    half = len(blocks) // 2
    return _joined(blocks[:half], entries_a_leaf) + _joined(blocks[half:], entries_a_leaf)


class LeafGrid:
    """The leaves of a model over the intervals between its thresholds.

    A value is turned into the number of its interval, its place, once for the
    whole model; a leaf's bounds are then a range of places. The leaves of a tree,
    or of many trees that split the same features in the same places, are tabled
    as one block, as far as TABLE_BYTES allows for their number.
    """

    def __init__(self, leaves, dim: int):
        ends = [set() for _ in range(dim)]
        for feats, lower, upper, *_ in leaves:
            for f, lo, hi in zip(feats, lower, upper):
                ends[f] |= {v for v in (lo, hi) if np.isfinite(v)}
        self.ends = [np.array(sorted(e)) for e in ends]
        runs: list[list] = []
        self.wide, tree_before = [], None
        for (feats, lower, upper, shares, value, tree), outcomes in zip(leaves, _outcomes(leaves)):
            first = [int(np.searchsorted(self.ends[f], lo, "left")) + 1 if np.isfinite(lo) else 0 for f, lo in zip(feats, lower)]
            last = [int(np.searchsorted(self.ends[f], hi, "left")) if np.isfinite(hi) else len(self.ends[f]) for f, hi in zip(feats, upper)]
            last = [max(a, b) for a, b in zip(first, last)]
            if outcomes is None:
                self.wide.append((feats, first, last, shares, value))
                continue
            if tree != tree_before or len(runs[-1]) == 64:
                runs.append([])
            runs[-1].append((feats, first, last, outcomes))
            tree_before = tree
        places, entries_a_leaf = [len(e) + 1 for e in self.ends], TABLE_BYTES / 8 / max(len(leaves), 1)
        alike: dict[tuple, list[Block]] = {}
        for run in runs:
            for block in _tabled(run, places, entries_a_leaf):
                alike.setdefault(tuple(block.feats), []).append(block)
        self.groups = []  # features, and (offsets, cells) of each block over them
        for feats, blocks in alike.items():
            tables = [(b.offsets(), np.ascontiguousarray(b.table.reshape(len(feats), -1).T)) for b in _joined(blocks, entries_a_leaf)]
            self.groups.append((list(feats), tables))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Contribution of every feature for every row of `x`."""
        out = np.zeros(x.shape)
        for k in range(0, len(x), _ROWS_AT_ONCE):
            place = [np.searchsorted(e, x[k : k + _ROWS_AT_ONCE, f], "left") for f, e in enumerate(self.ends)]
            own = out[k : k + _ROWS_AT_ONCE]
            for feats, tables in self.groups:
                total = np.zeros((len(own), len(feats)))
                for offsets, table in tables:
                    at = offsets[0].take(place[feats[0]])
                    for f, offset in zip(feats[1:], offsets[1:]):
                        at += offset.take(place[f])
                    total += table.take(at, axis=0)
                own[:, feats] += total
            for feats, first, last, shares, value in self.wide:
                on = np.stack([(a <= place[f]) & (place[f] <= b) for f, a, b in zip(feats, first, last)]).astype(np.uint8)
                for f, column in zip(feats, shapley(on, shares, value)):
                    own[:, f] += column
        return out


def _outcomes(leaves) -> list[np.ndarray | None]:
    """For each leaf its features' values, (features, outcomes), where bit j of an outcome tells whether feature j keeps a row on the path."""
    out: list[np.ndarray | None] = [None] * len(leaves)
    for m in range(1, TABLE_FEATURES + 1):
        every = ((np.arange(1 << m)[None, :] >> np.arange(m)[:, None]) & 1)[:, None, :]
        own = [k for k, leaf in enumerate(leaves) if len(leaf[0]) == m]
        for at in range(0, len(own), 1024):
            some = own[at : at + 1024]
            shares, values = np.array([leaves[k][3] for k in some]).T[:, :, None], np.array([leaves[k][4] for k in some])[:, None]
            tables = shapley(every, shares, values)
            for j, k in enumerate(some):
                out[k] = tables[:, j]
    return out


def contributions(x: np.ndarray, leaves) -> np.ndarray:
    return LeafGrid(leaves, x.shape[1]).contributions(x)


def explain_top_k(df: DataFrame, key: str, classifier: BoostedTrees, features: Sequence[str], k: int = 5) -> DataFrame:
    """`key`, base margin, row margin and the `k` strongest contributions.

    The contributions of all features plus the base add up to the margin; that
    sum is returned as `explained`.
    """
    spark = df.sparkSession
    leaves, base = leaf_tables(classifier.trees())
    base += classifier.base
    shared = spark.sparkContext.broadcast((LeafGrid(leaves, len(classifier.features)), classifier.bare()))
    raw = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{j}") for j, c in enumerate(classifier.features)]
    rows = df.select(F.col(key), *raw)
    names, dim = list(features), len(features)
    entry = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()),
         T.StructField("contribution", T.DoubleType())]
    )
    schema = T.StructType(
        [rows.schema[key], T.StructField("margin", T.DoubleType()), T.StructField("explained", T.DoubleType()),
         T.StructField("top", T.ArrayType(entry))]
    )
    arrow = to_arrow_schema(schema)
    top = min(k, dim)

    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = np.column_stack([np.asarray(c) for c in batch.columns[1:]])
            grid, model = shared.value
            phi = grid.contributions(x)
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top]
            at = (order + np.arange(0, n * dim, dim)[:, None]).ravel()
            entries = pa.StructArray.from_arrays(
                [pa.array(names).take(pa.array(order.ravel())), pa.array(x.ravel().take(at)), pa.array(phi.ravel().take(at))],
                fields=list(arrow.field("top").type.value_type),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * top + 1, top), type=pa.int32()), entries)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.margins(x)), pa.array(base + phi.sum(axis=1)), lists.cast(arrow.field("top").type)],
                schema=arrow,
            )

    return rows.mapInArrow(scan, schema).withColumn("base", F.lit(base))
