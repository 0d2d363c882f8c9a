"""Contributions of many trees against a plain sum over leaves, and the work that a row takes."""

import time

import numpy as np
import pytest

from busbar.operators import attribution, boosting


def random_model(x, trees, depth, seen, seed=0):
    """Trees over rows `x` that split a random one of `seen` features at one of its values."""
    rng = np.random.default_rng(seed)
    nodes, roots = [], []

    def grow(rows, level, features):
        k = len(nodes)
        nodes.append(None)
        f = int(rng.choice(features))
        cuts = np.unique(x[rows, f])[:-1]
        if level == depth or not len(cuts):
            nodes[k] = (-1, 0.0, -1, -1, rng.normal(), len(rows), 0.0)
        else:
            cut = float(rng.choice(cuts))
            lo, hi = (grow(rows[side], level + 1, features) for side in (x[rows, f] <= cut, x[rows, f] > cut))
            nodes[k] = (f, cut, lo, hi, 0.0, len(rows), 1.0)
        return k

    for _ in range(trees):
        roots.append(grow(np.arange(len(x)), 0, rng.permutation(x.shape[1])[:seen]))
    kinds = np.int32, float, np.int32, np.int32, float, float, float
    columns = [np.array(c, t) for c, t in zip(zip(*nodes), kinds)]
    return boosting.BoostedTrees([f"f{k}" for k in range(x.shape[1])], "logistic", 0.25, np.array(roots), *columns)


def leaf_by_leaf(x, leaves):
    out = np.zeros(x.shape)
    for feats, lower, upper, shares, value, *_ in leaves:
        on = np.stack([((x[:, f] > lo) | (lo == -np.inf)) & (x[:, f] <= hi) for f, lo, hi in zip(feats, lower, upper)]).astype(float)
        out[:, feats] += attribution.shapley(on, shares, value).T
    return out


@pytest.mark.parametrize(("dim", "seen", "digits"), [(4, 3, 1), (4, 4, 9), (12, 9, 9)])
def test_tables_hold_what_the_leaves_add(monkeypatch, dim, seen, digits):
    """Whether leaves, trees or many trees are tabled together: the values are the leaves', also on the thresholds."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(1500, dim)), digits)
    model = random_model(x, 24, 6, seen)
    leaves, base = attribution.leaf_tables(model.trees())
    rows = np.concatenate([x[:300], rng.choice(model.threshold[model.feature >= 0], (300, dim))])
    rows[0], rows[1], rows[2, 0] = np.inf, -np.inf, np.inf
    want = leaf_by_leaf(rows, leaves)
    assert np.allclose(base + model.base + want.sum(axis=1), model.margins(rows), atol=1e-9)
    lookups = {}
    for size in (0, 4 << 20, attribution.TABLE_BYTES):
        monkeypatch.setattr(attribution, "TABLE_BYTES", size)
        grid = attribution.LeafGrid(leaves, dim)
        assert np.allclose(grid.contributions(rows), want, atol=1e-12)
        lookups[size] = sum(len(tables) for _, tables in grid.groups)
        held = sum(cells.nbytes for _, tables in grid.groups for _, cells in tables)
        assert size == 0 or held <= size
    # a leaf each, and as few as there is room for; coarse values are split in the same places by all trees of the same features
    assert lookups[0] == len(leaves) and lookups[attribution.TABLE_BYTES] < len(leaves) / 4
    assert digits > 1 or lookups[attribution.TABLE_BYTES] <= 4


def test_a_row_takes_a_lookup_a_tree_not_a_leaf():
    """All thresholds differ, so no two trees are tabled together; still the work is of the order of finding the leaves."""
    x = np.random.default_rng(2).normal(size=(4000, 4))
    model = random_model(x, 60, 6, 3)
    grid = attribution.LeafGrid(attribution.leaf_tables(model.trees())[0], 4)

    def seconds(work):
        work(x)
        took = []
        for _ in range(5):
            began = time.perf_counter()
            work(x)
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(grid.contributions) < 15 * seconds(model.margins)


def test_rows_explained(spark):
    """Null features count as 0, keys may be null or repeat, and the strongest contributions come first."""
    x = np.round(np.random.default_rng(3).normal(size=(400, 5)), 2)
    model = random_model(x, 10, 4, 4)
    data = [(None if i % 50 == 0 else f"r{i // 2}", *(None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    names = [f"f{j}" for j in range(5)]
    df = spark.createDataFrame(data, "key string, " + ", ".join(f"{c} double" for c in names))
    got = attribution.explain_top_k(df, "key", model, names, 3).collect()
    leaves, base = attribution.leaf_tables(model.trees())
    own = np.array([[0.0 if v is None else v for v in r[1:]] for r in data])
    phi, margins = leaf_by_leaf(own, leaves), model.margins(own)
    want = []
    for (key, *_), values, p, margin in zip(data, own, phi, margins):
        best = sorted(range(5), key=lambda j: -abs(p[j]))[:3]
        want.append((key or "", tuple(names[j] for j in best), tuple(values[best]), tuple(p[best].round(9)), round(margin, 9)))
    found = [(r["key"] or "", tuple(e["feature"] for e in r["top"]), tuple(e["value"] for e in r["top"]),
              tuple(round(e["contribution"], 9) for e in r["top"]), round(r["margin"], 9)) for r in got]
    assert sorted(found) == sorted(want)
    assert all(r["explained"] == pytest.approx(r["margin"], abs=1e-9) and r["base"] == pytest.approx(base + model.base) for r in got)
