"""Boosted trees against a plain program that sees all rows at once, and what a model must keep."""

import numpy as np
import pytest

from busbar.operators import attribution, boosting, stability


def rows(n, seed, dim=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2)
    score = x[:, 0] * x[:, 1 % dim] + 0.5 * (x[:, dim - 1] > 0.3)
    return x, score + 0.1 * rng.normal(size=n), (score + 0.3 * rng.normal(size=n) > 0).astype(float)


def frame(spark, x, target, label, parts=3):
    names = ", ".join(f"f{k} double" for k in range(x.shape[1]))
    data = [(*map(float, r), float(t), float(c)) for r, t, c in zip(x, target, label)]
    return spark.createDataFrame(data, f"{names}, target double, label double").repartition(parts)


def plain_fit(x, y, loss, depth, trees, rate, edges, base, smoothing=1.0, least=1.0):
    """Margins of the training rows after each tree: every split is tried on the rows themselves."""
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        if loss == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
        else:
            g, h = margin - y, np.ones(len(y))
        step = np.zeros(len(y))

        def grow(own, level):
            gs, hs = g[own].sum(), h[own].sum()
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        left = own[x[own, f] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        gr, hr = gs - gl, hs - hl
                        if hl < least or hr < least:
                            continue
                        gain = gl**2 / (hl + smoothing) + gr**2 / (hr + smoothing) - gs**2 / (hs + smoothing)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, cut))
            if best[1] is None:
                step[own] = -rate * gs / (hs + smoothing)
                return
            f, cut = best[1]
            grow(own[x[own, f] <= cut], level + 1)
            grow(own[x[own, f] > cut], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.mark.parametrize(("loss", "depth"), [("logistic", 3), ("squared", 2)])
def test_fit_equals_a_plain_program(spark, loss, depth):
    x, target, label = rows(240, 1)
    y = label if loss == "logistic" else target
    df = frame(spark, x, target, label)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    edges = [e[:: max(1, len(e) // 40)] for e in edges]
    spec = boosting.Spec("label" if loss == "logistic" else "target", loss, depth, trees=6, rate=0.3)
    model = boosting.fit_boosted(df, ["f0", "f1", "f2"], [spec], edges)[0]
    want = plain_fit(x, y, loss, depth, 6, 0.3, edges, model.base)
    assert np.allclose(model.margins(x), want[-1], atol=1e-9)
    assert model.base == pytest.approx(np.log(y.mean() / (1 - y.mean())) if loss == "logistic" else y.mean())
    assert len(model.roots) == 6 and model.importances().sum() == pytest.approx(1)


def test_column_equals_arrays_and_reload(spark, tmp_path):
    x, target, label = rows(500, 2)
    df = frame(spark, x, target, label)
    names = ["f0", "f1", "f2"]
    cls, reg = stability.fit_models(df, names, "label", "target", trees=60, classifier_depth=4, regressor_depth=3)
    got = stability.predict_batch(df, cls, reg, names).toPandas()
    own = got[names].to_numpy()
    assert np.allclose(got.pred_prob_unstable, 1 / (1 + np.exp(-cls.margins(own))), atol=1e-12)
    assert np.allclose(got.pred_stab_score, reg.margins(own), atol=1e-12)
    assert ((got.pred_prob_unstable >= 0.5) == (got.label == 1)).mean() > 0.85
    # the target is a product of two features, which few shallow trees follow slowly; that they follow rightly is tested above
    assert np.abs(got.pred_stab_score - got.target).mean() < 0.75 * np.abs(got.target - got.target.mean()).mean()
    path = f"file://{tmp_path}/model"
    stability.save_model(cls, spark, path)
    again = stability.load_model(spark, path)
    assert np.array_equal(again.margins(own), cls.margins(own)) and again.features == names


def test_sampling_and_partitions(spark):
    """The sample depends on the rows' values, so neither another call nor another partitioning changes the model."""
    x, target, label = rows(600, 3)
    spec = boosting.Spec("target", "squared", 4, trees=30, row_share=0.8, column_share=0.8)
    df = frame(spark, x, target, label, 2).cache()
    names = ["f0", "f1", "f2"]
    one, two = (boosting.fit_boosted(d, names, [spec])[0] for d in (df, df.repartition(5)))
    assert np.allclose(one.margins(x), two.margins(x), atol=1e-9)
    err = np.abs(one.margins(x) - target).mean()
    assert err < 0.75 * np.abs(target - target.mean()).mean()
    drawn = boosting.sampled(spec, 3, np.arange(10**5, dtype=np.uint64) << np.uint64(20))
    assert abs(drawn.mean() - 0.8) < 0.01
    for t in range(30):  # two of three columns are open to a tree
        nodes = one.feature[one.roots[t] : one.roots[t + 1] if t < 29 else None]
        assert len(set(nodes[nodes >= 0].tolist())) <= 2


def test_awkward_rows(spark):
    names = "f0 double, f1 double, target double"
    none = spark.createDataFrame([], names)
    spec = boosting.Spec("target", "squared", 3, trees=2)
    model = boosting.fit_boosted(none, ["f0", "f1"], [spec])[0]
    assert model.margins(np.zeros((2, 2))).tolist() == [0, 0]
    same = spark.createDataFrame([(1.0, None, 2.0)] * 5 + [(1.0, 0.0, None)], names)
    model = boosting.fit_boosted(same, ["f0", "f1"], [spec])[0]
    assert model.margins(np.array([[1.0, 0.0]]))[0] == pytest.approx(2)
    got = same.select(model.margin_column(spark).alias("m")).collect()
    assert all(r.m == pytest.approx(2) for r in got)


def test_contributions_of_a_wide_model(spark):
    x, target, label = rows(800, 4, dim=30)
    names = [f"f{k}" for k in range(30)]
    df = frame(spark, x, target, label)
    cls, _ = stability.fit_models(df, names, "label", "target", trees=15)
    got = attribution.explain_top_k(df.withColumn("id", df.f0), "id", cls, names, 5).collect()
    assert len(got) == 800
    for r in got[:100]:
        assert r["explained"] == pytest.approx(r["margin"], abs=1e-9) and len(r["top"]) == 5


def test_leaves_of_many_features(spark, monkeypatch):
    """Without tables the values are the same, and deep trees over many features are no matter of subsets."""
    x, target, label = rows(400, 5, dim=14)
    names = [f"f{k}" for k in range(14)]
    spec = boosting.Spec("target", "squared", 12, trees=3, least_weight=0.5, smoothing=0.1)
    model = boosting.fit_boosted(frame(spark, x, target, label), names, [spec])[0]
    leaves, base = attribution.leaf_tables(model.trees())
    assert max(len(leaf[0]) for leaf in leaves) >= 7
    tabled = attribution.contributions(x, leaves)
    monkeypatch.setattr(attribution, "TABLE_FEATURES", 0)
    worked = attribution.contributions(x, leaves)
    assert np.allclose(tabled, worked, atol=1e-12)
    assert np.allclose(base + model.base + worked.sum(axis=1), model.margins(x), atol=1e-9)


def test_work_follows_cells(spark, monkeypatch):
    """Rows with the same bins are summed up as one cell, however many; rows drawn for a tree are the same as before."""
    x, target, label = rows(3000, 6)
    x = np.round(x)
    df = frame(spark, x, target, label).cache()
    names = ["f0", "f1", "f2"]
    specs = [boosting.Spec("label", "logistic", 3, trees=4, row_share=0.8), boosting.Spec("target", "squared", 3, trees=4)]
    models = boosting.fit_boosted(df, names, specs)
    edges = [np.array(sorted({r[f] for r in x.tolist()}))[:-1] for f in range(3)]
    bins = np.stack([boosting.bin_values(x[:, f], e) for f, e in enumerate(edges)])
    cells, of_row = np.unique(bins, axis=1, return_inverse=True)
    order = np.argsort(of_row.ravel(), kind="stable")
    starts = np.searchsorted(of_row.ravel()[order], np.arange(cells.shape[1]))
    draw = np.array([r[0] for r in df.select("f0", "f1", "f2", df.label.alias("y0"), df.target.alias("y1")).selectExpr("xxhash64(*)").collect()]).view(np.uint64)
    got = [r for r in df.collect()]
    y = np.array([r["label"] for r in got])
    own = np.stack([boosting.bin_values(np.array([r[f"f{f}"] for r in got]), e) for f, e in enumerate(edges)])
    place = np.array([np.flatnonzero((cells == c[:, None]).all(axis=0))[0] for c in own.T])
    order = np.argsort(place, kind="stable")
    count, mean = boosting._weights(specs[0], 0, starts, y[order], draw[order])
    drawn = boosting.sampled(specs[0], 0, draw)
    assert np.array_equal(count, np.bincount(place[drawn], minlength=len(starts)))
    assert np.allclose(count * mean, np.bincount(place[drawn], y[drawn], len(starts)))
    # the first tree's root sees the drawn rows, each with the curvature of the base value
    p = y.mean()
    assert models[0].cover[0] == pytest.approx(drawn.sum() * p * (1 - p)) and models[1].cover[0] == pytest.approx(3000)
    seen = boosting._start(specs, [0.0, 0.0])((cells, starts, np.stack([y[order]] * 2), draw[order]))
    assert len(seen[1][0]) == len(starts) < 600


def test_masks_lead_to_the_same_leaves():
    """All trees at once give what the walk through each gives, on thresholds and on values beside them too."""
    rng = np.random.default_rng(7)
    parts, roots = [], []

    def grow(depth):
        k = len(parts)
        parts.append(None)
        if depth == 0 or rng.random() < 0.1:
            parts[k] = (-1, 0.0, -1, -1, rng.normal())
        else:
            lo, hi = grow(depth - 1), grow(depth - 1)
            parts[k] = (int(rng.integers(3)), np.inf if rng.random() < 0.02 else float(rng.integers(8)), lo, hi, 0.0)
        return k

    roots = [grow(6) for _ in range(40)]
    columns = [np.array(c) for c in zip(*parts)]
    model = boosting.BoostedTrees(["a", "b", "c"], "squared", 0.5, np.array(roots), *columns, np.ones(len(parts)), np.ones(len(parts)))
    x = rng.integers(-1, 9, (1500, 3)).astype(float) + rng.choice([0, 0.5, -1e-9], (1500, 3))
    x[0], x[1], x[2] = np.nan, np.inf, -np.inf
    got = model.margins(x)
    assert model._masks
    model._masks = ()
    assert np.allclose(got, model.margins(x), atol=1e-12)
    empty = boosting.BoostedTrees(["a"], "squared", 0.5, np.array([0, 1]), *(np.array(v) for v in ([-1, -1], [0.0] * 2, [-1] * 2, [-1] * 2, [1.0, 2.0])), np.ones(2), np.ones(2))
    assert empty.margins(np.zeros((2, 1))).tolist() == [3.5, 3.5]


def test_all_trees_grow_in_one_job(spark, monkeypatch):
    """However many trees, the number of jobs is the same, and the trees are those of a job for every level."""
    monkeypatch.setattr(boosting, "LEAST_ROWS", 200)
    monkeypatch.setattr(boosting, "MOST_ROWS", 100)  # more blocks than cores: a task has several
    x, target, label = rows(1500, 8)
    df = frame(spark, x, target, label).cache()
    names = ["f0", "f1", "f2"]
    specs = [boosting.Spec("label", "logistic", 4, trees=25, row_share=0.8, column_share=0.8), boosting.Spec("target", "squared", 3, trees=22)]
    spark.sparkContext.setJobGroup("fit-25", "")
    try:
        models = boosting.fit_boosted(df, names, specs)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit-25"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 25
    monkeypatch.setattr(boosting, "_cores_at_once", lambda spark: 0)
    for one, other in zip(models, boosting.fit_boosted(df, names, specs)):
        assert len(one.roots) == len(other.roots) and np.array_equal(one.feature, other.feature)
        assert np.allclose(one.margins(x), other.margins(x), atol=1e-9)


def test_sums_of_tasks_are_exchanged(tmp_path):
    """Each task gets the sums of all, in the same order; a task without rows has none, and old levels are cleared away."""
    from concurrent.futures import ThreadPoolExecutor

    edges = [np.arange(5.0), np.arange(2.0)]
    shapes = [None, (None, None, 1, [0, 1])]

    def task(k):
        shared, out = boosting._Sums(str(tmp_path / "run"), k, 3, edges), []
        for level in range(4):
            own = np.zeros((2, 2, 2, boosting.BINS))
            own[:, :, 0, :6], own[:, :, 1, :3] = k + level, 10 * k
            out.append(shared.added(None if k == 1 else [None, own], shapes))
        return out

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(task, range(3)))
    for level in range(4):
        for own in found:
            assert own[level][0] is None
            sums = own[level][1]
            assert (sums[:, :, 0, :6] == 2 + 2 * level).all() and (sums[:, :, 1, :3] == 20).all() and sums.sum() == 4 * (6 * (2 + 2 * level) + 60)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["2", "3"]


def test_only_mounted_folders_are_opened():
    assert boosting._mounted("file:///a/b") == "/a/b" and boosting._mounted("file:/a") == "/a" and boosting._mounted("/a") == "/a"
    assert boosting._mounted("hdfs://host/a") is None and boosting._mounted("s3a://b/a") is None
