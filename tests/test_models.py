"""Contributions, forest and model invariants."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from busbar.catalog import model_checks as mc
from busbar.operators import attribution, forest


def test_contributions_add_up(spark, sf):
    rows = mc.explain_top_k(spark, sf).collect()
    assert len(rows) == 6000
    for r in rows[:500]:
        assert r["explained"] == pytest.approx(r["margin"], abs=1e-9)
        # four features, so the top list holds them all
        assert r["base"] + sum(e["contribution"] for e in r["top"]) == pytest.approx(r["margin"], abs=1e-9)
        sizes = [abs(e["contribution"]) for e in r["top"]]
        assert sizes == sorted(sizes, reverse=True)


def expectation(nodes, i, x, known):
    """Expected tree value when only the features in `known` are given."""
    n = nodes[i]
    if n["lo"] < 0:
        return n["value"]
    if n["feature"] in known:
        return expectation(nodes, n["lo"] if x[n["feature"]] <= n["threshold"] else n["hi"], x, known)
    return sum(nodes[c]["cover"] / n["cover"] * expectation(nodes, c, x, known) for c in (n["lo"], n["hi"]))


def test_contributions_are_shapley_values(spark, sf):
    _, cls, _ = mc.models(spark, sf)
    trees = cls.trees()
    leaves, base = attribution.leaf_tables(trees)
    x = np.random.default_rng(0).normal(size=(5, 4))
    got = attribution.contributions(x, leaves)
    for row, phi in zip(x, got):
        value = lambda s: sum(w * expectation(t, 0, row, s) for w, t in trees)  # noqa: E731, B023
        assert value(()) == pytest.approx(base)
        for f in range(4):
            rest = [j for j in range(4) if j != f]
            want = sum(
                factorial(len(s)) * factorial(3 - len(s)) / 24 * (value((*s, f)) - value(s))
                for size in range(4) for s in combinations(rest, size))
            assert phi[f] == pytest.approx(want, abs=1e-10)


def test_forest_flags_the_contamination_share(spark, sf):
    scored = mc.isolation_forest_score(spark, sf).toPandas()
    assert 0.03 <= scored.is_anomaly.mean() <= 0.07
    f = mc.fitted_forest(spark, sf)
    raw = forest.raw_scores(mc.labelled(spark, sf), f, "row_id").toPandas()._score
    assert raw.between(-1, 0, inclusive="neither").all()
    assert f.sample_size == 256 and f.nodes.select("tree").distinct().count() == 100
    again = forest.score_forest(mc.labelled(spark, sf), f, "row_id").toPandas().set_index("row_id").anomaly_score
    assert np.allclose(again.sort_index(), scored.set_index("row_id").anomaly_score.sort_index())


def test_forest_finds_an_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(600, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    f = forest.fit_forest(df, "id", ["a", "b"], n_trees=40)
    assert forest.detect(df, f, "id", top=1).first()["id"] == 600


def test_forest_scoring_equals_a_walk(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    trees = [forest._grow(x, np.random.default_rng(t), 7) for t in range(5)]
    packed, depth = forest._pack([[n[1:] for n in t] for t in trees])
    for tree, (feature, threshold, child, path) in zip(trees, packed):
        node = np.zeros(len(x), dtype=np.int32)
        for _ in range(depth):
            node = child[2 * node + (x[np.arange(len(x)), feature[node]] > threshold[node])]
        for row, end in zip(x, node):
            i = 0
            while tree[i][1] >= 0:
                i = tree[i][3] if row[tree[i][1]] <= tree[i][2] else tree[i][4]
            assert path[end] == tree[i][5]


def test_model_quality_and_health(spark, sf):
    row = mc.evaluate(spark, sf).first()
    assert row["n"] == pytest.approx(1200, abs=3) and row["accuracy"] > 0.6 and row["mae"] < 0.02
    p = mc.predict_batch(spark, sf).toPandas()
    assert (p.pred_health_score == ((1 - p.pred_prob_unstable) * 100).astype(int)).all()
    assert ((p.pred_prob_unstable >= 0.5) == (p.pred_label == "unstable")).all()


def test_expected_path():
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert float(forest.expected_path(256)) == pytest.approx(10.24, abs=0.01)
