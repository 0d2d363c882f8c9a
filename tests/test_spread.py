"""Chunked ranks, fills and quantiles against pandas, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busbar.operators import spread, windows
from busbar.operators.sampling import stratified_split


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n)),
            "t": rng.integers(0, 400, n),
            "v": np.where(rng.random(n) < 0.4, np.nan, rng.integers(0, 50, n).astype(float)),
        }
    )
    # A long gap in the hot group that covers whole chunks, and a group without any value.
    pdf.loc[(pdf.g == "hot") & pdf.t.between(50, 300), "v"] = np.nan
    pdf.loc[pdf.g == "f", "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.persist(), pdf


def test_global_rank(hot):
    df, pdf = hot
    got = spread.global_rank(df, ["t", "id"]).toPandas().set_index("id")["rank"].sort_index()
    want = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    want["rank"] = want.index + 1
    assert (got == want.set_index("id")["rank"].sort_index()).all()


def test_group_rank_and_total(hot):
    df, pdf = hot
    got = spread.group_rank(df, ["g"], ["t", "id"], total="n").toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["g", "t", "id"])
    rank = want.groupby("g").cumcount() + 1
    assert (got["rank"] == pd.Series(rank.values, index=want.id).sort_index()).all()
    assert (got["n"] == pdf.groupby("g").id.transform("count").set_axis(pdf.id).sort_index()).all()


def test_group_rank_with_null_key(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id int, g string")
    got = spread.group_rank(df, ["g"], ["id"]).toPandas().set_index("id")["rank"]
    assert all(got[i] == i // 2 + 1 for i in range(100))


@pytest.mark.parametrize("forward,backward", [(True, False), (False, True), (True, True)])
def test_fill_crosses_chunks(hot, forward, backward):
    df, pdf = hot
    got = spread.fill_gaps(df, ["g"], ["t", "id"], ["v"], forward, backward).toPandas().set_index("id")["v"].sort_index()
    by = pdf.sort_values(["g", "t", "id"])
    want = by.v
    if forward:
        want = want.groupby(by.g).ffill()
    if backward:
        want = want.groupby(by.g).bfill()
    want = pd.Series(want.values, index=by.id).sort_index()
    pd.testing.assert_series_equal(got.astype(float), want, check_names=False)


def test_block_fill_stays_in_its_block(spark):
    rows = [(i, None if i in (0, 9, 10, 11) else float(i)) for i in range(20)]
    got = windows.block_fill(spark.createDataFrame(rows, "id int, v double"), ["id"], ["v"], 10).toPandas()
    got = got.set_index("id")["v"]
    assert got[0] == 1.0  # leading null takes the next value
    assert got[9] == 8.0
    assert got[10] == 12.0 and got[11] == 12.0  # never 8.0 from the block before


def test_quantiles_equal_pandas(hot):
    df, pdf = hot
    got = spread.exact_quantiles(df, "v", {"q1": 0.02, "q2": 0.5, "q3": 0.97}, by=["g"]).toPandas().set_index("g")
    want = pdf.dropna(subset="v").groupby("g").v.quantile([0.02, 0.5, 0.97]).unstack()
    np.testing.assert_allclose(got.sort_index().values, want.sort_index().values, rtol=1e-12)
    one = spread.exact_quantiles(df, "v", {"q": 0.85}).first()["q"]
    assert one == pytest.approx(pdf.v.quantile(0.85))


def test_quantile_of_nothing(spark):
    assert spread.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", {"q": 0.5}).first()["q"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_nearest_quartiles_small(spark, n):
    from busbar.operators.aggregates import nearest_quartiles

    row = nearest_quartiles(spark.createDataFrame([(float(i),) for i in range(n)], "v double"), "v").first()
    assert (row["p25"], row["p75"]) == (n // 4, 3 * n // 4)


def test_top_per_group(hot):
    df, pdf = hot
    got = spread.top_per_group(df, ["g"], [F.desc("t"), F.asc("id")], 7, salts=3).toPandas()
    want = pdf.sort_values(["g", "t", "id"], ascending=[True, False, True]).groupby("g").head(7)
    assert set(got.id) == set(want.id)
    assert sorted(got[got.g == "hot"]["rank"]) == list(range(1, 8))


def test_split_is_exact_per_class(hot):
    df, pdf = hot
    got = stratified_split(df, "g", "id").groupBy("g", "part").count().toPandas().pivot(index="g", columns="part", values="count")
    size = pdf.groupby("g").size()
    assert (got["train"] == np.floor(0.8 * size)).all() and (got["train"] + got["test"] == size).all()


def test_spread_ends_are_exact(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id int")
    got = [str(r["timestamp"]) for r in windows.spread_timestamps(rows, ["id"]).orderBy("id").collect()]
    assert got[0] == "2020-01-01 00:00:00" and got[-1] == "2023-12-31 23:00:00"
    one = windows.spread_timestamps(rows.limit(1), ["id"]).first()
    assert str(one["timestamp"]) == "2020-01-01 00:00:00"


def test_split_ranks_few_rows(spark, monkeypatch):
    """Most rows are split by counts; those that are ranked, equal and null keys too, fill their class's share exactly."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from busbar.functions.hashing import hash_key
    from busbar.operators import sampling

    data = [("abc"[k % 3] if k % 50 else None, k if k % 40 else None) for k in range(4000)] + [("hot", 7)] * 1000
    df = spark.createDataFrame(data, "g string, id long").repartition(5)
    seen, rank = [], sampling.group_rank
    monkeypatch.setattr(sampling, "group_rank", lambda rows, *a, **b: (seen.append(rows.count()), rank(rows, *a, **b))[1])
    got = stratified_split(df, "g", "id")
    order = Window.partitionBy("g").orderBy(hash_key(F.col("id"), "42"), "id")
    all_ranked = df.withColumns({"rn": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("g"))})
    want = all_ranked.select("g", "id", F.when(F.col("rn") <= F.floor(0.8 * F.col("n")), "train").otherwise("test").alias("part"))
    assert got.columns == ["g", "id", "part"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert seen and seen[0] < 1100  # the equal keys, and next to nothing else


def test_quantile_moves_few_rows(spark):
    """The threshold of a forest is the exact quantile, also where all values are alike or none is known."""
    rng = np.random.default_rng(5)
    many, tied = rng.normal(size=999), np.round(rng.normal(size=500), 1)
    cases = [(many, 0.05, 4), (many, 0.77, 1e6), (tied, 0.5, 4), (np.full(40, 0.25), 0.05, 4), (np.array([3.0]), 1.0, 4), (np.array([-1.0, 2.0]), 0.5, 1e6)]
    for values, q, parts in cases:
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(3)
        assert spread.quantile_by_buckets(df, "x", q, F.floor(F.col("x") * parts)) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert spread.quantile_by_buckets(df.filter("x > 9"), "x", 0.5, F.floor("x")) is None
