"""Order statistics on both paths: one window per group, and groups cut into pieces."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.asof import asof
from tapeloom.functions.ranking import prefix_counts, spread_median, spread_pct_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 900
    day = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 6, n))           # one hot day
    v = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(0, 3, n), 1))  # one hot value
    pdf = pd.DataFrame({"day": day, "symbol": [f"S{i:04d}" for i in range(n)], "v": v})
    pdf.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()
    return pdf, df


@pytest.mark.parametrize("piece", [7, 1_000_000])
def test_positions_are_exact(skewed, piece):
    pdf, df = skewed
    got = prefix_counts(df, ["day"], ["v", "symbol"], None, piece).toPandas().set_index("symbol")
    want = pdf.dropna().sort_values(["day", "v", "symbol"])
    want["before"] = want.groupby("day").cumcount()
    want = want.set_index("symbol")
    assert len(got) == len(want)
    assert (got["_before"].reindex(want.index) == want["before"]).all()
    assert (got["_total"].reindex(want.index) == want.groupby("day")["v"].transform("size")).all()


@pytest.mark.parametrize("piece", [7, 1_000_000])
def test_percent_rank_averages_ties(skewed, piece):
    pdf, df = skewed
    got = spread_pct_rank(df, ["day"], "v", "p", piece).toPandas().set_index("symbol")["p"]
    want = pdf.set_index("symbol").groupby("day")["v"].rank(pct=True).dropna()
    assert len(got) == len(want) and np.allclose(got.reindex(want.index), want)


@pytest.mark.parametrize("piece", [7, 1_000_000])
def test_median_is_exact(skewed, piece):
    pdf, df = skewed
    got = spread_median(df, ["day"], "v", ["symbol"], "m", piece).toPandas().set_index("day")["m"]
    assert np.allclose(got.sort_index(), pdf.groupby("day")["v"].median())


@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, True), (True, False)])
def test_asof_against_brute_force(spark, forward, strict):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "t": rng.integers(0, 40, 60), "i": range(60)})
    right = pd.DataFrame({"k": ["a", "b"] * 10, "t": np.repeat(rng.choice(40, 10, replace=False), 2), "x": rng.normal(size=20)})
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), "t", ["x"], ["k"], forward, strict).toPandas().set_index("i")
    for r in left.itertuples():
        c = right[right.k == r.k]
        c = c[(c.t > r.t) if forward and strict else (c.t >= r.t) if forward else (c.t < r.t) if strict else (c.t <= r.t)]
        want = (c.nsmallest(1, "t") if forward else c.nlargest(1, "t"))["x"]
        have = got.loc[r.i, "x"]
        assert (len(want) == 0 and pd.isna(have)) or have == want.iloc[0]
