"""Running statistics against step-by-step loops, on short, long, gappy and tied series."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.scans import with_ema, with_rank_so_far

D0 = dt.date(1990, 1, 1)


def series(spark, values):
    rows = [(D0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "trade_date date, v double").repartition(3)


def cases():
    rng = np.random.default_rng(9)
    walk = 100 + np.cumsum(rng.normal(size=900))
    gaps = walk.copy()
    gaps[rng.random(900) < 0.2] = np.nan
    gaps[:7] = np.nan
    return {"walk": walk, "gaps": gaps, "one": np.array([5.0]), "empty": np.full(4, np.nan), "ties": np.round(rng.normal(size=257), 1), "none": np.array([])}


@pytest.mark.parametrize("name", list(cases()))
def test_ema_equals_the_recursion(spark, name):
    values = cases()[name]
    d = series(spark, values)
    for span in (1, 2, 20, 50):
        d = with_ema(d, "v", f"e{span}", span)
    got = d.orderBy("trade_date").collect()
    for span in (1, 2, 20, 50):
        a, e = 2 / (span + 1), None
        for v, r in zip(values, got):
            if not np.isnan(v):
                e = v if e is None else a * v + (1 - a) * e
            assert r[f"e{span}"] is None if e is None else r[f"e{span}"] == pytest.approx(e, rel=1e-11)


@pytest.mark.parametrize("name", list(cases()))
def test_rank_so_far_equals_counting(spark, name):
    values = cases()[name]
    got = [r["r"] for r in with_rank_so_far(series(spark, values), "v", "r").orderBy("trade_date").collect()]
    want = [None if np.isnan(v) else np.sum(values[:i + 1] <= v) / (i + 1) for i, v in enumerate(values)]
    assert got == pytest.approx(want, nan_ok=True) if values.size else got == []


def test_a_long_axis_with_a_hot_value(spark):
    """Three hundred thousand steps, a third of them of one value, and no column of lists on the way."""
    n = 300_000
    d = spark.range(n).select(F.col("id").alias("trade_date"), F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 10007) / 10007.0).alias("v"))
    made = with_rank_so_far(with_ema(d, "v", "e", 5000), "v", "r")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    v = np.where(np.arange(n) % 3 == 0, 0.5, (np.arange(n) * 7919 % 10007) / 10007.0)
    rows = made.where(F.col("trade_date").isin(0, 1, 2, 1000, 150_001, n - 1)).collect()
    a = 2 / 5001
    e = np.empty(n)
    e[0] = v[0]
    for i in range(1, n):
        e[i] = a * v[i] + (1 - a) * e[i - 1]
    for r in rows:
        i = r["trade_date"]
        assert r["r"] == pytest.approx(np.sum(v[:i + 1] <= v[i]) / (i + 1)) and r["e"] == pytest.approx(e[i], rel=1e-10)
