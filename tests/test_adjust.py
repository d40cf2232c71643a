"""Corporate actions on literal series: factors, as-of joins, frames and levels without phantoms."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import adjust as adj
from tapeloom.operators import bars as bo
from tapeloom.operators import levels as lv
from tapeloom.params import Session
from .test_bars import frame

FULL = Session(open_min=0, close_min=1440, carry_min=1300, last30_min=22 * 60)


def swing(n, base, step):
    return [(base, base + (2 if i % 4 == 1 else 1) * step, base - (2 if i % 4 == 3 else 1) * step, base + (0.5 if i % 2 else -0.5) * step) for i in range(n)]


def test_factors_are_suffix_products(spark):
    b = frame(spark, [(1000, 1010, 990, 1000)] * 4 + [(500, 505, 495, 500)] * 4 + [(50, 51, 49, 50)] * 4, step=1440)
    rows = adj.action_factors(b).orderBy(F.col("valid_from").asc_nulls_first()).collect()
    assert [r["valid_from"] and r["valid_from"].day for r in rows] == [None, 5, 9]
    assert np.allclose([r["factor"] for r in rows], [0.05, 0.1, 1.0])
    got = adj.adjusted(b, adj.action_factors(b))
    assert np.allclose([r["close"] for r in got.collect()], 50)
    want = bo.back_adjust(b)
    cols = ["ts", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_random_series_equal_the_step_by_step_rule(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80)))
    for at, times in ((10, 5), (11, 0.5), (40, 2), (78, 3)):
        close[:at] *= times
    b = frame(spark, [(c, c * 1.01, c * 0.99, c) for c in close], step=1440)
    got = [r["close"] for r in adj.adjusted(b, adj.action_factors(b)).orderBy("ts").collect()]
    want, ratio = close.copy(), close[1:] / close[:-1]
    for i in np.flatnonzero(np.abs(ratio - 1) > 0.25):
        want[:i + 1] *= ratio[i]
    assert np.allclose(got, want)


def test_series_without_actions_zero_and_null_closes(spark):
    rows = [("A", dt.datetime(2024, 1, i), x) for i, x in ((1, 100.0), (2, 110.0), (3, 100.0))]
    rows += [("B", dt.datetime(2024, 1, i), x) for i, x in ((1, 0.0), (2, 50.0), (3, None), (4, 5.0))]
    rows += [("C", dt.datetime(2024, 1, i), x) for i, x in ((1, 100.0), (2, 10.0))]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    assert adj.action_factors(b).collect() == []
    full = b.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    assert sorted(map(str, adj.adjusted(full, adj.action_factors(b)).select("symbol", "ts", "close").collect())) == sorted(map(str, b.collect()))


def test_fine_bars_take_the_daily_table_as_of_their_time(spark):
    day = frame(spark, [(1000, 1001, 999, 1000)] * 5 + [(200, 201, 199, 200)] * 5, step=1440, start=dt.datetime(2024, 1, 1))
    fine = frame(spark, [(1000, 1000, 1000, 1000)] * 20 + [(200, 200, 200, 200)] * 20, step=360, start=dt.datetime(2024, 1, 1))
    got = adj.adjusted(fine, adj.action_factors(day))
    assert got.select("close").distinct().count() == 1 and abs(got.first()["close"] - 200) < 1e-9


def test_no_phantom_wall(spark):
    """With a 1:5 split inside the window, levels stay around the price after it."""
    rows = swing(40, 1000, 5) + swing(40, 200, 1)
    panel = frame(spark, rows, step=1440, start=dt.datetime(2024, 1, 1)).select(
        "symbol", F.to_date("ts").alias("trade_date"), *[F.col(c).alias(f"{c}_price") for c in ("open", "high", "low", "close")],
        F.col("volume").alias("ttl_trd_qnty"))
    plain = frame(spark, rows, step=1440, start=dt.datetime(2024, 1, 1))
    raw = lv.frame_summary(plain, ["symbol"]).first()
    assert any(w["level"] > 500 for w in raw["walls"])
    frames = adj.all_frames(None, panel, {}, "2024-03-20", FULL)
    made = {r["frame"]: r for r in lv.frame_summary(frames, ["symbol", "frame"]).collect()}
    assert set(made) == {"1D", "1W", "1M"} and made["1D"]["walls"]
    assert all(190 < w["level"] < 210 for w in made["1D"]["walls"])
    assert made["1D"]["struct"] not in ("TREND_DOWN", "BREAKOUT_DOWN")


def test_all_frames_join_fine_and_daily(spark):
    """Intraday frames come from the fine bars, days from the history, each on its own scale after the action."""
    panel = frame(spark, [(1000, 1010, 990, 1000)] * 20 + [(100, 101, 99, 100)] * 11, step=1440, start=dt.datetime(2024, 1, 1)).select(
        "symbol", F.to_date("ts").alias("trade_date"), *[F.col(c).alias(f"{c}_price") for c in ("open", "high", "low", "close")],
        F.col("volume").alias("ttl_trd_qnty"))
    fine = frame(spark, [(1000, 1002, 998, 1000)] * 24 + [(100, 101, 99, 100)] * 24, step=60, start=dt.datetime(2024, 1, 20))
    got = adj.all_frames(fine, panel, {"4h": 240}, "2024-02-02", FULL).groupBy("frame").agg(
        F.count("*").alias("n"), F.max("high").alias("hi"), F.min("low").alias("lo")).collect()
    made = {r["frame"]: r for r in got}
    assert {k: r["n"] for k, r in made.items()} == {"4h": 12, "1D": 31, "1W": 4, "1M": 1}
    assert all(98.9 < r["lo"] and r["hi"] < 101.1 for r in made.values())
