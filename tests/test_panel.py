"""Features, selection, regime, ledger, sector and delivery on small literal tables."""
import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars as sc
from tapeloom.operators import calendar as cal
from tapeloom.operators import delivery as dl
from tapeloom.operators import features as ft
from tapeloom.operators import ledger as lg
from tapeloom.operators import positioning as ps
from tapeloom.operators import regime as rg
from tapeloom.operators import sector as se
from tapeloom.operators import selection as sel
from tapeloom.operators import shorthorizon as sh
from tapeloom.operators import synthesis as sy
from tapeloom.params import Delivery, Signal, Tilt

D0 = dt.date(2024, 1, 1)


def panel(spark, n=30, symbol="A", **last):
    rows = []
    for i in range(n):
        r = dict(trade_date=D0 + dt.timedelta(days=i), symbol=symbol, series="EQ", prev_close=100.0, open_price=100.0, high_price=102.0,
                 low_price=98.0, close_price=100.0, avg_price=100.0, ttl_trd_qnty=1000, deliv_per=65.0, turnover_lacs=3000.0)
        if i == n - 1:
            r.update(last)
        rows.append(r)
    return spark.createDataFrame(pd.DataFrame(rows))


PASSING = dict(open_price=101.0, high_price=106.0, low_price=100.0, close_price=105.5, avg_price=103.0, ttl_trd_qnty=5000)


def index(spark, n=30):
    return spark.createDataFrame(pd.DataFrame({"trade_date": [D0 + dt.timedelta(days=i) for i in range(n)], "close_val": [100.0] * n}))


def is_signal(spark, **over):
    d = ft.add_relative_strength(ft.add_features(panel(spark, **{**PASSING, **over})), index(spark))
    return ft.signals(d).where(F.col("trade_date") == F.lit(D0 + dt.timedelta(days=29))).count() == 1


def test_every_leg_of_the_signal_matters(spark):
    assert is_signal(spark)
    for broken in (dict(close_price=102.0), dict(ttl_trd_qnty=1000), dict(prev_close=105.0), dict(avg_price=105.4), dict(turnover_lacs=100.0)):
        assert not is_signal(spark, **broken)


def test_baseline_excludes_the_day_itself(spark):
    d = ft.add_features(panel(spark, ttl_trd_qnty=10_000_000)).orderBy("trade_date").toPandas()
    assert d["vol_ratio"].iloc[-1] > 100 and d["vol_ratio"].iloc[-2] == 1.0


def cand(spark):
    return spark.createDataFrame([("A", "X", 5.0), ("B", "X", 4.0), ("C", "X", 3.0), ("D", "Y", 2.0), ("E", "Z", 1.0)],
                                 "symbol string, sector string, score double").withColumn("trade_date", F.lit(D0))


def test_sector_cap_and_weights(spark):
    b = sel.capped_book(cand(spark)).toPandas()
    assert set(b.symbol) == {"A", "B", "D", "E"} and abs(b.weight.sum() - 1) < 1e-9
    for mult, total in ((0.5, 0.5), (1.8, 1.0)):
        assert abs(sel.capped_book(cand(spark), size_mult=mult).agg(F.sum("weight")).first()[0] - total) < 1e-9
    assert sel.capped_book(cand(spark), size_mult=0.0).count() == 0


def test_event_window_is_after_the_session_and_three_days_long(spark):
    ev = spark.createDataFrame([("A", dt.date(2026, 7, 10)), ("B", dt.date(2026, 7, 12)), ("C", dt.date(2026, 7, 20))], "symbol string, date date")
    rows = spark.createDataFrame([(s, dt.date(2026, 7, 10)) for s in "ABC"], "symbol string, trade_date date")
    assert [r.symbol for r in cal.with_events(rows, ev).collect()] == ["B"]


def test_live_gate_guards(spark):
    ix = index(spark, 60)
    day = D0 + dt.timedelta(days=60)
    live = spark.createDataFrame([(day, 120.0), (day + dt.timedelta(days=1), 80.0), (day + dt.timedelta(days=2), None),
                                  (day + dt.timedelta(days=30), 120.0)], "trade_date date, live_close double")
    got = {r.trade_date: r.up for r in rg.live_gate(ix, live).collect()}
    assert list(got[k] for k in sorted(got)) == [True, False, False, False]


def test_debounce_against_loop(spark):
    rng = np.random.default_rng(2)
    labs = list(rng.choice(["U", "D", "C"], 300, p=[.6, .3, .1]))
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i), l) for i, l in enumerate(labs)], "trade_date date, lab string")
    from tapeloom.functions.rolling import axis
    got = [r.o for r in rg.debounce(df, "lab", "o", 3, axis()).orderBy("trade_date").collect()]
    want, pend, cnt, cur = [], labs[0], 0, labs[0]
    for v in labs:
        pend, cnt = (pend, cnt + 1) if v == pend else (v, 1)
        cur = v if cnt >= 3 else cur
        want.append(cur)
    assert got == want


def test_ema_matches_pandas(spark):
    x = np.random.default_rng(3).normal(100, 5, 200)
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "trade_date date, v double")
    from tapeloom.functions.scans import with_ema
    got = [r.e for r in df.select("trade_date", "v").transform(lambda d: with_ema(d, "v", "e", 20)).orderBy("trade_date").collect()]
    assert np.allclose(got, pd.Series(x).ewm(span=20, adjust=False).mean())


def test_compounding(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i), v) for i, v in enumerate([0.0, 10.0, 10.0, 10.0])], "trade_date date, v double")
    from tapeloom.functions.rolling import axis, compound
    got = [r.c for r in df.select("trade_date", compound(F.col("v"), axis(), 3).alias("c")).orderBy("trade_date").collect()]
    assert got[:3] == [None] * 3 and abs(got[3] - 33.1) < 1e-9


def test_slope_with_holes_matches_definition(spark):
    rng = np.random.default_rng(4)
    n = 40
    wide = pd.DataFrame(rng.normal(50, 5, (n, 3)), columns=list("ABC"))
    wide.iloc[20, 0] = wide.iloc[25, 1] = np.nan
    rows = [(D0 + dt.timedelta(days=i), c, "X", float(wide.loc[i, c]), 500.0) for i in range(n) for c in "ABC" if not np.isnan(wide.loc[i, c])]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, sector string, deliv_per double, turnover_lacs double")
    t = Tilt(deliv_min_hist=5, dv_base=12, slope_win=15)
    got = {(r.trade_date, r.symbol): r.slope for r in se.delivery_state(df, t).collect()}
    xd = np.arange(15) - 7.0
    for i in range(20, n):
        for c in "ABC":
            y = wide[c].iloc[i - 14:i + 1].to_numpy()
            if np.isnan(y[-1]):
                continue
            ok = ~np.isnan(y)
            s = ((y[ok] * xd[ok]).sum() - y[ok].mean() * xd[ok].sum()) / (xd ** 2).sum()
            med = np.nanmedian(wide[c].iloc[i - 12:i])
            assert abs(got[(D0 + dt.timedelta(days=i), c)] - s / med) < 1e-9


def test_tenure_runs_and_gaps(spark):
    def ten(labels):
        rows = [(D0 + dt.timedelta(days=i), "X", l) for i, l in enumerate(labels) if l] + [(D0 + dt.timedelta(days=i), "Y", "NEUTRAL") for i in range(len(labels))]
        t = se.tenure(spark.createDataFrame(rows, "trade_date date, sector string, tilt string"))
        return t.where("sector = 'X'").orderBy(F.col("trade_date").desc()).first()["days_in_tilt"]
    assert ten(["OVERWEIGHT", "NEUTRAL", "OVERWEIGHT", "OVERWEIGHT", "OVERWEIGHT"]) == 3
    assert ten(["UNDERWEIGHT", "UNDERWEIGHT", None, "UNDERWEIGHT"]) == 1
    assert ten(["NEUTRAL", "NEUTRAL"]) == 0


def test_tilt_label_order(spark):
    df = spark.createDataFrame([(0.9, 0.0, False, False), (0.9, 0.0, True, False), (0.2, 0.6, False, False), (0.2, 0.0, False, False), (0.5, 0.0, False, False), (None, 0.9, False, False)],
                               "r double, b double, thin boolean, rev boolean")
    got = [x[0] for x in df.select(se.tilt_label(F.col("r"), F.col("b"), F.col("thin"), F.col("rev"))).collect()]
    assert got == ["OVERWEIGHT", "NEUTRAL", "WATCH", "UNDERWEIGHT", "NEUTRAL", None]


def test_sector_tilt_bulk_equals_pointwise(spark):
    from tapeloom.plans import base as B
    from tapeloom.plans.sector_queries import _inputs
    B.new_run()
    d, m, n = _inputs(spark, "/root/testdata/sf0.01")
    day = "2000-05-01"
    bulk = se.sector_tilt(d, m, n, "2000-01-01", "2000-12-01", B.TILT, B.REGIME).where(F.col("trade_date") == day)
    point = se.sector_tilt_asof(d, m, n, day, B.TILT, B.REGIME)
    cols = [F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in point.dtypes]
    a, b = sorted(map(str, bulk.select(*cols).collect())), sorted(map(str, point.select(*cols).collect()))
    assert a == b and len(a) > 0


def test_weighted_delivery_is_turnover_weighted(spark):
    rows = [(dt.date(2024, 1, 2), "A", 20.0, 1000.0), (dt.date(2024, 1, 3), "A", 90.0, 10.0)]
    df = spark.createDataFrame(rows, "trade_date date, symbol string, deliv_per double, turnover_lacs double")
    got = dl.delivery_trend(df, "2024-01-05", Delivery(), "week").first()
    assert abs(got["w5"] - 20.6930693) < 1e-6 and got["cell"] == "21  Base -> (n/a)"
    part = dl.delivery_trend(df, "2024-01-03", Delivery(), "week").first()
    assert part["cell"] == "21*2d  Base -> (n/a)"


def ledger(spark, rows):
    return spark.createDataFrame([{**dict.fromkeys(lg.COLUMNS), **r} for r in rows], lg.SCHEMA)


def test_upsert_refreshes_open_and_leaves_closed(spark):
    old = ledger(spark, [dict(date=D0, symbol="A", entry_px=1.0, status="OPEN"), dict(date=D0, symbol="B", entry_px=1.0, status="CLOSED")])
    new = ledger(spark, [dict(date=D0, symbol=s, entry_px=2.0, status="OPEN") for s in "ABC"])
    got = {r.symbol: (r.entry_px, r.status) for r in lg.upsert(old, new).collect()}
    assert got == {"A": (2.0, "OPEN"), "B": (1.0, "CLOSED"), "C": (2.0, "OPEN")}


def test_reconcile_takes_the_first_later_open(spark):
    led = ledger(spark, [dict(date=D0, symbol="A", entry_px=100.0, status="OPEN"), dict(date=D0 + dt.timedelta(days=29), symbol="A", entry_px=100.0, status="OPEN")])
    p = panel(spark).withColumn("open_price", F.when(F.col("trade_date") == F.lit(D0 + dt.timedelta(days=1)), 101.0).otherwise(500.0))
    got = {r.date: r for r in lg.reconcile(led, p).collect()}
    assert got[D0].status == "CLOSED" and got[D0].gross_bps == 100.0 and got[D0].net_bps == 78.0
    assert got[D0 + dt.timedelta(days=29)].status == "OPEN"


def test_posterior_shrinks(spark):
    df = spark.createDataFrame([(20.0, 20.0, 40.0, 115.0, 50), (20.0, 20.0, 40.0, 115.0, 0)], "mu0 double, tau double, m double, s double, n int")
    c = [F.col(x) for x in ("mu0", "tau", "m", "s", "n")]
    rows = df.select(*lg.posterior(*c)).collect()
    assert 20 < rows[0][0] < 40 and rows[0][1] < 20 and tuple(rows[1]) == (20.0, 20.0)


def test_calibration_multiplier_bounds(spark):
    prior = spark.createDataFrame([(13.0, 13.0, 20.0, 100)], "mu0 double, mu0_mean double, tau double, n0 long")
    cost = spark.createDataFrame([(0, 0.0, 22.0)], "n_live_fills int, slippage_bps double, effective_cost_bps double")
    def run(nets):
        led = ledger(spark, [dict(date=D0 + dt.timedelta(days=i), symbol="A", net_bps=float(v), status="CLOSED") for i, v in enumerate(nets)])
        r = lg.calibrate(led, prior, cost).first()
        return r.size_multiplier, r.trust
    assert run([10.0] * 5) == (0.3, "prior only")
    assert run([200.0, 100.0] * 10) == (0.75, "forming")
    assert run([200.0, 100.0] * 30) == (1.0, "trusted")
    assert run([-400.0, -300.0] * 30)[0] == 0.0


def test_readiness_equals_signal(spark):
    p = Signal()
    rows = [(c, r, v, k, w) for c in (0.69, 0.70, 0.71) for r in (0.9, 1.0, 1.1) for v in (1.9, 2.0, 2.1) for k in (-0.01, 0.0, 0.01) for w in (0.004, 0.005, 0.006)]
    df = spark.createDataFrame(rows, "c double, r double, v double, k double, w double")
    ready = sc.long_readiness(F.col("c"), F.col("r"), F.col("k"), F.col("v"), F.col("w"), p)
    full = (F.col("c") >= p.clr) & (F.col("r") >= 100 * p.ret) & (F.col("v") >= p.vol_ratio) & (F.col("k") > p.rs_min) & (F.col("w") >= p.close_vs_vwap)
    assert df.where((ready == 5) != full).count() == 0
    unknown = df.select(sc.long_readiness(F.col("c"), F.col("r"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("x"))
    assert unknown.agg(F.max("x")).first()[0] == 2


def test_day_fraction_ends(spark):
    df = spark.createDataFrame([(540,), (555,), (559,), (560,), (925,), (1000,)], "m int")
    assert [r[0] for r in df.select(sc.day_fraction(F.col("m"))).collect()] == [0.0424, 0.0424, 0.0424, 0.0674, 1.0, 1.0]


def test_cost_and_odds(spark):
    d = spark.range(1).select(sc.round_trip_bps(F.lit(200000.0), F.lit(1000.0), F.lit(2.0)).alias("t"), sc.p_pays(F.lit(10.0), F.lit(2.0)).alias("lo"),
                              sc.p_pays(F.lit(10.0), F.lit(50.0)).alias("hi"), sc.p_pays(F.lit(10.0), F.lit(4.5)).alias("mid"), sc.exp_move_bps(F.lit(-1.0)).alias("neg")).first()
    assert 5 < d.t < 13 and d.lo == 81.4 and d.hi == 7.1 and abs(d.mid - 69.4) < 1e-9 and d.neg is None


def syn(spark, hs, hi, lo, n, ls, px):
    df = spark.createDataFrame([(hs, hi, lo, n, ls, px)], "hs string, hi double, lo double, n int, ls string, px double")
    s = sy.synthesize(*[F.col(c) for c in ("hs", "hi", "lo", "n", "ls", "px")])
    r = df.select(s["setup"].alias("t"), s["dir"].alias("d"), sy.side_of(s["setup"], s["dir"]).alias("s")).first()
    return tuple(r)


@pytest.mark.parametrize("args,want", [
    (("RANGE", 110.0, 100.0, 30, "BREAKOUT_UP", 109.5), ("RANGE-TOP BREAK", "UP", "LONG")),
    (("RANGE", 110.0, 100.0, 30, "BREAKOUT_UP", 105.0), ("FALSE-BREAK TRAP", "NONE", "—")),
    (("RANGE", 110.0, 100.0, 30, "BREAKOUT_DOWN", 100.5), ("RANGE-FLOOR BREAK", "DOWN", "SHORT")),
    (("RANGE", 110.0, 100.0, 30, "CONSOLIDATION", 105.0), ("NESTED SQUEEZE", "NONE", "—")),
    (("RANGE", 110.0, 100.0, 30, "RANGE", 105.0), ("RANGE-BOUND (no setup)", "NONE", "—")),
    (("RANGE", 110.0, 100.0, 30, "TREND_UP", 105.0), ("DRIFT-IN-RANGE", "NONE", "—")),
    (("TREND_UP", 110.0, 100.0, 30, "CONSOLIDATION", 105.0), ("WITH-TREND CONTINUATION", "UP", "LONG")),
    (("TREND_UP", 110.0, 100.0, 30, "CONSOLIDATION", 109.9), ("COIL AT THE EXTREME", "UP", "LONG")),
    (("TREND_DOWN", 110.0, 100.0, 30, "TREND_DOWN", 105.0), ("EXTENDED (aligned)", "DOWN", "SHORT")),
    (("TREND_DOWN", 110.0, 100.0, 30, "TREND_UP", 105.0), ("PULLBACK vs HTF", "DOWN", "SHORT")),
    (("RANGE", 110.0, 100.0, 3, "RANGE", 105.0), ("HTF warming", "NONE", "—")),
    (("RANGE", 110.0, 100.0, 30, "n/a", 105.0), ("LTF warming", "NONE", "—")),
])
def test_synthesis_table(spark, args, want):
    assert syn(spark, *args) == want


def test_run_start_and_signed_move(spark):
    t0 = dt.datetime(2024, 1, 2, 9, 15)
    rows = [("A", t0 + dt.timedelta(minutes=i), 100.0 + i, "LONG" if i < 10 or i >= 57 else "—") for i in range(60)]
    sides = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, side string")
    cur = spark.createDataFrame([("A", "LONG", 159.0)], "symbol string, side string, ltp double")
    r = sh.run_start(sides, cur).first()
    assert r.entered == (t0 + dt.timedelta(minutes=57)).strftime("%H:%M") and r["at"] == 157.0
    always = sides.withColumn("side", F.lit("LONG"))
    assert sh.run_start(always, cur).first().entered.startswith("≥")
    short = spark.createDataFrame([(99.0, 100.0, "SHORT")], "l double, p double, s string").select(sc.since_pct(F.col("l"), F.col("p"), F.col("s"))).first()[0]
    assert short == 1.0


def test_short_entry_skips_names_already_short(spark):
    d1, d2 = dt.datetime(2024, 1, 2, 15), dt.datetime(2024, 1, 3, 10)
    rows = [("A", d1, 10.0, "LONG"), ("A", d2, 9.0, "SHORT"), ("B", d1, 10.0, "SHORT"), ("B", d2, 9.0, "SHORT")]
    sides = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, side string")
    assert [(r.symbol, r.entered, r["at"]) for r in sh.short_entry(sides).collect()] == [("A", "10:00", 9.0)]


def test_option_labels(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, -1.0, 100.0, 150.0)], "co double, cp double, po double, pp double, c double, p double")
    r = df.select(ps.option_read(ps.option_leg("C", F.col("co"), F.col("cp")), ps.option_leg("P", F.col("po"), F.col("pp")), F.col("c"), F.col("p")).alias("x")).first()
    assert r.x == "Bull | PCR 1.50"
