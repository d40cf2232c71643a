"""Index regime: moving-average gate and the debounced posture of the index series.

The index has one row per session, so its windows have no partition key; the series is bounded by
the calendar and never grows with the panel.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import axis, compound, nz, roll_mean, roll_std, yes
from ..functions.scans import with_ema, with_rank_so_far
from ..params import Regime, Signal
from ..session import known_size

def regime_gate(index: DataFrame, p: Signal = Signal()) -> DataFrame:
    """(trade_date, up): close above its moving average; unknown counts as not up."""
    ma = roll_mean(F.col("close_val"), axis(), p.regime_ma)
    return index.select("trade_date", yes(F.col("close_val") > ma).alias("up"))


def gate_on(dates: DataFrame, index: DataFrame, p: Signal = Signal()) -> DataFrame:
    """The gate on given dates; a date without an index row reads False."""
    return (dates.join(known_size(regime_gate(index, p)), "trade_date", "left")
                 .withColumn("up", yes(F.col("up"))))


def live_gate(index: DataFrame, live: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Gate for sessions still running. `live` has one row per (trade_date, live_close).

    The window is the last regime_ma - 1 closes strictly before the session plus the live value;
    no live value, too short a history or a newest close older than the stale limit reads False.
    Bulk form: every session is evaluated in one pass.
    """
    n = p.regime_ma - 1
    hist = index.select("trade_date", "close_val", F.lit(None).cast("double").alias("live_close"),
                        F.lit(0).alias("_live"))
    now = live.select("trade_date", F.lit(None).cast("double").alias("close_val"), "live_close",
                      F.lit(1).alias("_live"))
    u = hist.unionByName(now)
    # closes strictly before the session: count closes seen so far, live rows first on their date
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date", F.col("_live").desc())
    seen = w.rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumns({"_k": F.count("close_val").over(seen),
                       "_last": F.max(F.when(F.col("_live") == 0, F.col("trade_date"))).over(seen),
                       "_cum": F.sum("close_val").over(seen)})
    closes = (hist.select(F.row_number().over(axis()).alias("_at"),
                          F.sum("close_val").over(axis()).alias("_upto")))
    lives = u.where("_live = 1").join(closes.withColumnRenamed("_upto", "_old"),
                                      F.col("_at") == F.col("_k") - n, "left")
    ma = (F.col("_cum") - F.coalesce("_old", F.lit(0.0)) + F.col("live_close")) / p.regime_ma
    fresh = F.datediff("trade_date", "_last") <= p.max_stale_days
    return lives.select("trade_date", "live_close",
                        yes((F.col("_k") >= n) & fresh & (F.col("live_close") != 0)
                            & (F.col("live_close") > ma)).alias("up"))


def debounce(df: DataFrame, label: str, out: str, confirm: int, w) -> DataFrame:
    """Accept a label change only after it has held `confirm` rows; the first label is accepted
    at once."""
    d = df.withColumn("_chg", F.when(F.lag(label).over(w) == F.col(label), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_chg").over(w))
    in_run = Window.partitionBy("_run").orderBy("trade_date")
    d = d.withColumn("_pos", F.row_number().over(in_run))
    held = F.when(F.col("_pos") >= confirm, F.col(label))
    first = F.first(label).over(w)
    d = d.withColumn(out, F.coalesce(F.last(held, ignorenulls=True).over(w), first))
    return d.drop("_chg", "_run", "_pos")


def regime_history(nifty: DataFrame, p: Regime = Regime()) -> DataFrame:
    """Posture per session from (trade_date, close_val, nret): state, verdict, size hint,
    confidence multiplier, divergence, medium trend, trend strength and efficiency ratio."""
    w = axis()
    px, nret = F.col("close_val"), F.col("nret")
    d = with_ema(with_ema(nifty, "close_val", "e20", p.ema_fast), "close_val", "e50", p.ema_slow).withColumns({
        "_rn": F.row_number().over(w),
        "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))),
        "vol20": roll_std(nret / 100.0, w, p.vol_win),
        "ret_s": compound(nret, w, p.ret_short), "ret_m": compound(nret, w, p.ret_mid),
        "ret_t": compound(nret, w, p.trend_win),
        "_diff": F.abs(px - F.lag(px).over(w)),
    })
    path = F.when(F.count("_diff").over(w.rowsBetween(-(p.er_win - 1), 0)) >= p.er_win,
                  F.sum("_diff").over(w.rowsBetween(-(p.er_win - 1), 0)))
    d = with_rank_so_far(d, "vol20", "volpct").withColumns({
        "slope": F.col("e20") - F.lag("e20", p.slope_win).over(w),
        "reg_er20": F.abs(px - F.lag(px, p.er_win).over(w)) / nz(path),
    })
    raw = (F.when((px < F.col("e20")) & (F.col("e20") < F.col("e50")), "DOWN")
            .when(yes(F.col("volpct") >= p.vol_hi), "HIGH_VOL")
            .when((px > F.col("e20")) & (F.col("e20") > F.col("e50")), "UP").otherwise("CHOP"))
    d = debounce(d.withColumn("_raw", raw), "_raw", "_base", p.confirm, w)
    return d.select("trade_date", "_rn", "_n", *posture(p)).transform(lambda x: _warm(x, p))


def posture(p: Regime) -> list[Column]:
    """Decision table from the debounced state, the short pullback and the trend overlays. The
    overlays only ever downgrade."""
    er = F.col("reg_er20")
    strength = (F.when(er >= p.er_strong, "strong").when(er < p.er_choppy, "choppy")
                 .otherwise("moderate"))
    reversal = yes((F.col("ret_s") <= p.pullback) & (F.col("ret_m") > 0))
    up_m = yes((F.col("ret_t") > 0) & (F.col("slope") > 0))
    dn_m = yes((F.col("ret_t") < 0) & (F.col("slope") < 0))
    up_s = yes(F.col("ret_s") > 0)
    state = F.when(reversal, "REVERSAL").otherwise(F.col("_base"))
    div = (F.when(up_s & dn_m, "BULLTRAP").when(~up_s & up_m, "DIP_IN_UP")
            .when(up_s & up_m, "ALIGNED_UP").when(~up_s & dn_m, "ALIGNED_DN").otherwise("MIXED"))
    bull = div == "BULLTRAP"
    act0 = state.isin("UP", "HIGH_VOL")
    mult0 = (F.when(state == "REVERSAL", 0.40).when(state == "DOWN", 0.50)
              .when(state == "HIGH_VOL", 1.00).when(state == "UP", 1.00).otherwise(0.70))
    quality = F.when(strength == "strong", 1.00).when(strength == "moderate", 0.90).otherwise(0.80)
    size0 = (F.when(state == "REVERSAL", 0.3).when(state == "DOWN", 0.4)
              .when(state == "HIGH_VOL", 0.75).when(state == "UP", 1.0).otherwise(0.5))
    size1 = F.when(act0, size0 * quality).otherwise(size0)
    size2 = F.when(bull, F.least(size1, F.lit(0.5))).otherwise(size1)
    act = act0 & ~bull
    aligned = (div == "ALIGNED_DN") & ~act
    mult1 = F.when(bull, mult0 * 0.70).otherwise(mult0)
    return [
        F.when(state == "UP", "TRENDING_UP").when(state == "DOWN", "TRENDING_DOWN")
         .when(state == "CHOP", "CHOPPY").otherwise(state).alias("reg_state"),
        F.when(act, "ACT").otherwise("SELECTIVE").alias("reg_verdict"),
        F.bround(F.when(aligned, F.least(size2, F.lit(0.3))).otherwise(size2), 2).alias("reg_size_hint"),
        F.when(aligned, F.least(mult1, F.lit(0.50))).otherwise(mult1).alias("reg_conf_mult"),
        div.alias("reg_divergence"),
        F.when(up_m, "UP").when(dn_m, "DOWN").otherwise("FLAT").alias("reg_med_trend"),
        strength.alias("reg_trend_strength"), er.alias("reg_er20"),
    ]


def _warm(d: DataFrame, p: Regime) -> DataFrame:
    """The first min_rows - 1 sessions (or all, if the whole series is shorter) read UNKNOWN."""
    cold = (F.col("_rn") < p.min_rows) | (F.col("_n") < p.min_rows)
    unknown = {"reg_state": F.lit("UNKNOWN"), "reg_verdict": F.lit("SELECTIVE"),
               "reg_size_hint": F.lit(0.5), "reg_conf_mult": F.lit(1.0),
               "reg_divergence": F.lit("n/a"), "reg_med_trend": F.lit("UNKNOWN"),
               "reg_trend_strength": F.lit("moderate"), "reg_er20": F.lit(None).cast("double")}
    return d.select("trade_date", *[F.when(cold, v).otherwise(F.col(k)).alias(k)
                                    for k, v in unknown.items()])
