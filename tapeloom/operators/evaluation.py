"""Walk-forward evaluation of the signal."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nz, series, yes
from ..params import Calibration, Signal
from ..session import known_size
from .features import add_features, add_relative_strength, conviction_score, signal_mask
from .regime import regime_gate
from .selection import top_per_session


def add_forward_returns(panel: DataFrame) -> DataFrame:
    """Gap to the next session's open and that session's open-to-close move, in bps. "Next" is the
    next row present for the symbol."""
    w = series("symbol")
    d = panel.withColumns({"next_open": F.lead("open_price").over(w),
                           "next_close": F.lead("close_price").over(w)})
    return d.withColumns({"on_bps": (F.col("next_open") / nz(F.col("close_price")) - 1) * 1e4,
                          "d2_bps": (F.col("next_close") / nz(F.col("next_open")) - 1) * 1e4})


def prepare(panel: DataFrame, index: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Features, relative strength, forward returns and the gate, without incomplete rows."""
    d = add_forward_returns(add_relative_strength(add_features(panel, p), index, p))
    return (d.join(known_size(regime_gate(index, p)), "trade_date", "left")
             .withColumn("yr", F.year("trade_date"))
             .na.drop(subset=["clr", "deliv_per", "vol_ratio", "on_bps", "up"]))


def select_signals(prepared: DataFrame, p: Signal = Signal(), gated: bool = True,
                   top_n: int | None = None, score_by: list[str] = ()) -> DataFrame:
    """Signal rows, optionally gated and cut to the best `top_n` per session. The score is ranked
    over the whole selected set unless `score_by` names a partition."""
    d = prepared.where(signal_mask(p))
    if gated:
        d = d.where(yes(F.col("up")))
    if top_n:
        d = top_per_session(conviction_score(d, list(score_by), ["trade_date", "symbol"], p), top_n)
    return d


def per_year(sel: DataFrame, p: Signal = Signal()) -> DataFrame:
    net = F.col("on_bps") - p.cost_bps
    return (sel.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), F.avg("on_bps").alias("gross_on"), F.avg(net).alias("net_on"),
        (100 * F.avg((net > 0).cast("double"))).alias("win_pct"), F.sum(net).alias("total_bps"),
        F.avg(F.col("d2_bps") - p.day2_cost_bps).alias("d2_net"))
        .where(F.col("n") >= p.min_year_rows).withColumnRenamed("yr", "year"))


def weighted_total(years: DataFrame) -> DataFrame:
    return years.agg(F.sum("n").alias("n"),
                     (F.sum(F.col("n") * F.col("net_on")) / F.sum("n")).alias("net_on"))


def evaluate_signal(panel: DataFrame, index: DataFrame, p: Signal = Signal(), gated: bool = True,
                    top_n: int | None = None) -> DataFrame:
    return per_year(select_signals(prepare(panel, index, p), p, gated, top_n), p)


def prior(years: DataFrame, c: Calibration = Calibration()) -> DataFrame:
    """One row: year median, n-weighted mean and between-year spread (population, floored). An
    empty evaluation gives the neutral prior. A year table has one row per calendar year."""
    y = years.agg(
        F.percentile("net_on", F.lit(0.5)).alias("mu0"),
        (F.sum(F.col("n") * F.col("net_on")) / F.sum("n")).alias("mu0_mean"),
        F.greatest(F.stddev_pop("net_on"), F.lit(c.tau_floor)).alias("tau"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n0"))
    return y.select(F.coalesce("mu0", F.lit(0.0)).alias("mu0"),
                    F.coalesce("mu0_mean", F.lit(0.0)).alias("mu0_mean"),
                    F.when(F.col("mu0").isNull(), 30.0).otherwise(F.col("tau")).alias("tau"), "n0")
