"""Ranked nightly screen and decision board, for one session or for all of them in one job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Signal
from ..sources.panel import with_sector
from ..session import stage
from .calendar import blocked_days, without_events
from .features import add_features, add_relative_strength, conviction_score, signals
from .regime import gate_on
from .selection import capped_book

KEYS = ["trade_date", "symbol"]
COLUMNS = ["trade_date", "symbol", "sector", "close_price", "clr", "deliv_trail", "deliv_per",
           "vol_ratio", "ret", "close_vs_vwap", "rs_idx_cum", "score", "weight", "risk_on"]


def featured(panel: DataFrame, index: DataFrame, p: Signal = Signal()) -> DataFrame:
    return add_relative_strength(add_features(panel, p), index, p)


def _day(feat: DataFrame, date) -> DataFrame:
    return feat if date is None else feat.where(F.col("trade_date") == F.lit(date))


def gross_size(calibrations: DataFrame | None, explicit: float | None = None) -> Column:
    """Gross size of a book: the explicit one, else that of the newest calibration (calibrated, when it
    was made; size_multiplier), else 1. A scalar subquery, so nothing is read while the plan is made."""
    if explicit is not None or calibrations is None:
        return F.lit(1.0 if explicit is None else float(explicit))
    newest = calibrations.where("size_multiplier IS NOT NULL").agg(F.max_by("size_multiplier", "calibrated")).scalar()
    return F.coalesce(newest, F.lit(1.0))


def screen(feat: DataFrame, index: DataFrame, events: DataFrame, sectors: DataFrame, date=None,
           p: Signal = Signal(), size_mult: float | None = None, calibrations: DataFrame | None = None) -> DataFrame:
    """Signal rows without an event in the hold window, scored within their session, capped by
    sector and count. The gross size is `size_mult`, else the last calibration's, else 1; 0 gives an
    empty book."""
    cand = without_events(signals(_day(feat, date), p), events, p.event_horizon_days)
    scored = with_sector(conviction_score(cand, ["trade_date"], KEYS, p), sectors)
    book = capped_book(scored.withColumn("_gross", gross_size(calibrations, size_mult)), p, size_mult="_gross").drop("_gross")
    return gate_on(book, index, p).withColumnRenamed("up", "risk_on").select(*COLUMNS, "position")


def band(df: DataFrame, price: str = "close_price", atr: str = "atr14") -> DataFrame:
    from ..functions.scalars import band_columns
    return df.withColumns(band_columns(F.col(price), F.col(atr)))


def decision_board(feat: DataFrame, index: DataFrame, events: DataFrame, sectors: DataFrame,
                   date=None, p: Signal = Signal(), size_mult: float = 1.0) -> DataFrame:
    """BUY rows with their expected-move band and AVOID rows with a reason, in one table. The score
    is ranked over all footprint rows of the session, thin ones included."""
    core = conviction_score(signals(_day(feat, date), p, require_liquidity=False), ["trade_date"], KEYS, p)
    core = gate_on(with_sector(core, sectors), index, p).withColumnRenamed("up", "risk_on")
    core = core.join(blocked_days(events, p.event_horizon_days).withColumn("_event", F.lit(True)), KEYS, "left")
    core = stage(core)
    thin, event = F.col("turnover_lacs") < p.liq_lacs, F.col("_event").isNotNull()
    buys = band(capped_book(core.where(~thin & ~event & F.col("risk_on")), p, size_mult=size_mult))
    avoid = core.where(thin | event | ~F.col("risk_on")).withColumn(
        "reason", F.when(thin, "illiquid (<₹20cr turnover)").when(event, "EARNINGS — results during the hold")
        .otherwise("regime RISK-OFF (Nifty<50MA)"))
    return (buys.withColumns({"action": F.lit("BUY"), "reason": F.lit("")}).drop("position")
            .unionByName(avoid.withColumn("action", F.lit("AVOID")), allowMissingColumns=True).drop("_event"))
