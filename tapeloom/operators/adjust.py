"""Corporate actions: a table of price factors told on one axis, joined as of to any frame.

An action is a close that differs from the one before it by more than the gap. The table has a row for
each action of a symbol, valid from the action's bar, and one (null) for the time in front of the first;
its factor is the product of the ratios of all later actions, a suffix product over the actions alone.
Only symbols with an action are in it, so the planner sees a small table and may broadcast it; a bar
looks up the newest row that is valid at its time. Frames built on adjusted bars need no table of their
own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nz
from ..params import Levels
from .bars import OHLCV, calendar_frame, multi_frame

PRICES = ("open", "high", "low", "close")
MIN_BARS = 3


def action_factors(axis: DataFrame, gap: float = Levels().gap, keys: list[str] = ("symbol",)) -> DataFrame:
    """(keys, valid_from, factor) of an axis (keys, ts, close); series under three bars have no actions."""
    w, whole = Window.partitionBy(*keys).orderBy("ts"), Window.partitionBy(*keys)
    d = axis.select(*keys, "ts", (F.col("close") / nz(F.lag("close").over(w))).alias("_ratio"),
                    F.count(F.lit(1)).over(whole).alias("_n"))
    d = d.where((F.abs(F.col("_ratio") - 1) > gap) & (F.col("_ratio") > 0) & (F.col("_n") >= MIN_BARS)).withColumn("_ln", F.ln("_ratio"))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    d = d.select(*keys, "ts", "_ln", F.coalesce(F.sum("_ln").over(later), F.lit(0.0)).alias("_later"),
                 (F.row_number().over(w) == 1).alias("_first"))
    after = F.struct(F.col("ts").alias("valid_from"), F.exp("_later").alias("factor"))
    before = F.struct(F.lit(None).cast(d.schema["ts"].dataType).alias("valid_from"), F.exp(F.col("_ln") + F.col("_later")).alias("factor"))
    return d.select(*keys, F.explode(F.when(F.col("_first"), F.array(before, after)).otherwise(F.array(after))).alias("f")).select(*keys, "f.*")


def adjusted(bars: DataFrame, factors: DataFrame, keys: list[str] = ("symbol",)) -> DataFrame:
    """bars with their prices on the scale after the newest action. The rows of one series in the table
    (at most one for each of its sessions, and one) are looked up in order."""
    table = factors.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("valid_from", "factor"))).alias("_f"))
    valid = F.filter("_f", lambda f: f["valid_from"].isNull() | (f["valid_from"] <= F.col("ts")))
    d = bars.join(table, list(keys), "left").withColumn("_k", F.coalesce(F.try_element_at(valid, F.lit(-1))["factor"], F.lit(1.0)))
    return d.withColumns({c: F.col(c) * F.col("_k") for c in PRICES}).drop("_f", "_k")


def history(daily: DataFrame, end, days: int, p: Levels = Levels()) -> DataFrame:
    """Adjusted daily bars (symbol, ts, prices, volume) of the calendar days before and including `end`,
    from a panel (trade_date, symbol, ..._price, ttl_trd_qnty)."""
    last = F.lit(end).cast("date")
    d = (daily.where((F.col("trade_date") <= last) & (F.col("trade_date") >= F.date_sub(last, days)))
         .select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), *[F.col(f"{c}_price").alias(c) for c in PRICES],
                 F.col("ttl_trd_qnty").cast("double").alias("volume")))
    return adjusted(d, action_factors(d, p.gap))


def daily_history(daily: DataFrame, end, p: Levels = Levels()) -> DataFrame:
    return history(daily, end, p.daily_days, p)


def monthly_history(daily: DataFrame, end, p: Levels = Levels()) -> DataFrame:
    """Months of the adjusted days; the month that is not over is left out."""
    return calendar_frame(history(daily, end, p.monthly_days, p), "1M", end)


def all_frames(fine: DataFrame | None, daily: DataFrame, intraday: dict[str, int], now, session, p: Levels = Levels()) -> DataFrame:
    """Every frame of every symbol (symbol, frame, ts, prices, volume): intraday frames from the fine bars,
    days and weeks from the daily history, months from the long one. Fine bars are adjusted by their own
    axis, where the first bar after an action tells its ratio."""
    days = daily_history(daily, now, p)
    out = multi_frame(days, {}, ("1D", "1W"), now, session)
    months = monthly_history(daily, now, p).withColumn("frame", F.lit("1M"))
    out = out.unionByName(months.select("symbol", "frame", "ts", *OHLCV))
    if fine is None:
        return out
    return multi_frame(adjusted(fine, action_factors(fine, p.gap)), intraday, (), now, session).unionByName(out)
