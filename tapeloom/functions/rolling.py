"""Window helpers: per-key row windows with an explicit minimum-observations guard.

Row windows here always run on series that are already one row per (symbol, session) or
(symbol, bar). Such a series is bounded by the calendar, however many raw ticks or trades stood
behind it, so a window partition stays small even when one symbol owns a third of the raw rows.
"""
from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def series(*keys: str, order: str = "trade_date"):
    return Window.partitionBy(*keys).orderBy(order)


def axis(order: str = "trade_date"):
    """Window over a calendar axis (one row per session of one series): no partition key, and
    bounded by the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def guarded(agg: Column, value: Column, frame, need: int) -> Column:
    """`agg` over `frame`, NULL until `need` non-null values of `value` are inside it."""
    return F.when(F.count(value).over(frame) >= need, agg.over(frame))


def roll_mean(value: Column, w, n: int, skip: int = 0, need: int | None = None) -> Column:
    frame = w.rowsBetween(-(n - 1) - skip, -skip)
    return guarded(F.avg(value), value, frame, n if need is None else need)


def roll_sum(value: Column, w, n: int, skip: int = 0, need: int | None = None) -> Column:
    frame = w.rowsBetween(-(n - 1) - skip, -skip)
    return guarded(F.sum(value), value, frame, n if need is None else need)


def roll_median(value: Column, w, n: int, skip: int = 0, need: int | None = None) -> Column:
    frame = w.rowsBetween(-(n - 1) - skip, -skip)
    return guarded(F.percentile(value, F.lit(0.5)), value, frame, n if need is None else need)


def roll_std(value: Column, w, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return guarded(F.stddev_samp(value), value, frame, n)


def compound(pct: Column, w, n: int) -> Column:
    """Percent return compounded over the last n rows; NULL until row n+1 (the first row has no
    predecessor to divide by) or where either end of the span is missing."""
    first = F.lag(pct, n).over(w)
    span = F.sum(F.log1p(pct / 100.0)).over(w.rowsBetween(-(n - 1), 0))
    return F.when(pct.isNotNull() & first.isNotNull(), F.expm1(span) * 100.0)


def true_range(high: Column, low: Column, prev_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def nz(value: Column) -> Column:
    """Zero becomes NULL, so that a division by it is NULL too."""
    return F.when(value != 0, value)


def yes(cond: Column) -> Column:
    """A comparison with a missing value counts as not met."""
    return F.coalesce(cond, F.lit(False))


def even(value: Column, n: int) -> Column:
    """Rounded half-even to n decimals as arrays round: scaled in floating point, rounded, scaled back. SQL's
    round_even of a double does the same; bround rounds the decimal text and differs next to a tie."""
    scale = float(10 ** n)
    return F.rint((F.col(value) if isinstance(value, str) else value) * scale) / scale


def fixed2(value: Column) -> Column:
    """Text with two decimals of the exact binary value, as printf writes it. A %.2f of Java's rounds the
    shortest decimal text instead: 25703.035 lies below its tie and is 25703.03."""
    return F.call_function("format_number", value, F.lit("0.00"))
