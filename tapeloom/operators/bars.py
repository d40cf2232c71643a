"""Bar frames: cleaning, resampling, adjustment, session state and first triggers.

Bars are long tables (symbol, ts, open, high, low, close, volume) with ts the bar's open. One row
per (symbol, bar) is bounded by the calendar, so the per-symbol windows below stay small whatever
the tick count behind them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof
from ..functions.rolling import nz, yes
from ..functions.scalars import day_fraction, minute_of_day, price_action
from ..params import Levels, Session, Signal

OHLCV = ("open", "high", "low", "close", "volume")
DAY_MINUTES = 24 * 60


def minutes_after(day: Column, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=m.cast("int"))


def session_slot(ts: Column, minutes: int, s: Session) -> Column:
    return F.floor((minute_of_day(ts) - s.open_min) / minutes).cast("int")


def folded_slot(ts: Column, minutes: int, s: Session) -> Column:
    """Slot of a bar inside its session. A last slot with less than half its span left in the
    session belongs to the slot before it."""
    span = s.close_min - s.open_min
    last = -(-span // minutes) - 1
    stub = last > 0 and span - last * minutes < minutes / 2
    slot = session_slot(ts, minutes, s)
    return F.when(slot >= last, last - 1).otherwise(slot) if stub else F.least(slot, F.lit(last))


def _ohlcv(ts: str = "ts") -> list[Column]:
    return [F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")]


def resample(bars: DataFrame, minutes: int, s: Session = Session(), keys: list[str] = ("symbol",)) -> DataFrame:
    """Coarser bars anchored at the session open, trailing stubs folded by key. A stub with no bar
    in front of it in its session stays a bar of its own."""
    day = F.to_date("ts")
    start = minutes_after(day, s.open_min + session_slot(F.col("ts"), minutes, s) * minutes)
    g = (bars.withColumns({"_day": day, "_slot": folded_slot(F.col("ts"), minutes, s), "_start": start})
             .groupBy(*keys, "_day", "_slot").agg(F.min("_start").alias("_open_ts"), *_ohlcv()))
    return g.select(*keys, F.col("_open_ts").alias("ts"), *OHLCV)


def week_end(day: Column) -> Column:
    return F.date_add(day, (F.lit(4) - F.weekday(day) + 7) % 7)


def calendar_frame(bars: DataFrame, unit: str, now=None, keys: list[str] = ("symbol",)) -> DataFrame:
    """Daily ("1D"), weekly ("1W", ending Friday) or monthly ("1M") bars. With `now`, a last period
    that the data has not filled and the calendar has not passed is dropped."""
    day = F.to_date("ts")
    end = {"1D": day, "1W": week_end(day), "1M": F.last_day(day)}[unit]
    g = (bars.withColumns({"_day": day, "_end": end}).groupBy(*keys, "_end")
             .agg(F.max("_day").alias("_last"), *_ohlcv()))
    if now is not None and unit != "1D":
        g = g.where(~((F.col("_last") < F.col("_end")) & (F.lit(now).cast("date") <= F.col("_end"))))
    return g.select(*keys, F.col("_end").cast("timestamp_ntz").alias("ts"), *OHLCV)


def multi_frame(bars: DataFrame, intraday: dict[str, int], calendar: tuple = ("1D", "1W"), now=None,
                s: Session = Session()) -> DataFrame:
    """All frames of all symbols in one shuffle: the fine bars are shuffled by symbol, then each is exploded
    to its bar key in every frame and folded by (symbol, frame, bar) where it is. Windows over a frame and
    aggregates by symbol find the bars in place, too."""
    day, ts = F.to_date("ts"), F.col("ts")
    fr = []
    for name, m in intraday.items():
        start = minutes_after(day, s.open_min + session_slot(ts, m, s) * m)
        fr.append(F.struct(F.lit(name).alias("frame"), minutes_after(day, folded_slot(ts, m, s)).alias("key"),
                           start.alias("start"), F.lit(None).cast("date").alias("end")))
    ends = {"1D": day, "1W": week_end(day), "1M": F.last_day(day)}
    for name in calendar:
        e = ends[name]
        fr.append(F.struct(F.lit(name).alias("frame"), e.cast("timestamp_ntz").alias("key"),
                           e.cast("timestamp_ntz").alias("start"), e.alias("end")))
    g = (bars.select("symbol", "ts", *OHLCV).repartition("symbol")
             .select("symbol", "ts", *OHLCV, day.alias("_day"), F.explode(F.array(*fr)).alias("f"))
             .groupBy("symbol", "f.frame", F.col("f.key").alias("_key"))
             .agg(F.min("f.start").alias("_start"), F.max("_day").alias("_last"), F.max("f.end").alias("_end"), *_ohlcv()))
    if now is not None:
        partial = F.col("frame").isin("1W", "1M") & (F.col("_last") < F.col("_end")) & (F.lit(now).cast("date") <= F.col("_end"))
        g = g.where(~yes(partial))
    return g.select("symbol", "frame", F.col("_start").alias("ts"), *OHLCV)


def drop_phantom_bars(bars: DataFrame, keys: list[str] = ("symbol",)) -> DataFrame:
    """Remove a bar that repeats its predecessor in every price and in volume."""
    w = Window.partitionBy(*keys).orderBy("ts")
    row = F.struct(*OHLCV)
    return bars.withColumn("_dup", yes(F.lag(row).over(w) == row)).where("NOT _dup").drop("_dup")


def distinct_bars(bars: DataFrame, keys: list[str] = ("symbol",)) -> DataFrame:
    return bars.dropDuplicates([*keys, "ts"])


def closed_bars(bars: DataFrame, minutes: int, now, keys: list[str] = ("symbol",)) -> DataFrame:
    """Bars finished by `now`; a series with none finished keeps all but its newest bar."""
    cut = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    w = Window.partitionBy(*keys)
    d = bars.withColumns({"_ok": F.col("ts") <= cut, "_newest": F.max("ts").over(w)})
    d = d.withColumn("_any", F.max("_ok").over(w))
    return d.where(F.col("_ok") | (~F.col("_any") & (F.col("ts") < F.col("_newest")))).drop("_ok", "_any", "_newest")


def up_to(bars: DataFrame, cut) -> DataFrame:
    """Causal cut: bars that open at or before a point in time."""
    return bars.where(F.col("ts") <= F.lit(cut).cast("timestamp_ntz"))


def back_adjust(bars: DataFrame, gap: float = Levels().gap, keys: list[str] = ("symbol",)) -> DataFrame:
    """Scale every bar in front of a corporate action onto the scale after it: the factor of a bar
    is the product of the close ratios of all later actions. Fewer than three bars stay as they are."""
    w = Window.partitionBy(*keys).orderBy("ts")
    ratio = F.lead("close").over(w) / nz(F.col("close"))
    event = (F.abs(ratio - 1) > gap) & (ratio > 0)
    later = w.rowsBetween(0, Window.unboundedFollowing)
    d = bars.withColumn("_ln", F.when(event, F.ln(ratio)))
    d = d.withColumn("_f", F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= 3,
                                  F.exp(F.coalesce(F.sum("_ln").over(later), F.lit(0.0)))).otherwise(1.0))
    return d.withColumns({c: F.col(c) * F.col("_f") for c in ("open", "high", "low", "close")}).drop("_ln", "_f")


def with_atr(bars: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    """Simple-mean ATR over the bars there are; the first bar's range has no previous close."""
    w = Window.partitionBy(*keys).orderBy("ts")
    pc = F.coalesce(F.lag("close").over(w), F.col("close"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return bars.withColumn("_tr", tr).withColumn("atr", F.avg("_tr").over(w.rowsBetween(-(n - 1), 0))).drop("_tr")


def session_vwap(bars: DataFrame, keys: list[str]) -> DataFrame:
    """VWAP per session from typical prices; without volume the last close."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum("volume")
    return bars.groupBy(*keys).agg(
        F.when(v > 0, F.sum(tp * F.col("volume")) / v).otherwise(F.max_by("close", "ts")).alias("vwap"))


def last_minutes_vwap(bars: DataFrame, keys: list[str], late: Column | None = None) -> DataFrame:
    """VWAP of the closing stretch of the session (by default from 15:00); missing when nothing
    traded in it."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    if late is None:
        late = minute_of_day(F.col("ts")) >= Session().last30_min
    late = F.when(late, F.col("volume"))
    return bars.groupBy(*keys).agg(F.when(F.sum(late) > 0, F.sum(tp * late) / F.sum(late)).alias("close30"))


def session_state(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Session rollup: open, high, low, last price, volume, VWAP, candle anatomy."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum("volume")
    d = bars.groupBy(*keys).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("ltp"), v.alias("volume"),
        F.when(v > 0, F.sum(tp * F.col("volume")) / v).otherwise(F.max_by("close", "ts")).alias("vwap"),
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_bars"))
    d = d.withColumns(price_action(F.col("open"), F.col("high"), F.col("low"), F.col("ltp")))
    return d.withColumns({"vs_vwap": 100 * (F.col("ltp") / nz(F.col("vwap")) - 1), "above_vwap": F.col("ltp") >= F.col("vwap")})


def rsi_columns(close: str, n: str, rn: str, period: int, drop_last: int = 0) -> tuple[Column, Column]:
    """(average gain, average loss) of Wilder smoothing as plain weighted sums, so the recursion is
    an ordinary aggregate: seed changes share the weight k^(m - p) / p, a later change i weighs
    k^(m - i) / p, with k = (p - 1) / p and m changes in all."""
    m = F.col(n) - 1 - drop_last
    i = F.col(rn) - 1
    weight = F.pow(F.lit((period - 1) / period), m - F.greatest(i, F.lit(period))) / period
    use = (i >= 1) & (i <= m)
    d = F.col("_d")
    return (F.sum(F.when(use, F.when(d > 0, d).otherwise(0.0) * weight)),
            F.sum(F.when(use, F.when(d < 0, -d).otherwise(0.0) * weight)))


def _rsi(gain: Column, loss: Column, n: Column, period: int) -> Column:
    value = F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + gain / loss))
    return F.when(n <= period, 50.0).otherwise(value)


def rsi_state(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Fast and slow Wilder RSI of each series, the slope of the fast one, and its tone."""
    from ..functions.scalars import rsi_tone
    w = Window.partitionBy(*keys).orderBy("ts")
    d = bars.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
                          "_d": F.col("close") - F.lag("close").over(w)})
    sums = {}
    for name, period, drop in (("f", 7, 0), ("s", 14, 0), ("p", 7, 1)):
        g, l = rsi_columns("close", "_n", "_rn", period, drop)
        sums[f"_{name}g"], sums[f"_{name}l"] = g, l
    a = d.groupBy(*keys).agg(F.max("_n").alias("_n"), *[c.alias(k) for k, c in sums.items()])
    n = F.col("_n")
    a = a.withColumns({"_f": _rsi(F.col("_fg"), F.col("_fl"), n, 7), "_s": _rsi(F.col("_sg"), F.col("_sl"), n, 14),
                       "_p": _rsi(F.col("_pg"), F.col("_pl"), n - 1, 7)})
    slope = F.when(n > 8, F.col("_f") - F.col("_p")).otherwise(0.0)
    return a.select(*keys, F.bround("_f", 1).alias("rsi7"), F.bround("_s", 1).alias("rsi14"),
                    F.bround(slope, 1).alias("rsi_slope"), rsi_tone(F.col("_f"), slope).alias("tone"))


def running_session(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Running VWAP, range, close location and cumulative volume inside each session."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = bars.withColumns({"cum_volume": F.sum("volume").over(w), "_pv": F.sum(tp * F.col("volume")).over(w),
                          "run_high": F.max("high").over(w), "run_low": F.min("low").over(w)})
    rng = F.col("run_high") - F.col("run_low")
    return d.withColumns({
        "run_vwap": F.when(F.col("cum_volume") > 0, F.col("_pv") / F.col("cum_volume")).otherwise(F.col("close")),
        "run_clr": F.when(rng > 0, (F.col("close") - F.col("run_low")) / rng).otherwise(0.5)}).drop("_pv")


def first_trigger(running: DataFrame, keys: list[str], p: Signal = Signal(), bar_minutes: int = 5,
                  pace: bool = True, rs: bool = True) -> DataFrame:
    """First bar of each session at which every footprint leg holds: its time and close.

    `running` carries prev_close, and ref_volume / rs_base / idx_ret for the optional legs; a
    missing baseline leaves that leg out. The pace leg reads the clock at the bar's close."""
    day_ret = F.col("close") / nz(F.col("prev_close")) - 1
    cvwap = F.when(F.col("run_vwap") > 0, (F.col("close") - F.col("run_vwap")) / F.col("run_vwap")).otherwise(0.0)
    ok = (day_ret >= p.ret) & (F.col("run_clr") >= p.clr) & (cvwap >= p.close_vs_vwap) & (F.col("prev_close") != 0)
    if rs:
        ok = ok & F.when(F.col("rs_base").isNull(), True).otherwise(
            F.col("rs_base") + day_ret - F.coalesce("idx_ret", F.lit(0.0)) > p.rs_min)
    if pace:
        minute = (minute_of_day(F.col("ts")) + bar_minutes) % DAY_MINUTES
        frac = day_fraction(minute)
        ok = ok & F.when(yes(F.col("ref_volume") > 0),
                         F.col("cum_volume") / F.col("ref_volume") / frac >= p.vol_ratio).otherwise(True)
    hit = F.when(ok, F.col("ts"))
    return (running.groupBy(*keys).agg(F.min(hit).alias("entered"), F.min_by("close", hit).alias("at"))
                   .where("entered IS NOT NULL"))


def index_at_bars(bars: DataFrame, index: DataFrame, prev_close: str = "prev_close") -> DataFrame:
    """Index return so far at each bar time of a session: the last index bar at or before it, 0 where
    there is none. The as-of step runs on the distinct bar times."""
    axis = bars.select(F.to_date("ts").alias("_day"), "ts").distinct()
    ix = index.select(F.to_date("ts").alias("_day"), "ts", (F.col("close") / nz(F.col(prev_close)) - 1).alias("idx_ret"))
    a = asof(axis, ix, "ts", ["idx_ret"], by=["_day"]).drop("matched_ts", "_day")
    return bars.join(a, "ts", "left").withColumn("idx_ret", F.coalesce("idx_ret", F.lit(0.0)))


def attach_trigger(board: DataFrame, triggers: DataFrame, keys: list[str], ltp: str = "ltp",
                   wanted: Column | None = None) -> DataFrame:
    """Trigger time, price and move since, for the wanted rows; every board row is kept."""
    from ..functions.scalars import since_pct
    t = triggers.select(*keys, "entered", F.bround("at", 2).alias("at"), F.col("at").alias("_px"))
    d = board.join(t, keys, "left")
    if wanted is not None:
        d = d.withColumns({c: F.when(wanted, F.col(c)) for c in ("entered", "at", "_px")})
    return d.withColumn("since_pct", since_pct(F.col(ltp), F.col("_px"))).drop("_px")
