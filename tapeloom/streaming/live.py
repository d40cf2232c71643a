"""Structured Streaming forms of the live operators.

Time is event time throughout. Lateness is a parameter: a row later than the watermark allows is
dropped by Spark and shows up in the query's progress (numRowsDroppedByWatermark).

The stateful operators take bars, not raw ticks, and key their state by (symbol, session). Ticks
are folded to bars by a windowed aggregate first, with its map-side combine, so a symbol that
sends a third of all ticks still reaches the state as one row per bar.
"""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as sc
from ..operators.bars import DAY_MINUTES, folded_slot, minutes_after
from ..params import Session, Signal

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def bars_stream(ticks: DataFrame, minutes: int, delay: str, s: Session = Session()) -> DataFrame:
    """Closed OHLCV bars of a tick stream (symbol, ts, event_id, price). A bar is emitted once the
    watermark has passed its end, which is the closed-bar rule.

    A length that divides the day uses time windows shifted to the session open. Any other length
    carries its bucket start as the event-time column; its one watermark sits on that column, so
    `delay` there has to be at least the bar length."""
    agg = [F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
           F.max_by("price", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")]
    if DAY_MINUTES % minutes == 0:
        shift = s.open_min % minutes
        win = F.window("ts", f"{minutes} minutes", f"{minutes} minutes", f"{shift} minutes")
        g = ticks.withWatermark("ts", delay).groupBy("symbol", win.alias("w")).agg(*agg)
        return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    start = minutes_after(F.to_date("ts"), s.open_min + folded_slot(F.col("ts"), minutes, s) * minutes).cast("timestamp")
    t = ticks.withColumn("bar", start).withWatermark("bar", delay)
    g = t.groupBy("symbol", "bar").agg(*agg)
    return g.select("symbol", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def distinct_bars_stream(bars: DataFrame, delay: str) -> DataFrame:
    """Drop re-sent bars within the watermark."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


RUN_COLS = "symbol string, day date, ts timestamp, close double, run_high double, run_low double, run_vwap double, run_clr double, cum_volume double"
_RUN_STATE = "hi double, lo double, pv double, cv double"


def _advance(state: tuple, b: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    """Run the session totals of one (symbol, session) forward over its new bars."""
    hi, lo, pv, cv = state
    b = b.sort_values("ts", kind="stable")
    tp = (b["high"] + b["low"] + b["close"]) / 3.0
    out = pd.DataFrame({"ts": b["ts"], "close": b["close"]})
    out["run_high"] = b["high"].cummax().clip(lower=hi)
    out["run_low"] = b["low"].cummin().clip(upper=lo)
    out["cum_volume"] = cv + b["volume"].cumsum()
    total = pv + (tp * b["volume"]).cumsum()
    out["run_vwap"] = (total / out["cum_volume"]).where(out["cum_volume"] > 0, out["close"])
    rng = out["run_high"] - out["run_low"]
    out["run_clr"] = ((out["close"] - out["run_low"]) / rng).where(rng > 0, 0.5)
    return out, (float(out["run_high"].iloc[-1]), float(out["run_low"].iloc[-1]), float(total.iloc[-1]), float(out["cum_volume"].iloc[-1]))


_FRESH = (float("-inf"), float("inf"), 0.0, 0.0)


def _session_ttl(state: GroupState, day) -> None:
    """State of a session expires a day after its date."""
    end = int((pd.Timestamp(day) + pd.Timedelta(days=2)).timestamp() * 1000)
    state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))


def _keyed(bars: DataFrame, delay: str) -> DataFrame:
    return bars.withWatermark("ts", delay).withColumn("day", F.to_date("ts")).groupBy("symbol", "day")


def running_session_stream(bars: DataFrame, delay: str) -> DataFrame:
    """Running VWAP, range, close location and volume per (symbol, session)."""
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        b = pd.concat(list(pdfs))
        out, new = _advance(tuple(state.get) if state.exists else _FRESH, b)
        state.update(new)
        _session_ttl(state, key[1])
        out.insert(0, "day", key[1])
        out.insert(0, "symbol", key[0])
        yield out
    return _keyed(bars, delay).applyInPandasWithState(step, RUN_COLS, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_trigger_stream(bars: DataFrame, delay: str, p: Signal = Signal()) -> DataFrame:
    """First bar of each (symbol, session) at which the price legs hold, emitted once and never
    revised. `bars` carries prev_close."""
    cols = "symbol string, day date, entered timestamp, at double"

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        b = pd.concat(list(pdfs))
        old = tuple(state.get) if state.exists else (*_FRESH, False)
        out, new = _advance(old[:4], b)
        fired = bool(old[4])
        if not fired:
            prev = b.sort_values("ts", kind="stable")["prev_close"]
            ok = ((prev != 0) & (out["close"] / prev - 1 >= p.ret) & (out["run_clr"] >= p.clr)
                  & ((out["close"] - out["run_vwap"]) / out["run_vwap"] >= p.close_vs_vwap))
            hits = out[ok]
            if len(hits):
                fired = True
                h = hits.iloc[0]
                yield pd.DataFrame({"symbol": [key[0]], "day": [key[1]], "entered": [h["ts"]], "at": [h["close"]]})
        state.update((*new, fired))
        _session_ttl(state, key[1])
    return _keyed(bars, delay).applyInPandasWithState(step, cols, _RUN_STATE + ", fired boolean", "append",
                                                      GroupStateTimeout.EventTimeTimeout)


def first_seen_stream(rows: DataFrame, delay: str) -> DataFrame:
    """Earliest event time of each symbol in a session, whatever order its rows come in; emitted once
    the watermark has passed the session. Tasks combine before the shuffle, so raw ticks may be passed."""
    day = F.window("ts", "1 day")
    g = rows.withWatermark("ts", delay).groupBy("symbol", day.alias("w")).agg(F.min("ts").alias("first_seen"))
    return g.select("symbol", F.to_date("w.start").alias("day"), "first_seen")


def side_run_stream(sides: DataFrame, delay: str) -> DataFrame:
    """Start of each unbroken run of a side per (symbol, session): one row per flip. `sides` is
    (symbol, ts, side, close)."""
    cols = "symbol string, day date, side string, run_start timestamp, at double"

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        b = pd.concat(list(pdfs)).sort_values("ts", kind="stable")
        last = state.get[0] if state.exists else ""
        flips = b[b["side"] != b["side"].shift(1).fillna(last)]
        state.update((str(b["side"].iloc[-1]),))
        _session_ttl(state, key[1])
        if len(flips):
            yield pd.DataFrame({"symbol": key[0], "day": key[1], "side": flips["side"], "run_start": flips["ts"], "at": flips["close"]})
    return _keyed(sides, delay).applyInPandasWithState(step, cols, "side string", "append", GroupStateTimeout.EventTimeTimeout)


def latest_quotes_stream(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol, kept up to date; for the update or complete output mode."""
    cols = [c for c in quotes.columns if c != "symbol"]
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*cols), "ts").alias("q")).select("symbol", "q.*")


def reprice_sink(board: DataFrame, path: str, reprice):
    """foreachBatch writer: join the newest quotes to a pinned board and write the whole board as
    one snapshot per batch. A batch that is run again overwrites its own snapshot."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reprice(board, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def bar_bucket(ts, minutes: int, s: Session = Session()):
    """Bar number a clock time falls into; a re-scan is due when it changes."""
    return F.floor((sc.minute_of_day(ts) - s.open_min) / minutes).cast("int")


def rescan_due(clock: DataFrame, minutes: int, delay: str, s: Session = Session()) -> DataFrame:
    """One row per (day, bar bucket) the clock stream enters: the moments a scan is due. The clock
    is a bar stream or any other slow stream, not the ticks."""
    d = clock.withWatermark("ts", delay).withColumns({"day": F.to_date("ts"), "bucket": bar_bucket(F.col("ts"), minutes, s)})
    return d.dropDuplicatesWithinWatermark(["day", "bucket"]).select("day", "bucket", "ts")


def gate_stream(live: DataFrame, prior: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Live regime gate: stream-static join of index quotes (trade_date, ts, live_close) with the
    sums of the closes before each session (trade_date, n, total, newest)."""
    d = live.join(prior, "trade_date", "left")
    ma = (F.col("total") + F.col("live_close")) / p.regime_ma
    ok = ((F.col("n") == p.regime_ma - 1) & (F.datediff("trade_date", "newest") <= p.max_stale_days)
          & (F.col("live_close") != 0) & (F.col("live_close") > ma))
    return d.select("trade_date", "ts", "live_close", F.coalesce(ok, F.lit(False)).alias("up"))


def prior_sums(index: DataFrame, p: Signal = Signal()) -> DataFrame:
    """For each session, the last regime_ma - 1 closes strictly before it: count, sum, newest date."""
    from ..functions.rolling import axis
    w = axis().rowsBetween(-(p.regime_ma - 1), -1)
    return index.select("trade_date", F.count("close_val").over(w).alias("n"), F.sum("close_val").over(w).alias("total"),
                        F.max("trade_date").over(w).alias("newest"))
