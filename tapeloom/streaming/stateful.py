"""Live operators with state of their own: value state in RocksDB, timers on event time, a state to start from.

State is kept by (symbol, session). An event-time timer clears a session a day after its date; the side of
a run, which is read against the clock, expires by a time to live instead. Rows are bars, folded from ticks
in front of the shuffle, and arrive closed, so a key's rows of one batch are few; they are sorted by time.
Everything a batch leaves behind is in the checkpoint, so a restarted query goes on where it stopped.
"""
from __future__ import annotations

import datetime as dt
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import day_fraction, minute_of_day
from ..operators.bars import DAY_MINUTES
from ..params import Signal

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000
TOTALS = "hi double, lo double, pv double, cv double"
RUN_COLS = "symbol string, day date, ts timestamp, close double, run_high double, run_low double, run_vwap double, run_clr double, cum_volume double"
TRIGGER_COLS = "symbol string, day date, entered timestamp, at double"
SIDE_COLS = "symbol string, day date, side string, run_start timestamp, at double"


def rocksdb(spark: SparkSession) -> None:
    """This kind of state needs the RocksDB store; a session that names another keeps it and fails at the start."""
    if spark.conf.get(PROVIDER, None) is None or "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)


def _end_ms(day: dt.date) -> int:
    return int((pd.Timestamp(day) + pd.Timedelta(days=2)).timestamp() * 1000)


class SessionTotals(StatefulProcessor):
    """Running high, low, volume and price x volume of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)

    def advance(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The rows, by time, with the totals up to each; the state moves on."""
        b = pd.concat(list(rows)).sort_values("ts", kind="stable")
        hi, lo, pv, cv = self.totals.get() if self.totals.exists() else (float("-inf"), float("inf"), 0.0, 0.0)
        b["run_high"], b["run_low"] = b["high"].cummax().clip(lower=hi), b["low"].cummin().clip(upper=lo)
        b["cum_volume"] = cv + b["volume"].cumsum()
        paid = pv + ((b["high"] + b["low"] + b["close"]) / 3.0 * b["volume"]).cumsum()
        b["run_vwap"] = (paid / b["cum_volume"]).where(b["cum_volume"] > 0, b["close"])
        span = b["run_high"] - b["run_low"]
        b["run_clr"] = ((b["close"] - b["run_low"]) / span).where(span > 0, 0.5)
        self.totals.update((float(b["run_high"].iloc[-1]), float(b["run_low"].iloc[-1]), float(paid.iloc[-1]), float(b["cum_volume"].iloc[-1])))
        return b

    def until(self, day: dt.date, timers) -> None:
        """One timer for a session, a day after its end (or now, for rows that come after that)."""
        for _ in self.handle.listTimers():
            return
        self.handle.registerTimer(max(_end_ms(day), timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b = self.advance(rows)
        self.until(key[1], timerValues)
        b["symbol"], b["day"] = key[0], key[1]
        yield b[["symbol", "day", "ts", "close", "run_high", "run_low", "run_vwap", "run_clr", "cum_volume"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        yield from ()


class FirstTrigger(SessionTotals):
    """First bar of a session at which every leg holds, told once. Baselines of the session come with the
    state the query starts from; a session without any has no trigger, one without a single baseline
    leaves that leg out."""

    def __init__(self, p: Signal, pace: bool, rs: bool):
        self.p, self.pace, self.rs = p, pace, rs

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.base = handle.getValueState("base", "prev_close double, ref_volume double, rs_base double")
        self.fired = handle.getValueState("fired", "entered timestamp, at double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.base.update(tuple(None if pd.isna(r[c]) else float(r[c]) for c in ("prev_close", "ref_volume", "rs_base")))
        self.until(key[1], timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b = self.advance(rows)
        self.until(key[1], timerValues)
        if self.fired.exists() or not self.base.exists():
            return
        prev, ref, rs_base = self.base.get()
        if not prev:
            return
        ret = b["close"] / prev - 1
        above = ((b["close"] - b["run_vwap"]) / b["run_vwap"]).where(b["run_vwap"] > 0, 0.0)
        ok = (ret >= self.p.ret) & (b["run_clr"] >= self.p.clr) & (above >= self.p.close_vs_vwap)
        if self.rs and rs_base is not None:
            ok &= rs_base + ret - b["idx_ret"].fillna(0.0) > self.p.rs_min
        if self.pace and ref is not None and ref > 0:
            ok &= b["cum_volume"] / ref / b["day_part"] >= self.p.vol_ratio
        if ok.any():
            hit = b[ok].iloc[0]
            self.fired.update((hit["ts"].to_pydatetime(), float(hit["close"])))
            yield pd.DataFrame({"symbol": [key[0]], "day": [key[1]], "entered": [hit["ts"]], "at": [float(hit["close"])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.base, self.fired):
            state.clear()
        yield from ()


class SideRuns(StatefulProcessor):
    """A row for each change of side in a session."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.side = handle.getValueState("side", "side string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values("ts", kind="stable")
        before = b["side"].shift(1)
        before.iloc[0] = self.side.get()[0] if self.side.exists() else ""
        flips = b[b["side"] != before]
        self.side.update((str(b["side"].iloc[-1]),))
        if len(flips):
            yield pd.DataFrame({"symbol": key[0], "day": key[1], "side": flips["side"], "run_start": flips["ts"], "at": flips["close"]})


def _keyed(bars: DataFrame, delay: str):
    return bars.withWatermark("ts", delay).withColumn("day", F.to_date("ts")).groupBy("symbol", "day")


def running_session(bars: DataFrame, delay: str) -> DataFrame:
    """Running VWAP, range, close location and volume of each (symbol, session) of a bar stream."""
    rocksdb(bars.sparkSession)
    return _keyed(bars, delay).transformWithStateInPandas(SessionTotals(), RUN_COLS, "Append", "EventTime")


def first_trigger(bars: DataFrame, baselines: DataFrame, delay: str, p: Signal = Signal(), bar_minutes: int = 5, pace: bool = True,
                  rs: bool = True) -> DataFrame:
    """Triggers of a bar stream (symbol, ts, high, low, close, volume, idx_ret) whose state starts from
    baselines (symbol, day, prev_close, ref_volume, rs_base)."""
    rocksdb(bars.sparkSession)
    b = bars.withColumn("day_part", day_fraction((minute_of_day(F.col("ts")) + bar_minutes) % DAY_MINUTES).cast("double"))
    start = baselines.select("symbol", "day", "prev_close", "ref_volume", "rs_base").groupBy("symbol", "day")
    return _keyed(b, delay).transformWithStateInPandas(FirstTrigger(p, pace, rs), TRIGGER_COLS, "Append", "EventTime", initialState=start)


def side_runs(sides: DataFrame, delay: str, ttl_ms: int = 2 * DAY_MS) -> DataFrame:
    """Starts of unbroken runs of a side in a stream (symbol, ts, side, close)."""
    rocksdb(sides.sparkSession)
    return _keyed(sides, delay).transformWithStateInPandas(SideRuns(ttl_ms), SIDE_COLS, "Append", "ProcessingTime")
