"""Short-horizon board: fine trigger frame against a settled confirm frame, expected move, cost,
room to the next level, and how long the current side has held."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.asof import asof
from ..functions.rolling import even, nz, yes
from ..params import Cost, Levels, Session, Structure
from ..session import stage
from . import bars as bo
from . import synthesis as sy
from .levels import frame_summary, sr_levels
from .structure import last_bar, structure_table

H = ["struct", "box_hi", "box_lo", "n"]


def side_by_bar(fine: DataFrame, coarse: DataFrame, delay_minutes: int, s: Structure = Structure(),
                min_bars: int = 5) -> DataFrame:
    """Verdict at the close of every fine bar, from the newest coarse bar that had opened at least
    `delay_minutes` before it (coarse minus fine bar length when the coarse bar must be complete).
    NULL where either frame has too few bars."""
    low = structure_table(fine, ["symbol"], s).select("symbol", "ts", "close", "n", F.col("struct").alias("_ls"))
    high = structure_table(coarse, ["symbol"], s).select("symbol", "ts", *H)
    low = low.withColumn("_at", F.col("ts") - F.make_dt_interval(mins=F.lit(delay_minutes))).withColumnRenamed("n", "_ln")
    d = asof(low.withColumnRenamed("ts", "bar_ts").withColumnRenamed("_at", "ts"), high, "ts", H, by=["symbol"])
    syn = sy.synthesize(F.col("struct"), F.col("box_hi"), F.col("box_lo"), F.col("n"), F.col("_ls"), F.col("close"))
    readable = (F.col("_ln") >= min_bars) & yes(F.col("n") >= min_bars)
    d = d.withColumns({"setup": syn["setup"], "dir": syn["dir"]})
    return d.select("symbol", F.col("bar_ts").alias("ts"), "close", "setup",
                    F.when(readable, sy.side_of(F.col("setup"), F.col("dir"))).alias("side"))


def run_start(sides: DataFrame, current: DataFrame, max_walk: int = 240, min_index: int = 4) -> DataFrame:
    """Start of the unbroken run behind the side each symbol shows now: time (with a bound mark when
    the run reaches the first readable bar of the session), price and signed move. The newest bar's
    side is taken from `current` (symbol, side, ltp)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = Window.partitionBy("symbol")
    sides, current = stage(sides), stage(current.select("symbol", "side", "ltp"))     # both are read twice
    d = sides.withColumns({"_i": F.row_number().over(w) - 1, "_last": F.count(F.lit(1)).over(whole) - 1,
                           "_day": F.to_date("ts"), "_today": F.to_date(F.max("ts").over(whole))})
    d = d.withColumn("_s0", F.min(F.when(F.col("_day") == F.col("_today"), F.col("_i"))).over(whole))
    d = d.withColumn("_floor", F.greatest("_s0", F.col("_last") - max_walk, F.lit(min_index)))
    d = d.withColumnRenamed("side", "_side").join(current.select("symbol", "side", "ltp"), "symbol")
    inside = (F.col("_i") >= F.col("_floor")) & (F.col("_i") < F.col("_last"))
    breaks = F.when(inside & ~yes(F.col("_side") == F.col("side")), F.col("_i"))
    unread = F.when(F.col("_side").isNull(), breaks)
    b = d.groupBy("symbol").agg(F.max(breaks).alias("_break"), F.max(unread).alias("_unread"),
                                F.max("_last").alias("_l"), F.max("_floor").alias("_f"))
    start = F.when(F.col("_break").isNotNull(), F.col("_break") + 1).otherwise(F.least("_f", "_l"))
    bounded = F.when(F.col("_break").isNotNull(), F.coalesce(F.col("_unread") == F.col("_break"), F.lit(False))).otherwise(start <= F.col("_f"))
    b = b.withColumns({"_start": start, "_bounded": bounded})
    d = d.join(b.select("symbol", "_start", "_bounded"), "symbol").where((F.col("_i") == F.col("_start")) & (F.col("_last") >= 5))
    d = d.where(F.col("side").isin("LONG", "SHORT"))
    return d.select("symbol", F.concat(F.when(F.col("_bounded"), "≥").otherwise(""), F.date_format("ts", "HH:mm")).alias("entered"),
                    even("close", 2).alias("at"), sc.since_pct(F.col("ltp"), F.col("close"), F.col("side")).alias("since_pct"))


def short_entry(sides: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """First bar of the newest session whose verdict is SHORT; no row for a symbol that was already
    short at the end of the session before."""
    whole = Window.partitionBy("symbol")
    d = sides.withColumns({"_day": F.to_date("ts"), "_today": F.to_date(F.max("ts").over(whole))})
    prior = F.when(F.col("_day") < F.col("_today"), F.col("ts"))
    short_today = F.when((F.col("_day") == F.col("_today")) & yes(F.col("side") == "SHORT"), F.col("ts"))
    g = d.groupBy("symbol").agg(F.max_by("side", prior).alias("_before"), F.min(short_today).alias("_ts"),
                                F.min_by("close", short_today).alias("_px"))
    g = g.where(F.col("_ts").isNotNull() & ~yes(F.col("_before") == "SHORT"))
    return g.select("symbol", F.date_format("_ts", "HH:mm").alias("entered"), even("_px", 2).alias("at"))


def energy(bars: DataFrame, now, minutes: int, rows: int = 10) -> DataFrame:
    """Mean range in bps and relative volume of the last closed bars of the newest session (the
    whole session while fewer have closed)."""
    whole = Window.partitionBy("symbol")
    day = F.to_date("ts")
    d = bars.withColumns({"_day": day, "_today": F.to_date(F.max("ts").over(whole))})
    cut = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    d = d.withColumns({"_in": F.col("_day") == F.col("_today"), "_closed": (F.col("_day") == F.col("_today")) & (F.col("ts") <= cut)})
    d = d.withColumn("_n", F.sum(F.col("_closed").cast("int")).over(whole))
    d = d.withColumn("_use", F.when(F.col("_n") >= rows, F.col("_closed")).otherwise(F.col("_in")))
    w = Window.partitionBy("symbol", "_use").orderBy(F.col("ts").desc())
    d = d.withColumn("_k", F.row_number().over(w))
    take = F.col("_use") & (F.col("_k") <= rows)
    med = F.percentile("volume", F.lit(0.5))
    return d.groupBy("symbol").agg(
        F.avg(F.when(take, sc.bps_range(F.col("high"), F.col("low"), F.col("close")))).alias("rv10"),
        F.when(med > 0, F.avg(F.when(take, F.col("volume"))) / med).alias("rvol"))


def short_horizon_board(fine: DataFrame, fine_min: int, confirm_min: int, up_min: int, now, cost: Cost = Cost(),
                        s: Session = Session(), st: Structure = Structure(), p: Levels = Levels(),
                        position: float | None = None) -> DataFrame:
    """One row per symbol. Trigger structure includes the printing bar, confirm and upper frames use
    closed bars only. Room is the distance to the next multi-touch wall of the upper frame in
    expected moves; headroom is in ATR, so it is scaled by the ATR."""
    key = ["symbol"]
    low = last_bar(structure_table(fine, key, st, forming=True), key).select("symbol", F.col("struct").alias("ltf_struct"))
    confirm = bo.closed_bars(bo.resample(fine, confirm_min, s), confirm_min, now)
    conf = structure_table(confirm, key, st)
    high = last_bar(conf, key).where("n >= 5").select("symbol", *H, F.col("atr").alias("atr_c"))
    upper = bo.closed_bars(bo.resample(fine, up_min, s), up_min, now)
    day = F.to_date("ts")
    newest = fine.groupBy("symbol").agg(F.max(day).alias("_d"))
    marked = fine.join(newest, "symbol")
    sess = bo.session_state(marked.where(day == F.col("_d")), key)
    prev = marked.where(day < F.col("_d")).groupBy("symbol").agg(F.max_by("close", "ts").alias("_pc"))
    turn = marked.where(day == F.col("_d")).groupBy("symbol").agg((F.sum(F.col("volume") * F.col("close")) / 1e5).alias("turnover"))
    d = (sess.join(low, "symbol").join(high, "symbol").join(prev, "symbol", "left").join(turn, "symbol")
             .join(energy(fine, now, fine_min), "symbol"))
    syn = sy.synthesize(F.col("struct"), F.col("box_hi"), F.col("box_lo"), F.col("n"), F.col("ltf_struct"), F.col("ltp"))
    d = d.withColumns({"setup": syn["setup"], "dir": syn["dir"], "loc": syn["loc"]})
    d = d.withColumns({"side": sy.side_of(F.col("setup"), F.col("dir")), "setup_rank": sy.setup_rank(F.col("setup"))})
    exp = sc.exp_move_bps(F.col("rv10"))
    trip = sc.round_trip_bps(F.lit(position if position is not None else cost.position), F.col("ltp"), F.lit(cost.spread_ticks), cost)
    d = d.withColumns({"_exp": exp, "_cost": trip})
    d = d.withColumn("_pays", sc.p_pays(F.col("_exp"), F.col("_cost")))
    spot = d.select("symbol", F.col("ltp").alias("spot"))
    lv = sr_levels(frame_summary(upper, key, st, p).join(spot, "symbol"), F.col("spot"), p).select(
        "symbol", "support", "resistance", "head_up", "head_dn", F.col("atr").alias("atr_u"))
    d = d.join(lv, "symbol", "left")
    head = F.when(F.col("side") == "LONG", F.col("head_up")).when(F.col("side") == "SHORT", F.col("head_dn"))
    room = 1e4 * head * F.col("atr_u") / nz(F.col("ltp")) / F.col("_exp")
    sides = side_by_bar(fine, bo.resample(fine, confirm_min, s), confirm_min - fine_min, st)
    d = d.join(run_start(sides, d.select("symbol", "side", "ltp")), "symbol", "left")
    pc = F.coalesce("_pc", "open")
    atr = F.when(F.col("atr_c") > 0, F.col("atr_c"))
    return d.select(
        "symbol", "setup", "dir", "side", "setup_rank", "loc", even("ltp", 2).alias("ltp"),
        even(100 * (F.col("ltp") / nz(pc) - 1), 2).alias("day_pct"), F.coalesce("entered", F.lit("—")).alias("entered"),
        "at", "since_pct", even("_exp", 1).alias("exp_move"), even("_cost", 1).alias("cost"),
        even("_pays", 0).alias("p_pays"), sc.pays_tag(F.col("_pays")).alias("pays"), even("rvol", 2).alias("rvol"),
        even(1e4 * cost.tick / nz(F.col("ltp")), 2).alias("spread"), "ltf_struct", F.col("struct").alias("htf_struct"),
        even(100 * (F.col("ltp") / nz(F.col("vwap")) - 1), 2).alias("vs_vwap"), F.col("support").alias("sup"), F.col("resistance").alias("res"),
        F.coalesce(even(room, 2), F.lit(float("inf"))).alias("room"),
        even(F.col("ltp") - atr, 2).alias("stop"), even(F.col("ltp") + atr, 2).alias("t1"), even(atr, 2).alias("atr"),
        even("turnover", 1).alias("turnover"), F.col("n_bars").alias("bars"))


def short_entries(sides: DataFrame) -> DataFrame:
    """The entry of short_entry() as of every session of every symbol, in one pass: (symbol, d, entered,
    at) for the sessions in which a short side appears that the last read before did not have."""
    short = F.when(F.col("side") == "SHORT", F.struct("ts", "close"))
    days = sides.groupBy("symbol", F.to_date("ts").alias("d")).agg(
        F.min(short).alias("hit"), F.max_by("side", F.when(F.col("side").isNotNull(), F.col("ts"))).alias("_side"))
    past = Window.partitionBy("symbol").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.last("_side", ignorenulls=True).over(past))
    new = F.col("hit").isNotNull() & F.coalesce(F.col("_before") != "SHORT", F.lit(True))
    return days.where(new).select("symbol", "d", F.date_format("hit.ts", "HH:mm").alias("entered"), even("hit.close", 2).alias("at"))
