"""Sector rotation engine: sector-day factors, breadth, persistence, cross-sectional tilt.

Symbol-level work happens once, in one pass over the panel partitioned by symbol; everything after
the first aggregate has one row per (session, sector) and is bounded by the calendar and the
sector list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof
from ..functions.ranking import pct_rank, spread_median
from ..functions.rolling import axis, compound, nz, series, yes
from ..params import Regime, Tilt
from ..session import known_size, stage, stage_all
from .regime import regime_history

KEY = ["trade_date", "sector"]


def _members(daily: DataFrame, master: DataFrame, t: Tilt) -> DataFrame:
    return (daily.where(F.col("series").isin(*t.series))
                 .join(master.where(~F.col("sector").isin(*t.exclude)), "symbol"))


def sector_panel(daily: DataFrame, master: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    """Per (session, sector): delivery value, return weighted by the previous session's turnover,
    and the number of liquid names. Moves beyond `drop_pct` are corporate actions and leave the
    return; the rest is clipped. Liquidity is judged on the previous session."""
    w = series("symbol")
    raw = (F.col("close_price") - F.col("prev_close")) / nz(F.col("prev_close")) * 100
    d = _members(daily, master, t).select(
        *KEY, "turnover_lacs", "deliv_per", raw.alias("raw"),
        F.lag("turnover_lacs").over(w).alias("w_lag")).where(F.col("w_lag") >= t.min_turnover)
    ok = yes(F.abs("raw") < t.drop_pct)
    r = F.least(F.greatest(F.col("raw"), F.lit(-t.clip_pct)), F.lit(t.clip_pct))
    return d.groupBy(*KEY).agg(
        (F.sum(F.when(ok, F.col("turnover_lacs") * F.col("deliv_per") / 100)) / 100).alias("daily_dv_cr"),
        (F.sum(F.when(ok, F.col("w_lag") * r)) / nz(F.sum(F.when(ok, F.col("w_lag"))))).alias("wtd_ret_pct"),
        F.count(F.lit(1)).alias("n_liq"), F.count_if(ok).alias("n_ret"))


def sector_factors(panel: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    """Momentum and delivery-flow factors per sector; needs min_hist rows in the trailing window."""
    p = panel.where("n_ret > 0").withColumn("_day", F.unix_date("trade_date"))
    w = series("sector")
    recent = Window.partitionBy("sector").orderBy("_day").rangeBetween(-(t.panel_cal - 2), 0)
    base = F.avg("daily_dv_cr").over(w.rowsBetween(-t.dv_base, -1))
    flow = F.avg("daily_dv_cr").over(w.rowsBetween(-(t.dv_flow - 1), 0))
    return p.withColumns({
        "mom_2w": compound(F.col("wtd_ret_pct"), w, t.mom_2w),
        "mom_1w": compound(F.col("wtd_ret_pct"), w, t.mom_1w),
        "dv5d": flow / F.when(base > 0, base),
        "_seq": F.count(F.lit(1)).over(recent)}).where(F.col("_seq") >= t.min_hist).drop("_seq", "_day")


def with_slot(d: DataFrame) -> DataFrame:
    """Number the sessions of a panel. A window over the session number counts market sessions, so
    a missing symbol-day takes up a slot without the grid ever being filled in."""
    slots = d.select("trade_date").distinct().withColumn("slot", F.row_number().over(axis()))
    return d.join(known_size(slots), "trade_date")


def delivery_state(deliv: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    """Accumulation flag and normalised delivery slope of every usable (session, symbol)."""
    d = with_slot(deliv)
    y, x = F.col("deliv_per"), F.col("slot")
    w = Window.partitionBy("symbol").orderBy("slot")
    prev = w.rangeBetween(-t.dv_base, -1)
    trend = w.rangeBetween(-(t.slope_win - 1), 0)
    m = (t.slope_win - 1) / 2.0
    hist = F.count(y).over(prev)
    # x of a slot is its distance from the window centre; an absent slot leaves the numerator only
    d = d.withColumns({
        "_base": F.when(hist >= t.deliv_min_hist, F.avg(y).over(prev)),
        "_hist": F.sort_array(F.collect_list(y).over(prev)),
        "_flow": F.avg(y).over(w.rangeBetween(-(t.dv_flow - 1), 0)),
        "_n": F.count(y).over(trend), "_sy": F.sum(y).over(trend),
        "_sx": F.sum(x).over(trend), "_sxy": F.sum(x * y).over(trend)})
    # explode of a one-element array evaluates the sorted window once; as a plain column it would be
    # copied into every expression and filter that reads it
    d = d.withColumn("_m", F.explode(F.transform(F.array("_hist"), _median_and_pin)))
    med = F.when(F.col("_m.n") >= t.deliv_min_hist, F.col("_m.med"))
    denom = sum((i - m) ** 2 for i in range(t.slope_win))
    centre = x - m
    raw = (F.col("_sxy") - centre * F.col("_sy")
           - F.col("_sy") / F.col("_n") * (F.col("_sx") - centre * F.col("_n"))) / denom
    raw = F.when(x >= t.slope_win, raw) / nz(med)
    ratio5 = F.col("_flow") / nz(F.col("_base"))
    d = d.withColumns({"_med": med, "ratio5": ratio5, "slope": F.when(F.abs(raw) > 1e-12, raw).otherwise(0.0),
                       "_pinned": F.col("_m.pinned")})
    usable = ((F.col("_med").isNotNull()) & (F.col("turnover_lacs") >= t.min_turnover)
              & F.col("ratio5").isNotNull() & ~F.col("_pinned"))
    return d.where(usable).select(
        "trade_date", "symbol", "sector", "ratio5", "slope",
        ((F.col("ratio5") > t.accum_r5) & (F.col("slope") > 0)).cast("double").alias("accum"))


def _median_and_pin(h: Column) -> Column:
    """Length, median and "more than half equal the median" of an ascending array."""
    n = F.size(h)
    med = F.when(n > 0, (F.element_at(h, F.greatest(((n + 1) / 2).cast("int"), F.lit(1)))
                         + F.element_at(h, F.greatest(((n + 2) / 2).cast("int"), F.lit(1)))) / 2)
    # a value that fills more than half of a sorted array sits in its middle, so it is the median
    return F.struct(n.alias("n"), med.alias("med"), (2 * F.size(F.filter(h, lambda v: v == med)) > n).alias("pinned"))


def breadth(state: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    """Share of accumulating names and median slope per sector; at least min_names names."""
    g = state.groupBy(*KEY).agg(F.avg("accum").alias("accum_breadth"), F.count(F.lit(1)).alias("n_names"))
    med = spread_median(state, KEY, "slope", ["symbol"], "deliv_slope")
    return g.where(F.col("n_names") >= t.min_names).join(med, KEY, "left")


def persistence(panel: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    """Trailing mean of each sector's forward return over the session median, using only forward
    windows already complete at the session."""
    d = with_slot(panel.where("n_ret > 0").select(*KEY, "wtd_ret_pct"))
    w = Window.partitionBy("sector").orderBy("slot")
    d = d.withColumn("_cr", F.when(F.col("wtd_ret_pct").isNotNull(),
                                   F.sum(F.log1p(F.col("wtd_ret_pct") / 100)).over(
                                       w.rowsBetween(Window.unboundedPreceding, 0))))
    ahead = F.max("_cr").over(w.rangeBetween(t.pers_fwd, t.pers_fwd))
    d = d.withColumn("_fwd", F.expm1(ahead - F.col("_cr")) * 100)
    mid = F.percentile("_fwd", F.lit(0.5)).over(Window.partitionBy("trade_date"))
    d = d.withColumns({"_edge": F.col("_fwd") - mid, "_day": F.unix_date("trade_date")})
    cal = Window.partitionBy("sector").orderBy("_day").rangeBetween(-(t.pers_cal - 1), 0)
    tail = w.rangeBetween(-(t.pers_fwd - 1), 0)
    zero = F.lit(0.0)
    d = d.withColumns({
        "pers_n": F.count("_edge").over(cal) - F.count("_edge").over(tail),
        "_s": F.coalesce(F.sum("_edge").over(cal), zero) - F.coalesce(F.sum("_edge").over(tail), zero)})
    return (d.where(F.col("pers_n") >= t.pers_min_obs)
             .select(*KEY, (F.col("_s") / F.col("pers_n")).alias("persistence"), "pers_n"))


def index_momentum(nifty: DataFrame, t: Tilt = Tilt()) -> DataFrame:
    return nifty.select("trade_date", compound(F.col("nret"), axis(), t.mom_2w).alias("n2"),
                        compound(F.col("nret"), axis(), t.mom_1w).alias("n1"))


def tilt_label(rank: Column, br: Column, thin: Column, revert: Column, t: Tilt = Tilt()) -> Column:
    demoted = thin | revert
    return (F.when(rank.isNull(), F.lit(None).cast("string"))
             .when((br >= t.watch_breadth) & (rank <= t.watch_rank), "WATCH")
             .when(rank >= t.ow_rank, F.when(demoted, "NEUTRAL").otherwise("OVERWEIGHT"))
             .when(rank <= t.uw_rank, "UNDERWEIGHT").otherwise("NEUTRAL"))


def sector_tilt(daily: DataFrame, master: DataFrame, nifty: DataFrame, start=None, end=None,
                t: Tilt = Tilt(), r: Regime = Regime()) -> DataFrame:
    """Tilt of every ranked sector for every session in [start, end]; causal at each of them. The
    trailing factors are formed before the range is cut, so a single session reads the same in a
    one-session run and in a full-history run.

    Spark cannot push the range below the windows. The panel is read from as many days before `start`
    as the trailing windows of the parameters reach: the panel's and, before it, the persistence's.
    The index series is always read whole, its volatility rank is over all history."""
    if end is not None:
        daily = daily.where(F.col("trade_date") <= F.lit(end))
        nifty = nifty.where(F.col("trade_date") <= F.lit(end))
    if start is not None:
        daily = daily.where(F.col("trade_date") >= F.date_sub(F.lit(start).cast("date"), t.panel_cal + t.pers_cal))
    deliv = (_members(daily, master, t).where("deliv_per IS NOT NULL")
             .select("symbol", "sector", "trade_date", "deliv_per", "turnover_lacs"))
    nifty = known_size(nifty)
    index_read = index_momentum(nifty, t).join(regime_history(nifty, r), "trade_date")
    panel, state, index_read = stage_all(sector_panel(daily, master, t), delivery_state(deliv, t), index_read)
    d = (sector_factors(panel, t).join(breadth(state, t).drop("n_names"), KEY, "left")
         .join(persistence(panel, t).drop("pers_n"), KEY, "left"))
    if start is not None:
        d = d.where(F.col("trade_date") >= F.lit(start))
    d = stage(d)                                 # sector-level: sessions x sectors
    context = asof(d.select("trade_date").distinct(), index_read, "trade_date",
                   [c for c in index_read.columns if c != "trade_date"]).drop("matched_trade_date")
    d = d.join(known_size(context), "trade_date")
    day = Window.partitionBy("trade_date")
    d = d.withColumns({"rs_2w": F.col("mom_2w") - F.col("n2"), "rs_1w": F.col("mom_1w") - F.col("n1"),
                       "thin": F.col("n_liq") < t.min_names, "n_sectors": F.count(F.lit(1)).over(day)})
    d = d.withColumns({"_r2": pct_rank("rs_2w", ["trade_date"]), "_r1": pct_rank("rs_1w", ["trade_date"]),
                       "_rd": pct_rank("dv5d", ["trade_date"]), "dispersion": F.stddev_samp("rs_2w").over(day)})
    # twelve decimals: the three weighted ranks are added in whatever order, equal scores stay equal
    d = d.withColumn("score", F.round(t.w_rs2 * F.col("_r2") + t.w_rs1 * F.col("_r1") + t.w_dv5 * F.col("_rd"), 12))
    pos = F.rank().over(day.orderBy(F.col("score").desc_nulls_last()))
    d = d.withColumns({"rank": pct_rank("score", ["trade_date"]),
                       "rank_pos": F.when(F.col("score").isNotNull(), pos),
                       "divergence": F.col("_rd") - F.col("_r2"),
                       "revert": yes(F.col("persistence") < 0)})
    d = d.where(F.col("n_sectors") >= t.min_sectors)
    low = yes(F.col("dispersion") < t.disp_min)
    cm = F.coalesce("reg_conf_mult", F.lit(1.0))
    thin_k, rev_k = F.when(F.col("thin"), 0.5).otherwise(1.0), F.when(F.col("revert"), 0.6).otherwise(1.0)
    return d.select(
        *KEY, "score", "rank", "rank_pos", "n_sectors",
        tilt_label(F.col("rank"), F.coalesce("accum_breadth", F.lit(0.0)), F.col("thin"), F.col("revert"), t).alias("tilt"),
        "rs_2w", "rs_1w", "dv5d", "accum_breadth", "deliv_slope", "n_liq", "thin", "divergence", "persistence",
        "revert", F.bround((F.col("rank") - 0.5) * t.slope_bps * cm, 0).alias("est_rel_bps"),
        F.bround(cm * thin_k * rev_k, 2).alias("confidence"), "reg_state",
        F.when(low & (F.col("reg_verdict") == "ACT"), "SELECTIVE").otherwise(F.col("reg_verdict")).alias("reg_verdict"),
        F.when(low, F.bround(F.col("reg_size_hint") * 0.5, 2)).otherwise(F.col("reg_size_hint")).alias("reg_size_hint"),
        "reg_conf_mult", "reg_divergence", "reg_med_trend", "reg_trend_strength", "reg_er20", "dispersion")


def sector_tilt_asof(daily: DataFrame, master: DataFrame, nifty: DataFrame, as_of, t: Tilt = Tilt(),
                     r: Regime = Regime()) -> DataFrame:
    """The tilt of one session; empty if the day is not a session."""
    return sector_tilt(daily, master, nifty, as_of, as_of, t, r)


def tenure(tilt: DataFrame) -> DataFrame:
    """Sessions in a row each sector has held its current OVERWEIGHT or UNDERWEIGHT call, 0 for any
    other label. A session in which the sector was not ranked breaks the run."""
    d = with_slot(tilt)
    w = Window.partitionBy("sector").orderBy("slot")
    same = (F.lag("tilt").over(w) == F.col("tilt")) & (F.lag("slot").over(w) == F.col("slot") - 1)
    d = d.withColumn("_run", F.sum(F.when(yes(same), 0).otherwise(1)).over(w))
    k = F.row_number().over(Window.partitionBy("sector", "_run").orderBy("slot"))
    held = F.col("tilt").isin("OVERWEIGHT", "UNDERWEIGHT")
    return d.withColumn("days_in_tilt", F.when(yes(held), k).otherwise(0)).drop("_run", "slot")


def badge(side: Column | None = None, cap: int = 90) -> Column:
    """One text cell: call, rank, tenure, agreement with a side, thin mark."""
    tilt, days = F.col("tilt"), F.coalesce("days_in_tilt", F.lit(0))
    text = (F.when(tilt == "OVERWEIGHT", "🟢 OW").when(tilt == "UNDERWEIGHT", "🔴 UW")
             .when(tilt == "NEUTRAL", "⚪ NEUTRAL").when(tilt == "WATCH", "👁 WATCH").otherwise(tilt))
    rank = F.when(F.col("rank_pos").isNotNull(), F.format_string(" #%d/%d", "rank_pos", "n_sectors")).otherwise("")
    held = (F.when(days >= cap, F.lit(f" · Days → {cap}+"))
             .when(days > 1, F.format_string(" · Days → %d", days)).when(days == 1, " · Days → 1 NEW").otherwise(""))
    agree = F.lit("")
    if side is not None:
        with_it = (tilt == "OVERWEIGHT") == (side == "LONG")
        agree = F.when(side.isin("LONG", "SHORT") & tilt.isin("OVERWEIGHT", "UNDERWEIGHT"),
                       F.concat(F.lit(" · "), F.when(with_it, "with").otherwise("against"), F.lit(" your "), side)).otherwise("")
    thin = F.when(yes(F.col("thin")), F.format_string("  ⚠thin(%d)", "n_liq")).otherwise("")
    return F.when(tilt.isNull(), "— sector not ranked").otherwise(F.concat(text, rank, held, agree, thin))
