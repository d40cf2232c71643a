"""Live boards: reference table, footprint board, frame boards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.asof import asof
from ..functions.rolling import even, nz, roll_mean, roll_median, roll_sum, series, true_range, yes
from ..params import Levels, Session, Signal
from ..session import known_size, stage
from ..sources.panel import with_sector
from . import bars as bo
from . import synthesis as sy
from .calendar import blocked_days
from .features import conviction_score, index_day_returns
from .levels import WALL, big_wall, live_levels
from .selection import capped_book, top_per_session, two_sided_shortlist
from .structure import last_bar, structure_table


def reference_table(panel: DataFrame, index: DataFrame, sectors: DataFrame,
                    p: Signal | None = Signal(), win: Signal = Signal()) -> DataFrame:
    """Baselines a live board needs, per symbol and session: closes, volume median, ATR, trailing
    delivery and relative strength through the row and excluding it. `p` sets the turnover floor;
    None keeps every row."""
    w = series("symbol")
    n = win.rs_lookback - 1
    pc = F.lag("close_price").over(w)
    d = panel.join(known_size(index_day_returns(index)), "trade_date", "left").withColumns({
        "prev_c": pc, "_tr": true_range(F.col("high_price"), F.col("low_price"), pc),
        "_rs": F.col("close_price") / nz(pc) - 1 - F.col("idx_ret")})
    d = d.withColumns({
        "vol_med20": roll_median(F.col("ttl_trd_qnty"), w, win.lookback),
        "atr14": roll_mean(F.col("_tr"), w, win.atr_win),
        "deliv_trail": roll_mean(F.col("deliv_per"), w, win.deliv_trail_win),
        "deliv_trail_prior": roll_mean(F.col("deliv_per"), w, win.deliv_trail_win, 1),
        "rs_cum9": roll_sum(F.col("_rs"), w, n), "rs_cum9_prior": roll_sum(F.col("_rs"), w, n, 1)})
    if p is not None:
        d = d.where(F.col("turnover_lacs") >= p.liq_lacs)
    return with_sector(d, sectors).select(
        "symbol", "trade_date", "sector", F.col("close_price").alias("ref_close"),
        F.col("prev_c").alias("prev_close"), "vol_med20", "atr14", "deliv_trail",
        "deliv_trail_prior", "rs_cum9", "rs_cum9_prior", F.col("high_price").alias("pdh"),
        F.col("low_price").alias("pdl"))


def next_session_reference(ref: DataFrame) -> DataFrame:
    """Key every reference row by the next session of its symbol, the session it is the baseline
    for; so boards of all sessions are one equi join and none sees its own close."""
    w = series("symbol")
    return ref.withColumn("trade_date", F.lead("trade_date").over(w)).where("trade_date IS NOT NULL")


def latest_quotes(ticks: DataFrame, keys: list[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Newest quote row per key; a max_by keeps it a map-side aggregate."""
    cols = [c for c in ticks.columns if c not in keys]
    g = ticks.groupBy(*keys).agg(F.max_by(F.struct(*cols), ts).alias("q"))
    return g.select(*keys, "q.*")


BOARD_KEYS = ["trade_date", "symbol"]


def quote_legs(quotes: DataFrame, ref: DataFrame, index_pct: DataFrame, minute: int, p: Signal = Signal()) -> DataFrame:
    """Quote beside its reference row: candle anatomy, day move, relative strength, volume pace,
    risk levels, turnover proxy. `index_pct` is (trade_date, idx_pct)."""
    d = quotes.join(ref, BOARD_KEYS).join(known_size(index_pct), "trade_date", "left")
    pc = F.coalesce(F.when(F.col("prev_close_price") != 0, F.col("prev_close_price")), F.col("ref_close"))
    d = d.withColumn("pc", pc).where("open_price IS NOT NULL AND high_price IS NOT NULL AND low_price IS NOT NULL "
                                     "AND lp IS NOT NULL AND pc <> 0")
    h, l = sc.reconcile_range(F.col("high_price"), F.col("low_price"), F.col("lp"))
    d = d.withColumns({"h": h, "l": l, "ltp": F.col("lp"), "atr": F.coalesce("atr14", F.lit(0.0))})
    anatomy = sc.price_action(F.col("open_price"), F.col("h"), F.col("l"), F.col("ltp"))
    d = d.withColumns({k: anatomy[k] for k in ("clr", "body", "character")})
    d = d.withColumn("day_raw", 100 * (F.col("ltp") / nz(F.col("pc")) - 1))
    d = d.withColumns({
        "rs_raw": F.col("day_raw") - F.col("idx_pct"),
        "pace": F.when(F.col("volume") > 0, sc.volume_pace(F.col("volume"), F.col("vol_med20"), F.lit(minute))),
        "deliv_trail": F.coalesce("deliv_trail", F.lit(0.0)),
        "turnover": sc.turnover_proxy(F.col("volume"), F.col("h"), F.col("l"), F.col("ltp")),
        **sc.levels(F.col("ltp"), F.col("atr"), F.col("l")), **sc.short_levels(F.col("ltp"), F.col("atr"))})
    return d.withColumn("rs_cum", F.col("rs_cum9") + F.col("rs_raw") / 100)


def footprint_board(legs: DataFrame, extras: DataFrame, gate: DataFrame, events: DataFrame, minute: int,
                    p: Signal = Signal(), s: Session = Session(), size_mult: float = 1.0) -> DataFrame:
    """Live footprint board: legs met, action, and the capped overnight book.

    Names whose price legs hold without the path leg form a shortlist; their session VWAP, exact
    turnover and closing-stretch VWAP (`extras`: vwap, close30, entered, at) complete the read. The
    rest keep the quote-only read."""
    d = gate_rows(legs, gate).join(
        blocked_days(events, p.event_horizon_days).withColumn("_event", F.lit(True)), BOARD_KEYS, "left")
    d = d.withColumn("earnings", F.col("_event").isNotNull()).join(extras, BOARD_KEYS, "left")
    none = F.lit(None).cast("double")
    minute_c = F.lit(minute)

    def action(clr, day, cvwap, liquid):
        ready = sc.long_readiness(clr, day, F.col("rs_cum"), F.col("pace"), cvwap, p)
        act = sc.live_action(ready, clr, day, F.col("risk_on"), F.col("deliv_trail"), minute_c, liquid, p, s)
        return ready, F.when(F.col("earnings"), "EARNINGS").otherwise(act)
    r0, a0 = action(F.col("clr"), F.col("day_raw"), none, F.col("turnover") >= p.liq_lacs)
    sready = sc.short_readiness(F.col("clr"), F.col("day_raw"), F.col("rs_raw"), F.col("pace"), p)
    d = d.withColumns({"_r0": r0, "_a0": a0, "_sready": sready})
    short = F.col("_a0").isin("BTST-CARRY", "FORMING")
    has_vw = short & yes(F.col("vwap") > 0)
    has_30 = short & yes(F.col("close30") > 0)
    h2, l2 = F.greatest("h", "close30"), F.least("l", "close30")
    d = d.withColumns({
        "turnover": F.when(has_vw & (F.col("volume") > 0), F.col("volume") * F.col("vwap") / 1e5).otherwise(F.col("turnover")),
        "clr": F.when(has_30 & (h2 > l2), even((F.col("close30") - l2) / (h2 - l2), 3)).otherwise(F.col("clr")),
        "day_raw": F.when(has_30, 100 * (F.col("close30") / F.col("pc") - 1)).otherwise(F.col("day_raw")),
        "cvwap": F.when(has_vw, (F.when(has_30, F.col("close30")).otherwise(F.col("ltp")) - F.col("vwap")) / F.col("vwap")),
        "est_close": F.when(has_30, even("close30", 2)),
        "entered": F.when(short, F.col("entered")), "at": F.when(short, even("at", 2)),
        "since_pct": F.when(short, sc.since_pct(F.col("ltp"), F.col("at")))})
    r1, a1 = action(F.col("clr"), F.col("day_raw"), F.col("cvwap"), F.col("turnover") >= p.liq_lacs)
    d = d.withColumns({
        "btst": F.when(short, r1).otherwise(F.col("_r0")), "action": F.when(short, a1).otherwise(F.col("_a0")),
        "short_ready": F.col("_sready"), "sell": sc.sell_action(F.col("_sready"), F.col("character")),
        "day_pct": even("day_raw", 2), "vol_x": even("pace", 2), "rs_pct": even("rs_raw", 2),
        "rs_cum_pct": even(100 * F.col("rs_cum"), 2), "cvwap_pct": even(100 * F.col("cvwap"), 2),
        "deliv_tr": even("deliv_trail", 1), "turnover": even("turnover", 0)})
    return overnight_book(d.drop("_r0", "_a0", "_sready", "_event"), p, size_mult)


def overnight_book(board: DataFrame, p: Signal = Signal(), size_mult: float = 1.0) -> DataFrame:
    """Tag the carry rows: taken with their weight, capped out, or stood aside; other rows are left
    without a tag."""
    board = stage(board)
    carry = board.where("action = 'BTST-CARRY'").select(*BOARD_KEYS, "sector", "clr", "deliv_tr", "vol_x", "day_pct", "rs_cum_pct")
    legs = {"clr": F.col("clr"), "deliv": F.col("deliv_tr"), "vol": F.least("vol_x", F.lit(p.vol_cap)),
            "day": F.greatest("day_pct", F.lit(0.0)), "rs": F.col("rs_cum_pct")}
    scored = conviction_score(carry, ["trade_date"], BOARD_KEYS, p, legs)
    book = capped_book(scored, p, size_mult=size_mult).select(*BOARD_KEYS, "weight")
    d = board.join(book, BOARD_KEYS, "left")
    is_carry, taken = F.col("action") == "BTST-CARRY", F.col("weight").isNotNull()
    aside = "✗ STAND ASIDE (calib)" if size_mult <= 0 else "✗ capped"
    return d.withColumns({
        "book": F.when(is_carry, F.when(taken, "✓ TAKE").otherwise(aside)),
        "wt_pct": F.when(is_carry, F.when(taken, even(100 * F.col("weight"), 1)).otherwise(0.0))}).drop("weight")


def gate_rows(d: DataFrame, gate: DataFrame) -> DataFrame:
    g = known_size(gate.select("trade_date", F.col("up").alias("risk_on")))
    return d.join(g, "trade_date", "left").withColumn("risk_on", yes(F.col("risk_on")))


def action_counts(board: DataFrame) -> DataFrame:
    """Rows per action and per sell label, as one long table."""
    both = board.select(F.explode(F.array(F.struct(F.lit("action").alias("kind"), F.col("action").alias("label")),
                                          F.struct(F.lit("sell").alias("kind"), F.col("sell").alias("label")))).alias("x"))
    return both.groupBy("x.kind", "x.label").agg(F.count(F.lit(1)).alias("n"))


def baseline_health(quotes: DataFrame, ref: DataFrame, tol: float = 0.005, need: int = 20, limit: float = 0.20) -> DataFrame:
    """Does the feed's previous close equal the stored close, or the one before it? One row per
    session: names checked, mismatches, and whether the store is stale."""
    d = quotes.join(ref.select(*BOARD_KEYS, "ref_close", "prev_close"), BOARD_KEYS).where(
        "prev_close_price <> 0 AND ref_close > 0")
    near = lambda base: yes(F.abs(F.col("prev_close_price") / nz(F.col(base)) - 1) <= tol)
    ok = near("ref_close") | (yes(F.col("prev_close") > 0) & near("prev_close"))
    g = d.groupBy("trade_date").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~ok).alias("mismatch"))
    share = F.col("mismatch") / F.col("checked")
    return g.withColumns({"pct": even(100 * share, 1), "stale": (F.col("checked") >= need) & (share > limit)})


def missing_sessions(calendar: DataFrame, panel: DataFrame, before) -> DataFrame:
    """Finished sessions of an independent calendar that are newer than the panel's last one."""
    newest = panel.agg(F.max("trade_date")).scalar()
    days = calendar.select("trade_date").distinct().where(F.col("trade_date") < F.lit(before))
    return days.where(F.col("trade_date") > newest)


def wide_frames(summary: DataFrame, frames: list[str], fields: list[str]) -> DataFrame:
    """One row per symbol with `<field>_<frame>` columns, from the long (symbol, frame) table."""
    pick = lambda fr, c: F.max_by(F.col(c), F.when(F.col("frame") == fr, 1)).alias(f"{c}_{fr}")
    return summary.groupBy("symbol").agg(*[pick(fr, c) for fr in frames for c in fields])


LADDER = ("1h", "4h", "1D", "1W", "1M")
ORDER = ("15m", "1h", "2h", "4h", "1D", "1W", "1M")


def frame_above(htf: str) -> str | None:
    """The next frame of the confirmation ladder above a frame."""
    at = ORDER.index(htf) if htf in ORDER else -1
    return next((f for f in LADDER if ORDER.index(f) > at), None)


def add_setup(board: DataFrame, ltf: str, htf: str, p: Levels = Levels(), above: str | None = None) -> DataFrame:
    """Two-frame setup of every board row: tag, side, rank, location, live levels from the walls of
    both frames, and the wall one frame up. Pure column work on the wide board."""
    syn = sy.synthesize(F.col(f"struct_{htf}"), F.col(f"box_hi_{htf}"), F.col(f"box_lo_{htf}"), F.col(f"n_{htf}"),
                        F.col(f"struct_{ltf}"), F.col("ltp"))
    d = board.withColumns({"setup": syn["setup"], "dir": syn["dir"], "loc": even(syn["loc"], 2)})
    d = d.withColumns({"side": sy.side_of(F.col("setup"), F.col("dir")), "setup_rank": sy.setup_rank(F.col("setup")),
                       "sr_atr": F.col(f"atr_{ltf}"), "wall_pair": merge_walls(F.col(f"walls_{htf}"), F.col(f"walls_{ltf}"))})
    d = live_levels(d, p)
    above = above or frame_above(htf)
    if above is None or f"walls_{above}" not in board.columns:
        return d.withColumns({"big_wall": F.lit(""), "big_gap": F.lit(float("inf")), "big_wall_px": F.lit(None).cast("double")})
    return big_wall(d, above, p, walls=f"walls_{above}", blind_lo=f"blind_lo_{above}", blind_hi=f"blind_hi_{above}")


def merge_walls(upper: Column, lower: Column) -> Column:
    empty = F.array().cast(WALL)
    return F.concat(F.coalesce(upper, empty), F.coalesce(lower, empty))


def price_band(df: DataFrame, col: str, lo: float = 0.0, hi: float = 0.0) -> DataFrame:
    """Keep a price band; 0 leaves that side open."""
    if lo:
        df = df.where(F.col(col) >= lo)
    return df.where(F.col(col) <= hi) if hi else df


def delivery_filter(df: DataFrame, min_recent: float = 0.0, min_vs: float = 0.0) -> DataFrame:
    """Minimum weighted delivery and excess over the norm; a missing value fails an active filter."""
    if min_recent > 0:
        df = df.where(yes(F.col("wtd_recent") >= min_recent))
    return df.where(yes(F.col("deliv_vs_norm") >= min_vs)) if min_vs > 0 else df


def setup_predicate(kind: str) -> Column:
    """Setup-quality filter: all, textbook, long, short, no_traps."""
    return {"all": F.lit(True), "textbook": F.col("setup") == "WITH-TREND CONTINUATION", "long": F.col("side") == "LONG",
            "short": F.col("side") == "SHORT", "no_traps": F.col("setup") != "FALSE-BREAK TRAP"}[kind]


def room_predicate(kind: str) -> Column:
    """Distance to the wall one frame up, in ATR: all, room (1 or clear), tight, capped."""
    g = F.col("big_gap")
    return {"all": F.lit(True), "room": g >= 1.0, "tight": (g >= 0.5) & (g < 1.0), "capped": g < 0.5}[kind]


def structure_predicate(frame: str, label: str | None) -> Column:
    return F.lit(True) if label is None else yes(F.col(f"struct_{frame}") == label)


def filter_funnel(board: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter stage, in one pass over the board."""
    passed, counts = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("scanned").alias("stage"), F.count(F.lit(1)).alias("n"))]
    for i, (name, cond) in enumerate(stages, 1):
        passed = passed & yes(cond)
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count_if(passed).alias("n")))
    return board.agg(F.array(*counts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def setup_census(board: DataFrame, liquidity: str = "turnover", examples: int = 4) -> DataFrame:
    """Names per (setup, direction) on the whole scan and the most traded of each. The examples come
    from a rank filter, so no group is gathered."""
    w = Window.partitionBy("setup", "dir").orderBy(F.col(liquidity).desc_nulls_last(), "symbol")
    top = (board.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples).groupBy("setup", "dir")
           .agg(F.sort_array(F.collect_list(F.struct("_r", "symbol"))).alias("t")))
    n = board.groupBy("setup", "dir").agg(F.count(F.lit(1)).alias("n"))
    return n.join(top, ["setup", "dir"]).select("setup", "dir", "n", F.array_join(F.transform("t", lambda x: x["symbol"]), ", ").alias("examples"))


def side_table(board: DataFrame, side: str, preset: str = "btst", liquidity: str = "turnover") -> DataFrame:
    """LONG or SHORT rows with their verdict, ordered by measured evidence and then by turnover."""
    verdict = (sy.long_verdict if side == "LONG" else sy.short_verdict)(F.col("setup"), preset)
    d = board.where(F.col("side") == side).withColumns({"note": verdict, "evidence_rank": sy.evidence_rank(F.col("setup"), side, preset)})
    return d.orderBy("evidence_rank", F.col(liquidity).desc_nulls_last(), "symbol")


def carry_tables(board: DataFrame, fallback: int = 10) -> DataFrame:
    """Carry and forming rows; in a session where nothing forms, its strongest closes as well. The
    fallback is a rank filter, so no session is gathered or sorted whole."""
    named = F.when(F.col("action") == "BTST-CARRY", "carry").when(F.col("action") == "FORMING", "forming")
    forming = known_size(board.where("action = 'FORMING'").select("trade_date").distinct())
    strong = top_per_session(board.join(forming, "trade_date", "left_anti"), fallback, "clr")
    return (board.withColumn("table", named).where("table IS NOT NULL")
            .unionByName(strong.where("action NOT IN ('BTST-CARRY', 'FORMING')").withColumn("table", F.lit("strongest"))))


def scan_quality(summary: DataFrame, symbols: DataFrame, quotes: DataFrame, frame: str) -> DataFrame:
    """Blank frames, missing quotes and the barren share of a scan, one row."""
    d = (symbols.select("symbol").distinct()
         .join(summary.where(F.col("frame") == frame).select("symbol", "struct"), "symbol", "left")
         .join(quotes.select("symbol", F.lit(True).alias("_q")), "symbol", "left"))
    blank = F.coalesce(F.col("struct") == "n/a", F.lit(True))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("n_blank"), F.count_if(F.col("_q").isNull()).alias("n_quote_gap"),
                 F.avg(blank.cast("double")).alias("barren_share"))


def frame_features(bars: DataFrame, minutes: int, now, s: Session = Session()) -> DataFrame:
    """Newest bar of each symbol's frame with its session's state, RSI tone, ATR and span label."""
    keys = ["symbol"]
    day = F.to_date("ts")
    newest = bars.groupBy("symbol").agg(F.max(day).alias("_last"))
    sess = bo.session_state(bars.withColumn("_d", day).join(newest, "symbol").where("_d = _last"), keys)
    last = last_bar(structure_table(bars, keys), keys).select(
        "symbol", "ts", "struct", "atr", F.col("high").alias("bar_h"), F.col("low").alias("bar_l"), F.col("close").alias("_c"))
    rng = F.col("bar_h") - F.col("bar_l")
    last = last.withColumns({"bar_clr": F.when(rng > 0, even((F.col("_c") - F.col("bar_l")) / rng, 3)).otherwise(0.5),
                             "span": sc.span_label(F.col("ts"), minutes, s),
                             "forming": F.lit(now).cast("timestamp_ntz") < sc.bar_close(F.col("ts"), minutes, s)}).drop("_c")
    return sess.withColumnRenamed("low", "day_low").join(last, "symbol").join(bo.rsi_state(bars, keys), "symbol")


def frame_board(feat: DataFrame, quotes: DataFrame, idx_pct: Column, risk_on: Column, p: Signal = Signal()) -> DataFrame:
    """Timeframe shortlist row: last-bar strength, VWAP side, tone, relative strength, levels and
    both labels. `quotes` is (symbol, prev_close)."""
    d = feat.join(quotes.select("symbol", "prev_close"), "symbol")
    d = d.withColumns({"day_pct": even(100 * (F.col("ltp") / nz(F.col("prev_close")) - 1), 2)})
    d = d.withColumns({"rs_pct": even(F.col("day_pct") - idx_pct, 2),
                       **sc.levels(F.col("ltp"), F.col("atr"), F.col("day_low")), **sc.short_levels(F.col("ltp"), F.col("atr"))})
    args = [F.col("bar_clr"), F.col("above_vwap"), F.col("tone"), F.col("rs_pct")]
    return d.withColumns({"action": sc.frame_action(*args, risk_on, p), "sell": sc.frame_sell_action(*args, p)})


def reprice(board: DataFrame, quotes: DataFrame, idx_pct: Column, risk_on: Column, p: Signal = Signal()) -> DataFrame:
    """Rebuild everything that moves with the price from the newest quote; structure, RSI and ATR
    stay pinned. A row without a quote keeps its values."""
    d = board.join(quotes.select("symbol", F.col("lp").alias("_lp")), "symbol", "left")
    live = F.col("_lp").isNotNull() & (F.col("_lp") != 0)
    ltp = F.when(live, even("_lp", 2)).otherwise(F.col("ltp"))
    keep = lambda name, value: F.when(live, value).otherwise(F.col(name))
    px = F.col("_lp")
    day = 100 * (px / nz(F.col("prev_close")) - 1)
    bh, bl = F.greatest("bar_h", px), F.least("bar_l", px)
    new = {"ltp": ltp, "day_pct": keep("day_pct", even(day, 2)), "rs_pct": keep("rs_pct", even(day - idx_pct, 2)),
           "bar_clr": keep("bar_clr", F.when(bh > bl, even((px - bl) / (bh - bl), 3)).otherwise(0.5)),
           "vs_vwap": keep("vs_vwap", even(100 * (px / nz(F.col("vwap")) - 1), 2)),
           "above_vwap": keep("above_vwap", px >= F.col("vwap"))}
    for k, v in {**sc.levels(px, F.col("atr"), F.col("day_low")), **sc.short_levels(px, F.col("atr"))}.items():
        if k in board.columns:
            new[k] = keep(k, v)
    d = d.withColumns(new)
    args = [F.col("bar_clr"), F.col("above_vwap"), F.col("tone"), F.col("rs_pct")]
    return d.withColumns({"action": keep("action", sc.frame_action(*args, risk_on, p)),
                          "sell": keep("sell", sc.frame_sell_action(*args, p))}).drop("_lp")


def reprice_scan(board: DataFrame, quotes: DataFrame) -> DataFrame:
    """Price and day move of a scan board from the newest quotes; setups are attached again on top."""
    d = board.drop("lp").join(quotes.select("symbol", "lp"), "symbol", "left")
    live = F.col("lp").isNotNull() & (F.col("lp") != 0)
    return d.withColumns({"day_pct": F.when(live, even(100 * (F.col("lp") / nz(F.col("prev_close")) - 1), 2)).otherwise(F.col("day_pct")),
                          "ltp": F.when(live, even("lp", 2)).otherwise(F.col("ltp"))}).drop("lp")


def universe_board(scan: DataFrame, names: DataFrame, momentum: DataFrame, quotes: DataFrame) -> DataFrame:
    """Scan of all names of the universe (symbol, sector) that have a usable quote (symbol, lp,
    prev_close, high, low, volume): price, day move and turnover from the quote, delivery momentum, and
    the wide frames of `scan`. A name without structure keeps its row."""
    q = quotes.where("lp IS NOT NULL AND prev_close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND high <> low")
    hi, lo = sc.reconcile_range(F.col("high"), F.col("low"), F.col("lp"))
    q = q.withColumn("turnover", even(sc.turnover_proxy(F.col("volume"), hi, lo, F.col("lp")), 1))
    board = (names.select("symbol", "sector").join(q.select("symbol", "prev_close", "turnover"), "symbol")
             .join(momentum.select("symbol", even("wtd_recent", 1).alias("wtd_recent"), even("deliv_vs_norm", 1).alias("deliv_vs_norm")),
                   "symbol", "left")
             .join(scan, "symbol", "left")
             .withColumns({"ltp": F.lit(None).cast("double"), "day_pct": F.lit(None).cast("double")}))
    return reprice_scan(board, q)


def asof_board(bars: DataFrame, cuts: DataFrame, ref: DataFrame, index: DataFrame, gate: DataFrame, events: DataFrame,
               p: Signal = Signal(), s: Session = Session(), bar_minutes: int = 5, pace: bool = True) -> DataFrame:
    """The board as it stood at each of the cuts (trade_date, cut, minute): one row for each cut and name
    with a bar up to it. All cuts are answered by one plan.

    Every bar (symbol, trade_date, ts, prices, volume) carries the state of its session up to it, and a cut
    takes the state of the newest bar at or before it, so nothing after a cut is read. Baselines are those of
    the row in front of the session (`ref`, keyed by the session they are for). `index` holds bars of the
    index (trade_date, ts, open, close); its move runs from the session's first open."""
    first = Window.partitionBy("trade_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    moves = known_size(index.select("trade_date", "ts", (F.col("close") / nz(F.first("open").over(first)) - 1).alias("idx_ret")))
    base = ref.select(*BOARD_KEYS, "sector", F.col("ref_close").alias("prev_close"), F.col("vol_med20").alias("ref_volume"),
                      F.coalesce("atr14", F.lit(0.0)).alias("atr"), F.coalesce("deliv_trail", F.lit(0.0)).alias("deliv_trail"),
                      F.col("rs_cum9").alias("rs_base"))
    opened = Window.partitionBy("symbol", "trade_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = (bo.running_session(bars.join(base, BOARD_KEYS), ["symbol", "trade_date"]).withColumn("run_open", F.first("open").over(opened))
           .join(moves, ["trade_date", "ts"], "left"))
    trig = bo.first_trigger(run, BOARD_KEYS, p, bar_minutes, pace)
    state = ["sector", "prev_close", "ref_volume", "atr", "deliv_trail", "rs_base", "run_open", "run_high", "run_low", "close", "cum_volume", "run_vwap"]
    wanted = run.select(*BOARD_KEYS).distinct().join(known_size(cuts.select("trade_date", "cut", "minute")), "trade_date")
    d = asof(wanted, run.select(*BOARD_KEYS, F.col("ts").alias("cut"), *state), "cut", state, by=["trade_date", "symbol"]).where("matched_cut IS NOT NULL")
    at = asof(cuts.select("trade_date", "cut").distinct(), moves.select("trade_date", F.col("ts").alias("cut"), "idx_ret"), "cut", ["idx_ret"],
              by=["trade_date"])
    d = d.join(known_size(at.select("trade_date", "cut", (100 * F.col("idx_ret")).alias("idx_pct"))), ["trade_date", "cut"], "left")
    d = gate_rows(d, gate).join(blocked_days(events, p.event_horizon_days).withColumn("_event", F.lit(True)), BOARD_KEYS, "left").join(trig, BOARD_KEYS, "left")
    ltp, minute = F.col("close"), F.col("minute")
    d = d.where("prev_close <> 0").withColumns(sc.price_action(F.col("run_open"), F.col("run_high"), F.col("run_low"), ltp))
    fired = F.col("entered") <= F.col("cut")
    d = d.withColumns({
        "day_raw": 100 * (ltp / F.col("prev_close") - 1), "cvwap": (ltp - F.col("run_vwap")) / nz(F.col("run_vwap")),
        "pace": F.when(F.col("cum_volume") > 0, sc.volume_pace(F.col("cum_volume"), F.col("ref_volume"), minute)),
        "at": F.when(fired, F.col("at")), "entered": F.when(fired, F.col("entered"))})
    d = d.withColumn("rs_raw", F.col("day_raw") - F.col("idx_pct")).withColumn("rs_cum", F.col("rs_base") + F.col("rs_raw") / 100)
    ready = sc.long_readiness(F.col("clr"), F.col("day_raw"), F.col("rs_cum"), F.col("pace"), F.col("cvwap"), p)
    act = sc.live_action(ready, F.col("clr"), F.col("day_raw"), F.col("risk_on"), F.col("deliv_trail"), minute, F.lit(True), p, s)
    weak = sc.short_readiness(F.col("clr"), F.col("day_raw"), F.col("rs_raw"), F.col("pace"), p)
    return d.withColumns({
        "ltp": ltp, "btst": ready, "action": F.when(F.col("_event"), "EARNINGS").otherwise(act), "sell": sc.sell_action(weak, F.col("character")),
        "day_pct": even("day_raw", 2), "rs_pct": even("rs_raw", 2), "rs_cum_pct": even(100 * F.col("rs_cum"), 2),
        "vol_x": even("pace", 2), "cvwap_pct": even(100 * F.col("cvwap"), 2), "deliv_tr": even("deliv_trail", 1),
        "since_pct": sc.since_pct(ltp, F.col("at")), "trigger_px": F.col("at"), "at": even("at", 2),
        **sc.levels(ltp, F.col("atr"), F.col("run_low")), **sc.short_levels(ltp, F.col("atr"))}).drop("_event").orderBy("cut", "action", F.desc("btst"), "symbol")


def timeframe_board(bars: DataFrame, frame: DataFrame, index_pct: DataFrame, gate: DataFrame, minutes: int, now, n: int = 25,
                    p: Signal = Signal(), s: Session = Session()) -> DataFrame:
    """Shortlist board on one frame: fine bars (symbol, ts, ...) give today's quote of each name, the
    two-sided screen keeps the strongest and weakest, and only their frame bars are read. `index_pct`
    (trade_date, idx_pct) and `gate` (trade_date, up) are the index's."""
    day = F.to_date("ts")
    dated = bars.withColumn("trade_date", day)
    today = dated.agg(F.max("trade_date")).scalar()
    q = bo.session_state(dated.where(F.col("trade_date") == today), ["symbol", "trade_date"])
    prev = dated.where(F.col("trade_date") < today).groupBy("symbol").agg(F.max_by("close", "ts").alias("prev_close"))
    q = q.join(prev, "symbol").where("high <> low").withColumns({
        "turnover_lacs": sc.turnover_proxy(F.col("volume"), F.col("high"), F.col("low"), F.col("ltp")),
        "day_pct": 100 * (F.col("ltp") / nz(F.col("prev_close")) - 1), "clr": (F.col("ltp") - F.col("low")) / (F.col("high") - F.col("low"))})
    short = known_size(gate_rows(two_sided_shortlist(q, n, p).join(index_pct, "trade_date", "left"), gate)
                       .select("symbol", "list", "prev_close", "idx_pct", "risk_on"))
    feat = frame_features(frame.join(short.select("symbol"), "symbol", "left_semi"), minutes, now, s).join(
        short.select("symbol", "list", "idx_pct", "risk_on"), "symbol")
    return frame_board(feat, short, F.col("idx_pct"), F.col("risk_on"), p).orderBy("action", F.desc("bar_clr"), "symbol")
