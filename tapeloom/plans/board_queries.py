"""Scalar columns, live boards, setups, filters, short-horizon board."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import params as P
from ..functions import scalars as sc
from ..operators import bars as bo
from ..operators import boards as bd
from ..operators import delivery as dl
from ..operators import features as ft
from ..operators import levels as lv
from ..operators import regime as rg
from ..operators import selection as sel
from ..operators import shorthorizon as sh
from ..operators import structure as st
from ..operators import synthesis as sy
from ..params import Cost, Delivery, Levels, Signal, Structure
from ..session import stage
from ..sources import panel as src
from ..sources import testdata as td
from . import bar_queries as bq
from . import base as B
from .bar_queries import ANATOMY, BARS, FULL, agg_sql, slot_sql, struct_sql, summary_sql
from .base import CALENDAR, FEATURES, LOOSE, PANEL
from .panel_queries import BOOK, REF
from .spec import register

MINUTE = 15 * 60 + 20
FRAC = P.VOLUME_PROFILE[(MINUTE - P.VOLUME_PROFILE_START) // P.VOLUME_PROFILE_STEP]
BOARD = Signal(clr=0.45, deliv_trail=20.0, vol_ratio=0.5, ret=0.0, close_vs_vwap=-0.5, rs_min=-50.0, liq_lacs=2.0, regime_ma=10)


def _num(cond: str) -> str:
    return f"CASE WHEN coalesce({cond}, FALSE) THEN 1 ELSE 0 END"


# --- scalar columns ------------------------------------------------------------------------------
@register("price_action", "SC5 SC1", "trade_date:d symbol clr:f body:f upper_wick:f lower_wick:f character", PANEL + f""",
p AS (SELECT trade_date, symbol, open_price AS open, high_price AS high, low_price AS low, close_price AS close FROM panel),
out AS (SELECT *, CASE WHEN high <= low THEN 0.5 ELSE round_even((close - low) / (high - low), 3) END AS clr,
  CASE WHEN high <= low THEN 0 ELSE round_even((close - open) / (high - low), 3) END AS body,
  CASE WHEN high <= low THEN 0 ELSE round_even((high - greatest(open, close)) / (high - low), 3) END AS upper_wick,
  CASE WHEN high <= low THEN 0 ELSE round_even((least(open, close) - low) / (high - low), 3) END AS lower_wick, {ANATOMY} AS character FROM p)""")
def price_action(spark, sf):
    c = [F.col(x) for x in ("open_price", "high_price", "low_price", "close_price")]
    return td.eod_panel(spark, sf).withColumns(sc.price_action(*c))


@register("range_and_turnover", "SC6 SC13", "trade_date:d symbol h:r l:r turnover:f4", PANEL + """,
q AS (SELECT *, close_price * 1.05::DOUBLE AS ltp FROM panel),
out AS (SELECT *, greatest(high_price, ltp) AS h, least(low_price, ltp) AS l,
  ttl_trd_qnty * (greatest(high_price, ltp) + least(low_price, ltp) + ltp) / 3 / 100000 AS turnover FROM q)""")
def range_and_turnover(spark, sf):
    d = td.eod_panel(spark, sf).withColumn("ltp", F.col("close_price") * 1.05)
    h, l = sc.reconcile_range(F.col("high_price"), F.col("low_price"), F.col("ltp"))
    return d.withColumns({"h": h, "l": l}).withColumn(
        "turnover", sc.turnover_proxy(F.col("ttl_trd_qnty"), F.col("h"), F.col("l"), F.col("ltp")))


PROFILE_SQL = """pr AS (SELECT unnest(f) AS frac, generate_subscripts(f, 1) - 1 AS slot FROM (SELECT [""" + ", ".join(
    str(v) for v in P.VOLUME_PROFILE) + """]::DOUBLE[] AS f))"""


@register("volume_pace", "SC7 SC8 SC9", "symbol ts:t surge:f frac:f pace:f", BARS + """,
run AS (SELECT *, hour(ts) * 60 + 60 AS minute, sum(volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS cv FROM fine),
""" + PROFILE_SQL + """,
j AS (SELECT *, least(greatest(CAST(floor((minute - 555) / CAST(5 AS DOUBLE)) AS INT), 0), 74) AS slot FROM run),
out AS (SELECT *, cv / CAST(12 AS DOUBLE) AS surge, cv / CAST(12 AS DOUBLE) / frac AS pace FROM j JOIN pr USING (slot))""")
def volume_pace(spark, sf):
    d = bo.running_session(td.bars(spark, sf, 60).withColumn("d", F.to_date("ts")), ["symbol", "d"])
    minute = F.hour("ts") * 60 + 60
    return d.withColumns({"surge": sc.volume_surge(F.col("cum_volume"), F.lit(12.0)), "frac": sc.day_fraction(minute),
                          "pace": sc.volume_pace(F.col("cum_volume"), F.lit(12.0), minute)})


@register("risk_levels", "SC10 SC11", "trade_date:d symbol entry:f limit_buy:f stop:f t1:f t2:f risk_pct:f rr1:f atr_pct:f s_stop:f s_t1:f s_t2:f",
          FEATURES + """,
l0 AS (SELECT *, CASE WHEN low_price < close_price THEN greatest(close_price - atr14, low_price) ELSE close_price - atr14 END AS st FROM feat WHERE atr14 IS NOT NULL),
out AS (SELECT *, round_even(CAST(CAST(close_price AS VARCHAR) AS DECIMAL(38, 16)), 2) AS entry, round_even(CAST(CAST(low_price AS VARCHAR) AS DECIMAL(38, 16)), 2) AS limit_buy, round_even(CAST(CAST(st AS VARCHAR) AS DECIMAL(38, 16)), 2) AS stop, round_even(CAST(CAST(close_price + atr14 AS VARCHAR) AS DECIMAL(38, 16)), 2) AS t1,
  round_even(CAST(CAST(close_price + 2 * atr14 AS VARCHAR) AS DECIMAL(38, 16)), 2) AS t2, round_even(CAST(CAST(100 * (close_price - st) / close_price AS VARCHAR) AS DECIMAL(38, 16)), 2) AS risk_pct,
  CASE WHEN close_price - st > 0 THEN round_even(CAST(CAST(atr14 / (close_price - st) AS VARCHAR) AS DECIMAL(38, 16)), 2) END AS rr1, round_even(CAST(CAST(100 * atr14 / close_price AS VARCHAR) AS DECIMAL(38, 16)), 2) AS atr_pct,
  round_even(CAST(CAST(close_price + atr14 AS VARCHAR) AS DECIMAL(38, 16)), 2) AS s_stop, round_even(CAST(CAST(close_price - atr14 AS VARCHAR) AS DECIMAL(38, 16)), 2) AS s_t1, round_even(CAST(CAST(close_price - 2 * atr14 AS VARCHAR) AS DECIMAL(38, 16)), 2) AS s_t2 FROM l0)""")
def risk_levels(spark, sf):
    d = ft.add_features(B.eod(spark, sf), LOOSE).where("atr14 IS NOT NULL")
    px, atr = F.col("close_price"), F.col("atr14")
    return d.withColumns({**sc.levels(px, atr, F.col("low_price")), **sc.short_levels(px, atr)})


@register("symbol_names", "SC43", "symbol feed plain", """
out AS (SELECT 'S' || s_suppkey AS symbol, 'NSE:S' || s_suppkey || '-EQ' AS feed, 'S' || s_suppkey AS plain FROM supplier)""")
def symbol_names(spark, sf):
    d = td.sector_dim(spark, sf).select("symbol", sc.feed_symbol(F.col("symbol")).alias("feed"))
    return d.withColumn("plain", sc.plain_symbol(F.col("feed")))


@register("session_hours", "SC49", "event_id:i open:b", """
out AS (SELECT event_id, isodow(ts) <= 5 AND CAST(date_trunc('second', ts) AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00' AS open FROM events)""")
def session_hours(spark, sf):
    return td.ticks(spark, sf).select("event_id", sc.in_session(F.col("ts")).alias("open"))


@register("bar_spans", "SC48", "symbol ts:t span forming:b", BARS + """,
e AS (SELECT *, least(ts + INTERVAL 240 MINUTES, date_trunc('day', ts) + INTERVAL 930 MINUTES) AS ce FROM fine),
out AS (SELECT *, strftime(ts, '%H:%M') || '-' || strftime(ce, '%H:%M') AS span, TIMESTAMP '2024-01-10 12:00:00' < ce AS forming FROM e)""")
def bar_spans(spark, sf):
    return td.bars(spark, sf, 60).withColumns({
        "span": sc.span_label(F.col("ts"), 240),
        "forming": F.lit("2024-01-10 12:00:00").cast("timestamp_ntz") < sc.bar_close(F.col("ts"), 240)})


@register("index_strip", "SC50", "trade_date:d lp:f ch:f chp:f", PANEL + """,
raw AS (SELECT trade_date, CASE month(trade_date) WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE close_val END AS lp0,
  CASE month(trade_date) WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE lag(close_val) OVER (ORDER BY trade_date) END AS pv FROM idx),
r AS (SELECT *, CASE WHEN lp0 > 0 THEN lp0 END AS lp FROM raw),
out AS (SELECT trade_date, lp, CASE WHEN lp IS NULL THEN NULL WHEN pv > 0 THEN lp - pv WHEN pv <= 0 THEN NULL ELSE 1 END AS ch,
  CASE WHEN lp IS NULL THEN NULL WHEN pv > 0 THEN (lp / pv - 1) * 100 WHEN pv <= 0 THEN NULL ELSE 2 END AS chp FROM r)""")
def index_strip(spark, sf):
    from ..functions.rolling import axis
    m = F.month("trade_date")
    d = B.index(spark, sf).withColumn("_pv", F.lag("close_val").over(axis()))
    d = d.select("trade_date", F.when(m == 1, F.lit("bad")).when(m == 2, "-1").otherwise(F.col("close_val").cast("string")).alias("p"),
                 F.when(m == 3, F.lit("0")).when(m == 4, F.lit(None).cast("string")).otherwise(F.col("_pv").cast("string")).alias("v"))
    return d.select("trade_date", *[c.alias(k) for k, c in sc.index_strip(F.col("p"), F.col("v"), F.lit("2"), F.lit("1")).items()])


COST_SQL = """
c0 AS (SELECT s_suppkey, 'S' || s_suppkey AS symbol, CASE WHEN s_acctbal > 0 THEN s_acctbal * 100 ELSE 200000 END AS v,
  CASE WHEN s_suppkey % 7 = 0 THEN 1000 ELSE 10 + s_suppkey % 3000 END AS px, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE s_suppkey % 4 END AS tk FROM supplier),
c1 AS (SELECT *, 2 * least(20, 0.0003::DOUBLE * v) AS bk, 2 * 0.0000297::DOUBLE * v AS tx, 2 * 0.000001::DOUBLE * v AS sb FROM c0),
cost AS (SELECT *, 10000 * bk / v AS brokerage, 10000 * tx / v AS exchange, 10000 * sb / v AS sebi, 10000 * 0.18::DOUBLE * (bk + tx + sb) / v AS gst,
  2.5 AS stt, 0.3 AS stamp, 10000 * tk * 0.05::DOUBLE / px AS spread FROM c1),
trip AS (SELECT *, brokerage + exchange + sebi + gst + stt + stamp + spread AS total FROM cost)"""


def _cost_inputs(spark, sf):
    k = F.col("s_suppkey")
    return td.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), k).alias("symbol"), (F.col("s_acctbal") * 100).alias("value"), k.alias("k"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(10 + k % 3000).alias("px"),
        F.when(k % 5 == 0, F.lit(-1.0)).otherwise(k % 4).alias("ticks"))


@register("cost_parts", "SC26 SC27", "symbol brokerage:f exchange:f sebi:f gst:f stt:f stamp:f spread:f total:f", COST_SQL + ", out AS (SELECT * FROM trip)")
def cost_parts(spark, sf):
    d = _cost_inputs(spark, sf)
    a = (F.col("value"), F.col("px"), F.col("ticks"))
    return d.withColumns({**sc.cost_parts(*a), "total": sc.round_trip_bps(*a)})


@register("pay_odds", "SC28 SC29 SC30", "symbol exp_move:f p:f tag", COST_SQL + """,
kn AS (SELECT unnest([0.25, 0.40, 0.50, 0.60, 0.75, 1.00, 1.25, 1.50, 2.00, 2.50]::DOUBLE[]) AS x0, unnest([0.40, 0.50, 0.60, 0.75, 1.00, 1.25, 1.50, 2.00, 2.50, 3.00]::DOUBLE[]) AS x1,
  unnest([81.4, 72.3, 66.5, 61.0, 53.3, 42.3, 33.5, 26.5, 16.8, 10.8]::DOUBLE[]) AS y0, unnest([72.3, 66.5, 61.0, 53.3, 42.3, 33.5, 26.5, 16.8, 10.8, 7.1]::DOUBLE[]) AS y1),
e AS (SELECT symbol, total, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 2.271::DOUBLE + 0.854::DOUBLE * (s_suppkey % 40) END AS exp_move FROM trip),
r AS (SELECT *, total / exp_move AS x FROM e),
o AS (SELECT symbol, exp_move, CASE WHEN x <= 0.25 THEN 81.4 WHEN x > 3 THEN 7.1 ELSE (SELECT y0 + (y1 - y0) / (x1 - x0) * (x - x0) FROM kn WHERE x > x0 AND x <= x1) END AS p FROM r),
out AS (SELECT *, CASE WHEN p IS NULL THEN '—' ELSE concat(CASE WHEN p >= 60 THEN '✅ ' WHEN p >= 45 THEN '⚠ ' ELSE '⛔ ' END, CAST(CAST(round_even(p, 0) AS INT) AS VARCHAR), '%') END AS tag FROM o)""")
def pay_odds(spark, sf):
    d = _cost_inputs(spark, sf)
    total = sc.round_trip_bps(F.col("value"), F.col("px"), F.col("ticks"))
    rv = F.when(F.col("k") % 9 == 0, -1.0).otherwise(F.col("k") % 40)
    d = d.withColumns({"exp_move": sc.exp_move_bps(rv), "_t": total})
    d = d.withColumn("p", sc.p_pays(F.col("exp_move"), F.col("_t")))
    return d.withColumn("tag", sc.pays_tag(F.col("p")))


@register("bar_range_bps", "SC31", "symbol ts:t rng:f", BARS + ", out AS (SELECT *, 10000 * (high - low) / nullif(close, 0) AS rng FROM fine)")
def bar_range_bps(spark, sf):
    return td.bars(spark, sf, 60).withColumn("rng", sc.bps_range(F.col("high"), F.col("low"), F.nullif(F.col("close"), F.lit(0.0))))


# --- live footprint board ------------------------------------------------------------------------
EXTRA = """,
sb AS (SELECT 'S' || l_suppkey AS symbol, trade_date, day, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close, sum(qty) AS volume FROM prints GROUP BY l_suppkey, trade_date, day),
sbt AS (SELECT *, (high + low + close) / 3 AS tp FROM sb),
ext AS (SELECT symbol, trade_date, sum(tp * volume) / sum(volume) AS vwap,
  sum(tp * volume) FILTER (day(day) >= 25) / sum(volume) FILTER (day(day) >= 25) AS close30 FROM sbt GROUP BY 1, 2),
nref AS (SELECT * REPLACE (lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS trade_date) FROM ref),
srun AS (SELECT s.*, n.ref_close, sum(tp * volume) OVER w / sum(volume) OVER w AS rv, max(high) OVER w AS rh, min(low) OVER w AS rl
  FROM sbt s JOIN nref n USING (symbol, trade_date) WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY day ROWS UNBOUNDED PRECEDING)),
strg AS (SELECT symbol, trade_date, min(day) AS entered, arg_min(close, day) AS at_px FROM srun
  WHERE close / ref_close - 1 >= 0 AND CASE WHEN rh > rl THEN (close - rl) / (rh - rl) ELSE 0.5 END >= 0.45::DOUBLE AND (close - rv) / rv >= -0.5::DOUBLE GROUP BY 1, 2)"""

LEG_ANATOMY = re.sub(r"\b(open|high|low|close)\b", lambda m: {"open": "o", "high": "h", "low": "l", "close": "ltp"}[m[0]], ANATOMY)
LEGS_SQL = REF + EXTRA + f""",
q0 AS (SELECT e.trade_date, e.symbol, n.sector, e.open_price AS o, greatest(e.high_price, e.close_price) AS h, least(e.low_price, e.close_price) AS l, e.close_price AS ltp,
  coalesce(nullif(e.prev_close, 0), n.ref_close) AS pc, e.ttl_trd_qnty AS vol, n.vol_med20, coalesce(n.atr14, 0) AS atr, n.rs_cum9, coalesce(n.deliv_trail, 0) AS dtr, i.idx_pct
  FROM eod e JOIN nref n ON n.symbol = e.symbol AND n.trade_date = e.trade_date
  LEFT JOIN (SELECT trade_date, nret AS idx_pct FROM nifty) i ON i.trade_date = e.trade_date),
q1 AS (SELECT *, {LEG_ANATOMY} AS character,
  CASE WHEN h <= l THEN 0.5 ELSE round_even((ltp - l) / (h - l), 3) END AS clr, 100 * (ltp / pc - 1) AS day_raw,
  vol / CASE WHEN vol_med20 > 0 THEN vol_med20 END / {FRAC}::DOUBLE AS pace, vol * (h + l + ltp) / 3 / 100000 AS turn FROM q0 WHERE pc <> 0),
legs AS (SELECT *, day_raw - idx_pct AS rs, rs_cum9 + (day_raw - idx_pct) / 100 AS rs_cum FROM q1)"""


def action_sql(clr: str, day: str, cv: str, turn: str) -> tuple[str, str]:
    ready = " + ".join(_num(x) for x in (f"{clr} >= 0.45", f"{day} >= 0", "pace >= 0.5", "rs_cum > -50", f"{cv} >= -0.5"))
    act = (f"CASE WHEN earn THEN 'EARNINGS' WHEN NOT risk_on THEN 'AVOID' WHEN {ready} >= 5 AND dtr >= 20 AND {turn} >= 2 THEN 'BTST-CARRY' "
           f"WHEN {ready} >= 4 THEN 'FORMING' WHEN coalesce({clr} <= 0.33 OR {day} < 0, FALSE) THEN 'AVOID' ELSE 'NEUTRAL' END")
    return ready, act


_R0, _A0 = action_sql("clr", "day_raw", "CAST(NULL AS DOUBLE)", "turn")
_R1, _A1 = action_sql("clr2", "day2", "cv", "turn2")
BOARD_SQL = LEGS_SQL + CALENDAR + f""",
gate10 AS (SELECT trade_date, coalesce(close_val > CASE WHEN count(close_val) OVER g = 10 THEN avg(close_val) OVER g END, FALSE) AS up
  FROM idx WINDOW g AS (ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
b0 AS (SELECT f.*, coalesce(up, FALSE) AS risk_on, EXISTS (SELECT 1 FROM cal c WHERE c.symbol = f.symbol AND c.date > f.trade_date AND c.date <= f.trade_date + 3) AS earn,
  vwap, close30, entered, at_px FROM legs f LEFT JOIN gate10 USING (trade_date) LEFT JOIN ext USING (symbol, trade_date) LEFT JOIN strg USING (symbol, trade_date)),
b1 AS (SELECT *, {_R0} AS r0, {_A0} AS a0,
  {_num('clr <= 1 - 0.45::DOUBLE')} + {_num('day_raw <= 0')} + {_num('pace >= 0.5')} + CASE WHEN coalesce(rs < 0, TRUE) THEN 1 ELSE 0 END AS sready FROM b0),
b2 AS (SELECT *, a0 IN ('BTST-CARRY', 'FORMING') AS sl FROM b1),
b3 AS (SELECT *, sl AND coalesce(close30 > 0, FALSE) AS h30 FROM b2),
b4 AS (SELECT *, CASE WHEN sl AND vwap > 0 THEN vol * vwap / 100000 ELSE turn END AS turn2,
  CASE WHEN h30 AND greatest(h, close30) > least(l, close30) THEN round_even((close30 - least(l, close30)) / (greatest(h, close30) - least(l, close30)), 3) ELSE clr END AS clr2,
  CASE WHEN h30 THEN 100 * (close30 / pc - 1) ELSE day_raw END AS day2,
  CASE WHEN sl AND vwap > 0 THEN (CASE WHEN h30 THEN close30 ELSE ltp END - vwap) / vwap END AS cv FROM b3),
b5 AS (SELECT trade_date, symbol, sector, ltp, CASE WHEN sl THEN {_R1} ELSE r0 END AS btst, CASE WHEN sl THEN {_A1} ELSE a0 END AS action, sready AS short_ready,
  CASE WHEN sready >= 4 AND character IN ('marubozu_bear', 'shooting_star', 'weak_close') THEN 'SHORT' WHEN sready >= 3 THEN 'WEAK' ELSE '—' END AS sell,
  clr2 AS clr, round_even(day2, 2) AS day_pct, round_even(pace, 2) AS vol_x, round_even(rs, 2) AS rs_pct, round_even(100 * rs_cum, 2) AS rs_cum_pct,
  round_even(100 * cv, 2) AS cvwap_pct, round_even(dtr, 1) AS deliv_tr, round_even(turn2, 0) AS turnover, CASE WHEN h30 THEN round_even(close30, 2) END AS est_close,
  CASE WHEN sl THEN CAST(entered AS TIMESTAMP) END AS entered, CASE WHEN sl THEN at_px END AS at_px FROM b4),
ca0 AS (SELECT *, least(vol_x, 6) AS vc, greatest(day_pct, 0) AS dc FROM b5 WHERE action = 'BTST-CARRY'),
ca AS (SELECT *, round(""" + " + ".join(B.pct_rank_sql(c, "trade_date") for c in ("clr", "deliv_tr", "vc", "dc", "rs_cum_pct")) + """, 9) AS score FROM ca0),
""" + BOOK.format(src="ca", dst="bk", mult="1") + """,
board AS (SELECT b5.*, CASE WHEN action = 'BTST-CARRY' THEN CASE WHEN weight IS NOT NULL THEN '✓ TAKE' ELSE '✗ capped' END END AS book,
  CASE WHEN action = 'BTST-CARRY' THEN CASE WHEN weight IS NOT NULL THEN round_even(100 * weight, 1) ELSE 0 END END AS wt_pct,
  CASE WHEN at_px > 0 THEN round_even(100 * (ltp / at_px - 1), 2) END AS since_pct
  FROM b5 LEFT JOIN (SELECT trade_date, symbol, weight FROM bk) USING (trade_date, symbol))"""


def _quotes(spark, sf):
    return B.eod(spark, sf).select("trade_date", "symbol", "open_price", "high_price", "low_price", F.col("close_price").alias("lp"),
                                   F.col("prev_close").alias("prev_close_price"), F.col("ttl_trd_qnty").alias("volume"))


def _next_ref(spark, sf):
    return B.once(spark, sf, "next_ref", lambda: bd.next_session_reference(
        bd.reference_table(B.eod(spark, sf), B.index(spark, sf), B.sectors(spark, sf), None)))


def _extras(spark, sf):
    keys = ["symbol", "trade_date"]
    b = B.session_bars(spark, sf)
    run = bo.running_session(b.join(_next_ref(spark, sf).select(*keys, F.col("ref_close").alias("prev_close")), keys), keys)
    trig = bo.first_trigger(run, keys, BOARD, pace=False, rs=False)
    return (bo.session_vwap(b, keys).join(bo.last_minutes_vwap(b, keys, F.dayofmonth("ts") >= 25), keys)
            .join(trig, keys, "left"))


def _legs(spark, sf):
    idx = B.nifty(spark, sf).select("trade_date", F.col("nret").alias("idx_pct"))
    return bd.quote_legs(_quotes(spark, sf), _next_ref(spark, sf).drop("prev_close"), idx, MINUTE, BOARD)


def _board(spark, sf):
    return bd.footprint_board(_legs(spark, sf), _extras(spark, sf), rg.regime_gate(B.index(spark, sf), BOARD), B.calendar(spark, sf), MINUTE, BOARD)


@register("quote_legs", "SC14 SC9 SC6 MT10", "trade_date:d symbol clr:f character day_raw:f4 rs_raw:f4 pace:f rs_cum:f turnover:f4", LEGS_SQL + """,
out AS (SELECT *, rs AS rs_raw, turn AS turnover FROM legs)""")
def quote_legs(spark, sf):
    return _legs(spark, sf)


BOARD_COLS = ("trade_date:d symbol sector btst:i action short_ready:i sell clr:f day_pct:f vol_x:f rs_pct:f rs_cum_pct:f cvwap_pct:f deliv_tr:f turnover:f "
              "est_close:f entered:t since_pct:f book wt_pct:f")


@register("footprint_board", "MT10 MT6 SC15 SC16 SC17 SC18 F17", BOARD_COLS, BOARD_SQL + ", out AS (SELECT * FROM board)")
def footprint_board(spark, sf):
    return _board(spark, sf)


@register("action_counts", "A30", "kind label n:i", BOARD_SQL + """,
out AS (SELECT 'action' AS kind, action AS label, count(*) AS n FROM board GROUP BY 2 UNION ALL SELECT 'sell', sell, count(*) FROM board GROUP BY 2)""")
def action_counts(spark, sf):
    return bd.action_counts(_board(spark, sf))


@register("carry_tables", "T6 T7", "trade_date:d symbol table action btst:i clr:f", BOARD_SQL + """,
ct AS (SELECT *, bool_or(action = 'FORMING') OVER (PARTITION BY trade_date) AS anyf, row_number() OVER (PARTITION BY trade_date ORDER BY clr DESC NULLS LAST, symbol) AS k FROM board),
out AS (SELECT *, CASE action WHEN 'BTST-CARRY' THEN 'carry' WHEN 'FORMING' THEN 'forming' ELSE 'strongest' END AS "table" FROM ct
  WHERE action IN ('BTST-CARRY', 'FORMING') OR (NOT anyf AND k <= 10))""")
def carry_tables(spark, sf):
    return bd.carry_tables(_board(spark, sf))


@register("two_sided_shortlist", "F17 T8", "symbol list day_pct:f clr:f", LEGS_SQL + """,
z AS (SELECT symbol, day_raw AS day_pct, clr FROM legs WHERE trade_date = DATE '2000-03-01' AND turn >= 2),
out AS (SELECT * FROM (SELECT 'UP' AS list, * FROM z WHERE day_pct >= 0 AND clr >= 0.5 ORDER BY clr DESC, day_pct DESC, symbol LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'DOWN' AS list, * FROM z WHERE day_pct <= 0 AND clr <= 0.5 ORDER BY clr, day_pct, symbol LIMIT 5))""")
def two_sided_shortlist(spark, sf):
    d = _legs(spark, sf).where("trade_date = '2000-03-01'").withColumns({"day_pct": F.col("day_raw"), "turnover_lacs": F.col("turnover")})
    return sel.two_sided_shortlist(d, 10, BOARD)


@register("baseline_health", "J22 A32", "trade_date:d checked:i mismatch:i pct:f stale:b", REF + """,
nref AS (SELECT * REPLACE (lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS trade_date) FROM ref),
h AS (SELECT e.trade_date, abs(e.prev_close / n.ref_close - 1) <= 0.005::DOUBLE OR coalesce(n.prev_close > 0 AND abs(e.prev_close / n.prev_close - 1) <= 0.005::DOUBLE, FALSE) AS ok
  FROM eod e JOIN nref n USING (symbol, trade_date) WHERE e.prev_close <> 0 AND n.ref_close > 0),
g AS (SELECT trade_date, count(*) AS checked, count(*) FILTER (NOT ok) AS mismatch FROM h GROUP BY 1),
out AS (SELECT *, round_even(100 * (mismatch / CAST(checked AS DOUBLE)), 1) AS pct, checked >= 20 AND mismatch / CAST(checked AS DOUBLE) > 0.2 AS stale FROM g)""")
def baseline_health(spark, sf):
    return bd.baseline_health(_quotes(spark, sf), _next_ref(spark, sf))


@register("missing_sessions", "J23", "trade_date:d", PANEL + """,
out AS (SELECT DISTINCT trade_date FROM panel WHERE trade_date < DATE '2001-06-01' AND trade_date > (SELECT max(trade_date) FROM panel WHERE trade_date < DATE '2001-02-01'))""")
def missing_sessions(spark, sf):
    d = B.panel(spark, sf)
    return bd.missing_sessions(d, d.where("trade_date < '2001-02-01'"), "2001-06-01")


# --- structure scan over daily / weekly / monthly frames -----------------------------------------
SCAN_FRAMES = ["1D", "1W", "1M"]
SCAN_NOW = "2001-11-10"
FIELDS = ["struct", "box_hi", "box_lo", "n", "atr", "band_pct", "walls", "blind_lo", "blind_hi", "last"]


def scan_sql() -> str:
    day = "CAST(ts AS DATE)"
    wk = f"{day} + CAST((4 - (isodow(ts) - 1) + 7) % 7 AS INT)"
    parts = [f"SELECT *, '1D' AS frame, {day} AS d, {day} AS e FROM sbar", f"SELECT *, '1W', {wk}, {wk} FROM sbar",
             f"SELECT *, '1M', last_day({day}), last_day({day}) FROM sbar"]
    wide = ", ".join(f"any_value({c}) FILTER (frame = '{fr}') AS {c}_{fr}" for fr in ("1D", "1W", "1M") for c in FIELDS)
    return """
sbar AS (SELECT 'S' || l_suppkey AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, arg_min(l_extendedprice / l_quantity, ROW(l_orderkey, l_linenumber)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, ROW(l_orderkey, l_linenumber)) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
keyed AS (""" + "\nUNION ALL ".join(parts) + f"""),
multi AS (SELECT symbol, frame, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, CAST(d AS TIMESTAMP) AS ts
  FROM keyed GROUP BY symbol, frame, d HAVING NOT (frame <> '1D' AND CAST(max(keyed.ts) AS DATE) < d AND DATE '{SCAN_NOW}' <= d))""" + struct_sql(
        "multi", "symbol, frame") + summary_sql("symbol, frame", bq.LB_SQL) + f""",
turn AS (SELECT symbol, sum(volume * close) / 100000 AS turnover FROM sbar GROUP BY 1),
wide AS (SELECT symbol, {wide} FROM summ GROUP BY symbol),
scan AS (SELECT *, last_1D AS ltp FROM wide JOIN turn USING (symbol)),
"""


def synth_sql(htf: str, ltf: str, src: str, dst: str, keep: str = "*") -> str:
    loc = (f"CASE WHEN box_hi_{htf} <> 0 AND box_lo_{htf} <> 0 AND box_hi_{htf} > box_lo_{htf} AND ltp <> 0 THEN "
           f"greatest(0, least(1, (ltp - box_lo_{htf}) / (box_hi_{htf} - box_lo_{htf}))) END")
    return f"""{dst}a AS (SELECT *, {loc} AS loc0, coalesce(struct_{htf}, 'n/a') AS hs, coalesce(struct_{ltf}, 'n/a') AS ls, coalesce(n_{htf}, 0) AS hn FROM {src}),
{dst}b AS (SELECT *, coalesce(loc0 >= 0.72, FALSE) AS nhi, coalesce(loc0 <= 0.28, FALSE) AS nlo, hs = 'n/a' OR hn < 6 AS ch, ls = 'n/a' AS cl,
  hs IN ('CONSOLIDATION', 'RANGE') AS hr, ls IN ('CONSOLIDATION', 'RANGE') AS lr, hs IN ('BREAKOUT_UP', 'TREND_UP') AS hu, ls IN ('BREAKOUT_UP', 'TREND_UP') AS lu FROM {dst}a),
{dst}c AS (SELECT *, CASE WHEN ch THEN 'HTF warming' WHEN cl THEN 'LTF warming'
    WHEN hr AND lr THEN CASE WHEN 'CONSOLIDATION' IN (hs, ls) THEN 'NESTED SQUEEZE' ELSE 'RANGE-BOUND (no setup)' END
    WHEN hr AND ls = 'BREAKOUT_UP' THEN CASE WHEN nhi THEN 'RANGE-TOP BREAK' ELSE 'FALSE-BREAK TRAP' END
    WHEN hr AND ls = 'BREAKOUT_DOWN' THEN CASE WHEN nlo THEN 'RANGE-FLOOR BREAK' ELSE 'FALSE-BREAK TRAP' END
    WHEN hr THEN 'DRIFT-IN-RANGE'
    WHEN lr THEN CASE WHEN (hu AND nhi) OR (NOT hu AND nlo) THEN 'COIL AT THE EXTREME' ELSE 'WITH-TREND CONTINUATION' END
    WHEN lu = hu THEN 'EXTENDED (aligned)' ELSE 'PULLBACK vs HTF' END AS setup,
  CASE WHEN ch OR cl THEN 'NONE' WHEN hr THEN CASE WHEN ls = 'BREAKOUT_UP' AND nhi THEN 'UP' WHEN ls = 'BREAKOUT_DOWN' AND nlo THEN 'DOWN' ELSE 'NONE' END
    WHEN hu THEN 'UP' ELSE 'DOWN' END AS dir, CASE WHEN NOT ch AND NOT cl THEN round_even(loc0, 2) END AS loc FROM {dst}b),
{dst} AS (SELECT {keep}, CASE WHEN setup IN ('WITH-TREND CONTINUATION', 'RANGE-TOP BREAK', 'RANGE-FLOOR BREAK', 'PULLBACK vs HTF', 'EXTENDED (aligned)', 'COIL AT THE EXTREME')
    THEN CASE dir WHEN 'UP' THEN 'LONG' WHEN 'DOWN' THEN 'SHORT' ELSE '—' END ELSE '—' END AS side,
  CASE setup {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.TAG_RANK.items())} ELSE 9 END AS setup_rank FROM {dst}c)"""


def live_sql(src: str, dst: str, walls: str, atr: str) -> str:
    """Side-wise merge of wall lists and the nearest levels around ltp."""
    def merge(cond: str) -> str:
        pts = f"list_filter({walls}, lambda c: c.level {cond} ltp)"
        items = f"list_transform(list_sort(list_transform(range(1, len({pts}) + 1), lambda i: {{'level': ({pts})[i].level, 'i': i, 'touches': ({pts})[i].touches}})), lambda c: [{{'level': c.level, 'touches': c.touches, 'edge': c.level, 'first': c.level}}])"
        return (f"CASE WHEN len({pts}) = 0 THEN [] ELSE list_reduce({items}, lambda acc, y: CASE WHEN y[1].level - acc[-1].edge <= 0.6::DOUBLE * {atr} AND y[1].level - acc[-1].first <= 3 * 0.6::DOUBLE * {atr} "
                f"THEN list_concat(acc[1:-2], [{{'level': CASE WHEN y[1].touches > acc[-1].touches THEN y[1].level ELSE acc[-1].level END, 'touches': greatest(acc[-1].touches, y[1].touches), "
                f"'edge': y[1].level, 'first': acc[-1].first}}]) ELSE list_concat(acc, y) END) END")
    return f"""{dst}a AS (SELECT *, {merge('<')} AS bl, {merge('>=')} AS ab FROM {src}),
{dst}b AS (SELECT *, list_filter(bl, lambda c: c.touches >= 2 OR c.level < ltp - 0.25 * {atr}) AS bs, list_filter(ab, lambda c: c.touches >= 2 OR c.level > ltp + 0.25 * {atr}) AS bres,
  list_filter(list_concat(bl, ab), lambda c: c.touches >= 2 AND abs(c.level - ltp) <= 0.15::DOUBLE * {atr}) AS onw FROM {dst}a),
{dst}c AS (SELECT *, list_max(list_transform(bs, lambda c: {{'l': c.level, 't': c.touches}})) AS s, list_min(list_transform(bres, lambda c: {{'l': c.level, 't': c.touches}})) AS r,
  list_min(list_transform(onw, lambda c: {{'d': abs(c.level - ltp), 'l': c.level, 't': c.touches}})) AS o FROM {dst}b),
{dst} AS (SELECT *, round_even(s.l, 2) AS sup, coalesce(s.t, 0) AS sup_t, round_even(r.l, 2) AS res, coalesce(r.t, 0) AS res_t,
  CASE WHEN side = 'SHORT' THEN coalesce(round_even((ltp - s.l) / {atr}, 2), 'inf'::DOUBLE) ELSE coalesce(round_even((r.l - ltp) / {atr}, 2), 'inf'::DOUBLE) END AS headroom,
  CASE WHEN o IS NULL THEN '' ELSE printf('%s %.2f x%d', CASE WHEN o.l >= ltp THEN 'RES' ELSE 'SUP' END, o.l, o.t) END AS at_wall FROM {dst}c)"""


SETUP_SQL = scan_sql() + synth_sql("1W", "1D", "scan", "syn") + """,
syw AS (SELECT *, list_concat(coalesce(walls_1W, []), coalesce(walls_1D, [])) AS wp FROM syn),
""" + live_sql("syw", "lvl", "wp", "atr_1D") + """,
bw0 AS (SELECT *, list_concat(
  CASE WHEN side <> 'SHORT' THEN list_filter(list_transform(coalesce(walls_1M, []), lambda c: {'l': CASE WHEN c.level <= ltp AND ltp < c.hi THEN c.hi ELSE c.level END, 't': c.touches, 'm': ''}),
    lambda c: (c.t >= 2 OR c.l > ltp + 0.25 * atr_1D) AND c.l > ltp)
  ELSE list_filter(list_transform(coalesce(walls_1M, []), lambda c: {'l': CASE WHEN c.level >= ltp AND ltp > c.lo THEN c.lo ELSE c.level END, 't': c.touches, 'm': ''}),
    lambda c: (c.t >= 2 OR c.l < ltp - 0.25 * atr_1D) AND c.l <= ltp) END,
  CASE WHEN side <> 'SHORT' AND blind_hi_1M > ltp THEN [{'l': blind_hi_1M, 't': 1, 'm': '~'}] WHEN side = 'SHORT' AND blind_lo_1M < ltp THEN [{'l': blind_lo_1M, 't': 1, 'm': '~'}] ELSE [] END) AS cw FROM lvl),
bw1 AS (SELECT *, CASE WHEN side <> 'SHORT' THEN list_min(list_transform(cw, lambda c: c.l)) ELSE list_max(list_transform(cw, lambda c: c.l)) END AS big_wall_px FROM bw0),
bw2 AS (SELECT *, list_filter(cw, lambda c: c.l = big_wall_px)[1] AS w FROM bw1),
setup AS (SELECT *, CASE WHEN w IS NULL THEN '' ELSE printf('1M %.2f ×%d%s', w.l, w.t, w.m) END AS big_wall,
  CASE WHEN w IS NULL THEN 'inf'::DOUBLE ELSE round_even(abs(w.l - ltp) / atr_1D, 2) END AS big_gap FROM bw2)"""


def _scan_summary(spark, sf):
    b = B.session_bars(spark, sf).select("symbol", "ts", *bo.OHLCV)
    lb = F.when(F.col("frame") == "1D", Levels().daily_lookback).otherwise(Levels().lookback)
    return lv.frame_summary(bo.multi_frame(b, {}, ("1D", "1W", "1M"), SCAN_NOW, FULL), ["symbol", "frame"], Structure(), Levels(), lb)


def _scan(spark, sf):
    b = B.session_bars(spark, sf)
    turn = b.groupBy("symbol").agg((F.sum(F.col("volume") * F.col("close")) / 1e5).alias("turnover"))
    wide = bd.wide_frames(_scan_summary(spark, sf), SCAN_FRAMES, FIELDS)
    return wide.join(turn, "symbol").withColumn("ltp", F.col("last_1D"))


def _setup(spark, sf):
    return bd.add_setup(_scan(spark, sf), "1D", "1W")


@register("universe_scan", "MT7 MT1 J20", "symbol struct_1D struct_1W struct_1M band_pct_1D:f band_pct_1W:f n_1D:i n_1W:i n_1M:i ltp:r turnover:f3",
          scan_sql() + "out AS (SELECT * FROM scan)")
def universe_scan(spark, sf):
    return _scan(spark, sf)


@register("setup_tags", "SC32 SC33 SC34", "symbol setup dir loc:f side setup_rank:i", SETUP_SQL + ", out AS (SELECT * FROM setup)")
def setup_tags(spark, sf):
    return _setup(spark, sf)


@register("live_levels", "LV5 J21", "symbol sup:f sup_t:i res:f res_t:i headroom:f at_wall", SETUP_SQL + ", out AS (SELECT * FROM setup)")
def live_levels(spark, sf):
    return _setup(spark, sf)


@register("big_wall", "LV6 MT2", "symbol side big_wall big_gap:f big_wall_px:f", SETUP_SQL + ", out AS (SELECT * FROM setup)")
def big_wall(spark, sf):
    return _setup(spark, sf)


def verdict_sql(side: str, preset: str) -> str:
    hold = P.PRESET_HOLD[preset]
    table = (P.LONG_EVIDENCE if side == "LONG" else P.SHORT_EVIDENCE)[hold]
    ev = "CASE setup " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"
    yrs = "CASE setup " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LONG_YEARS.items()) + " ELSE '' END"
    if side == "LONG":
        text = (f"CASE WHEN ev IS NULL THEN '— not measured for this hold' WHEN ev >= 25 THEN printf('✅ BEST for this hold — %+.2f%% vs buying any stock · worked %s years', ev / 100, {yrs}) "
                f"WHEN ev <= 0 THEN printf('⛔ LOSES money if you hold this long (%+.2f%% vs buying any stock)', ev / 100) ELSE printf('⚠️ Weak here — only %+.2f%% vs buying any stock · worked %s years', ev / 100, {yrs}) END")
    else:
        text = ("CASE WHEN ev IS NULL THEN '— not measured for this hold' WHEN ev <= -35 THEN printf('⛔ It BOUNCES — worst short here (%+.2f%% vs shorting any stock)', ev / 100) "
                "WHEN ev < 0 THEN printf('⛔ Worse than shorting a random stock (%+.2f%%)', ev / 100) ELSE printf('⛔ Every multi-day short LOSES — this one loses least (%+.2f%%)', ev / 100) END")
    return f"""ev AS (SELECT *, {ev} AS ev FROM setup WHERE side = '{side}'),
out AS (SELECT *, {text} AS note, CAST(-round_even(coalesce(ev, -999) * 10, 0) AS INT) AS evidence_rank FROM ev)"""


@register("long_side_table", "SC35 SC36 T6 T7", "symbol setup note evidence_rank:i turnover:f3", SETUP_SQL + ", " + verdict_sql("LONG", "btst"))
def long_side_table(spark, sf):
    return bd.side_table(_setup(spark, sf), "LONG", "btst")


@register("short_side_table", "SC35 SC36 T6", "symbol setup note evidence_rank:i turnover:f3", SETUP_SQL + ", " + verdict_sql("SHORT", "positional"))
def short_side_table(spark, sf):
    return bd.side_table(_setup(spark, sf), "SHORT", "positional")


@register("setup_census", "A28", "setup dir n:i examples", SETUP_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY setup, dir ORDER BY turnover DESC NULLS LAST, symbol) AS pos FROM setup),
out AS (SELECT setup, dir, count(*) AS n, string_agg(symbol, ', ' ORDER BY pos) FILTER (pos <= 4) AS examples FROM rk GROUP BY 1, 2)""")
def setup_census(spark, sf):
    return bd.setup_census(_setup(spark, sf))


@register("filter_funnel", "A29 F5 F7 F8 F9", "step:i stage n:i", SETUP_SQL + """,
c AS (SELECT *, side = 'LONG' AS p1, big_gap >= 1 AS p2, ltp <= 30000 AS p3, struct_1W = 'RANGE' AS p4 FROM setup),
out AS (SELECT 0 AS step, 'scanned' AS stage, count(*) AS n FROM c UNION ALL SELECT 1, 'setup', count(*) FROM c WHERE p1 UNION ALL SELECT 2, 'room', count(*) FROM c WHERE p1 AND p2
  UNION ALL SELECT 3, 'price', count(*) FROM c WHERE p1 AND p2 AND p3 UNION ALL SELECT 4, 'structure', count(*) FROM c WHERE p1 AND p2 AND p3 AND p4)""")
def filter_funnel(spark, sf):
    return bd.filter_funnel(_setup(spark, sf), [("setup", bd.setup_predicate("long")), ("room", bd.room_predicate("room")),
                                                ("price", F.col("ltp") <= 30000), ("structure", bd.structure_predicate("1W", "RANGE"))])


@register("board_filters", "F5 F6 F7 F8 F9 T6", "symbol setup ltp:r wtd_recent:f turnover:f3", SETUP_SQL + """
p0 AS (SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS td, l_suppkey, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS dq,
  round(sum(l_extendedprice), 2) / CAST(100000 AS DOUBLE) AS t, max(l_extendedprice / l_quantity) AS mx, min(l_extendedprice / l_quantity) AS mn FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT *, CAST(100 AS DOUBLE) * dq / q AS dp, row_number() OVER (PARTITION BY symbol, td < DATE '2001-11-01' ORDER BY td DESC) AS k FROM p0 WHERE l_suppkey % 10 <> 9 AND mx > mn AND td >= DATE '2001-11-01' - 2000),
dm AS (SELECT symbol, sum(dp * t) FILTER (td > DATE '2001-11-01' - 95) / nullif(sum(t) FILTER (td > DATE '2001-11-01' - 95), 0) AS wtd_recent,
  sum(dp * t) FILTER (td < DATE '2001-11-01' AND k <= 24) / nullif(sum(t) FILTER (td < DATE '2001-11-01' AND k <= 24), 0) AS nm FROM u GROUP BY 1),
out AS (SELECT s.symbol, setup, ltp, wtd_recent, turnover FROM setup s LEFT JOIN dm USING (symbol)
  WHERE ltp >= 100 AND ltp <= 50000 AND setup <> 'FALSE-BREAK TRAP' AND coalesce(wtd_recent >= 20, FALSE) AND coalesce((wtd_recent / nm - 1) * 100 >= -50, FALSE)
  ORDER BY turnover DESC, symbol LIMIT 60)""".replace("\np0 AS", ",\np0 AS", 1))
def board_filters(spark, sf):
    mom = dl.delivery_momentum(B.eod(spark, sf), "2001-11-01", Delivery(recent_days=95, norm_rows=24), 2000)
    d = _setup(spark, sf).join(mom, "symbol", "left")
    d = bd.price_band(d, "ltp", 100.0, 50000.0).where(bd.setup_predicate("no_traps"))
    d = bd.delivery_filter(d, 20.0).where(F.coalesce(F.col("deliv_vs_norm") >= -50, F.lit(False)))
    return sel.top_k(d, 60, F.col("turnover").desc(), "symbol")


@register("scan_quality", "A31", "n:i n_blank:i n_quote_gap:i barren_share:f", scan_sql() + """
sy AS (SELECT 'S' || s_suppkey AS symbol FROM supplier),
out AS (SELECT count(*) AS n, count(*) FILTER (coalesce(struct_1M = 'n/a', TRUE)) AS n_blank, count(*) FILTER (s_odd) AS n_quote_gap,
  avg(CASE WHEN coalesce(struct_1M = 'n/a', TRUE) THEN 1 ELSE 0 END) AS barren_share FROM (SELECT sy.symbol, struct_1M, CAST(substr(sy.symbol, 2) AS INT) % 2 = 1 AS s_odd FROM sy LEFT JOIN wide USING (symbol)))""")
def scan_quality(spark, sf):
    syms = td.sector_dim(spark, sf)
    even = syms.where(F.substring("symbol", 2, 20).cast("int") % 2 == 0)
    return bd.scan_quality(_scan_summary(spark, sf), syms, even, "1M")


# --- frame board over event bars -----------------------------------------------------------------
H4 = BARS + f""",
k4 AS (SELECT *, {slot_sql(240)} FROM fine), h4 AS ({agg_sql('symbol')} FROM k4 GROUP BY symbol, d, slot)"""
def frame_sql(index_pct: str = "1.5") -> str:
    """CTEs from 4-hour bars `h4` to the board rows `fb`."""
    return (bq.RSI.replace("FROM fine", "FROM h4") + struct_sql("h4", "symbol") + f""",
nd AS (SELECT symbol, max(CAST(ts AS DATE)) AS ld FROM h4 GROUP BY 1),
ss AS (SELECT symbol, arg_min(open, ts) AS o, max(high) AS dh, min(low) AS day_low, arg_max(close, ts) AS ltp, sum((high + low + close) / 3 * volume) / sum(volume) AS vwap
  FROM h4 JOIN nd USING (symbol) WHERE CAST(ts AS DATE) = ld GROUP BY 1),
pv AS (SELECT symbol, arg_max(close, ts) AS prev_close FROM h4 JOIN nd USING (symbol) WHERE CAST(ts AS DATE) < ld GROUP BY 1),
lb AS (SELECT symbol, ts, struct, atr, high AS bar_h, low AS bar_l, CASE WHEN high > low THEN round_even((close - low) / (high - low), 3) ELSE 0.5 END AS bar_clr
  FROM stru QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
fb0 AS (SELECT *, round_even(100 * (ltp / prev_close - 1), 2) AS day_pct, ltp >= vwap AS above_vwap, 100 * (ltp / vwap - 1) AS vs_vwap FROM ss JOIN pv USING (symbol) JOIN lb USING (symbol) JOIN rsi USING (symbol)),
fb AS (SELECT *, round_even(day_pct - {index_pct}, 2) AS rs_pct FROM fb0)""")


FB = H4 + frame_sql()


def _label_sql(clr: str, vw: str, rs: str) -> tuple[str, str]:
    a = (f"CASE WHEN {clr} >= 0.7 AND {vw} AND tone IN ('strong', 'neutral') AND {rs} > 0 THEN 'LONG' WHEN {clr} <= 0.33 OR NOT {vw} THEN 'AVOID' ELSE 'NEUTRAL' END")
    s = (f"CASE WHEN {clr} <= 1 - 0.7::DOUBLE AND NOT {vw} AND tone IN ('weak', 'rolling-over') AND {rs} < 0 THEN 'SHORT' WHEN {clr} <= 0.4 AND NOT {vw} THEN 'WEAK' ELSE '—' END")
    return a, s


_FA, _FS = _label_sql("bar_clr", "above_vwap", "rs_pct")


def _frame_board(spark, sf):
    h4 = stage(bo.resample(td.bars(spark, sf, 60), 240, FULL))
    feat = bd.frame_features(h4, 240, bq.NOW, FULL)
    newest = h4.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("_l"))
    prev = h4.join(newest, "symbol").where(F.to_date("ts") < F.col("_l")).groupBy("symbol").agg(F.max_by("close", "ts").alias("prev_close"))
    return bd.frame_board(feat, prev, F.lit(1.5), F.lit(True))


@register("frame_board", "MT3 MT4 SC19", "symbol ltp:r day_pct:f rs_pct:f bar_clr:f above_vwap:b rsi7:f tone entry:f stop:f t1:f s_stop:f action sell struct span", FB + f""",
out AS (SELECT *, {_FA} AS action, {_FS} AS sell, round_even(ltp, 2) AS entry, round_even(CASE WHEN day_low <> 0 AND day_low < ltp THEN greatest(ltp - atr, day_low) ELSE ltp - atr END, 2) AS stop,
  round_even(ltp + atr, 2) AS t1, round_even(ltp + atr, 2) AS s_stop, strftime(ts, '%H:%M') || '-' || strftime(ts + INTERVAL 240 MINUTES, '%H:%M') AS span FROM fb)""")
def frame_board(spark, sf):
    return _frame_board(spark, sf)


_RA, _RS = _label_sql("clr2", "vw2", "rs2")


@register("repriced_board", "MT5 STR7s", "symbol ltp:f day_pct:f rs_pct:f bar_clr:f vs_vwap:f stop:f t1:f action sell", FB + f""",
px AS (SELECT *, CASE WHEN symbol <> 'error' THEN ltp * 1.1::DOUBLE END AS lp FROM fb),
rp AS (SELECT *, coalesce(100 * (lp / prev_close - 1), day_pct) AS day2, CASE WHEN lp IS NULL THEN rs_pct ELSE round_even(100 * (lp / prev_close - 1) - 1.5::DOUBLE, 2) END AS rs2,
  CASE WHEN lp IS NULL THEN bar_clr WHEN greatest(bar_h, lp) > least(bar_l, lp) THEN round_even((lp - least(bar_l, lp)) / (greatest(bar_h, lp) - least(bar_l, lp)), 3) ELSE 0.5 END AS clr2,
  coalesce(lp, ltp) >= vwap AS vw2, coalesce(lp, ltp) AS p2 FROM px),
out AS (SELECT symbol, CASE WHEN lp IS NULL THEN ltp ELSE round_even(lp, 2) END AS ltp, CASE WHEN lp IS NULL THEN day_pct ELSE round_even(day2, 2) END AS day_pct, rs2 AS rs_pct, clr2 AS bar_clr,
  CASE WHEN lp IS NULL THEN vs_vwap ELSE round_even(100 * (lp / vwap - 1), 2) END AS vs_vwap,
  round_even(CASE WHEN day_low <> 0 AND day_low < p2 THEN greatest(p2 - atr, day_low) ELSE p2 - atr END, 2) AS stop, round_even(p2 + atr, 2) AS t1, {_RA} AS action, {_RS} AS sell FROM rp)""")
def repriced_board(spark, sf):
    b = stage(_frame_board(spark, sf))
    quotes = b.where("symbol <> 'error'").select("symbol", (F.col("ltp") * 1.1).alias("lp"))
    return bd.reprice(b, quotes, F.lit(1.5), F.lit(True))


# --- short horizon -------------------------------------------------------------------------------
def renamed(sql: str, prefix: str) -> str:
    """The same CTEs under prefixed names, so that a fragment can be used twice in one statement."""
    names = "s0 s1 s2 s3 s4 stru v0 v1 v2 v3 v4 summ wbars".split()
    for n in names:
        sql = re.sub(rf"(?m)(^{n} AS|FROM {n}\b|JOIN {n}\b)", lambda m, n=n: m[0].replace(n, prefix + n), sql)
    return sql.lstrip(",\n")


# event prices only range, so the side queries read structure with lower thresholds
EASY = Structure(breakout_atr=0.1, trend_er=0.15, trend_atr=0.4)
_LOW = renamed(struct_sql("fz", "symbol", p=EASY), "l")


def sides_sql(delay: int) -> str:
    """CTE `sides`: verdict per fine bar from the newest coarse bar `delay` minutes back."""
    return H4 + struct_sql("h4", "symbol", p=EASY) + f""",
hstr AS (SELECT symbol, ts AS hts, struct AS struct_H, box_hi AS box_hi_H, box_lo AS box_lo_H, n AS n_H FROM stru),
fz AS (SELECT * FROM fine),
{_LOW},
pair AS (SELECT l.symbol, l.ts, l.close AS ltp, l.n AS ln, l.struct AS struct_L, h.* EXCLUDE (symbol) FROM lstru l
  ASOF LEFT JOIN hstr h ON h.symbol = l.symbol AND l.ts - INTERVAL {delay} MINUTES >= h.hts),
{synth_sql("H", "L", "pair", "sd")},
sides AS (SELECT symbol, ts, setup, ltp, CASE WHEN ln >= 5 AND coalesce(n_H >= 5, FALSE) THEN side END AS side FROM sd)"""


@register("side_by_bar", "W37 W34 W35", "symbol ts:t setup side", sides_sql(180) + ", out AS (SELECT * FROM sides)")
def side_by_bar(spark, sf):
    fine = td.bars(spark, sf, 60)
    return sh.side_by_bar(fine, bo.resample(fine, 240, FULL), 180, EASY)


@register("short_entries", "W35", "symbol d:d entered at:f", sides_sql(0) + """,
dd AS (SELECT *, CAST(ts AS DATE) AS d FROM sides),
eod_side AS (SELECT symbol, d, arg_max(side, ts) AS last_side FROM dd WHERE side IS NOT NULL GROUP BY 1, 2),
hit AS (SELECT symbol, d, min(ts) AS ts, arg_min(ltp, ts) AS px FROM dd WHERE side = 'SHORT' GROUP BY 1, 2),
nd AS (SELECT DISTINCT symbol, d FROM dd),
bf AS (SELECT n.symbol, n.d, (SELECT arg_max(side, ts) FROM dd WHERE dd.symbol = n.symbol AND dd.d < n.d AND side IS NOT NULL) AS before FROM nd n),
out AS (SELECT b.symbol, b.d, strftime(ts, '%H:%M') AS entered, round_even(px, 2) AS "at" FROM bf b JOIN hit h ON h.symbol = b.symbol AND h.d = b.d WHERE coalesce(before <> 'SHORT', TRUE))""")
def short_entries(spark, sf):
    fine = td.bars(spark, sf, 60)
    return sh.short_entries(sh.side_by_bar(fine, bo.resample(fine, 240, FULL), 0, EASY))


@register("energy", "A34", "symbol rv10:f rvol:f", BARS + """,
nd AS (SELECT symbol, max(CAST(ts AS DATE)) AS ld FROM fine GROUP BY 1),
cl AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY f.symbol) AS c FROM fine f JOIN nd USING (symbol)
  WHERE CAST(ts AS DATE) = ld AND ts <= TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 60 MINUTES),
md AS (SELECT symbol, median(volume) AS m FROM fine GROUP BY 1),
out AS (SELECT symbol, avg(10000 * (high - low) / close) AS rv10, avg(volume) / any_value(m) AS rvol FROM cl JOIN md USING (symbol) WHERE k <= 10 GROUP BY 1 HAVING any_value(c) >= 10)""")
def energy(spark, sf):
    return sh.energy(td.bars(spark, sf, 60), "2024-01-30 22:00:00", 60)


SHORT_SQL = sides_sql(180) + ",\n" + renamed(struct_sql("fine", "symbol", True, EASY), "f") + f""",
k7 AS (SELECT *, {slot_sql(420)} FROM fine), h7 AS ({agg_sql('symbol')} FROM k7 GROUP BY symbol, d, slot),
""" + renamed(struct_sql("h7", "symbol", p=EASY) + summary_sql("symbol", "60"), "u") + """,
nd AS (SELECT symbol, max(CAST(ts AS DATE)) AS ld FROM fine GROUP BY 1),
se AS (SELECT symbol, arg_min(open, ts) AS o, arg_max(close, ts) AS ltp, sum(volume * close) / 100000 AS turnover, avg(1) AS one
  FROM fine JOIN nd USING (symbol) WHERE CAST(ts AS DATE) = ld GROUP BY 1),
pv AS (SELECT symbol, arg_max(close, ts) AS pc FROM fine JOIN nd USING (symbol) WHERE CAST(ts AS DATE) < ld GROUP BY 1),
lo AS (SELECT symbol, struct AS struct_L FROM fstru QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
ho AS (SELECT symbol, struct AS struct_H, box_hi AS box_hi_H, box_lo AS box_lo_H, n AS n_H, atr AS atr_c FROM stru QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
ex AS (SELECT * FROM se JOIN lo USING (symbol) JOIN ho USING (symbol) LEFT JOIN pv USING (symbol)),
""" + synth_sql("H", "L", "ex", "sx") + """,
cl AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol ORDER BY ts DESC) AS k FROM fine f JOIN nd USING (symbol) WHERE CAST(ts AS DATE) = ld),
en AS (SELECT symbol, avg(10000 * (high - low) / close) FILTER (k <= 10) AS rv10, avg(volume) FILTER (k <= 10) AS v10 FROM cl GROUP BY 1),
md AS (SELECT symbol, median(volume) AS m FROM fine GROUP BY 1),
c1 AS (SELECT *, 2.271::DOUBLE + 0.854::DOUBLE * rv10 AS ex5, v10 / m AS rv, 2 + 0.594::DOUBLE + 0.02::DOUBLE + 0.18::DOUBLE * (2 + 0.594::DOUBLE + 0.02::DOUBLE) + 2.5 + 0.3 + 10000 * 2 * 0.05::DOUBLE / ltp AS co
  FROM sx JOIN en USING (symbol) JOIN md USING (symbol)),
kn AS (SELECT unnest([0.25, 0.40, 0.50, 0.60, 0.75, 1.00, 1.25, 1.50, 2.00, 2.50]::DOUBLE[]) AS x0, unnest([0.40, 0.50, 0.60, 0.75, 1.00, 1.25, 1.50, 2.00, 2.50, 3.00]::DOUBLE[]) AS x1,
  unnest([81.4, 72.3, 66.5, 61.0, 53.3, 42.3, 33.5, 26.5, 16.8, 10.8]::DOUBLE[]) AS y0, unnest([72.3, 66.5, 61.0, 53.3, 42.3, 33.5, 26.5, 16.8, 10.8, 7.1]::DOUBLE[]) AS y1),
c2 AS (SELECT *, CASE WHEN co / ex5 <= 0.25 THEN 81.4 WHEN co / ex5 > 3 THEN 7.1 ELSE (SELECT y0 + (y1 - y0) / (x1 - x0) * (co / ex5 - x0) FROM kn WHERE co / ex5 > x0 AND co / ex5 <= x1) END AS pp FROM c1),
lvl0 AS (SELECT u.symbol, u.atr AS ua, u.walls AS uw, c2.ltp AS px FROM usumm u JOIN c2 USING (symbol)),
lvl1 AS (SELECT symbol, ua, list_min(list_transform(list_filter(uw, lambda c: c.level > px + 0.25 * ua), lambda c: c.level)) AS res, list_max(list_transform(list_filter(uw, lambda c: c.level < px - 0.25 * ua), lambda c: c.level)) AS sup,
  round_even((list_min(list_transform(list_filter(uw, lambda c: c.touches >= 2 AND c.level > px), lambda c: c.level)) - px) / ua, 2) AS hup,
  round_even((px - list_max(list_transform(list_filter(uw, lambda c: c.touches >= 2 AND c.level < px), lambda c: c.level))) / ua, 2) AS hdn FROM lvl0),
ix AS (SELECT s.symbol, s.ts, s.ltp AS close, s.side AS sd0, row_number() OVER (PARTITION BY s.symbol ORDER BY s.ts) - 1 AS i, count(*) OVER (PARTITION BY s.symbol) - 1 AS last, CAST(s.ts AS DATE) AS d FROM sides s),
fl AS (SELECT symbol, any_value(last) AS last, greatest(min(i) FILTER (d = ld), any_value(last) - 240, 4) AS flo FROM ix JOIN nd USING (symbol) GROUP BY 1),
bk AS (SELECT x.symbol, max(x.i) AS bi FROM ix x JOIN fl USING (symbol) JOIN c2 USING (symbol) WHERE x.i >= flo AND x.i < fl.last AND x.sd0 IS DISTINCT FROM c2.side GROUP BY 1),
st AS (SELECT fl.symbol, CASE WHEN bi IS NOT NULL THEN bi + 1 ELSE least(flo, fl.last) END AS s0, CASE WHEN bi IS NOT NULL THEN (SELECT sd0 IS NULL FROM ix WHERE ix.symbol = fl.symbol AND ix.i = bi) ELSE TRUE END AS bounded
  FROM fl LEFT JOIN bk USING (symbol)),
rn AS (SELECT st.symbol, bounded, ix.ts, ix.close FROM st JOIN ix ON ix.symbol = st.symbol AND ix.i = st.s0),
out AS (SELECT c2.symbol, setup, dir, c2.side, setup_rank, round_even(ltp, 2) AS ltp, round_even(100 * (ltp / coalesce(pc, o) - 1), 2) AS day_pct,
  CASE WHEN c2.side IN ('LONG', 'SHORT') THEN concat(CASE WHEN bounded THEN '≥' ELSE '' END, strftime(rn.ts, '%H:%M')) ELSE '—' END AS entered,
  CASE WHEN c2.side IN ('LONG', 'SHORT') THEN round_even(rn.close, 2) END AS "at",
  CASE WHEN c2.side IN ('LONG', 'SHORT') THEN round_even(CASE WHEN c2.side = 'SHORT' THEN -1 ELSE 1 END * 100 * (ltp / rn.close - 1), 2) END AS since_pct,
  round_even(ex5, 1) AS exp_move, round_even(co, 1) AS cost, round_even(pp, 0) AS p_pays, round_even(rv, 2) AS rvol, sup, res,
  coalesce(round_even(10000 * CASE c2.side WHEN 'LONG' THEN hup WHEN 'SHORT' THEN hdn END * ua / ltp / ex5, 2), 'inf'::DOUBLE) AS room,
  round_even(ltp - atr_c, 2) AS stop, round_even(ltp + atr_c, 2) AS t1 FROM c2 LEFT JOIN lvl1 USING (symbol) LEFT JOIN rn USING (symbol))"""


@register("short_horizon_board", "MT8 W34 SC42", "symbol setup dir side setup_rank:i ltp:f day_pct:f entered at:f since_pct:f exp_move:f cost:f p_pays:f rvol:f sup:f res:f room:f stop:f t1:f", SHORT_SQL)
def short_horizon_board(spark, sf):
    fine = stage(td.bars(spark, sf, 60))
    return sh.short_horizon_board(fine, 60, 240, 420, bq.NOW, Cost(), FULL, EASY)
