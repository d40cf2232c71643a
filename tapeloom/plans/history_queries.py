"""Histories with corporate actions: factors, adjusted frames, levels and the universe board on them."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import adjust as adj
from ..operators import boards as bd
from ..operators import delivery as dl
from ..operators import levels as lv
from ..params import Delivery, Levels
from ..session import stage
from ..sources import panel as src
from ..sources import testdata as td
from . import bar_queries as bq
from . import base as B
from .bar_queries import FULL, OHLC, frames_sql, struct_sql, summary_sql
from .base import PANEL
from .board_queries import FIELDS, SCAN_FRAMES
from .spec import register

GAP = Levels().gap
TODAY = "2001-10-01"      # the universe board's session begins here; histories end the day before
LAST = str(date.fromisoformat(TODAY) - timedelta(days=1))


def scale_sql(key: str, day: str, actions: dict) -> str:
    steps = [f"CASE WHEN {key} = {name!r} AND {day} < DATE '{at}' THEN {times}::DOUBLE ELSE 1 END"
             for name, rows in actions.items() for at, times in rows]
    return " * ".join(steps)


def adjust_sql(raw: str, out: str) -> str:
    """CTE `out`: the bars `raw` back-adjusted."""
    return f"""
{out}_r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ratio, count(*) OVER (PARTITION BY symbol) AS cnt FROM {raw}),
{out}_k AS (SELECT *, CASE WHEN cnt >= 3 AND abs(ratio - 1) > {GAP}::DOUBLE AND ratio > 0 THEN ln(ratio) END AS lr FROM {out}_r),
{out}_f AS (SELECT *, exp(coalesce(sum(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS k FROM {out}_k),
{out} AS (SELECT symbol, ts, open * k AS open, high * k AS high, low * k AS low, close * k AS close, volume FROM {out}_f)"""


LISTED = f"""
ltick AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, event_id,
  (1000 + least(value, 400) / 3) * ({scale_sql("event_type", "CAST(ts AS DATE)", td.LISTED_EVENTS)}) AS px FROM events),
fraw AS (SELECT symbol, h AS ts, arg_min(px, event_id) AS open, max(px) AS high, min(px) AS low, arg_max(px, event_id) AS close, count(*) AS volume
  FROM ltick GROUP BY symbol, h),
draw AS (SELECT symbol, date_trunc('day', b.ts) AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume
  FROM fraw b GROUP BY 1, 2),""" + adjust_sql("fraw", "fine") + "," + adjust_sql("draw", "daily")
PAPERS = f"""
lpx AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, ROW(l_orderkey, l_linenumber) AS pos, l_quantity AS qty,
  (1000 + (l_extendedprice % 1000) / 10) * ({scale_sql("l_suppkey % 10", "CAST(l_shipdate AS DATE)", td.LISTED_SUPPLIERS)}) AS px FROM lineitem),
praw AS (SELECT symbol, CAST(day AS TIMESTAMP) AS ts, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close, sum(qty) AS volume
  FROM lpx GROUP BY symbol, day)"""


def past_sql(name: str, days: int) -> str:
    return f"""{name}raw AS (SELECT * FROM praw WHERE ts <= TIMESTAMP '{LAST}' AND ts >= TIMESTAMP '{LAST}' - INTERVAL {days} DAYS),""" + adjust_sql(f"{name}raw", name)


HISTORY = PAPERS + ",\n" + past_sql("dh", Levels().daily_days) + ",\n" + past_sql("mh", Levels().monthly_days) + f""",
mkey AS (SELECT *, last_day(CAST(ts AS DATE)) AS me FROM mh),
months AS (SELECT symbol, CAST(me AS TIMESTAMP) AS ts, arg_min(open, k.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, k.ts) AS close, sum(volume) AS volume
  FROM mkey k GROUP BY symbol, me HAVING NOT (CAST(max(k.ts) AS DATE) < me AND DATE '{LAST}' <= me))"""


def _papers(spark, sf, end=LAST):
    return td.listed_panel(spark, sf, None, end)


@register("action_factors", "ADJ1", "symbol valid_from:t factor:f", PAPERS + "," + adjust_sql("praw", "adj") + """,
ev AS (SELECT symbol, ts, lr, k, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS nth FROM adj_f WHERE lr IS NOT NULL),
out AS (SELECT symbol, ts AS valid_from, k AS factor FROM ev UNION ALL SELECT symbol, NULL, k * exp(lr) FROM ev WHERE nth = 1)""")
def action_factors(spark, sf):
    d = _papers(spark, sf, None)
    return adj.action_factors(d.select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), F.col("close_price").alias("close")))


@register("daily_history", "SRC11 ADJ1", f"symbol ts:t {OHLC}", HISTORY + ", out AS (SELECT * FROM dh)")
def daily_history(spark, sf):
    return adj.daily_history(_papers(spark, sf), LAST)


@register("monthly_history", "SRC11 RS4 ADJ1", f"symbol ts:t {OHLC}", HISTORY + ", out AS (SELECT * FROM months)")
def monthly_history(spark, sf):
    return adj.monthly_history(_papers(spark, sf), LAST)


@register("adjusted_fine_bars", "ADJ1 MT1", f"symbol ts:t {OHLC}", LISTED + """,
out AS (SELECT b.symbol, b.ts, b.open * k AS open, b.high * k AS high, b.low * k AS low, b.close * k AS close, b.volume
  FROM fraw b JOIN daily_f d ON d.symbol = b.symbol AND d.ts = date_trunc('day', b.ts))""")
def adjusted_fine_bars(spark, sf):
    """The daily axis' table as of each fine bar."""
    fine = stage(td.listed_bars(spark, sf, 60))
    days = td.listed_daily(fine).select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), F.col("close_price").alias("close"))
    return adj.adjusted(fine, adj.action_factors(days))


FRAMES_SQL = frames_sql(LISTED, "daily")
SUMM = FRAMES_SQL + struct_sql("multi", "symbol, frame") + summary_sql("symbol, frame", bq.LB_SQL)


def _frames(spark, sf):
    fine = stage(td.listed_bars(spark, sf, 60))
    return adj.all_frames(fine, td.listed_daily(fine), bq.FRAMES, bq.NOW, FULL)


@register("adjusted_frames", "MT1 SRC11 ADJ1 J20", f"symbol frame ts:t {OHLC}", FRAMES_SQL + ", out AS (SELECT * FROM multi)")
def adjusted_frames(spark, sf):
    return _frames(spark, sf)


@register("adjusted_frame_summary", "MT1 LV7 ADJ1", bq.SUMM_COLS.replace(":r", ":f"), SUMM + ", out AS (SELECT *, len(walls) AS n_walls FROM summ)")
def adjusted_frame_summary(spark, sf):
    return bq.summarize(_frames(spark, sf)).withColumn("n_walls", F.size("walls"))


@register("adjusted_sr_levels", "LV4 LV3 ADJ1", bq.SR_COLS, SUMM + bq.LEVELS_SQL + ", out AS (SELECT * FROM sr)")
def adjusted_sr_levels(spark, sf):
    return lv.sr_levels(bq.summarize(_frames(spark, sf)))


@register("adjusted_levels_report", "E9 LV4 ADJ1", bq.REPORT_COLS, SUMM + bq.REPORT_SQL)
def adjusted_levels_report(spark, sf):
    return lv.levels_report(bq.summarize(_frames(spark, sf)), bq.KEYS)


def momentum_sql(as_of: str) -> str:
    return f"""
mu AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date < DATE '{as_of}' ORDER BY trade_date DESC) AS k FROM eod
  WHERE trade_date <= DATE '{as_of}' AND trade_date >= DATE '{as_of}' - 2000 AND turnover_lacs > 0 AND deliv_per IS NOT NULL),
mg AS (SELECT symbol, sum(deliv_per * turnover_lacs) FILTER (trade_date > DATE '{as_of}' - 95) / nullif(sum(turnover_lacs) FILTER (trade_date > DATE '{as_of}' - 95), 0) AS w,
  sum(deliv_per * turnover_lacs) FILTER (trade_date < DATE '{as_of}' AND k <= 24) / nullif(sum(turnover_lacs) FILTER (trade_date < DATE '{as_of}' AND k <= 24), 0) AS n
  FROM mu GROUP BY symbol),
mom AS (SELECT symbol, round_even(w, 1) AS wtd_recent, round_even(CASE WHEN n > 0 THEN (w / n - 1) * 100 END, 1) AS deliv_vs_norm FROM mg)"""


_WK = "CAST(ts AS DATE) + CAST((4 - (isodow(ts) - 1) + 7) % 7 AS INT)"
_WIDE = ", ".join(f"any_value({c}) FILTER (frame = '{fr}') AS {c}_{fr}" for fr in SCAN_FRAMES for c in FIELDS)
BOARD = PANEL + "," + HISTORY + "," + momentum_sql(LAST) + f""",
keyed AS (SELECT *, '1D' AS frame, CAST(ts AS DATE) AS d FROM dh UNION ALL SELECT *, '1W', {_WK} FROM dh),
multi AS (SELECT symbol, frame, arg_min(open, y.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, y.ts) AS close, sum(volume) AS volume, CAST(d AS TIMESTAMP) AS ts
  FROM keyed y GROUP BY symbol, frame, d HAVING NOT (frame = '1W' AND CAST(max(y.ts) AS DATE) < d AND DATE '{LAST}' <= d)
  UNION ALL SELECT symbol, '1M', open, high, low, close, volume, ts FROM months)""" + struct_sql("multi", "symbol, frame") + summary_sql(
    "symbol, frame", bq.LB_SQL) + f""",
wide AS (SELECT symbol, {_WIDE} FROM summ GROUP BY symbol),
qt AS (SELECT symbol, arg_max(px, ROW(day, pos)) AS lp, max(px) AS high, min(px) AS low, sum(qty) AS volume FROM lpx WHERE day >= DATE '{TODAY}' GROUP BY 1),
pvc AS (SELECT symbol, arg_max(close, ts) AS prev_close FROM praw WHERE ts <= TIMESTAMP '{LAST}' GROUP BY 1),
out AS (SELECT s.symbol, coalesce(s.sector, '_' || s.symbol) AS sector, round_even(lp, 2) AS ltp, round_even(100 * (lp / prev_close - 1), 2) AS day_pct,
  round_even(qt.volume * (greatest(high, lp) + least(low, lp) + lp) / 3 / 100000, 1) AS turnover, wtd_recent, deliv_vs_norm, wide.* EXCLUDE (symbol)
  FROM sectors s JOIN qt USING (symbol) JOIN pvc USING (symbol) LEFT JOIN mom USING (symbol) LEFT JOIN wide USING (symbol) WHERE high <> low)"""


@register("universe_board", "MT7 MT1 A14 ADJ1", "symbol sector ltp:f day_pct:f turnover:f wtd_recent:f deliv_vs_norm:f struct_1D struct_1W struct_1M "
          "band_pct_1D:f band_pct_1W:f box_hi_1D:f box_lo_1W:f n_1D:i n_1W:i n_1M:i", BOARD)
def universe_board(spark, sf):
    past = stage(_papers(spark, sf))
    today = td.listed_panel(spark, sf, TODAY)
    quotes = today.groupBy("symbol").agg(F.max_by("close_price", "trade_date").alias("lp"), F.max("high_price").alias("high"),
                                         F.min("low_price").alias("low"), F.sum("ttl_trd_qnty").alias("volume"))
    quotes = quotes.join(past.groupBy("symbol").agg(F.max_by("close_price", "trade_date").alias("prev_close")), "symbol")
    summary = bq.summarize(adj.all_frames(None, past, {}, LAST, FULL))
    window = B.eod(spark, sf, date.fromisoformat(LAST) - timedelta(days=2000), LAST)
    momentum = dl.delivery_momentum(window, LAST, Delivery(recent_days=95, norm_rows=24), 2000)
    return bd.universe_board(bd.wide_frames(summary, SCAN_FRAMES, FIELDS), src.load_sectors(B.sectors(spark, sf)), momentum, quotes)
