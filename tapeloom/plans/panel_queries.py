"""Sources, features, signal, screen."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import regime as rg
from ..operators import screen as scr
from ..operators import selection as sel
from ..sources import panel as src
from ..sources import testdata as td
from . import base as B
from .base import CALENDAR, FEATURES, LEGS, LOOSE, PANEL, SIGNAL, score_sql
from .spec import register


@register("eod_scan", "SRC1 J24 F11", "trade_date:d symbol prev_close:r open_price:r high_price:r low_price:r close_price:r "
          "avg_price:r ttl_trd_qnty:i deliv_qty:i deliv_per:f turnover_lacs:f8 no_of_trades:i", PANEL + """,
uni AS (SELECT DISTINCT symbol FROM (SELECT symbol, lead(avg_price) OVER (PARTITION BY symbol ORDER BY trade_date) nx
        FROM panel) WHERE nx IS NOT NULL),
out AS (SELECT * FROM eod WHERE symbol IN (SELECT symbol FROM uni) AND trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')""")
def eod_scan(spark, sf):
    return src.load_eod(B.panel(spark, sf), src.derivative_universe(B.futures(spark, sf)),
                        "1996-01-01", "2000-12-31")


@register("derivative_universe", "SRC2 U3", "symbol", PANEL + """,
out AS (SELECT DISTINCT symbol FROM (SELECT symbol, lead(avg_price) OVER (PARTITION BY symbol ORDER BY trade_date) nx
        FROM panel) WHERE nx IS NOT NULL)""")
def derivative_universe(spark, sf):
    return src.derivative_universe(B.futures(spark, sf))


@register("index_window", "SRC3", "trade_date:d close_val:f", PANEL + """,
out AS (SELECT * FROM idx WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')""")
def index_window(spark, sf):
    return src.load_index(td.index_series(B.panel(spark, sf)), B.INDEX, "1997-01-01", "1999-12-31")


@register("index_returns", "SRC4 W6", "trade_date:d close_val:f nret:f", PANEL + ", out AS (SELECT * FROM nifty)")
def index_returns(spark, sf):
    return B.nifty(spark, sf)


@register("sector_map", "SRC5", "symbol sector", PANEL + """,
out AS (SELECT symbol, coalesce(sector, '_' || symbol) AS sector FROM sectors)""")
def sector_map(spark, sf):
    return src.load_sectors(td.sector_dim(spark, sf))


@register("session_bounds", "SRC6 SRC7 SRC8", "kind trade_date:d", PANEL + """,
mx AS (SELECT max(trade_date) AS m FROM panel WHERE series = 'EQ'),
out AS (SELECT 'last' AS kind, m AS trade_date FROM mx
  UNION ALL SELECT 'before', max(trade_date) FROM panel WHERE series = 'EQ' AND trade_date < DATE '2000-06-01'
  UNION ALL SELECT 'asof', max(trade_date) FROM
    (SELECT trade_date, lead(avg_price) OVER (PARTITION BY symbol ORDER BY trade_date) nx FROM panel)
    WHERE nx IS NOT NULL AND trade_date <= DATE '2000-06-15')""")
def session_bounds(spark, sf):
    d = B.panel(spark, sf)
    dates = src.derivative_dates(B.futures(spark, sf))
    return (src.last_session(d).withColumn("kind", F.lit("last"))
            .unionByName(src.last_session(d, before="2000-06-01").withColumn("kind", F.lit("before")))
            .unionByName(src.dated(dates, None, "2000-06-15").agg(F.max("trade_date").alias("trade_date"))
                         .withColumn("kind", F.lit("asof"))))


@register("delivery_panel", "SRC9 J7", "symbol trade_date:d sector deliv_per:f turnover_lacs:f8", PANEL + """,
out AS (SELECT p.symbol, trade_date, s.sector, deliv_per, turnover_lacs FROM panel p JOIN sectors s USING (symbol)
  WHERE series IN ('EQ', 'SM', 'ST') AND s.sector NOT IN ('ETF', 'Others') AND deliv_per IS NOT NULL)""")
def delivery_panel(spark, sf):
    return src.deliv_panel(td.eod_panel(spark, sf), B.sectors(spark, sf), ("EQ", "SM", "ST"), ("ETF", "Others"))


@register("event_calendar", "SRC12", "symbol date:d purpose", PANEL + CALENDAR + ", out AS (SELECT * FROM cal)")
def event_calendar(spark, sf):
    return B.calendar(spark, sf)


@register("eod_features", "E1 SC1 SC2 SC3 SC4 W1 W2 W3 W4", "trade_date:d symbol clr:f body:f ret:f close_vs_vwap:f "
          "vwap_in_range:f vol_ratio:f deliv_spike:f deliv_trail:f atr14:f", FEATURES + ", out AS (SELECT * FROM feat)")
def eod_features(spark, sf):
    return ft.add_features(src.load_eod(td.eod_panel(spark, sf)), LOOSE)


@register("relative_strength", "J1 W5 W6", "trade_date:d symbol idx_ret:f rs_idx:f rs_idx_cum:f",
          FEATURES + ", out AS (SELECT * FROM feat)")
def relative_strength(spark, sf):
    return B.features(spark, sf)


@register("signal_rows", "E2 F1 F2", "trade_date:d symbol clr:f deliv_trail:f vol_ratio:f ret:f turnover_lacs:f8",
          FEATURES + f", out AS (SELECT * FROM feat WHERE {SIGNAL})")
def signal_rows(spark, sf):
    return ft.signals(B.features(spark, sf), LOOSE)


@register("thin_names", "F3", "trade_date:d symbol turnover_lacs:f8 clr:f",
          FEATURES + f", out AS (SELECT * FROM feat WHERE {LEGS} AND turnover_lacs < 4)")
def thin_names(spark, sf):
    return ft.thin_names(B.features(spark, sf), LOOSE)


@register("conviction_by_session", "W12", "trade_date:d symbol score:f",
          FEATURES + f", sig AS (SELECT * FROM feat WHERE {SIGNAL}), " + score_sql("sig", "out"))
def conviction_by_session(spark, sf):
    return ft.conviction_score(ft.signals(B.features(spark, sf), LOOSE), ["trade_date"], ["trade_date", "symbol"], LOOSE)


@register("conviction_whole_set", "W12", "trade_date:d symbol score:f",
          FEATURES + f", sig AS (SELECT * FROM feat WHERE {SIGNAL}), " + score_sql("sig", "out", ""))
def conviction_whole_set(spark, sf):
    return ft.conviction_score(ft.signals(B.features(spark, sf), LOOSE), [], ["trade_date", "symbol"], LOOSE)


@register("regime_gate", "W8", "trade_date:d up:b", FEATURES + ", out AS (SELECT * FROM gate)")
def regime_gate(spark, sf):
    return rg.regime_gate(B.index(spark, sf), LOOSE)


LIVE_SQL = FEATURES + """,
live AS (SELECT trade_date, close_val * (1 + ((month(trade_date) % 3) - 1) / CAST(10 AS DOUBLE)) AS live_close FROM idx),
out AS (
  SELECT l.trade_date, l.live_close, coalesce(
    (SELECT count(*) = 9 AND max(trade_date) >= l.trade_date - 40 AND l.live_close > (sum(close_val) + l.live_close) / 10
     FROM (SELECT * FROM idx i WHERE i.trade_date < l.trade_date ORDER BY i.trade_date DESC LIMIT 9)), FALSE) AS up
  FROM live l)"""


@register("live_gate", "W9 STR11s", "trade_date:d live_close:f up:b", LIVE_SQL)
def live_gate(spark, sf):
    ix = B.index(spark, sf)
    live = ix.select("trade_date", (F.col("close_val") * (1 + ((F.month("trade_date") % 3) - 1) / 10.0)).alias("live_close"))
    return rg.live_gate(ix, live, LOOSE)


@register("gate_lookup", "W10 J2", "trade_date:d up:b", FEATURES + """,
asked AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date FROM orders),
out AS (SELECT a.trade_date, coalesce(up, FALSE) AS up FROM asked a LEFT JOIN gate USING (trade_date))""")
def gate_lookup(spark, sf):
    asked = td.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("trade_date")).distinct()
    return rg.gate_on(asked, B.index(spark, sf), LOOSE)


@register("gated_signals", "F4 J2", "trade_date:d symbol", FEATURES + f"""
, out AS (SELECT trade_date, symbol FROM feat JOIN gate USING (trade_date) WHERE {SIGNAL} AND up)""")
def gated_signals(spark, sf):
    return rg.gate_on(ft.signals(B.features(spark, sf), LOOSE), B.index(spark, sf), LOOSE).where("up")


BLOCK = """EXISTS (SELECT 1 FROM cal c WHERE c.symbol = f.symbol AND c.date > f.trade_date
    AND c.date <= f.trade_date + 3)"""


@register("event_guard_anti", "J12 U4", "trade_date:d symbol", FEATURES + CALENDAR + f"""
, out AS (SELECT * FROM feat f WHERE {SIGNAL} AND NOT {BLOCK})""")
def event_guard_anti(spark, sf):
    return cal.without_events(ft.signals(B.features(spark, sf), LOOSE), B.calendar(spark, sf))


@register("event_guard_semi", "J12", "trade_date:d symbol", FEATURES + CALENDAR + f"""
, out AS (SELECT * FROM feat f WHERE {BLOCK})""")
def event_guard_semi(spark, sf):
    return cal.with_events(B.features(spark, sf), B.calendar(spark, sf))


@register("next_event_date", "J12", "trade_date:d symbol event_date:d", PANEL + CALENDAR + """,
out AS (SELECT trade_date, symbol, (SELECT min(c.date) FROM cal c WHERE c.symbol = f.symbol AND c.date > f.trade_date
    AND c.date <= f.trade_date + 3) AS event_date FROM eod f)""")
def next_event_date(spark, sf):
    return cal.next_event(src.load_eod(td.eod_panel(spark, sf)), B.calendar(spark, sf))


@register("event_guard_status", "A38", "available:b n:i asof:d", PANEL + CALENDAR + """,
out AS (SELECT count(*) > 0 AS available, count(*) AS n, max(date) AS asof FROM cal)""")
def event_guard_status(spark, sf):
    return cal.guard_status(B.calendar(spark, sf))


BOOK = """{dst}a AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector ORDER BY score DESC NULLS LAST, symbol) AS rs
  FROM {src}),
{dst}b AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, symbol) AS position
  FROM {dst}a WHERE rs <= 2),
{dst} AS (SELECT *, round_even(least({mult}, 1) / CAST(count(*) OVER (PARTITION BY trade_date) AS DOUBLE), 4) AS weight
  FROM {dst}b WHERE position <= 5)"""

SCREEN_SQL = FEATURES + CALENDAR + f"""
, cand AS (SELECT f.*, coalesce(s.sector, '_' || f.symbol) AS sector FROM feat f LEFT JOIN sectors s USING (symbol)
  WHERE {SIGNAL} AND NOT {BLOCK}),
""" + score_sql("cand", "scored") + ",\n" + BOOK.format(src="scored", dst="book", mult="1") + """,
out AS (SELECT b.*, coalesce(up, FALSE) AS risk_on FROM book b LEFT JOIN gate USING (trade_date))"""
SCREEN_COLS = ("trade_date:d symbol sector close_price:r clr:f deliv_trail:f deliv_per:f vol_ratio:f ret:f close_vs_vwap:f "
               "rs_idx_cum:f score:f weight:f risk_on:b position:i")


@register("screen_all_sessions", "E3 T2 T3 J3 F16", SCREEN_COLS, SCREEN_SQL)
def screen_all_sessions(spark, sf):
    return scr.screen(B.features(spark, sf), B.index(spark, sf), B.calendar(spark, sf), B.sectors(spark, sf), None, LOOSE)


@register("screen_one_session", "E3 T3", SCREEN_COLS, SCREEN_SQL.replace("least(1, 1)", "least(0.5, 1)").replace(
    "FROM book b LEFT JOIN gate USING (trade_date))",
    "FROM book b LEFT JOIN gate USING (trade_date) WHERE b.trade_date = DATE '2000-03-01')"))
def screen_one_session(spark, sf):
    return scr.screen(B.features(spark, sf), B.index(spark, sf), B.calendar(spark, sf), B.sectors(spark, sf),
                      "2000-03-01", LOOSE, size_mult=0.5)


@register("decision_board", "E3 T4 U1 SC12 F3", "trade_date:d symbol sector action reason score:f weight:f risk_on:b band_lo:f "
          "band_hi:f range_lo:f range_hi:f exp_move_pct:f", FEATURES + CALENDAR + f"""
, core0 AS (SELECT f.*, coalesce(s.sector, '_' || f.symbol) AS sector FROM feat f LEFT JOIN sectors s USING (symbol)
  WHERE {LEGS}),
""" + score_sql("core0", "core1") + f""",
core AS (SELECT f.*, coalesce(up, FALSE) AS risk_on, {BLOCK} AS earn FROM core1 f LEFT JOIN gate USING (trade_date)),
pool AS (SELECT * FROM core WHERE turnover_lacs >= 4 AND NOT earn AND risk_on),
""" + BOOK.format(src="pool", dst="book", mult="1") + """,
out AS (
  SELECT trade_date, symbol, sector, 'BUY' AS action, '' AS reason, score, weight, risk_on,
    round_even(close_price - 0.6::DOUBLE * atr14, 2) AS band_lo, round_even(close_price + 0.6::DOUBLE * atr14, 2) AS band_hi,
    round_even(close_price - atr14, 2) AS range_lo, round_even(close_price + atr14, 2) AS range_hi,
    round_even(100 * (0.6::DOUBLE * atr14) / close_price, 2) AS exp_move_pct FROM book
  UNION ALL SELECT trade_date, symbol, sector, 'AVOID', CASE WHEN turnover_lacs < 4 THEN 'illiquid (<₹20cr turnover)'
      WHEN earn THEN 'EARNINGS — results during the hold' ELSE 'regime RISK-OFF (Nifty<50MA)' END,
    score, NULL, risk_on, NULL, NULL, NULL, NULL, NULL FROM core WHERE turnover_lacs < 4 OR earn OR NOT risk_on)""")
def decision_board(spark, sf):
    return scr.decision_board(B.features(spark, sf), B.index(spark, sf), B.calendar(spark, sf), B.sectors(spark, sf), None, LOOSE)


PREP = FEATURES + f"""
, fwd AS (SELECT *, (next_open / close_price - 1) * 10000 AS on_bps, (next_close / next_open - 1) * 10000 AS d2_bps FROM (
    SELECT *, lead(open_price) OVER w AS next_open, lead(close_price) OVER w AS next_close FROM feat
    WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))),
prep AS (SELECT f.*, up, year(trade_date) AS yr FROM fwd f LEFT JOIN gate USING (trade_date)
  WHERE clr IS NOT NULL AND deliv_per IS NOT NULL AND vol_ratio IS NOT NULL AND on_bps IS NOT NULL AND up IS NOT NULL),
sel AS (SELECT * FROM prep WHERE {SIGNAL} AND up)"""
YEARS = """(SELECT yr AS year, count(*) AS n, avg(on_bps) AS gross_on, avg(on_bps - 22) AS net_on,
  100 * avg(CASE WHEN on_bps - 22 > 0 THEN 1 ELSE 0 END) AS win_pct, sum(on_bps - 22) AS total_bps, avg(d2_bps - 6) AS d2_net
  FROM {src} GROUP BY yr HAVING count(*) >= 10)"""
YEAR_COLS = "year:i n:i gross_on:f4 net_on:f4 win_pct:f total_bps:f3 d2_net:f4"


@register("forward_returns", "SC24 W11", "trade_date:d symbol on_bps:f4 d2_bps:f4", PREP + ", out AS (SELECT * FROM fwd)")
def forward_returns(spark, sf):
    return ev.add_forward_returns(src.load_eod(td.eod_panel(spark, sf)))


@register("prepared_rows", "F18 J2", "trade_date:d symbol yr:i up:b on_bps:f4", PREP + ", out AS (SELECT * FROM prep)")
def prepared_rows(spark, sf):
    return ev.prepare(B.eod(spark, sf), B.index(spark, sf), LOOSE)


@register("evaluate_gated", "E4 A4", YEAR_COLS, PREP + ", out AS " + YEARS.format(src="sel"))
def evaluate_gated(spark, sf):
    return ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE)


@register("evaluate_ungated", "E4 A4", YEAR_COLS, PREP + f", un AS (SELECT * FROM prep WHERE {SIGNAL}), out AS "
          + YEARS.format(src="un"))
def evaluate_ungated(spark, sf):
    return ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE, gated=False)


TOP = PREP + ", " + score_sql("sel", "sc", "") + """,
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS r FROM sc) WHERE r <= 2)"""


@register("top_per_session", "T1", "trade_date:d symbol score:f", TOP + ", out AS (SELECT * FROM tops)")
def top_per_session(spark, sf):
    return ev.select_signals(ev.prepare(B.eod(spark, sf), B.index(spark, sf), LOOSE), LOOSE, True, 2)


@register("evaluate_top2", "E4 A4 A5 T1", YEAR_COLS, TOP + ", out AS " + YEARS.format(src="tops"))
def evaluate_top2(spark, sf):
    return ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE, top_n=2)


@register("evaluation_total", "A5", "n:i net_on:f4", PREP + ", yrs AS " + YEARS.format(src="sel") + """,
out AS (SELECT sum(n) AS n, sum(n * net_on) / sum(n) AS net_on FROM yrs)""")
def evaluation_total(spark, sf):
    return ev.weighted_total(ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE))


REF = PANEL + """,
r0 AS (SELECT e.*, close_val / pv - 1 AS idx_ret, lag(close_price) OVER w AS pc FROM eod e
  LEFT JOIN (SELECT trade_date, close_val, lag(close_val) OVER (ORDER BY trade_date) AS pv FROM idx) USING (trade_date)
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
r1 AS (SELECT *, close_price / pc - 1 - idx_ret AS rs_d,
  greatest(high_price - low_price, abs(high_price - pc), abs(low_price - pc)) AS tr FROM r0),
ref AS (SELECT r1.symbol, trade_date, coalesce(s.sector, '_' || r1.symbol) AS sector, close_price AS ref_close, pc AS prev_close,
    turnover_lacs, high_price AS pdh, low_price AS pdl,
    CASE WHEN count(*) OVER c20 = 20 THEN quantile_cont(CAST(ttl_trd_qnty AS DOUBLE), 0.5) OVER c20 END AS vol_med20,
    CASE WHEN count(tr) OVER c14 = 14 THEN avg(tr) OVER c14 END AS atr14,
    CASE WHEN count(deliv_per) OVER c3 = 3 THEN avg(deliv_per) OVER c3 END AS deliv_trail,
    CASE WHEN count(deliv_per) OVER p3 = 3 THEN avg(deliv_per) OVER p3 END AS deliv_trail_prior,
    CASE WHEN count(rs_d) OVER c9 = 9 THEN sum(rs_d) OVER c9 END AS rs_cum9,
    CASE WHEN count(rs_d) OVER p9 = 9 THEN sum(rs_d) OVER p9 END AS rs_cum9_prior
  FROM r1 LEFT JOIN sectors s USING (symbol)
  WINDOW c20 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    c14 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
    c3 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    p3 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    c9 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
    p9 AS (PARTITION BY r1.symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))"""


@register("live_reference", "MT9 W7", "symbol trade_date:d sector ref_close:r prev_close:r vol_med20:f atr14:f deliv_trail:f "
          "deliv_trail_prior:f rs_cum9:f rs_cum9_prior:f pdh:r pdl:r", REF + ", out AS (SELECT * FROM ref WHERE turnover_lacs >= 4)")
def live_reference(spark, sf):
    from ..operators.boards import reference_table
    return reference_table(B.eod(spark, sf), B.index(spark, sf), B.sectors(spark, sf), LOOSE)


@register("trigger_universe", "A33 T5", "symbol atr_pct:f turn_cr:f", REF + """,
u AS (SELECT symbol, 100 * atr14 / ref_close AS atr_pct, vol_med20 * ref_close / 10000000 AS turn_cr FROM ref
  WHERE trade_date = (SELECT max(trade_date) FROM eod) AND atr14 IS NOT NULL AND vol_med20 IS NOT NULL),
out AS (SELECT * FROM u WHERE turn_cr >= 0.05 ORDER BY atr_pct DESC, symbol LIMIT 15)""")
def trigger_universe(spark, sf):
    return sel.trigger_universe(_last_reference(spark, sf), 15, 0.05)


@register("trigger_universe_fallback", "A33 T5", "symbol atr_pct:f turn_cr:f", REF + """,
u AS (SELECT symbol, 100 * atr14 / ref_close AS atr_pct, vol_med20 * ref_close / 10000000 AS turn_cr FROM ref
  WHERE trade_date = (SELECT max(trade_date) FROM eod) AND atr14 IS NOT NULL AND vol_med20 IS NOT NULL),
out AS (SELECT * FROM (SELECT * FROM u ORDER BY turn_cr DESC, symbol LIMIT 7) ORDER BY atr_pct DESC, symbol)""")
def trigger_universe_fallback(spark, sf):
    return sel.trigger_universe(_last_reference(spark, sf), 7, 1e12)


def _last_reference(spark, sf):
    from ..operators.boards import reference_table
    ref = reference_table(B.eod(spark, sf), B.index(spark, sf), B.sectors(spark, sf), None)
    newest = B.eod(spark, sf).agg(F.max("trade_date").alias("trade_date"))
    return ref.join(newest, "trade_date", "left_semi")
