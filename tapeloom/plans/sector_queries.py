"""Sector engine, regime posture, tilt statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import regime as rg
from ..operators import sector as se
from ..operators import tilt_stats as ts
from ..session import stage
from ..sources import panel as src
from ..sources import testdata as td
from . import base as B
from .base import LOOSE, PANEL, REGIME, SIGNAL, TILT, pct_rank_sql
from .panel_queries import PREP
from .spec import register


def compound_sql(x: str, n: int, part: str = "") -> str:
    over = f"({part} ORDER BY trade_date"
    return (f"CASE WHEN {x} IS NOT NULL AND lag({x}, {n}) OVER {over}) IS NOT NULL THEN "
            f"(exp(sum(ln(1 + {x} / 100)) OVER {over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) - 1) * 100 END")


SECTOR = PANEL + """,
mem AS (SELECT p.*, s.sector FROM panel p JOIN sectors s USING (symbol) WHERE series IN ('EQ', 'SM', 'ST') AND s.sector NOT IN ('ETF', 'Others')),
lagged AS (SELECT *, lag(turnover_lacs) OVER (PARTITION BY symbol ORDER BY trade_date) AS w_lag,
  (close_price - prev_close) / nullif(prev_close, 0) * 100 AS raw FROM mem),
spanel AS (SELECT trade_date, sector, sum(turnover_lacs * deliv_per / 100) / 100 AS daily_dv_cr,
  sum(w_lag * least(greatest(raw, -200), 200)) / nullif(sum(CASE WHEN raw IS NOT NULL THEN w_lag END), 0) AS wtd_ret_pct
  FROM lagged WHERE w_lag >= 1 AND abs(raw) < 1000 GROUP BY 1, 2),
liq AS (SELECT trade_date, sector, count(*) AS n_liq FROM lagged WHERE w_lag >= 1 GROUP BY 1, 2),
fac0 AS (SELECT *, """ + compound_sql("wtd_ret_pct", 3, "PARTITION BY sector") + """ AS mom_2w,
  """ + compound_sql("wtd_ret_pct", 2, "PARTITION BY sector") + """ AS mom_1w,
  avg(daily_dv_cr) OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS dvb,
  avg(daily_dv_cr) OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dvf,
  count(*) OVER (PARTITION BY sector ORDER BY trade_date RANGE BETWEEN INTERVAL 398 DAYS PRECEDING AND CURRENT ROW) AS seq FROM spanel),
fac AS (SELECT *, dvf / CASE WHEN dvb > 0 THEN dvb END AS dv5d FROM fac0 WHERE seq >= 6)"""

BREADTH = """,
slots AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS slot FROM (SELECT DISTINCT trade_date FROM mem)),
dp AS (SELECT symbol, sector, trade_date, deliv_per AS y, turnover_lacs, slot FROM mem JOIN slots USING (trade_date)),
hist AS (SELECT a.symbol, a.slot, count(b.y) AS hn, avg(b.y) AS base, median(b.y) AS med, list(b.y) AS hl
  FROM dp a JOIN dp b ON a.symbol = b.symbol AND b.slot BETWEEN a.slot - 12 AND a.slot - 1 GROUP BY 1, 2),
flow AS (SELECT a.symbol, a.slot, avg(b.y) AS fl FROM dp a JOIN dp b ON a.symbol = b.symbol AND b.slot BETWEEN a.slot - 2 AND a.slot GROUP BY 1, 2),
tr0 AS (SELECT a.symbol, a.slot, b.y, (b.slot - a.slot + 4) - CAST(2 AS DOUBLE) AS xd, avg(b.y) OVER (PARTITION BY a.symbol, a.slot) AS ym
  FROM dp a JOIN dp b ON a.symbol = b.symbol AND b.slot BETWEEN a.slot - 4 AND a.slot),
tr AS (SELECT symbol, slot, (sum(y * xd) - any_value(ym) * sum(xd)) / 10 AS sl FROM tr0 GROUP BY 1, 2),
ds0 AS (SELECT dp.*, fl / nullif(base, 0) AS ratio5, CASE WHEN dp.slot >= 5 THEN sl / nullif(med, 0) END AS sl, med, hn,
  len(list_filter(hl, lambda v: v = med)) * 2 > hn AS pinned
  FROM dp JOIN hist USING (symbol, slot) JOIN flow USING (symbol, slot) JOIN tr USING (symbol, slot) WHERE hn >= 6),
ds AS (SELECT *, CASE WHEN abs(sl) > 1e-12 THEN sl ELSE 0 END AS slope FROM ds0 WHERE turnover_lacs >= 1 AND ratio5 IS NOT NULL AND NOT pinned),
dstate AS (SELECT *, CASE WHEN ratio5 > 1.05::DOUBLE AND slope > 0 THEN 1 ELSE 0 END AS accum FROM ds),
brd AS (SELECT trade_date, sector, avg(accum) AS accum_breadth, median(slope) AS deliv_slope, count(*) AS n_names FROM dstate GROUP BY 1, 2 HAVING count(*) >= 3)"""

PERS = """,
ps0 AS (SELECT trade_date, sector, row_number() OVER () AS one, wtd_ret_pct FROM spanel),
pslot AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS slot FROM (SELECT DISTINCT trade_date FROM spanel)),
pc AS (SELECT sector, trade_date, slot, sum(ln(1 + wtd_ret_pct / 100)) OVER (PARTITION BY sector ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cr
  FROM ps0 JOIN pslot USING (trade_date)),
pf AS (SELECT a.sector, a.trade_date, a.slot, (exp(b.cr - a.cr) - 1) * 100 AS fwd FROM pc a LEFT JOIN pc b ON a.sector = b.sector AND b.slot = a.slot + 3),
pe AS (SELECT *, fwd - median(fwd) OVER (PARTITION BY trade_date) AS edge FROM pf),
pers AS (SELECT a.trade_date, a.sector, avg(b.edge) AS persistence, count(b.edge) AS pers_n FROM pe a JOIN pe b ON a.sector = b.sector
  AND b.trade_date > a.trade_date - 900 AND b.slot <= a.slot - 3 GROUP BY 1, 2 HAVING count(b.edge) >= 8)"""

REG = """,
ema0 AS (SELECT trade_date, close_val, nret, row_number() OVER (ORDER BY trade_date) AS rn, count(*) OVER () AS nn FROM nifty),
emas AS (
  WITH RECURSIVE r AS (
    SELECT rn, close_val AS e20, close_val AS e50 FROM ema0 WHERE rn = 1
    UNION ALL SELECT e.rn, 2 / CAST(21 AS DOUBLE) * close_val + (1 - 2 / CAST(21 AS DOUBLE)) * e20,
      2 / CAST(51 AS DOUBLE) * close_val + (1 - 2 / CAST(51 AS DOUBLE)) * e50 FROM r JOIN ema0 e ON e.rn = r.rn + 1)
  SELECT * FROM r),
rg0 AS (SELECT e.*, e20, e50, CASE WHEN count(nret) OVER v = 6 THEN stddev_samp(nret / 100) OVER v END AS vol20,
  """ + compound_sql("nret", 2) + " AS ret_s, " + compound_sql("nret", 6) + " AS ret_m, " + compound_sql("nret", 12) + """ AS ret_t,
  abs(close_val - lag(close_val) OVER o) AS diff, abs(close_val - lag(close_val, 8) OVER o) AS net8, e20 - lag(e20, 3) OVER o AS slope
  FROM ema0 e JOIN emas USING (rn) WINDOW o AS (ORDER BY trade_date), v AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT *, net8 / nullif(CASE WHEN count(diff) OVER w8 = 8 THEN sum(diff) OVER w8 END, 0) AS er,
  (SELECT count(*) FROM rg0 h WHERE h.rn <= g.rn AND h.vol20 <= g.vol20) / CAST(rn AS DOUBLE) AS vp
  FROM rg0 g WINDOW w8 AS (ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
rg2 AS (SELECT *, CASE WHEN close_val < e20 AND e20 < e50 THEN 'DOWN' WHEN vol20 IS NOT NULL AND vp >= 0.8 THEN 'HIGH_VOL'
  WHEN close_val > e20 AND e20 > e50 THEN 'UP' ELSE 'CHOP' END AS lab FROM rg1),
deb AS (
  WITH RECURSIVE r AS (
    SELECT rn, lab AS pending, 1 AS cnt, lab AS conf FROM rg2 WHERE rn = 1
    UNION ALL SELECT g.rn, g.lab, CASE WHEN g.lab = r.pending THEN r.cnt + 1 ELSE 1 END,
      CASE WHEN CASE WHEN g.lab = r.pending THEN r.cnt + 1 ELSE 1 END >= 3 THEN g.lab ELSE r.conf END
      FROM r JOIN rg2 g ON g.rn = r.rn + 1)
  SELECT * FROM r),
rg3 AS (SELECT *, CASE WHEN coalesce(ret_s <= -3 AND ret_m > 0, FALSE) THEN 'REVERSAL' ELSE conf END AS st,
  coalesce(ret_t > 0 AND slope > 0, FALSE) AS mu, coalesce(ret_t < 0 AND slope < 0, FALSE) AS md, coalesce(ret_s > 0, FALSE) AS su,
  CASE WHEN er >= 0.5 THEN 'strong' WHEN er < 0.3 THEN 'choppy' ELSE 'moderate' END AS strength FROM rg2 JOIN deb USING (rn)),
rg4 AS (SELECT *, CASE WHEN su AND md THEN 'BULLTRAP' WHEN NOT su AND mu THEN 'DIP_IN_UP' WHEN su AND mu THEN 'ALIGNED_UP'
    WHEN NOT su AND md THEN 'ALIGNED_DN' ELSE 'MIXED' END AS dv, st IN ('UP', 'HIGH_VOL') AS act0,
  CASE st WHEN 'REVERSAL' THEN 0.4 WHEN 'DOWN' THEN 0.5 WHEN 'HIGH_VOL' THEN 1 WHEN 'UP' THEN 1 ELSE 0.7 END AS m0,
  CASE st WHEN 'REVERSAL' THEN 0.3 WHEN 'DOWN' THEN 0.4 WHEN 'HIGH_VOL' THEN 0.75 WHEN 'UP' THEN 1 ELSE 0.5 END
    * CASE WHEN st IN ('UP', 'HIGH_VOL') THEN CASE strength WHEN 'strong' THEN 1 WHEN 'moderate' THEN 0.9 ELSE 0.8 END ELSE 1 END AS s0 FROM rg3),
rg5 AS (SELECT *, act0 AND dv <> 'BULLTRAP' AS act, CASE WHEN dv = 'BULLTRAP' THEN m0 * 0.7 ELSE m0 END AS m1,
  CASE WHEN dv = 'BULLTRAP' THEN least(s0, 0.5) ELSE s0 END AS s1 FROM rg4),
rg6 AS (SELECT *, dv = 'ALIGNED_DN' AND NOT act AS aln, rn < 20 OR nn < 20 AS cold FROM rg5),
reg AS (SELECT trade_date, CASE WHEN cold THEN 'UNKNOWN' WHEN st = 'UP' THEN 'TRENDING_UP' WHEN st = 'DOWN' THEN 'TRENDING_DOWN'
    WHEN st = 'CHOP' THEN 'CHOPPY' ELSE st END AS reg_state,
  CASE WHEN NOT cold AND act THEN 'ACT' ELSE 'SELECTIVE' END AS reg_verdict,
  CASE WHEN cold THEN 0.5 ELSE round_even(CAST(CASE WHEN aln THEN least(s1, 0.3) ELSE s1 END AS DOUBLE), 2) END AS reg_size_hint,
  CASE WHEN cold THEN 1 WHEN aln THEN least(m1, 0.5) ELSE m1 END AS reg_conf_mult, CASE WHEN cold THEN 'n/a' ELSE dv END AS reg_divergence,
  CASE WHEN cold THEN 'UNKNOWN' WHEN mu THEN 'UP' WHEN md THEN 'DOWN' ELSE 'FLAT' END AS reg_med_trend,
  CASE WHEN cold THEN 'moderate' ELSE strength END AS reg_trend_strength, CASE WHEN NOT cold THEN er END AS reg_er20 FROM rg6)"""

TILT_SQL = SECTOR + BREADTH + PERS + REG + """,
imom AS (SELECT trade_date, """ + compound_sql("nret", 3) + " AS n2, " + compound_sql("nret", 2) + """ AS n1 FROM nifty),
t0 AS (SELECT f.trade_date, f.sector, mom_2w - n2 AS rs_2w, mom_1w - n1 AS rs_1w, dv5d, accum_breadth, deliv_slope, n_liq, n_liq < 3 AS thin,
    persistence, coalesce(persistence < 0, FALSE) AS revert, count(*) OVER (PARTITION BY f.trade_date) AS n_sectors, r.* EXCLUDE (trade_date)
  FROM fac f ASOF LEFT JOIN imom i ON f.trade_date >= i.trade_date ASOF LEFT JOIN reg r ON f.trade_date >= r.trade_date
  LEFT JOIN brd b ON b.trade_date = f.trade_date AND b.sector = f.sector LEFT JOIN pers p ON p.trade_date = f.trade_date AND p.sector = f.sector
  LEFT JOIN liq l ON l.trade_date = f.trade_date AND l.sector = f.sector),
t1 AS (SELECT *, """ + f"{pct_rank_sql('rs_2w', 'trade_date')} AS r2, {pct_rank_sql('rs_1w', 'trade_date')} AS r1, {pct_rank_sql('dv5d', 'trade_date')} AS rd" + """,
  stddev_samp(rs_2w) OVER (PARTITION BY trade_date) AS dispersion FROM t0),
t2 AS (SELECT *, round(0.6::DOUBLE * r2 + 0.25::DOUBLE * r1 + 0.15::DOUBLE * rd, 12) AS score FROM t1),
t3 AS (SELECT *, """ + pct_rank_sql("score", "trade_date") + """ AS rank, CASE WHEN score IS NOT NULL THEN
  rank() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST) END AS rank_pos, rd - r2 AS divergence FROM t2),
tilt AS (SELECT * EXCLUDE (reg_verdict, reg_size_hint), CASE WHEN rank IS NULL THEN NULL WHEN coalesce(accum_breadth, 0) >= 0.55 AND rank <= 0.35 THEN 'WATCH'
    WHEN rank >= 0.75 THEN CASE WHEN thin OR revert THEN 'NEUTRAL' ELSE 'OVERWEIGHT' END WHEN rank <= 0.25 THEN 'UNDERWEIGHT' ELSE 'NEUTRAL' END AS tilt,
  round_even((rank - 0.5) * 290 * coalesce(reg_conf_mult, 1), 0) AS est_rel_bps,
  round_even(CAST(coalesce(reg_conf_mult, 1) * CASE WHEN thin THEN 0.5 ELSE 1 END * CASE WHEN revert THEN 0.6 ELSE 1 END AS DOUBLE), 2) AS confidence,
  CASE WHEN coalesce(dispersion < 60, FALSE) AND reg_verdict = 'ACT' THEN 'SELECTIVE' ELSE reg_verdict END AS reg_verdict,
  CASE WHEN coalesce(dispersion < 60, FALSE) THEN round_even(CAST(reg_size_hint * 0.5 AS DOUBLE), 2) ELSE reg_size_hint END AS reg_size_hint
  FROM t3 WHERE n_sectors >= 6)"""
TILT_COLS = ("trade_date:d sector score:f rank:f rank_pos:i n_sectors:i tilt rs_2w:f4 rs_1w:f4 dv5d:f accum_breadth:f deliv_slope:f n_liq:i "
             "thin:b divergence:f persistence:f4 revert:b est_rel_bps:f confidence:f reg_state reg_verdict reg_size_hint:f reg_conf_mult:f "
             "reg_divergence reg_med_trend reg_trend_strength reg_er20:f dispersion:f4")


def _inputs(spark, sf, end=None):
    return B.panel(spark, sf, None, end), td.sector_dim(spark, sf), B.nifty(spark, sf, end)


@register("sector_day_aggregate", "A1 SC25 J7", "trade_date:d sector daily_dv_cr:f wtd_ret_pct:f", SECTOR + ", out AS (SELECT * FROM spanel)")
def sector_day_aggregate(spark, sf):
    d, m, _ = _inputs(spark, sf)
    return se.sector_panel(d, m, TILT).where("n_ret > 0")


@register("sector_liquid_counts", "A2", "trade_date:d sector n_liq:i", SECTOR + ", out AS (SELECT * FROM liq)")
def sector_liquid_counts(spark, sf):
    d, m, _ = _inputs(spark, sf)
    return se.sector_panel(d, m, TILT)


@register("sector_factors", "W15 W16 W17 F16", "trade_date:d sector mom_2w:f4 mom_1w:f4 dv5d:f", SECTOR + ", out AS (SELECT * FROM fac)")
def sector_factors(spark, sf):
    d, m, _ = _inputs(spark, sf)
    return se.sector_factors(se.sector_panel(d, m, TILT), TILT)


def _deliv(spark, sf):
    d, m, _ = _inputs(spark, sf)
    return src.deliv_panel(d, m, TILT.series, TILT.exclude)


@register("delivery_state", "W18 W19 W20 W21", "trade_date:d symbol ratio5:f slope:f accum:f", SECTOR + BREADTH + ", out AS (SELECT * FROM dstate)")
def delivery_state(spark, sf):
    return se.delivery_state(_deliv(spark, sf), TILT)


@register("sector_breadth", "A3", "trade_date:d sector accum_breadth:f deliv_slope:f n_names:i", SECTOR + BREADTH + ", out AS (SELECT * FROM brd)")
def sector_breadth(spark, sf):
    return se.breadth(se.delivery_state(_deliv(spark, sf), TILT), TILT)


@register("sector_persistence", "W22", "trade_date:d sector persistence:f4 pers_n:i", SECTOR + PERS + ", out AS (SELECT * FROM pers)")
def sector_persistence(spark, sf):
    d, m, _ = _inputs(spark, sf)
    return se.persistence(se.sector_panel(d, m, TILT), TILT)


@register("regime_history", "W23 W24 W25 W26 W29 SC44", "trade_date:d reg_state reg_verdict reg_size_hint:f reg_conf_mult:f reg_divergence reg_med_trend "
          "reg_trend_strength reg_er20:f", PANEL + REG + ", out AS (SELECT * FROM reg)")
def regime_history(spark, sf):
    return rg.regime_history(B.nifty(spark, sf), REGIME)


@register("index_ema", "W23 P8", "trade_date:d e20:f e50:f", PANEL + REG + ", out AS (SELECT trade_date, e20, e50 FROM rg0)")
def index_ema(spark, sf):
    from ..functions.scans import with_ema
    return with_ema(with_ema(B.nifty(spark, sf), "close_val", "e20", 20), "close_val", "e50", 50)


@register("sector_tilt", "E5 W27 A35 SC45 SC46 J8 J9", TILT_COLS, TILT_SQL + ", out AS (SELECT * FROM tilt)")
def sector_tilt(spark, sf):
    return _tilt(spark, sf)


def _tilt(spark, sf):
    d, m, n = _inputs(spark, sf)
    return se.sector_tilt(d, m, n, None, None, TILT, REGIME)


@register("sector_tilt_asof", "E5", TILT_COLS, TILT_SQL + ", out AS (SELECT * FROM tilt WHERE trade_date = DATE '2000-05-01')")
def sector_tilt_asof(spark, sf):
    d, m, n = _inputs(spark, sf, "2000-05-01")
    return se.sector_tilt_asof(d, m, n, "2000-05-01", TILT, REGIME)


BADGED = TILT_SQL + """,
ti AS (SELECT *, dense_rank() OVER (ORDER BY trade_date) AS slot FROM tilt),
tj AS (SELECT *, CASE WHEN lag(tilt) OVER w = tilt AND lag(slot) OVER w = slot - 1 THEN 0 ELSE 1 END AS brk FROM ti
  WINDOW w AS (PARTITION BY sector ORDER BY slot)),
tk AS (SELECT *, sum(brk) OVER (PARTITION BY sector ORDER BY slot) AS run FROM tj),
ten AS (SELECT *, CASE WHEN tilt IN ('OVERWEIGHT', 'UNDERWEIGHT') THEN row_number() OVER (PARTITION BY sector, run ORDER BY slot) ELSE 0 END AS days_in_tilt FROM tk)"""


@register("tilt_tenure", "W28", "trade_date:d sector tilt days_in_tilt:i", BADGED + ", out AS (SELECT * FROM ten)")
def tilt_tenure(spark, sf):
    return se.tenure(_tilt(spark, sf))


@register("tilt_badge", "SC37 J17", "trade_date:d symbol sector badge", BADGED + """,
out AS (SELECT e.trade_date, e.symbol, coalesce(s.sector, '_' || e.symbol) AS sector,
  CASE WHEN tilt IS NULL THEN '— sector not ranked' ELSE concat(CASE tilt WHEN 'OVERWEIGHT' THEN '🟢 OW' WHEN 'UNDERWEIGHT' THEN '🔴 UW' WHEN 'WATCH' THEN '👁 WATCH'
      ELSE '⚪ NEUTRAL' END, CASE WHEN rank_pos IS NOT NULL THEN printf(' #%d/%d', rank_pos, n_sectors) ELSE '' END,
    CASE WHEN days_in_tilt >= 90 THEN ' · Days → 90+' WHEN days_in_tilt > 1 THEN ' · Days → ' || days_in_tilt WHEN days_in_tilt = 1 THEN ' · Days → 1 NEW' ELSE '' END,
    CASE WHEN tilt IN ('OVERWEIGHT', 'UNDERWEIGHT') THEN CASE WHEN tilt = 'OVERWEIGHT' THEN ' · with your LONG' ELSE ' · against your LONG' END ELSE '' END,
    CASE WHEN thin THEN '  ⚠thin(' || n_liq || ')' ELSE '' END) END AS badge
  FROM eod e LEFT JOIN sectors s USING (symbol) LEFT JOIN ten t ON t.trade_date = e.trade_date AND t.sector = coalesce(s.sector, '_' || e.symbol))""")
def tilt_badge(spark, sf):
    board = src.with_sector(B.eod(spark, sf).select("trade_date", "symbol"), B.sectors(spark, sf))
    ten = se.tenure(_tilt(spark, sf)).select("trade_date", "sector", "tilt", "rank_pos", "n_sectors", "days_in_tilt", "thin", "n_liq")
    return board.join(ten, ["trade_date", "sector"], "left").withColumn("badge", se.badge(F.lit("LONG")))


WIDE = "clr >= 0.3 AND deliv_trail >= 10 AND vol_ratio >= 0.3 AND ret >= -0.6 AND close_vs_vwap >= -0.5 AND rs_idx_cum > -50 AND turnover_lacs >= 1"
WIDE_P = dict(clr=0.3, deliv_trail=10.0, vol_ratio=0.3, ret=-0.6, close_vs_vwap=-0.5, rs_min=-50.0, liq_lacs=1.0)
STATS = PREP + TILT_SQL[len(PANEL):] + f"""
, night AS (SELECT trade_date, avg(on_bps) AS univ_on FROM prep WHERE turnover_lacs >= 1 GROUP BY 1),
tag AS (SELECT p.trade_date, p.symbol, yr, on_bps, d2_bps, on_bps - 22 AS net, univ_on, on_bps - univ_on AS excess, t.tilt
  FROM prep p LEFT JOIN sectors s USING (symbol) LEFT JOIN tilt t ON t.trade_date = p.trade_date AND t.sector = coalesce(s.sector, '_' || p.symbol)
  LEFT JOIN night n ON n.trade_date = p.trade_date WHERE {WIDE})"""


def _tagged(spark, sf):
    from dataclasses import replace
    p = replace(LOOSE, **WIDE_P)
    prep = ev.prepare(B.eod(spark, sf), B.index(spark, sf), LOOSE)
    sel = src.with_sector(ft.signals(prep, p), B.sectors(spark, sf))
    return ts.tagged_signals(sel.select("trade_date", "symbol", "sector", "yr", "on_bps", "d2_bps"), prep, _tilt(spark, sf), p)


@register("tilt_tagged_signals", "J14 J15 A8 E6", "trade_date:d symbol tilt net:f3 univ_on:f3 excess:f3", STATS + ", out AS (SELECT * FROM tag)")
def tilt_tagged_signals(spark, sf):
    return _tagged(spark, sf)


@register("tilt_bucket_table", "A6 E6", "tilt n:i gross_on:f3 net_on:f3 win_pct:f t_vs_0:f d2_net:f3", STATS + """,
out AS (SELECT tilt, count(*) AS n, avg(on_bps) AS gross_on, avg(net) AS net_on, 100 * avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS win_pct,
  CASE WHEN count(*) > 5 AND stddev_samp(net) > 0 THEN avg(net) / (stddev_samp(net) / sqrt(count(*))) END AS t_vs_0, avg(d2_bps - 6) AS d2_net
  FROM tag WHERE tilt IS NOT NULL GROUP BY 1)""")
def tilt_bucket_table(spark, sf):
    return ts.bucket_table(_tagged(spark, sf))


YR = """,
yr AS (SELECT yr AS year, count(*) FILTER (tilt = 'OVERWEIGHT') AS n_ow, count(*) FILTER (tilt = 'UNDERWEIGHT') AS n_uw,
  avg(net) FILTER (tilt = 'OVERWEIGHT') AS ow_net, avg(net) FILTER (tilt = 'UNDERWEIGHT') AS uw_net FROM tag GROUP BY 1),
yrw AS (SELECT *, CASE WHEN n_ow >= 5 AND n_uw >= 5 THEN ow_net > uw_net END AS ow_wins FROM yr)"""


@register("tilt_years", "A7", "year:i n_ow:i n_uw:i ow_net:f3 uw_net:f3 ow_wins:b", STATS + YR + ", out AS (SELECT * FROM yrw)")
def tilt_years(spark, sf):
    return ts.per_year(_tagged(spark, sf))


def welch_sql() -> str:
    out = []
    for name, x in (("on", "on_bps"), ("d2", "d2_bps"), ("night", "univ_on"), ("xs", "excess")):
        a, b = f"FILTER (tilt = 'OVERWEIGHT')", f"FILTER (tilt = 'UNDERWEIGHT')"
        diff = f"avg({x}) {a} - avg({x}) {b}"
        se2 = f"(var_samp({x}) {a} / count({x}) {a} + var_samp({x}) {b} / count({x}) {b})"
        out.append(f"{diff} AS diff_{name}, CASE WHEN count({x}) {a} >= 5 AND count({x}) {b} >= 5 AND {se2} > 0 THEN ({diff}) / sqrt({se2}) END AS t_{name}")
    return ", ".join(out)


WELCH = STATS + f""",
wel AS (SELECT count(*) AS n_signals, count(*) FILTER (tilt IS NULL) AS unmatched, {welch_sql()},
  count(DISTINCT trade_date) FILTER (tilt = 'OVERWEIGHT') AS nights_ow, count(DISTINCT trade_date) FILTER (tilt = 'UNDERWEIGHT') AS nights_uw FROM tag)"""


@register("tilt_welch", "A9 E6", "n_signals:i unmatched:i diff_on:f3 t_on:f diff_d2:f3 t_d2:f diff_night:f3 t_night:f diff_xs:f3 t_xs:f nights_ow:i nights_uw:i",
          WELCH + ", out AS (SELECT * FROM wel)")
def tilt_welch(spark, sf):
    return ts.welch_table(_tagged(spark, sf))


@register("tilt_cluster_t", "A10", "t_clustered:f beta:f3 n_nights:i", STATS + """,
sub AS (SELECT *, CASE WHEN tilt = 'OVERWEIGHT' THEN 1 ELSE 0 END AS x FROM tag WHERE tilt IN ('OVERWEIGHT', 'UNDERWEIGHT')),
res AS (SELECT *, on_bps - avg(on_bps) OVER (PARTITION BY x) AS e FROM sub),
sc AS (SELECT trade_date, sum(e) AS s0, sum(e * x) AS s1 FROM res GROUP BY 1),
mt AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*) AS n_nights FROM sc),
k AS (SELECT count(*) AS n, sum(x) AS k, avg(on_bps) FILTER (x = 1) - avg(on_bps) FILTER (x = 0) AS beta FROM sub),
v AS (SELECT *, (k * k * m00 - 2 * k * n * m01 + n * n * m11) / CAST((n * k - k * k) AS DOUBLE) / (n * k - k * k) AS var FROM mt, k),
out AS (SELECT CASE WHEN n > 20 AND n_nights > 5 THEN beta / sqrt(var) END AS t_clustered, CASE WHEN n > 20 AND n_nights > 5 THEN beta END AS beta, n_nights FROM v)""")
def tilt_cluster_t(spark, sf):
    return ts.cluster_t(_tagged(spark, sf))


@register("tilt_paired_t", "A11 J16", "n_pair:i diff_paired:f3 t_paired:f", STATS + """,
pr AS (SELECT trade_date, avg(on_bps) FILTER (tilt = 'OVERWEIGHT') - avg(on_bps) FILTER (tilt = 'UNDERWEIGHT') AS d FROM tag GROUP BY 1),
out AS (SELECT count(d) AS n_pair, CASE WHEN count(d) > 2 THEN avg(d) END AS diff_paired,
  CASE WHEN count(d) > 2 THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) END AS t_paired FROM pr)""")
def tilt_paired_t(spark, sf):
    return ts.paired_t(_tagged(spark, sf))


@register("tilt_decision", "A12", "diff_on:f3 t_on:f yrs_ow_wins:i yrs_tested:i verdict", WELCH + YR + """,
out AS (SELECT diff_on, t_on, (SELECT count(*) FROM yrw WHERE ow_wins) AS yrs_ow_wins, (SELECT count(ow_wins) FROM yrw) AS yrs_tested,
  CASE WHEN coalesce(diff_on > 0 AND abs(t_on) >= 2 AND (SELECT count(*) FROM yrw WHERE ow_wins) >= 5, FALSE) THEN 'WIRE AS GATE' ELSE 'DISPLAY-ONLY' END AS verdict FROM wel)""")
def tilt_decision(spark, sf):
    tagged = stage(_tagged(spark, sf))
    return ts.decide(ts.welch_table(tagged), ts.per_year(tagged))
