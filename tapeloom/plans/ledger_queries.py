"""Ledger, calibration, basis, positioning, delivery."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import basis as bs
from ..operators import delivery as dl
from ..operators import evaluation as ev
from ..operators import ledger as lg
from ..operators import positioning as ps
from ..params import Basis, Delivery
from ..session import stage
from ..sources import panel as src
from ..sources import testdata as td
from . import base as B
from .base import LOOSE, PANEL
from .panel_queries import PREP, SCREEN_SQL, YEARS, screen_all_sessions
from .spec import register

LEDGER_COLS = ("date:d symbol entry_px:r clr:f deliv_per:f vol_ratio:f score:f exit_date:d exit_px:r gross_bps:f "
               "net_bps:f status")
BOOKED = SCREEN_SQL.replace("out AS (SELECT b.*", "booked AS (SELECT b.*") + """,
picks AS (SELECT trade_date AS date, symbol, close_price AS entry_px, clr, deliv_per, vol_ratio, score,
  CAST(NULL AS DATE) AS exit_date, CAST(NULL AS DOUBLE) AS exit_px, CAST(NULL AS DOUBLE) AS gross_bps,
  CAST(NULL AS DOUBLE) AS net_bps, 'OPEN' AS status FROM booked WHERE risk_on)"""


def reconcile_sql(src_name: str, dst: str) -> str:
    return f"""{dst} AS (
  SELECT l.date, l.symbol, l.entry_px, l.clr, l.deliv_per, l.vol_ratio, l.score,
    CASE WHEN hit THEN e.trade_date ELSE l.exit_date END AS exit_date,
    CASE WHEN hit THEN e.open_price ELSE l.exit_px END AS exit_px,
    CASE WHEN hit THEN round_even((e.open_price / l.entry_px - 1) * 10000, 1) ELSE l.gross_bps END AS gross_bps,
    CASE WHEN hit THEN round_even((e.open_price / l.entry_px - 1) * 10000 - 22, 1) ELSE l.net_bps END AS net_bps,
    CASE WHEN hit THEN 'CLOSED' ELSE l.status END AS status
  FROM {src_name} l ASOF LEFT JOIN eod e ON l.symbol = e.symbol AND l.date < e.trade_date,
    LATERAL (SELECT l.status = 'OPEN' AND e.open_price IS NOT NULL AS hit))"""


CLOSED = BOOKED + ", " + reconcile_sql("picks", "led")


def _picks(spark, sf):
    return lg.picks(_book(spark, sf))


def _book(spark, sf):
    from ..operators import screen as scr
    return scr.screen(B.features(spark, sf), B.index(spark, sf), B.calendar(spark, sf), B.sectors(spark, sf), None, LOOSE)


def _closed(spark, sf):
    return lg.reconcile(_picks(spark, sf), B.eod(spark, sf), LOOSE)


@register("ledger_emit", "E10 SRC13", LEDGER_COLS, BOOKED + ", out AS (SELECT * FROM picks)")
def ledger_emit(spark, sf):
    return _picks(spark, sf)


@register("ledger_upsert", "J13", LEDGER_COLS, BOOKED + ", " + reconcile_sql("(SELECT * FROM picks WHERE date < DATE '2000-01-01')", "olda") + """,
old AS (SELECT * FROM olda UNION ALL
  SELECT * REPLACE (entry_px * 1.01::DOUBLE AS entry_px) FROM picks WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'),
new AS (SELECT * REPLACE (entry_px + 1 AS entry_px) FROM picks WHERE date >= DATE '1999-06-01'),
out AS (
  SELECT o.* REPLACE (CASE WHEN o.status = 'OPEN' AND n.symbol IS NOT NULL THEN n.entry_px ELSE o.entry_px END AS entry_px)
  FROM old o LEFT JOIN new n ON o.date = n.date AND o.symbol = n.symbol
  UNION ALL SELECT n.* FROM new n ANTI JOIN old o ON o.date = n.date AND o.symbol = n.symbol)""")
def ledger_upsert(spark, sf):
    picks = stage(_picks(spark, sf))
    old = lg.reconcile(picks.where("date < '2000-01-01'"), B.eod(spark, sf), LOOSE).unionByName(
        picks.where("date BETWEEN '2000-01-01' AND '2000-06-30'").withColumn("entry_px", F.col("entry_px") * 1.01))
    new = picks.where("date >= '1999-06-01'").withColumn("entry_px", F.col("entry_px") + 1)
    return lg.upsert(old, new)


@register("ledger_reconcile", "A37 J11", LEDGER_COLS, CLOSED + ", out AS (SELECT * FROM led)")
def ledger_reconcile(spark, sf):
    return _closed(spark, sf)


@register("ledger_stale_opens", "A36", "date:d symbol n_stale:i", BOOKED + """,
out AS (SELECT date, symbol, count(*) OVER () AS n_stale FROM picks
  WHERE date < (SELECT max(trade_date) FROM panel WHERE series = 'EQ'))""")
def ledger_stale_opens(spark, sf):
    return lg.stale_opens(_picks(spark, sf), src.last_session(B.panel(spark, sf)))


@register("ledger_summary", "A19", "trades:i win:f mean_bps:f4 total_bps:f2 worst_bps:f2", CLOSED + """,
out AS (SELECT count(*) AS trades, avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS win, avg(net_bps) AS mean_bps,
  sum(net_bps) AS total_bps, min(net_bps) AS worst_bps FROM led WHERE status = 'CLOSED')""")
def ledger_summary(spark, sf):
    return lg.summary(_closed(spark, sf))


EQUITY = CLOSED + """,
eq0 AS (SELECT *, sum(net_bps) OVER (ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS equity FROM led WHERE status = 'CLOSED'),
eq AS (SELECT *, equity - max(equity) OVER (ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS drawdown FROM eq0)"""


@register("ledger_equity", "W33", "date:d symbol equity:f2 drawdown:f2", EQUITY + ", out AS (SELECT * FROM eq)")
def ledger_equity(spark, sf):
    return lg.equity(_closed(spark, sf))


@register("ledger_scorecard", "A20", "trades:i win_pct:f4 mean_bps:f4 total_bps:f2 max_dd:f2 sharpe:f worst_bps:f2", EQUITY + """,
out AS (SELECT count(*) AS trades, 100 * avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS win_pct, avg(net_bps) AS mean_bps,
  sum(net_bps) AS total_bps, min(drawdown) AS max_dd, CASE WHEN stddev_pop(net_bps) > 0
  THEN avg(net_bps) / stddev_pop(net_bps) * sqrt(252) ELSE 0 END AS sharpe, min(net_bps) AS worst_bps FROM eq)""")
def ledger_scorecard(spark, sf):
    return lg.scorecard(_closed(spark, sf))


@register("ledger_health", "A21", "n:i full_mean:f4 recent_mean:f4 recent_win:f4 verdict", CLOSED + """,
c AS (SELECT *, row_number() OVER (ORDER BY date DESC, symbol DESC) <= 20 AS rec FROM led WHERE status = 'CLOSED'),
h AS (SELECT count(*) AS n, avg(net_bps) AS full_mean, avg(net_bps) FILTER (rec) AS recent_mean,
  100 * avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) FILTER (rec) AS recent_win FROM c),
out AS (SELECT *, CASE WHEN n < 25 THEN 'accruing' WHEN recent_mean <= 0 OR (full_mean > 0 AND recent_mean < 0.4 * full_mean)
  THEN 'decay' ELSE 'intact' END AS verdict FROM h)""")
def ledger_health(spark, sf):
    return lg.health(_closed(spark, sf))


def _with_refs(led):
    k = (F.dayofyear("date") % 3 - 1) / 1000.0
    return led.withColumns({"ref_close": F.col("entry_px") * (1 + k), "ref_open": F.col("exit_px") * (1 - k)})


REFS = CLOSED + """,
refd AS (SELECT *, entry_px * (1 + (dayofyear(date) % 3 - 1) / CAST(1000 AS DOUBLE)) AS ref_close,
  exit_px * (1 - (dayofyear(date) % 3 - 1) / CAST(1000 AS DOUBLE)) AS ref_open FROM led),
cost AS (SELECT count(*) AS n_live_fills, coalesce(avg(slip), 0) AS slippage_bps, 22 + coalesce(avg(slip), 0) AS effective_cost_bps
  FROM (SELECT ((entry_px / ref_close - 1) + (ref_open / exit_px - 1)) * 10000 AS slip FROM refd
        WHERE status = 'CLOSED' AND (ref_close <> entry_px OR ref_open <> exit_px)))"""


@register("realized_cost", "A24 SC47", "n_live_fills:i slippage_bps:f effective_cost_bps:f", REFS + ", out AS (SELECT * FROM cost)")
def realized_cost(spark, sf):
    return lg.realized_cost(_with_refs(_closed(spark, sf)), LOOSE)


PRIOR = """yrs AS """ + YEARS.format(src="sel") + """,
pri AS (SELECT coalesce(quantile_cont(net_on, 0.5), 0) AS mu0, coalesce(sum(n * net_on) / sum(n), 0) AS mu0_mean,
  CASE WHEN count(*) = 0 THEN 30 ELSE greatest(stddev_pop(net_on), 8) END AS tau, coalesce(sum(n), 0) AS n0 FROM yrs)"""


@register("calibration_prior", "A22", "mu0:f4 mu0_mean:f4 tau:f4 n0:i", PREP + ", " + PRIOR + ", out AS (SELECT * FROM pri)")
def calibration_prior(spark, sf):
    return ev.prior(ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE))


FWD_PART = PREP[PREP.index("\n, fwd AS"):]


CALIBRATE_SQL = REFS + FWD_PART + ", " + PRIOR + """,
c AS (SELECT *, row_number() OVER (ORDER BY date DESC, symbol DESC) <= 20 AS rec FROM refd WHERE status = 'CLOSED' AND net_bps IS NOT NULL),
st AS (SELECT count(*) AS n_closed, avg(net_bps) AS m, stddev_samp(net_bps) AS s, avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS win,
  avg(net_bps) FILTER (rec) AS rec_m, coalesce(stddev_samp(net_bps) FILTER (rec) / sqrt(count(*) FILTER (rec)), 0) AS rec_se FROM c),
j AS (SELECT *, n_closed >= 10 AND s > 0 AS use, 1 / (1 / (tau * tau) + n_closed / (s * s)) AS var FROM st, pri, cost),
k AS (SELECT *, CASE WHEN use THEN var * (mu0 / (tau * tau) + m * n_closed / (s * s)) ELSE mu0 END - (effective_cost_bps - 22) AS posterior_net,
  CASE WHEN use THEN sqrt(var) ELSE tau END AS posterior_sd, coalesce(n_closed >= 25 AND rec_m + rec_se < 0, FALSE) AS decayed FROM j),
l AS (SELECT *, greatest(0.3, least(1, CASE WHEN mu0 > 0 THEN posterior_net / mu0 ELSE 0 END)) AS sized,
  posterior_net + posterior_sd < 0 AS dead FROM k),
out AS (SELECT *, round_even(CASE WHEN dead OR decayed THEN 0 WHEN n_closed < 10 THEN 0.3 WHEN n_closed < 40 THEN least(sized, 0.75)
    ELSE sized END, 2) AS size_multiplier,
  CASE WHEN dead THEN 'posterior negative' WHEN decayed THEN 'recent decay' WHEN n_closed < 10 THEN 'prior only'
    WHEN n_closed < 40 THEN 'forming' ELSE 'trusted' END AS trust FROM l)"""


@register("calibrate", "E10 A23 A25 SRC16", "mu0:f4 tau:f4 n_closed:i m:f4 s:f4 win:f posterior_net:f4 posterior_sd:f4 effective_cost_bps:f "
          "decayed:b size_multiplier:f trust", CALIBRATE_SQL)
def calibrate(spark, sf):
    led = stage(_with_refs(_closed(spark, sf)))
    prior = ev.prior(ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE))
    return lg.calibrate(led, prior, lg.realized_cost(led, LOOSE), LOOSE)


# --- basis ---------------------------------------------------------------------------------------
FUT = PANEL + """,
legs AS (SELECT trade_date, symbol, 1 + CAST(substr(symbol, 2) AS BIGINT) % 30 AS nd,
    lead(avg_price, 1) OVER w AS p1, lead(avg_price, 2) OVER w AS p2, lead(ttl_trd_qnty, 1) OVER w AS o1,
    lead(ttl_trd_qnty, 2) OVER w AS o2 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
fut AS (
  SELECT trade_date, symbol, CAST(date_trunc('quarter', trade_date) + INTERVAL 2 MONTH AS DATE) + CAST(nd AS INT) AS expiry_date, p1 AS close_price, o1 AS open_interest, 1 AS rn FROM legs WHERE p1 IS NOT NULL
  UNION ALL SELECT trade_date, symbol, CAST(date_trunc('quarter', trade_date) + INTERVAL 5 MONTH AS DATE) + CAST(nd AS INT), p2, o2, 2 FROM legs WHERE p2 IS NOT NULL),
ixfut AS (SELECT trade_date, 20 AS dte, lead(close_val) OVER (ORDER BY trade_date) AS fut FROM idx),
nn AS (
  SELECT a.trade_date, a.symbol, a.close_price AS fut, a.expiry_date - a.trade_date AS dte, a.open_interest AS oi,
    b.close_price AS fut_next, b.expiry_date - b.trade_date AS dte_next, e.close_price AS spot, e.turnover_lacs
  FROM fut a LEFT JOIN fut b ON a.trade_date = b.trade_date AND a.symbol = b.symbol AND b.rn = 2
  JOIN panel e ON e.trade_date = a.trade_date AND e.symbol = a.symbol AND e.series = 'EQ' AND e.close_price > 0
  WHERE a.rn = 1),
bas AS (SELECT *, (fut / spot - 1) * 100 AS basis_pct, (fut / spot - 1) * 100 * 365 / dte AS basis_ann,
  (fut_next / fut - 1) * 100 * 365 / nullif(dte_next - dte, 0) AS roll_ann FROM nn WHERE dte >= 3),
crk AS (SELECT *, median(basis_pct) OVER d AS med, row_number() OVER (PARTITION BY trade_date ORDER BY basis_ann, symbol) AS r,
  count(*) OVER d AS n, count(DISTINCT basis_ann) OVER d AS nd FROM bas WINDOW d AS (PARTITION BY trade_date)),
carry0 AS (SELECT *, med - basis_pct AS div_impl, med - basis_pct > 0.25 AS exdiv,
  CASE WHEN nd >= 5 THEN greatest(1, CAST(ceil(5 * (r - 1) / CAST(n - 1 AS DOUBLE)) AS BIGINT)) END AS q FROM crk),
carry AS (SELECT *, coalesce(q >= 5, FALSE) AND NOT exdiv AS confirm FROM carry0)"""


def _spot(spark, sf):
    return B.panel(spark, sf).where("series = 'EQ' AND close_price > 0")


def _carry(spark, sf):
    return bs.carry_board(B.futures(spark, sf), _spot(spark, sf))


@register("near_next_contracts", "J4 J5 W13 F10", "trade_date:d symbol fut:r dte:i oi:i fut_next:r dte_next:i spot:r turnover_lacs:f8",
          FUT + ", out AS (SELECT * FROM nn)")
def near_next_contracts(spark, sf):
    return bs.near_next(B.futures(spark, sf), _spot(spark, sf))


@register("carry_board", "E7 SC21 SC22 SC23 W14", "trade_date:d symbol basis_pct:f basis_ann:f4 roll_ann:f4 div_impl:f exdiv:b q:i confirm:b tag dte:i",
          FUT + """,
out AS (SELECT *, CASE WHEN exdiv THEN printf('⚠️ ex-div? ~%.1f%%', div_impl) WHEN confirm THEN printf('✅ %+.1f%%', basis_ann)
  ELSE printf('%+.1f%%', basis_ann) END AS tag FROM carry)""")
def carry_board(spark, sf):
    return _carry(spark, sf)


IXC = FUT + """,
ixc AS (SELECT i.trade_date, (f.fut / i.close_val - 1) * 100 * 365 / f.dte AS carry_ann FROM ixfut f JOIN idx i USING (trade_date)
  WHERE f.fut IS NOT NULL)"""


@register("index_carry_history", "W36 J6 E7", "trade_date:d carry_ann:f", IXC + """,
out AS (SELECT * FROM ixc WHERE trade_date <= DATE '2001-01-15' ORDER BY trade_date DESC LIMIT 24)""")
def index_carry_history(spark, sf):
    return bs.carry_history(B.futures(spark, sf), B.index(spark, sf), "2001-01-15", 24)


@register("carry_market", "A13 E7", "trade_date:d index_ann:f pctile:f asof:d stale_days:i roll_med:f4 carry_med:f n_exdiv:i n:i", IXC + """,
pc AS (SELECT *, 100 * (SELECT avg(CASE WHEN h.carry_ann <= c.carry_ann THEN 1 ELSE 0 END) FROM ixc h WHERE h.trade_date <= c.trade_date) AS pctile FROM ixc c),
md AS (SELECT trade_date, median(roll_ann) AS roll_med, median(basis_pct) AS carry_med, count(*) FILTER (exdiv) AS n_exdiv, count(*) AS n
  FROM carry GROUP BY 1),
dates AS (SELECT DISTINCT trade_date FROM eod),
out AS (SELECT d.trade_date, p.carry_ann AS index_ann, pctile, p.trade_date AS asof, d.trade_date - p.trade_date AS stale_days, roll_med, carry_med,
  coalesce(n_exdiv, 0) AS n_exdiv, coalesce(n, 0) AS n FROM dates d ASOF LEFT JOIN pc p ON d.trade_date >= p.trade_date
  LEFT JOIN md ON md.trade_date = d.trade_date)""")
def carry_market(spark, sf):
    return bs.carry_market(_carry(spark, sf), B.futures(spark, sf), B.index(spark, sf),
                           B.eod(spark, sf).select("trade_date").distinct())


@register("carry_annotation", "J17", "trade_date:d symbol tag", FUT + """,
out AS (SELECT e.trade_date, e.symbol, coalesce(CASE WHEN exdiv THEN printf('⚠️ ex-div? ~%.1f%%', div_impl)
  WHEN confirm THEN printf('✅ %+.1f%%', basis_ann) ELSE printf('%+.1f%%', basis_ann) END, '—') AS tag
  FROM eod e LEFT JOIN carry c ON c.trade_date = e.trade_date AND c.symbol = e.symbol)""")
def carry_annotation(spark, sf):
    return bs.annotate(B.eod(spark, sf).select("trade_date", "symbol"), _carry(spark, sf), ["trade_date", "symbol"], ["tag"])


POS = FUT + """,
chg AS (SELECT *, open_interest - lag(open_interest) OVER w AS doi, close_price - lag(close_price) OVER w AS dpx,
  expiry_date - trade_date <= 3 AS rolling FROM fut WINDOW w AS (PARTITION BY symbol, expiry_date ORDER BY trade_date)),
lab AS (SELECT trade_date, symbol, rn, CASE WHEN rolling THEN '⟳ rolling' WHEN dpx > 0 AND doi > 0 THEN 'LB' WHEN dpx < 0 AND doi > 0 THEN 'SB'
  WHEN dpx > 0 AND doi < 0 THEN 'SC' WHEN dpx < 0 AND doi < 0 THEN 'LU' END AS label FROM chg),
pos AS (SELECT trade_date, symbol, max(label) FILTER (rn = 1) AS fut_near, max(label) FILTER (rn = 2) AS fut_next FROM lab GROUP BY 1, 2)"""


@register("futures_positions", "J19", "trade_date:d symbol fut_near fut_next", POS + ", out AS (SELECT * FROM pos)")
def futures_positions(spark, sf):
    return ps.futures_positions(B.futures(spark, sf))


@register("option_positions", "J19", "trade_date:d symbol call put bias pcr:f4", PANEL + """,
legs AS (SELECT trade_date, symbol, CAST(date_trunc('quarter', trade_date) + INTERVAL 2 MONTH AS DATE) + CAST(1 + CAST(substr(symbol, 2) AS BIGINT) % 30 AS INT) AS ex,
  deliv_qty AS coi, ttl_trd_qnty - deliv_qty AS poi, close_price - low_price AS cpx, high_price - close_price AS ppx FROM panel),
d AS (SELECT *, coi - lag(coi) OVER w AS dc, poi - lag(poi) OVER w AS dp, cpx - lag(cpx) OVER w AS dcp, ppx - lag(ppx) OVER w AS dpp
  FROM legs WINDOW w AS (PARTITION BY symbol, ex ORDER BY trade_date)),
l AS (SELECT *, CASE WHEN dc > 0 AND dcp > 0 THEN 'C.Buying' WHEN dc > 0 AND dcp < 0 THEN 'C.Writing' WHEN dc < 0 AND dcp > 0 THEN 'C.SC'
    WHEN dc < 0 AND dcp < 0 THEN 'C.LE' END AS "call",
  CASE WHEN dp > 0 AND dpp > 0 THEN 'P.Buying' WHEN dp > 0 AND dpp < 0 THEN 'P.Writing' WHEN dp < 0 AND dpp > 0 THEN 'P.SC'
    WHEN dp < 0 AND dpp < 0 THEN 'P.LE' END AS put FROM d),
out AS (SELECT *, CASE WHEN "call" = 'C.Buying' AND put = 'P.Writing' THEN 'Bull' WHEN "call" = 'C.Writing' AND put = 'P.Buying' THEN 'Bear'
    WHEN "call" = 'C.Writing' AND put = 'P.Writing' THEN 'Range' WHEN "call" = 'C.Buying' AND put = 'P.Buying' THEN 'Vol Bet'
    ELSE concat_ws(' ', "call", put) END AS bias, CASE WHEN coi > 0 THEN CAST(poi AS DOUBLE) / coi END AS pcr FROM l)""")
def option_positions(spark, sf):
    return ps.option_positions(td.options(B.panel(spark, sf)))


@register("positioning_asof", "J18 J17", "trade_date:d symbol date_used:d stale_days:i fut_near fut_next", POS + """,
quarter AS (SELECT * FROM pos WHERE month(trade_date) % 3 = 1),
days AS (SELECT DISTINCT trade_date AS d FROM quarter),
used AS (SELECT e.trade_date, max(d) AS date_used FROM (SELECT DISTINCT trade_date FROM eod) e LEFT JOIN days ON d <= e.trade_date GROUP BY 1),
out AS (SELECT e.trade_date, e.symbol, date_used, e.trade_date - date_used AS stale_days, coalesce(fut_near, '—') AS fut_near,
  coalesce(fut_next, '—') AS fut_next FROM eod e JOIN used USING (trade_date)
  LEFT JOIN quarter q ON q.trade_date = date_used AND q.symbol = e.symbol)""")
def positioning_asof(spark, sf):
    labels = ps.futures_positions(B.futures(spark, sf)).where(F.month("trade_date") % 3 == 1)
    return ps.asof_labels(B.eod(spark, sf).select("trade_date", "symbol"), labels, ["fut_near", "fut_next"])


# --- delivery ------------------------------------------------------------------------------------
AS_OF = "2000-09-01"


def _dated(spark, sf, days):
    """The sessions that a look back of so many days from AS_OF can meet."""
    return B.eod(spark, sf, date.fromisoformat(AS_OF) - timedelta(days=days), AS_OF)



@register("delivery_momentum", "E8 A14", "symbol wtd_recent:f avg_norm:f deliv_vs_norm:f", PANEL + f""",
u AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date < DATE '{AS_OF}' ORDER BY trade_date DESC) AS k FROM eod
  WHERE trade_date <= DATE '{AS_OF}' AND trade_date >= DATE '{AS_OF}' - 2000 AND turnover_lacs > 0 AND deliv_per IS NOT NULL),
g AS (SELECT symbol, sum(deliv_per * turnover_lacs) FILTER (trade_date > DATE '{AS_OF}' - 95)
    / nullif(sum(turnover_lacs) FILTER (trade_date > DATE '{AS_OF}' - 95), 0) AS wtd_recent,
  sum(deliv_per * turnover_lacs) FILTER (trade_date < DATE '{AS_OF}' AND k <= 24)
    / nullif(sum(turnover_lacs) FILTER (trade_date < DATE '{AS_OF}' AND k <= 24), 0) AS avg_norm FROM u GROUP BY symbol),
out AS (SELECT *, CASE WHEN avg_norm > 0 THEN (wtd_recent / avg_norm - 1) * 100 END AS deliv_vs_norm FROM g)""")
def delivery_momentum(spark, sf):
    return dl.delivery_momentum(_dated(spark, sf, 2000), AS_OF, Delivery(recent_days=95, norm_rows=24), 2000)


def trend_sql(bucket: str) -> str:
    day = bucket == "day"
    slot = "trade_date" if day else "trade_date + CAST((4 - (isodow(trade_date) - 1) + 7) % 7 AS INT)"
    cut = "(SELECT min(slot) FROM sl)" if day else "(SELECT max(slot) - 6 FROM sl)"
    val = "avg(deliv_per)" if day else "(sum(deliv_per * turnover_lacs) / nullif(sum(turnover_lacs), 0))"
    ws = ", ".join(f"max(v) FILTER (back = {b}) AS b{b}" for b in range(1, 6))
    recent = "wr" if day else "coalesce(b1, b2, b3, b4, b5)"
    seq = ", ', ', ".join("CASE WHEN b%d IS NULL THEN '–' ELSE printf('%%.0f', round_even(b%d, 0)) END%s" % (
        b, b, " || mark" if b == 1 else "") for b in range(1, 6))
    partial = "FALSE" if day else f"DATE '{AS_OF}' < (SELECT max(slot) FROM sl)"
    cur = "0" if day else "coalesce(cd, 0)"
    return PANEL + f""",
u AS (SELECT *, {slot} AS slot FROM eod WHERE trade_date <= DATE '{AS_OF}' AND trade_date >= DATE '{AS_OF}' - 1500
  AND turnover_lacs > 0 AND deliv_per IS NOT NULL),
sl AS (SELECT slot, row_number() OVER (ORDER BY slot DESC) AS back FROM (SELECT DISTINCT slot FROM u ORDER BY slot DESC LIMIT 5)),
cells AS (SELECT symbol, back, {val} AS v, count(*) AS c FROM u JOIN sl USING (slot) GROUP BY 1, 2),
grid AS (SELECT symbol, {ws}, max(c) FILTER (back = 1) AS cd FROM cells GROUP BY 1),
wrec AS (SELECT symbol, sum(deliv_per * turnover_lacs) / nullif(sum(turnover_lacs), 0) AS wr FROM u JOIN sl USING (slot) GROUP BY 1),
old AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM u WHERE trade_date < {cut}),
nrm AS (SELECT symbol, CASE WHEN count(*) >= 15 THEN sum(deliv_per * turnover_lacs) / nullif(sum(turnover_lacs), 0) END AS norm
  FROM old WHERE k <= 30 GROUP BY 1),
a AS (SELECT *, {recent} AS recent, {partial} AS partial, {cur} AS cur_days FROM grid LEFT JOIN wrec USING (symbol) LEFT JOIN nrm USING (symbol)),
b AS (SELECT *, CASE WHEN norm > 0 THEN (recent / norm - 1) * 100 END AS dev_pct,
  CASE WHEN partial AND b1 IS NOT NULL THEN CASE WHEN cur_days > 0 THEN '*' || cur_days || 'd' ELSE '*' END ELSE '' END AS mark FROM a),
out AS (SELECT *, b5 AS w1, b4 AS w2, b3 AS w3, b2 AS w4, b1 AS w5,
  concat({seq}, '  Base -> ', CASE WHEN dev_pct IS NULL THEN '(n/a)' ELSE printf('(%+.0f%%)', dev_pct) END) AS cell FROM b)"""


TREND_COLS = "symbol w1:f w2:f w3:f w4:f w5:f norm:f recent:f partial:b cur_days:i dev_pct:f cell"


@register("delivery_trend_week", "E8 A15 A17 A18 SC41", TREND_COLS, trend_sql("week"))
def delivery_trend_week(spark, sf):
    return dl.delivery_trend(_dated(spark, sf, 1500), AS_OF, Delivery(), "week", 1500)


@register("delivery_trend_day", "E8 A16 A17 A18 SC41", TREND_COLS, trend_sql("day"))
def delivery_trend_day(spark, sf):
    return dl.delivery_trend(_dated(spark, sf, 1500), AS_OF, Delivery(), "day", 1500)
