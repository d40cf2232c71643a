"""Stored tables written and read back, and set operations on the panel."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import boards as bd
from ..operators import evaluation as ev
from ..operators import positioning as ps
from ..operators import screen as scr
from ..session import shared_dir
from ..sources import states, store
from ..sources import panel as src
from ..sources import testdata as td
from . import base as B
from .bar_queries import BARS, OHLC
from .base import LOOSE, PANEL
from .ledger_queries import BOOKED, CALIBRATE_SQL, LEDGER_COLS, PRIOR, _picks, calibrate
from .ledger_queries import POS
from .panel_queries import BOOK, PREP, REF, SCREEN_COLS
from .sector_queries import TILT_SQL, _tilt
from .spec import register


def _new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("bars_store", "SRC10", f"symbol ts:t {OHLC}", BARS + ", out AS (SELECT * FROM fine WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21')")
def bars_store(spark, sf):
    path = _new_path(spark, "bars")
    store.write_bars(td.bars(spark, sf, 60), path, "1h")
    return store.read_bars(spark, path, "1h", "2024-01-10", "2024-01-20")


@register("tilt_history", "SRC14 SRC15 U2", "trade_date:d sector tilt rank:f n_liq:i", TILT_SQL + ", out AS (SELECT * FROM tilt)")
def tilt_history(spark, sf):
    path = _new_path(spark, "tilt")
    store.write_tilt_history(_tilt(spark, sf), path)
    return store.read_tilt_history(spark, path)


@register("ledger_store", "SRC13", LEDGER_COLS, BOOKED + ", out AS (SELECT * FROM picks)")
def ledger_store(spark, sf):
    from ..operators.ledger import upsert
    path = _new_path(spark, "ledger")
    store.write_ledger(upsert(store.read_ledger(spark, path, 0), _picks(spark, sf)), path, 1)
    return store.read_ledger(spark, path, 1)


@register("result_document", "SRC16", "mu0:f4 mu0_mean:f4 tau:f4 n0:i", PREP + ", " + PRIOR + ", out AS (SELECT * FROM pri)")
def result_document(spark, sf):
    path = _new_path(spark, "prior")
    prior = ev.prior(ev.evaluate_signal(B.eod(spark, sf), B.index(spark, sf), LOOSE))
    store.write_document(prior, path)
    return store.read_document(spark, path, prior.schema)


CALIBRATED = CALIBRATE_SQL.replace("\nout AS (", "\nnewest AS (") + """,
calib AS (SELECT size_multiplier / 2 + 0.4::DOUBLE AS size_multiplier FROM newest),
""" + BOOK.format(src="scored", dst="sized", mult="(SELECT size_multiplier FROM calib)") + """,
out AS (SELECT b.*, coalesce(up, FALSE) AS risk_on FROM sized b LEFT JOIN gate USING (trade_date) WHERE (SELECT size_multiplier FROM calib) > 0)"""


@register("screen_calibrated", "T3 E3 SRC16 A25", SCREEN_COLS, CALIBRATED)
def screen_calibrated(spark, sf):
    """The screen sized by the newest of two stored calibrations: the measured one, which may stand aside,
    and a later one in which half of that and four tenths are allowed."""
    path = _new_path(spark, "calibration")
    measured = calibrate(spark, sf).select(F.lit("2001-05-31").cast("date").alias("calibrated"), "size_multiplier")
    later = measured.select(F.lit("2001-11-30").cast("date").alias("calibrated"), (F.col("size_multiplier") / 2 + 0.4).alias("size_multiplier"))
    store.write_document(measured.unionByName(later), path)
    states_read = store.read_document(spark, path, measured.schema)
    return scr.screen(B.features(spark, sf), B.index(spark, sf), B.calendar(spark, sf), B.sectors(spark, sf), None, LOOSE, calibrations=states_read)


@register("common_sessions", "U5 U3", "trade_date:d", """
out AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem WHERE CAST(date_trunc('month', l_shipdate) AS DATE) IN
  (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders))""")
def common_sessions(spark, sf):
    ship = td.table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "month").alias("trade_date"))
    order = td.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("trade_date"))
    return ship.distinct().join(order.distinct(), "trade_date", "left_semi")


EOD_COLS = ("trade_date:d symbol prev_close:r open_price:r high_price:r low_price:r close_price:r avg_price:r ttl_trd_qnty:i deliv_qty:i deliv_per:f "
            "turnover_lacs:f8 no_of_trades:i")
DAY = "2000-05-01"


@register("session_states", "SRC1 SRC10 U2", EOD_COLS, PANEL + ", out AS (SELECT * FROM panel)")
def session_states(spark, sf):
    """The store brought up to date batch by batch: most sessions, then the rest, then prints that come
    late for sessions already held, and the first batch once more. It equals one fold of all prints."""
    s = states.SessionStore(spark, _new_path(spark, "sessions"))
    p = td.prints(spark, sf)
    late = F.col("pos") % 7 == 0
    s.update(p.where((F.col("trade_date") < "2000-01-01") & ~late), "past")
    s.update(p.where((F.col("trade_date") >= "2000-01-01") & ~late), "new")
    s.update(p.where(late), "late")
    s.update(p.where((F.col("trade_date") < "2000-01-01") & ~late), "past")
    return states.panel(s.read(), td.series_of())


def _trailing(spark, sf, day, back, ahead=0):
    """First and last of the `back` sessions up to a day, and so many after it, as the store's manifest has them."""
    s = B.store(spark, sf)
    upto, after = s.sessions(None, day), s.sessions(day)
    return (upto or [day])[-back:][0], ([x for x in after if str(x) > day][:ahead] or (upto or [day]))[-1]


@register("live_reference_day", "MT9 W7", "symbol trade_date:d sector ref_close:r prev_close:r vol_med20:f atr14:f deliv_trail:f deliv_trail_prior:f "
          "rs_cum9:f rs_cum9_prior:f pdh:r pdl:r", REF + f", out AS (SELECT * FROM ref WHERE turnover_lacs >= 4 AND trade_date = DATE '{DAY}')")
def live_reference_day(spark, sf):
    """The reference of one session, from the folders of the 40 sessions up to it."""
    first, last = _trailing(spark, sf, DAY, 40)
    daily = B.panel(spark, sf, first, last)
    index = src.load_index(td.index_series(daily), B.INDEX)
    return bd.reference_table(src.load_eod(daily), index, B.sectors(spark, sf), LOOSE).where(F.col("trade_date") == DAY)


@register("positioning_day", "J18 J17", "trade_date:d symbol date_used:d stale_days:i fut_near fut_next", POS + f""",
quarter AS (SELECT * FROM pos WHERE month(trade_date) % 3 = 1),
used AS (SELECT max(trade_date) AS date_used FROM quarter WHERE trade_date <= DATE '{DAY}'),
out AS (SELECT e.trade_date, e.symbol, date_used, e.trade_date - date_used AS stale_days, coalesce(fut_near, '—') AS fut_near,
  coalesce(fut_next, '—') AS fut_next FROM eod e CROSS JOIN used LEFT JOIN quarter q ON q.trade_date = date_used AND q.symbol = e.symbol
  WHERE e.trade_date = DATE '{DAY}')""")
def positioning_day(spark, sf):
    """Labels of one session. The newest labels are at most a quarter old and compare with the session before."""
    first, last = _trailing(spark, sf, DAY, 12, 12)
    daily = B.panel(spark, sf, first, last)
    labels = ps.futures_positions(td.derivatives(daily)).where((F.month("trade_date") % 3 == 1) & (F.col("trade_date") <= DAY))
    board = src.load_eod(daily).where(F.col("trade_date") == DAY).select("trade_date", "symbol")
    return ps.asof_labels(board, labels, ["fut_near", "fut_next"])
