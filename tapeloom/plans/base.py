"""Inputs shared by the registered queries and the SQL for the same inputs.

The driver's panel has monthly sessions and noisy prices, so the registered queries pass loose
thresholds; the operators' defaults are the locked ones.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import screen as scr
from ..operators.calendar import parse_calendar
from ..params import Signal
from ..session import shared_dir, stage
from ..sources import panel as src
from ..sources import states as src_states
from ..sources import testdata as td
from ..sources.states import SessionStore

LOOSE = Signal(clr=0.45, deliv_trail=25.0, vol_ratio=0.8, ret=0.0, close_vs_vwap=-0.1, rs_min=-5.0,
               liq_lacs=4.0, regime_ma=10, max_stale_days=40, min_year_rows=10, cost_bps=22.0)
INDEX = "MKT"

PANEL = """
prints AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
         CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, l_quantity AS qty,
         l_extendedprice AS value, l_returnflag = 'N' AS delivered,
         ROW(l_shipdate, l_orderkey, l_linenumber) AS pos
  FROM lineitem),
panel0 AS (
  SELECT l_suppkey, trade_date, arg_min(px, pos) AS open_price, max(px) AS high_price,
         min(px) AS low_price, arg_max(px, pos) AS close_price, sum(qty) AS qty, round(sum(value), 2) AS value,
         sum(CASE WHEN delivered THEN qty ELSE 0 END) AS dq, count(*) AS no_of_trades
  FROM prints GROUP BY ALL),
panel AS (
  SELECT trade_date, 'S' || l_suppkey AS symbol,
         CASE WHEN l_suppkey % 10 = 9 THEN 'SM' ELSE 'EQ' END AS series,
         lag(close_price) OVER (PARTITION BY l_suppkey ORDER BY trade_date) AS prev_close,
         open_price, high_price, low_price, close_price, value / qty AS avg_price,
         CAST(qty AS BIGINT) AS ttl_trd_qnty, CAST(dq AS BIGINT) AS deliv_qty,
         CAST(100 AS DOUBLE) * dq / qty AS deliv_per, value / CAST(100000 AS DOUBLE) AS turnover_lacs,
         no_of_trades
  FROM panel0),
eod AS (
  SELECT * FROM panel WHERE series = 'EQ' AND close_price > 0 AND high_price > low_price),
idx AS (SELECT trade_date, avg(close_price) AS close_val FROM eod GROUP BY trade_date),
nifty AS (
  SELECT trade_date, close_val,
         (close_val / lag(close_val) OVER (ORDER BY trade_date) - 1) * 100 AS nret FROM idx),
sectors AS (
  SELECT 'S' || s_suppkey AS symbol,
         CASE WHEN s_suppkey % 25 = 3 THEN NULL WHEN s_suppkey % 40 = 11 THEN 'ETF'
              ELSE 'SEC' || (s_nationkey % 10) END AS sector
  FROM supplier)"""

FEATURES = PANEL + """,
feat0 AS (
  SELECT *, lag(close_price) OVER w AS pc,
         nullif(high_price - low_price, 0) AS rng,
         CASE WHEN avg_price > 0 THEN avg_price END AS vw
  FROM eod WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
feat1 AS (
  SELECT *, (close_price - low_price) / rng AS clr, (close_price - open_price) / rng AS body,
         close_price / prev_close - 1 AS ret, (close_price - vw) / vw AS close_vs_vwap,
         (vw - low_price) / rng AS vwap_in_range,
         greatest(high_price - low_price, abs(high_price - pc), abs(low_price - pc)) AS tr
  FROM feat0),
feat2 AS (
  SELECT f.*, close_val / prev_val - 1 AS idx_ret
  FROM feat1 f LEFT JOIN (SELECT trade_date, close_val, lag(close_val) OVER (ORDER BY trade_date) AS prev_val
                          FROM idx) i USING (trade_date)),
feat AS (
  SELECT *, ret - idx_ret AS rs_idx,
    CASE WHEN count(ttl_trd_qnty) OVER p20 = 20
         THEN ttl_trd_qnty / quantile_cont(CAST(ttl_trd_qnty AS DOUBLE), 0.5) OVER p20 END AS vol_ratio,
    CASE WHEN count(deliv_per) OVER p20 = 20
         THEN deliv_per - quantile_cont(deliv_per, 0.5) OVER p20 END AS deliv_spike,
    CASE WHEN count(deliv_per) OVER p3 = 3 THEN avg(deliv_per) OVER p3 END AS deliv_trail,
    CASE WHEN count(tr) OVER c14 = 14 THEN avg(tr) OVER c14 END AS atr14,
    CASE WHEN count(ret - idx_ret) OVER c10 = 10 THEN sum(ret - idx_ret) OVER c10 END AS rs_idx_cum
  FROM feat2
  WINDOW p20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         p3 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         c14 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         c10 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
gate AS (
  SELECT trade_date, coalesce(close_val > CASE WHEN count(close_val) OVER g = 10 THEN avg(close_val) OVER g END,
                              FALSE) AS up
  FROM idx WINDOW g AS (ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""

LEGS = ("clr >= 0.45 AND deliv_trail >= 25 AND vol_ratio >= 0.8 AND ret >= 0 "
        "AND close_vs_vwap >= -0.1 AND rs_idx_cum > -5")
SIGNAL = LEGS + " AND turnover_lacs >= 4"

CALENDAR = """,
cal AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS date,
         CASE o_orderkey % 3 WHEN 0 THEN 'Financial Results' WHEN 1 THEN 'Board Meeting Intimation'
              ELSE 'Dividend' END AS purpose
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 < 2)"""


def pct_rank_sql(col: str, by: str) -> str:
    """Average-tie percent rank, as SQL."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{col}"
    return (f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {col} NULLS LAST)"
            f" + (count({col}) OVER ({tie}) - 1) / CAST(2 AS DOUBLE)) / count({col}) OVER ({part}) END")


def score_sql(src: str, dst: str, by: str = "trade_date") -> str:
    """CTE `dst`: `src` plus the five-leg score."""
    legs = ("clr", "deliv_trail", "vcap", "rfloor", "rs_idx_cum")
    return f"""{dst}0 AS (SELECT *, least(vol_ratio, 6) AS vcap, greatest(ret, 0) AS rfloor FROM {src}),
{dst} AS (SELECT *, round({' + '.join(pct_rank_sql(c, by) for c in legs)}, 9) AS score FROM {dst}0)"""


_staged: dict = {}


def new_run() -> None:
    """Forget the inputs staged by the query before; every query builds its own."""
    _staged.clear()


def once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """One staged table for each session, folder and name; queries over other data keep their own."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(make())
    return _staged[key]


_stores: dict = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times; a table that changes gets a new store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def store(spark: SparkSession, sf: str) -> SessionStore:
    """The session states of the prints. The first query of an application that needs them folds all
    prints once, as the first update of a new store; later ones read the sessions they want."""
    key = (spark.sparkContext.applicationId, sf, _version(spark, f"{sf}/lineitem.parquet"))
    if key not in _stores:
        made = SessionStore(spark, f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}")
        made.update(td.prints(spark, sf), "all")
        _stores[key] = made
    return _stores[key]


def panel(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    """The session panel out of the state store; a dated query opens the folders of its range only."""
    return src_states.panel(store(spark, sf).read(start, end), td.series_of())


def session_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars inside the sessions, folded from the prints once per query."""
    return once(spark, sf, "session_bars", lambda: td.session_bars(spark, sf))


def eod(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    return src.load_eod(panel(spark, sf, start, end))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "index", lambda: src.load_index(td.index_series(panel(spark, sf)), INDEX))


def nifty(spark: SparkSession, sf: str, end=None) -> DataFrame:
    return src.index_returns(td.index_series(panel(spark, sf, None, end)), INDEX)


def futures(spark: SparkSession, sf: str) -> DataFrame:
    return td.derivatives(panel(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return scr.featured(eod(spark, sf), index(spark, sf), LOOSE)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return parse_calendar(td.events_raw(spark, sf))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    return td.sector_dim(spark, sf)


# Monthly sessions: trailing windows are counted in months instead of days.
from ..params import Regime, Tilt  # noqa: E402

TILT = Tilt(mom_2w=3, mom_1w=2, dv_base=12, dv_flow=3, min_hist=6, min_sectors=6, min_names=3, panel_cal=400,
            deliv_min_hist=6, slope_win=5, pers_cal=900, pers_fwd=3, pers_min_obs=8, min_turnover=1.0,
            clip_pct=200.0, drop_pct=1000.0, disp_min=60.0)
REGIME = Regime(min_rows=20, trend_win=12, slope_win=3, ret_short=2, ret_mid=6, er_win=8, vol_win=6)
