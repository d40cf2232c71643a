"""Bars: resampling, cleaning, indicators, structure, levels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as bo
from ..operators import levels as lv
from ..operators import structure as st
from ..params import VOLUME_PROFILE, Levels, Session, Signal, Structure
from ..sources import testdata as td
from .spec import register

FULL = Session(open_min=0, close_min=1440, carry_min=1300, last30_min=22 * 60)
FRAMES = {"1h": 60, "2h": 120, "4h": 240, "7h": 420}
NOW = "2024-01-31"
OHLC = "open:f high:f low:f close:f volume:i"

BARS = """
fine AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


def agg_sql(keys: str) -> str:
    return (f"SELECT {keys}, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
            "sum(volume) AS volume, min(bts) AS ts")


def slot_sql(m: int) -> str:
    """Bar start and folded slot of a fine bar in an m-minute frame over a 24 h session."""
    n = -(-1440 // m)
    last = n - 1
    stub = 1440 - last * m < m / 2
    slot = f"CAST(floor((hour(ts) * 60 + minute(ts)) / CAST({m} AS DOUBLE)) AS INT)"
    folded = f"least({slot}, {last - 1})" if stub else slot
    return f"date_trunc('day', ts) + to_minutes({slot} * {m}) AS bts, CAST(ts AS DATE) AS d, {folded} AS slot"


def frames_sql(bars: str = BARS, daily: str = "fine") -> str:
    parts = [f"SELECT *, '{k}' AS frame, {slot_sql(m)} FROM fine" for k, m in FRAMES.items()]
    parts.append(f"SELECT *, '1D' AS frame, date_trunc('day', ts) AS bts, CAST(ts AS DATE) AS d, 0 AS slot FROM {daily}")
    wk = "CAST(ts AS DATE) + CAST((4 - (isodow(ts) - 1) + 7) % 7 AS INT)"
    parts.append(f"SELECT *, '1W' AS frame, CAST({wk} AS TIMESTAMP) AS bts, {wk} AS d, 0 AS slot FROM {daily}")
    return bars + ",\nkeyed AS (" + "\nUNION ALL ".join(parts) + f""")
, multi AS ({agg_sql('symbol, frame')} FROM keyed GROUP BY symbol, frame, d, slot
  HAVING NOT (frame = '1W' AND CAST(max(keyed.ts) AS DATE) < d AND DATE '{NOW}' <= d))"""


def struct_sql(src: str, keys: str, forming: bool = False, p: Structure = Structure()) -> str:
    """CTE `stru`: structure of every bar of `src`."""
    w = f"PARTITION BY {keys} ORDER BY ts"
    coil = ("CASE WHEN least(n, 20) > 8 THEN lag(s3) OVER o / quantile_cont(s3, 0.5) OVER (" + w + " ROWS BETWEEN 17 PRECEDING AND 2 PRECEDING) "
            if forming else "CASE WHEN FALSE THEN 0 ")
    coil += "WHEN least(n, 20) >= 8 THEN s3 / quantile_cont(s3, 0.5) OVER (" + w + " ROWS BETWEEN 17 PRECEDING AND 1 PRECEDING) END"
    return f""",
s0 AS (SELECT *, coalesce(lag(close) OVER o, close) AS pc, close - lag(close) OVER o AS chg, row_number() OVER o AS n FROM {src} WINDOW o AS ({w})),
s1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  max(high) OVER w20 AS box_hi, min(low) OVER w20 AS box_lo, first_value(close) OVER w20 AS c0,
  sum(abs(chg)) OVER ({w} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS path,
  list(high) OVER p19 AS ph, list(low) OVER p19 AS pl,
  CASE WHEN n >= 3 THEN max(high) OVER w3 - min(low) OVER w3 END AS s3
  FROM s0 WINDOW w20 AS ({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p19 AS ({w} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING),
    w3 AS ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s2 AS (SELECT *, avg(tr) OVER ({w} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, close - c0 AS net,
  CASE WHEN path > 0 THEN abs(close - c0) / path ELSE 0 END AS er, list_sort(ph) AS sh, list_sort(pl) AS sl,
  round_even({coil}, 2) AS coil FROM s1 WINDOW o AS ({w})),
s3 AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE (box_hi - box_lo) / 20 END AS u FROM s2),
s4 AS (SELECT *, CASE WHEN len(sh) >= 3 AND u > 0 AND sh[-1] - sh[-2] > 2 * u THEN sh[-2] ELSE sh[-1] END AS bh,
  CASE WHEN len(sl) >= 3 AND u > 0 AND sl[2] - sl[1] > 2 * u THEN sl[2] ELSE sl[1] END AS bl FROM s3),
stru AS (SELECT *, CASE WHEN n < 5 THEN 'n/a' WHEN close > bh + {p.breakout_atr}::DOUBLE * u THEN 'BREAKOUT_UP' WHEN close < bl - {p.breakout_atr}::DOUBLE * u THEN 'BREAKOUT_DOWN'
  WHEN er >= {p.trend_er}::DOUBLE AND abs(net) >= {p.trend_atr}::DOUBLE * u THEN CASE WHEN net > 0 THEN 'TREND_UP' ELSE 'TREND_DOWN' END
  WHEN coalesce(coil < 0.6::DOUBLE, FALSE) THEN 'CONSOLIDATION' ELSE 'RANGE' END AS struct FROM s4)"""


def summary_sql(keys: str, lookback: str, forming: bool = False) -> str:
    """CTEs `summ` (newest bar, box, walls) and `wbars` (window bars) on top of `stru`."""
    blind = "b = 1" if forming else "b < 2"
    w = f"PARTITION BY {keys} ORDER BY ts"
    merge = ("list_reduce(list_transform(list_sort(pv), lambda x: [{'level': x, 'touches': 1, 'lo': x, 'hi': x}]), lambda acc, y: "
             "CASE WHEN list_position(list_transform(acc, lambda c: abs(y[1].level - c.level) <= 0.6::DOUBLE * atr), TRUE) > 0 THEN "
             "list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda z: abs(y[1].level - z.level) <= 0.6::DOUBLE * atr), TRUE) "
             "THEN {'level': (c.level * c.touches + y[1].level) / (c.touches + 1), 'touches': c.touches + 1, 'lo': least(c.lo, y[1].level), 'hi': greatest(c.hi, y[1].level)} "
             "ELSE c END) ELSE list_concat(acc, y) END)")
    rounded = f"list_transform({merge}, lambda c: {{'level': round_even(c.level, 2), 'touches': c.touches, 'lo': round_even(c.lo, 2), 'hi': round_even(c.hi, 2)}})"
    return f""",
v0 AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS tot, {lookback} AS lb, max(high) OVER nb AS wh, min(low) OVER nb AS wl
  FROM stru WINDOW nb AS ({w} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
v1 AS (SELECT *, tot - n AS b, n >= greatest(1, tot - lb + 1) + 2 AND tot - n >= 2 AND wh > wl AS can FROM v0),
v2 AS (SELECT {keys}, list(v ORDER BY v) AS pv FROM (
  SELECT {keys}, high AS v FROM v1 WHERE can AND b < lb AND high >= wh - 1e-9
  UNION ALL SELECT {keys}, low FROM v1 WHERE can AND b < lb AND low <= wl + 1e-9) GROUP BY {keys}),
v3 AS (SELECT {keys}, max(high) FILTER ({blind}) AS blind_hi, min(low) FILTER ({blind}) AS blind_lo,
  max(high) FILTER (b < 3) - min(low) FILTER (b < 3) AS tight, quantile_cont(high, 0.95) FILTER (b < 20) AS p95,
  quantile_cont(low, 0.05) FILTER (b < 20) AS p05 FROM v1 GROUP BY {keys}),
wbars AS (SELECT {keys}, ts, high, low, close FROM v1 WHERE b < lb),
v4 AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, struct, box_hi, box_lo, er, coil, n, close AS last, atr, ts, pv, blind_hi, blind_lo, tight, p95, p05
  FROM v1 s LEFT JOIN v2 USING ({keys}) JOIN v3 USING ({keys}) WHERE b = 0),
summ AS (SELECT *, CASE WHEN struct <> 'n/a' AND last > 0 THEN round_even(CASE WHEN struct = 'CONSOLIDATION' THEN tight WHEN n >= 8 THEN p95 - p05
    ELSE box_hi - box_lo END / 2 / last * 100, 2) END AS band_pct,
  CASE WHEN n >= 12 AND atr > 0 AND len(pv) > 0 THEN {rounded} ELSE [] END AS walls FROM v4)"""


def zone_sql(keys: str, src: str, level: str, extra: str = "") -> str:
    """Visits, bars, closes and time share of the level column of `src`."""
    on = " AND ".join(f"b.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    lk = ", ".join("l." + k.strip() for k in keys.split(","))
    part = f"PARTITION BY {lk}, l.{level}{extra}"
    return f"""(SELECT {keys}, {level}, count(*) FILTER (inz AND NOT coalesce(prev, FALSE)) AS visits, count(*) FILTER (inz) AS bars,
    count(*) FILTER (close BETWEEN zlo AND zhi) AS closes, round_even(100 * count(*) FILTER (inz) / CAST(count(*) AS DOUBLE), 1) AS time_pct FROM (
      SELECT *, lag(inz) OVER (PARTITION BY {keys}, {level} ORDER BY ts) AS prev FROM (
        SELECT {lk}, l.{level}, b.ts, b.close, l.{level} - 0.6::DOUBLE * l.atr AS zlo, l.{level} + 0.6::DOUBLE * l.atr AS zhi,
          b.low <= l.{level} + 0.6::DOUBLE * l.atr AND b.high >= l.{level} - 0.6::DOUBLE * l.atr AS inz
        FROM {src} l JOIN wbars b ON {on} WHERE l.{level} IS NOT NULL)) GROUP BY {keys}, {level})"""


def _bars(spark, sf):
    return td.bars(spark, sf, 60)


def _multi(spark, sf):
    return bo.multi_frame(_bars(spark, sf), FRAMES, ("1D", "1W"), NOW, FULL)


@register("fine_bars", "SRC10 STR1s", f"symbol ts:t {OHLC}", BARS + ", out AS (SELECT * FROM fine)")
def fine_bars(spark, sf):
    return _bars(spark, sf)


for _m, _name in ((120, "resample_2h"), (420, "resample_7h_stub_folded")):
    register(_name, "RS1 RS2", f"symbol ts:t {OHLC}", BARS + f""",
k AS (SELECT *, {slot_sql(_m)} FROM fine), out AS ({agg_sql('symbol')} FROM k GROUP BY symbol, d, slot)""")(
        lambda spark, sf, m=_m: bo.resample(_bars(spark, sf), m, FULL))


@register("weekly_bars", "RS3", f"symbol ts:t {OHLC}", frames_sql() + ", out AS (SELECT * FROM multi WHERE frame = '1W')")
def weekly_bars(spark, sf):
    return bo.calendar_frame(_bars(spark, sf), "1W", NOW)


@register("monthly_bars", "RS4 SRC11", "symbol ts:t open:r high:r low:r close:r", """
prints AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, ROW(l_shipdate, l_orderkey, l_linenumber) AS pos FROM lineitem),
m AS (SELECT 'S' || l_suppkey AS symbol, last_day(day) AS me, max(day) AS ld, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close
  FROM prints GROUP BY 1, 2),
out AS (SELECT *, CAST(me AS TIMESTAMP) AS ts FROM m WHERE NOT (ld < me AND DATE '2001-11-10' <= me))""")
def monthly_bars(spark, sf):
    return bo.calendar_frame(td.session_bars(spark, sf), "1M", "2001-11-10")


@register("multi_frame_bars", "MT1 RS1 RS3 J20", f"symbol frame ts:t {OHLC}", frames_sql() + ", out AS (SELECT * FROM multi)")
def multi_frame_bars(spark, sf):
    return _multi(spark, sf)


@register("phantom_bars", "F14", f"symbol ts:t {OHLC}", BARS + """,
dup AS (SELECT * FROM fine UNION ALL SELECT symbol, ts + INTERVAL 30 MINUTES, open, high, low, close, volume FROM fine WHERE hour(ts) % 6 = 0),
ph AS (SELECT *, lag(ROW(open, high, low, close, volume)) OVER (PARTITION BY symbol ORDER BY ts) = ROW(open, high, low, close, volume) AS rep FROM dup),
out AS (SELECT * FROM ph WHERE NOT coalesce(rep, FALSE))""")
def phantom_bars(spark, sf):
    b = _bars(spark, sf)
    again = b.where(F.hour("ts") % 6 == 0).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.lit(30)))
    return bo.drop_phantom_bars(b.unionByName(again))


@register("distinct_bars", "F15", f"symbol ts:t {OHLC}", BARS + ", out AS (SELECT * FROM fine)")
def distinct_bars(spark, sf):
    b = _bars(spark, sf)
    return bo.distinct_bars(b.unionByName(b.where(F.hour("ts") % 2 == 0)))


@register("closed_bars", "F13 STR8s", f"symbol ts:t {OHLC}", BARS + """,
c AS (SELECT *, ts <= TIMESTAMP '2024-01-20 12:30:00' - INTERVAL 60 MINUTES AS ok FROM fine),
out AS (SELECT * FROM c WHERE ok)""")
def closed_bars(spark, sf):
    return bo.closed_bars(_bars(spark, sf), 60, "2024-01-20 12:30:00")


@register("causal_cut", "F12 MT6", f"symbol ts:t {OHLC}", BARS + ", out AS (SELECT * FROM fine WHERE ts <= TIMESTAMP '2024-01-15 13:00:00')")
def causal_cut(spark, sf):
    return bo.up_to(_bars(spark, sf), "2024-01-15 13:00:00")


@register("back_adjusted_bars", "ADJ1", "symbol ts:t open:f high:f low:f close:f", """
prints AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, ROW(l_shipdate, l_orderkey, l_linenumber) AS pos FROM lineitem),
m AS (SELECT 'S' || l_suppkey AS symbol, last_day(day) AS me, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close
  FROM prints GROUP BY 1, 2),
r AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY me) / close AS ratio, count(*) OVER (PARTITION BY symbol) AS c FROM m),
f AS (SELECT *, CASE WHEN c >= 3 THEN exp(coalesce(sum(CASE WHEN abs(ratio - 1) > 4 AND ratio > 0 THEN ln(ratio) END) OVER
  (PARTITION BY symbol ORDER BY me ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)) ELSE 1 END AS k FROM r),
out AS (SELECT symbol, CAST(me AS TIMESTAMP) AS ts, ln(open * k) AS open, ln(high * k) AS high, ln(low * k) AS low, ln(close * k) AS close FROM f)""")
def back_adjusted_bars(spark, sf):
    # adjusted prices span many magnitudes here, so they are compared as logarithms
    adj = bo.back_adjust(bo.calendar_frame(td.session_bars(spark, sf), "1M"), 4.0)
    return adj.withColumns({c: F.ln(c) for c in ("open", "high", "low", "close")})


@register("atr_by_bar", "IND1 SC4", "symbol ts:t atr:f", BARS + struct_sql("fine", "symbol") + ", out AS (SELECT * FROM stru)")
def atr_by_bar(spark, sf):
    return bo.with_atr(_bars(spark, sf), ["symbol"])


SESS = BARS + """,
day AS (SELECT *, CAST(ts AS DATE) AS d, (high + low + close) / 3 AS tp FROM fine)"""


@register("session_vwap", "A26", "symbol d:d vwap:f close30:f", SESS + """,
out AS (SELECT symbol, d, sum(tp * volume) / sum(volume) AS vwap, sum(tp * volume) FILTER (hour(ts) >= 22) / sum(volume) FILTER (hour(ts) >= 22) AS close30
  FROM day GROUP BY 1, 2)""")
def session_vwap(spark, sf):
    b = _bars(spark, sf).withColumn("d", F.to_date("ts"))
    return bo.session_vwap(b, ["symbol", "d"]).join(bo.last_minutes_vwap(b, ["symbol", "d"], F.hour("ts") >= 22), ["symbol", "d"])


ANATOMY = """CASE WHEN high <= low THEN 'flat' WHEN abs(close - open) / (high - low) >= 0.7 THEN CASE WHEN close >= open THEN 'marubozu_bull' ELSE 'marubozu_bear' END
  WHEN (least(open, close) - low) / (high - low) >= 0.5 AND (high - greatest(open, close)) / (high - low) <= 0.2 THEN 'hammer'
  WHEN (high - greatest(open, close)) / (high - low) >= 0.5 AND (least(open, close) - low) / (high - low) <= 0.2 THEN 'shooting_star'
  WHEN abs(close - open) / (high - low) <= 0.15 THEN 'doji' WHEN (close - low) / (high - low) >= 0.66 THEN 'strong_close'
  WHEN (close - low) / (high - low) <= 0.33 THEN 'weak_close' ELSE 'mid' END"""


@register("session_state", "A27 SC5", "symbol d:d open:f high:f low:f ltp:f volume:i vwap:f vs_vwap:f above_vwap:b clr:f body:f upper_wick:f lower_wick:f character", SESS + f""",
g AS (SELECT symbol, d, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
  sum(tp * volume) / sum(volume) AS vwap FROM day GROUP BY 1, 2),
out AS (SELECT *, close AS ltp, 100 * (close / vwap - 1) AS vs_vwap, close >= vwap AS above_vwap,
  CASE WHEN high <= low THEN 0.5 ELSE round_even((close - low) / (high - low), 3) END AS clr, CASE WHEN high <= low THEN 0 ELSE round_even((close - open) / (high - low), 3) END AS body,
  CASE WHEN high <= low THEN 0 ELSE round_even((high - greatest(open, close)) / (high - low), 3) END AS upper_wick,
  CASE WHEN high <= low THEN 0 ELSE round_even((least(open, close) - low) / (high - low), 3) END AS lower_wick, {ANATOMY} AS character FROM g)""")
def session_state(spark, sf):
    return bo.session_state(_bars(spark, sf).withColumn("d", F.to_date("ts")), ["symbol", "d"])


RSI = """,
ch AS (SELECT symbol, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close - lag(close) OVER w AS dd FROM fine WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
seed AS (SELECT symbol, avg(greatest(dd, 0)) FILTER (i BETWEEN 1 AND 7) AS g7, avg(greatest(-dd, 0)) FILTER (i BETWEEN 1 AND 7) AS l7,
  avg(greatest(dd, 0)) FILTER (i BETWEEN 1 AND 14) AS g14, avg(greatest(-dd, 0)) FILTER (i BETWEEN 1 AND 14) AS l14, any_value(n) AS n FROM ch GROUP BY 1),
walk AS (WITH RECURSIVE r AS (
  SELECT symbol, 7 AS i, g7 AS a, l7 AS b, g14 AS c, l14 AS e FROM seed
  UNION ALL SELECT r.symbol, h.i, (a * 6 + greatest(dd, 0)) / 7, (b * 6 + greatest(-dd, 0)) / 7,
    CASE WHEN h.i > 14 THEN (c * 13 + greatest(dd, 0)) / 14 ELSE c END, CASE WHEN h.i > 14 THEN (e * 13 + greatest(-dd, 0)) / 14 ELSE e END
  FROM r JOIN ch h ON h.symbol = r.symbol AND h.i = r.i + 1) SELECT * FROM r),
rr AS (SELECT w.symbol, w.i, n, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + a / b) END AS r7,
  CASE WHEN e = 0 THEN CASE WHEN c > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + c / e) END AS r14 FROM walk w JOIN seed USING (symbol)),
rs AS (SELECT a.symbol, a.r7, a.r14, a.r7 - b.r7 AS slope FROM rr a JOIN rr b ON a.symbol = b.symbol AND b.i = a.n - 2 WHERE a.i = a.n - 1),
rsi AS (SELECT symbol, round_even(r7, 1) AS rsi7, round_even(r14, 1) AS rsi14, round_even(slope, 1) AS rsi_slope,
  CASE WHEN r7 >= 60 AND slope >= 0 THEN 'strong' WHEN r7 <= 40 AND slope <= 0 THEN 'weak' WHEN slope < -3 THEN 'rolling-over' ELSE 'neutral' END AS tone FROM rs)"""


@register("rsi_state", "IND2 SC20", "symbol rsi7:f rsi14:f rsi_slope:f tone", BARS + RSI + ", out AS (SELECT * FROM rsi)")
def rsi_state(spark, sf):
    return bo.rsi_state(_bars(spark, sf), ["symbol"])


RUN = SESS + """,
rn AS (SELECT *, sum(volume) OVER w AS cum_volume, sum(tp * volume) OVER w / sum(volume) OVER w AS run_vwap, max(high) OVER w AS run_high, min(low) OVER w AS run_low
  FROM day WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)),
run AS (SELECT *, CASE WHEN run_high > run_low THEN (close - run_low) / (run_high - run_low) ELSE 0.5 END AS run_clr FROM rn)"""


@register("running_session", "W31 STR3s", "symbol ts:t cum_volume:i run_vwap:f run_high:f run_low:f run_clr:f", RUN + ", out AS (SELECT * FROM run)")
def running_session(spark, sf):
    return bo.running_session(_bars(spark, sf).withColumn("d", F.to_date("ts")), ["symbol", "d"])


TRIG = RUN + """,
daily AS (SELECT symbol, d, arg_max(close, ts) AS dclose, sum(volume) AS dvol FROM day GROUP BY 1, 2),
basel AS (SELECT symbol, d, lag(dclose) OVER w AS prev_close, median(dvol) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ref_volume
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY d)),
ixb AS (SELECT ts, CAST(ts AS DATE) AS d, avg(close) AS close FROM fine GROUP BY 1),
ixd AS (SELECT d, lag(lc) OVER (ORDER BY d) AS pc FROM (SELECT d, arg_max(close, ts) AS lc FROM ixb GROUP BY 1)),
ixr AS (SELECT ts, close / pc - 1 AS idx_ret FROM ixb JOIN ixd USING (d)),
pr AS (SELECT unnest(f) AS frac, generate_subscripts(f, 1) - 1 AS slot FROM (SELECT [""" + ", ".join(str(v) for v in VOLUME_PROFILE) + """]::DOUBLE[] AS f)),
tg AS (SELECT r.*, prev_close, ref_volume, coalesce(idx_ret, 0) AS idx_ret, least(greatest(CAST(floor(((hour(ts) * 60 + minute(ts) + 60) % 1440 - 555) / CAST(5 AS DOUBLE)) AS INT), 0), 74) AS slot
  FROM run r JOIN basel USING (symbol, d) LEFT JOIN ixr USING (ts)),
th AS (SELECT tg.* FROM tg JOIN pr USING (slot) WHERE prev_close <> 0 AND close / prev_close - 1 >= 0.01::DOUBLE AND run_clr >= 0.7::DOUBLE
  AND CASE WHEN run_vwap > 0 THEN (close - run_vwap) / run_vwap ELSE 0 END >= 0.005::DOUBLE AND 0.2 + (close / prev_close - 1 - idx_ret) > 0
  AND CASE WHEN coalesce(ref_volume > 0, FALSE) THEN cum_volume / ref_volume / CAST(frac AS DOUBLE) >= 0.5 ELSE TRUE END),
trg AS (SELECT symbol, d, min(ts) AS entered, arg_min(close, ts) AS at FROM th GROUP BY 1, 2)"""


def trigger_inputs(spark, sf):
    from pyspark.sql import Window
    b = _bars(spark, sf).withColumn("d", F.to_date("ts"))
    daily = b.groupBy("symbol", "d").agg(F.max_by("close", "ts").alias("dclose"), F.sum("volume").alias("dvol"))
    w = Window.partitionBy("symbol").orderBy("d")
    base = daily.select("symbol", "d", F.lag("dclose").over(w).alias("prev_close"),
                        F.percentile("dvol", F.lit(0.5)).over(w.rowsBetween(-10, -1)).alias("ref_volume"))
    ix = b.groupBy("ts", "d").agg(F.avg("close").alias("close"))
    iw = Window.partitionBy(F.lit(0)).orderBy("d")
    ixd = ix.groupBy("d").agg(F.max_by("close", "ts").alias("lc")).select("d", F.lag("lc").over(iw).alias("prev_close"))
    index = ix.join(ixd, "d").where("prev_close IS NOT NULL")
    r = bo.running_session(b, ["symbol", "d"]).join(base, ["symbol", "d"])
    return bo.index_at_bars(r, index).withColumn("rs_base", F.lit(0.2)), b


@register("index_at_bars", "J10", "symbol ts:t idx_ret:f", TRIG + ", out AS (SELECT * FROM tg)")
def index_at_bars(spark, sf):
    return trigger_inputs(spark, sf)[0]


TRIGGER_P = Signal(vol_ratio=0.5)


@register("first_trigger", "W32 STR4s", "symbol d:d entered:t at:r", TRIG + ", out AS (SELECT * FROM trg)")
def first_trigger(spark, sf):
    return bo.first_trigger(trigger_inputs(spark, sf)[0], ["symbol", "d"], TRIGGER_P, 60)


@register("trigger_attached", "W38 SC42", "symbol d:d ltp:r entered:t at:f since_pct:f", TRIG + """,
bd AS (SELECT symbol, d, arg_max(close, ts) AS ltp FROM day GROUP BY 1, 2),
out AS (SELECT b.symbol, b.d, ltp, CASE WHEN b.symbol <> 'view' THEN entered END AS entered, CASE WHEN b.symbol <> 'view' THEN round_even("at", 2) END AS "at",
  CASE WHEN b.symbol <> 'view' AND "at" > 0 THEN round_even(100 * (ltp / "at" - 1), 2) END AS since_pct FROM bd b LEFT JOIN trg USING (symbol, d))""")
def trigger_attached(spark, sf):
    r, b = trigger_inputs(spark, sf)
    trig = bo.first_trigger(r, ["symbol", "d"], TRIGGER_P, 60)
    board = b.groupBy("symbol", "d").agg(F.max_by("close", "ts").alias("ltp"))
    return bo.attach_trigger(board, trig, ["symbol", "d"], wanted=F.col("symbol") != "view")


STRUCT_COLS = "symbol frame ts:t struct n:i box_hi:f box_lo:f er:f coil:f atr:f"


@register("structure_by_bar", "ST0 ST1 SC48", STRUCT_COLS, frames_sql() + struct_sql("multi", "symbol, frame") + ", out AS (SELECT * FROM stru)")
def structure_by_bar(spark, sf):
    return st.structure_table(_multi(spark, sf), ["symbol", "frame"])


@register("structure_forming", "ST0", STRUCT_COLS, frames_sql() + struct_sql("multi", "symbol, frame", True) + ", out AS (SELECT * FROM stru)")
def structure_forming(spark, sf):
    return st.structure_table(_multi(spark, sf), ["symbol", "frame"], forming=True)


@register("bearish_age", "W30", "symbol dn_age:i", """
prints AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, ROW(l_shipdate, l_orderkey, l_linenumber) AS pos FROM lineitem),
m AS (SELECT 'S' || l_suppkey AS symbol, last_day(day) AS ts, arg_min(px, pos) AS open, max(px) AS high, min(px) AS low, arg_max(px, pos) AS close
  FROM prints GROUP BY 1, 2)""" + struct_sql("m", "symbol") + """,
ag AS (SELECT symbol, struct, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS k, max(n) OVER (PARTITION BY symbol) AS tot FROM stru),
ag2 AS (SELECT symbol, any_value(tot) AS tot, least(180, any_value(tot) - 20) AS lim, min(k) FILTER (struct NOT IN ('TREND_DOWN', 'BREAKOUT_DOWN')) AS broke FROM ag GROUP BY 1),
out AS (SELECT symbol, CASE WHEN tot >= 22 AND least(coalesce(broke, lim), lim) > 0 THEN least(coalesce(broke, lim), lim) END AS dn_age FROM ag2)""")
def bearish_age(spark, sf):
    m = bo.calendar_frame(td.session_bars(spark, sf), "1M")
    return st.bearish_age(st.structure_table(m, ["symbol"]), ["symbol"])


KEYS = ["symbol", "frame"]
LB_SQL = "CASE WHEN frame = '1D' THEN 180 ELSE 60 END"
SUMM = frames_sql() + struct_sql("multi", "symbol, frame") + summary_sql("symbol, frame", LB_SQL)
SUMM_COLS = "symbol frame struct n:i last:r box_hi:r box_lo:r band_pct:f blind_hi:r blind_lo:r n_walls:i"


def summarize(frames):
    lb = F.when(F.col("frame") == "1D", Levels().daily_lookback).otherwise(Levels().lookback)
    return lv.frame_summary(frames, KEYS, Structure(), Levels(), lb)


def summary(spark, sf):
    return summarize(_multi(spark, sf))


@register("frame_summary", "MT1 LV7", SUMM_COLS, SUMM + """,
out AS (SELECT *, len(walls) AS n_walls FROM summ)""")
def frame_summary(spark, sf):
    return summary(spark, sf).withColumn("n_walls", F.size("walls"))


@register("walls", "LV1 LV2", "symbol frame level:f touches:i lo:f hi:f", SUMM + """,
ex AS (SELECT symbol, frame, unnest(walls) AS wl FROM summ),
out AS (SELECT symbol, frame, wl.level AS level, wl.touches AS touches, wl.lo AS lo, wl.hi AS hi FROM ex)""")
def walls(spark, sf):
    return summary(spark, sf).select("symbol", "frame", F.explode("walls").alias("w")).select("symbol", "frame", "w.*")


LEVELS_SQL = """,
sr0 AS (SELECT *, list_filter(walls, lambda c: c.level > last + 0.25 * atr) AS up, list_filter(walls, lambda c: c.level < last - 0.25 * atr) AS dn,
  list_filter(walls, lambda c: c.touches >= 2 AND c.level > last) AS up2, list_filter(walls, lambda c: c.touches >= 2 AND c.level < last) AS dn2 FROM summ),
sr1 AS (SELECT *, list_min(list_transform(up, lambda c: c.level)) AS resistance, list_max(list_transform(dn, lambda c: c.level)) AS support FROM sr0),
sr2 AS (SELECT *, coalesce(list_min(list_transform(list_filter(up, lambda c: c.level = resistance), lambda c: c.touches)), 0) AS res_touches,
  coalesce(list_max(list_transform(list_filter(dn, lambda c: c.level = support), lambda c: c.touches)), 0) AS sup_touches,
  round_even((list_min(list_transform(up2, lambda c: c.level)) - last) / atr, 2) AS head_up,
  round_even((last - list_max(list_transform(dn2, lambda c: c.level))) / atr, 2) AS head_dn FROM sr1),
zs AS """ + zone_sql("symbol, frame", "sr2", "support") + ",\nzr AS " + zone_sql("symbol, frame", "sr2", "resistance") + """,
sr AS (SELECT sr2.*, coalesce(zs.visits, 0) AS sup_visits, coalesce(zs.bars, 0) AS sup_bars, coalesce(zs.time_pct, 0) AS sup_time_pct,
  coalesce(zr.visits, 0) AS res_visits, coalesce(zr.bars, 0) AS res_bars, coalesce(zr.time_pct, 0) AS res_time_pct
  FROM sr2 LEFT JOIN zs USING (symbol, frame) LEFT JOIN zr USING (symbol, frame))"""
SR = SUMM + LEVELS_SQL
SR_COLS = ("symbol frame support:f sup_touches:i resistance:f res_touches:i head_up:f head_dn:f sup_visits:i sup_bars:i sup_time_pct:f "
           "res_visits:i res_bars:i res_time_pct:f")
REPORT_SQL = """,
lx AS (SELECT symbol, frame, last, atr, unnest(walls) AS wl FROM summ),
ly AS (SELECT symbol, frame, last, atr, wl.level AS level, wl.touches AS touches FROM lx),
zz AS """ + zone_sql("symbol, frame", "ly", "level") + """,
out AS (SELECT ly.symbol, ly.frame, ly.level, 100 * (ly.level - last) / last AS dist_pct, touches, visits, bars, closes, time_pct,
  CASE WHEN ly.level > last THEN 'RES' ELSE 'SUP' END AS side FROM ly JOIN zz USING (symbol, frame, level))"""
REPORT_COLS = "symbol frame level:f dist_pct:f touches:i visits:i bars:i closes:i time_pct:f side"


@register("sr_levels", "LV3 LV4", SR_COLS, SR + ", out AS (SELECT * FROM sr)")
def sr_levels(spark, sf):
    return lv.sr_levels(summary(spark, sf))


@register("levels_report", "E9 LV3", REPORT_COLS, SUMM + REPORT_SQL)
def levels_report(spark, sf):
    return lv.levels_report(summary(spark, sf), KEYS)
