"""Bars, closing stretch and triggers on the real session clock, 09:15 to 15:30.

The event stream runs around the clock; each of its days is laid onto the 375 minutes of a session."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as bo
from ..params import VOLUME_PROFILE, Session, Signal
from ..session import stage
from ..sources import testdata as td
from .bar_queries import OHLC, agg_sql
from .spec import register

S = Session()
SPAN, FINE = S.close_min - S.open_min, 15
FRAMES = {"1h": 60, "2h": 120, "4h": 240, "50m": 50}

BARS = f"""
laid AS (SELECT event_type AS symbol, event_id, value, date_trunc('day', ts) AS d0,
  CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * {SPAN} / 86400.0) AS INT) + {S.open_min} AS minute FROM events),
fine AS (SELECT symbol, d0 + to_minutes(minute // {FINE} * {FINE}) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*) AS volume FROM laid GROUP BY symbol, d0, minute // {FINE})"""


def slot_sql(m: int) -> str:
    last = -(-SPAN // m) - 1
    slot = f"CAST(floor((hour(ts) * 60 + minute(ts) - {S.open_min}) / {m}.0) AS INT)"
    folded = f"least({slot}, {last - 1 if last > 0 and SPAN - last * m < m / 2 else last})"
    return f"date_trunc('day', ts) + to_minutes({S.open_min} + {slot} * {m}) AS bts, CAST(ts AS DATE) AS d, {folded} AS slot"


def fine_bars(spark, sf):
    t = td.ticks(spark, sf)
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    at = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.floor(seconds * SPAN / 86400.0) + S.open_min).cast("int"))
    return td.fold_ticks(t.withColumn("ts", at), FINE)


@register("session_frames", "RS1 RS2 MT1 J20", f"symbol frame ts:t {OHLC}", BARS + ",\nk AS (" + "\nUNION ALL ".join(
    f"SELECT *, '{name}' AS frame, {slot_sql(m)} FROM fine" for name, m in FRAMES.items()) + f"), out AS ({agg_sql('symbol, frame')} FROM k GROUP BY symbol, frame, d, slot)")
def session_frames(spark, sf):
    return bo.multi_frame(fine_bars(spark, sf), FRAMES, (), None, S)


@register("session_close_vwap", "A26", "symbol d:d vwap:f close30:f", BARS + f""",
t AS (SELECT *, CAST(ts AS DATE) AS d, (high + low + close) / 3 AS tp, hour(ts) * 60 + minute(ts) >= {S.last30_min} AS late FROM fine),
out AS (SELECT symbol, d, sum(tp * volume) / sum(volume) AS vwap, sum(tp * volume) FILTER (late) / nullif(sum(volume) FILTER (late), 0) AS close30 FROM t GROUP BY 1, 2)""")
def session_close_vwap(spark, sf):
    b = stage(fine_bars(spark, sf).withColumn("d", F.to_date("ts")))
    return bo.session_vwap(b, ["symbol", "d"]).join(bo.last_minutes_vwap(b, ["symbol", "d"]), ["symbol", "d"])


LIMITS = Signal(vol_ratio=0.5)


@register("session_trigger", "W32 W31 STR4s", "symbol d:d entered:t at:r", BARS + f""",
t AS (SELECT *, CAST(ts AS DATE) AS d, (high + low + close) / 3 AS tp, hour(ts) * 60 + minute(ts) + {FINE} AS closes FROM fine),
r0 AS (SELECT *, sum(volume) OVER w AS cv, sum(tp * volume) OVER w / sum(volume) OVER w AS rv, max(high) OVER w AS rh, min(low) OVER w AS rl
  FROM t WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)),
dl AS (SELECT symbol, d, arg_max(close, ts) AS dc, sum(volume) AS dv FROM t GROUP BY 1, 2),
bl AS (SELECT symbol, d, lag(dc) OVER w AS pc, median(dv) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ref
  FROM dl WINDOW w AS (PARTITION BY symbol ORDER BY d)),
prof AS (SELECT {list(VOLUME_PROFILE)}::DOUBLE[] AS f),
hit AS (SELECT r0.*, f[CAST(least(greatest(floor((closes - 555) / 5.0), 0), {len(VOLUME_PROFILE) - 1}) AS INT) + 1] AS part, pc, ref FROM r0 JOIN bl USING (symbol, d) CROSS JOIN prof),
out AS (SELECT symbol, d, min(ts) AS entered, arg_min(close, ts) AS "at" FROM hit WHERE pc <> 0 AND close / pc - 1 >= 0.01::DOUBLE
  AND CASE WHEN rh > rl THEN (close - rl) / (rh - rl) ELSE 0.5 END >= 0.7::DOUBLE AND CASE WHEN rv > 0 THEN (close - rv) / rv ELSE 0 END >= 0.005::DOUBLE
  AND CASE WHEN coalesce(ref > 0, FALSE) THEN cv / ref / part >= 0.5 ELSE TRUE END GROUP BY 1, 2)""")
def session_trigger(spark, sf):
    b = stage(fine_bars(spark, sf).withColumn("d", F.to_date("ts")))
    w = Window.partitionBy("symbol").orderBy("d")
    daily = b.groupBy("symbol", "d").agg(F.max_by("close", "ts").alias("_c"), F.sum("volume").alias("_v"))
    base = daily.select("symbol", "d", F.lag("_c").over(w).alias("prev_close"), F.percentile("_v", F.lit(0.5)).over(w.rowsBetween(-10, -1)).alias("ref_volume"))
    run = bo.running_session(b, ["symbol", "d"]).join(base, ["symbol", "d"])
    return bo.first_trigger(run, ["symbol", "d"], LIMITS, FINE, rs=False)
