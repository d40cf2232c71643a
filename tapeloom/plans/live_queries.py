"""Boards as of a cut and on a frame, and the live operators over replayed events in many batches."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import bars as bo
from ..operators import boards as bd
from ..operators import regime as rg
from ..params import Session, Signal
from ..session import shared_dir, stage
from ..sources import testdata as td
from ..sources.replay import replay
from ..streaming import pinned, run, stateful
from ..streaming.late import LateRows
from . import bar_queries as bq
from . import base as B
from . import board_queries as bdq
from .bar_queries import ANATOMY, BARS, FULL, RUN, TRIG, agg_sql, slot_sql
from .base import CALENDAR
from .board_queries import BOARD, EXTRA
from .panel_queries import REF
from .spec import register

# --- the board as of a cut -----------------------------------------------------------------------
#: Session (a month here), its cut, and the clock the cut stands for.
CUTS = [("1999-03-01", "1999-03-10", "10:40"), ("1999-03-01", "1999-03-24", "15:15"), ("2000-06-01", "2000-06-16", "13:00"), ("2000-11-01", "2000-11-30", "15:25")]


def _minute(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:])


_CUT_SQL = ", ".join(f"(DATE '{d}', DATE '{c}', {_minute(t)})" for d, c, t in CUTS)
_BTST = " + ".join(bdq._num(x) for x in ("clr >= 0.45", "day_raw >= 0", "pace >= 0.5", "rs_cum > -50", "cv >= -0.5"))
_ANATOMY = (ANATOMY.replace("high", "rh").replace("low", "rl").replace("close", "c").replace("open", "o")
            .replace("strong_c", "strong_close").replace("weak_c", "weak_close"))
ASOF_SQL = REF + EXTRA + CALENDAR + f""",
cuts AS (SELECT * FROM (VALUES {_CUT_SQL}) t(trade_date, cut, minute)),
ixb AS (SELECT trade_date, day, avg(open) AS open, avg(close) AS close FROM sb GROUP BY 1, 2),
mv AS (SELECT *, close / first_value(open) OVER (PARTITION BY trade_date ORDER BY day) - 1 AS idx_ret FROM ixb),
pre AS (SELECT s.symbol, s.trade_date, s.day, s.close AS c, n.sector, n.ref_close AS pc, n.vol_med20, coalesce(n.atr14, 0) AS atr, coalesce(n.deliv_trail, 0) AS dtr, n.rs_cum9,
    first_value(s.open) OVER w AS o, max(high) OVER w AS rh, min(low) OVER w AS rl, sum(volume) OVER w AS cv0,
    CASE WHEN sum(volume) OVER w > 0 THEN sum(tp * volume) OVER w / sum(volume) OVER w ELSE s.close END AS rv, mv.idx_ret
  FROM sbt s JOIN nref n USING (symbol, trade_date) JOIN mv USING (trade_date, day) WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY day ROWS UNBOUNDED PRECEDING)),
tg2 AS (SELECT symbol, trade_date, min(day) AS entered, arg_min(c, day) AS at_px FROM pre WHERE pc <> 0 AND c / pc - 1 >= 0
  AND CASE WHEN rh > rl THEN (c - rl) / (rh - rl) ELSE 0.5 END >= 0.45::DOUBLE AND (c - rv) / rv >= -0.5::DOUBLE
  AND CASE WHEN rs_cum9 IS NULL THEN TRUE ELSE rs_cum9 + (c / pc - 1) - coalesce(idx_ret, 0) > -50 END GROUP BY 1, 2),
at0 AS (SELECT p.* EXCLUDE (idx_ret), cut, minute FROM cuts JOIN pre p ON p.trade_date = cuts.trade_date AND p.day <= cuts.cut
  QUALIFY row_number() OVER (PARTITION BY symbol, cut ORDER BY p.day DESC) = 1),
ixc AS (SELECT cut, 100 * arg_max(idx_ret, day) AS idx_pct FROM cuts JOIN mv ON mv.trade_date = cuts.trade_date AND mv.day <= cuts.cut GROUP BY 1),
gate10 AS (SELECT trade_date, coalesce(close_val > CASE WHEN count(close_val) OVER g = 10 THEN avg(close_val) OVER g END, FALSE) AS up
  FROM idx WINDOW g AS (ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
prof AS (SELECT [{", ".join(str(v) for v in bdq.P.VOLUME_PROFILE)}]::DOUBLE[] AS f),
at1 AS (SELECT a.*, idx_pct, coalesce(up, FALSE) AS risk_on, CASE WHEN entered <= a.cut THEN entered END AS entered, CASE WHEN entered <= a.cut THEN at_px END AS at_px,
  EXISTS (SELECT 1 FROM cal k WHERE k.symbol = a.symbol AND k.date > a.trade_date AND k.date <= a.trade_date + 3) AS earn,
  CASE WHEN rh <= rl THEN 0.5 ELSE round_even((c - rl) / (rh - rl), 3) END AS clr, {_ANATOMY} AS character, 100 * (c / pc - 1) AS day_raw, (c - rv) / nullif(rv, 0) AS cv,
  CASE WHEN cv0 > 0 THEN cv0 / CASE WHEN vol_med20 > 0 THEN vol_med20 END / f[CAST(least(greatest(floor((minute - 555) / 5.0), 0), 74) AS INT) + 1] END AS pace
  FROM at0 a CROSS JOIN prof LEFT JOIN ixc USING (cut) LEFT JOIN gate10 g ON g.trade_date = a.trade_date LEFT JOIN tg2 ON tg2.symbol = a.symbol AND tg2.trade_date = a.trade_date WHERE pc <> 0),
at2 AS (SELECT *, day_raw - idx_pct AS rs, rs_cum9 + (day_raw - idx_pct) / 100 AS rs_cum FROM at1),
at3 AS (SELECT *, {_BTST} AS btst, {bdq._num('clr <= 1 - 0.45::DOUBLE')} + {bdq._num('day_raw <= 0')} + {bdq._num('pace >= 0.5')} + CASE WHEN coalesce(rs < 0, TRUE) THEN 1 ELSE 0 END AS sready FROM at2),
out AS (SELECT cut, symbol, sector, c AS ltp, btst, CASE WHEN earn THEN 'EARNINGS' WHEN NOT risk_on THEN 'AVOID' WHEN btst >= 5 AND dtr >= 20 AND minute >= 910 THEN 'BTST-CARRY'
    WHEN btst >= 4 THEN 'FORMING' WHEN coalesce(clr <= 0.33 OR day_raw < 0, FALSE) THEN 'AVOID' ELSE 'NEUTRAL' END AS action,
  CASE WHEN sready >= 4 AND character IN ('marubozu_bear', 'shooting_star', 'weak_close') THEN 'SHORT' WHEN sready >= 3 THEN 'WEAK' ELSE '—' END AS sell, character, clr,
  round_even(day_raw, 2) AS day_pct, round_even(rs, 2) AS rs_pct, round_even(100 * rs_cum, 2) AS rs_cum_pct, round_even(pace, 2) AS vol_x, round_even(100 * cv, 2) AS cvwap_pct,
  round_even(dtr, 1) AS deliv_tr, CAST(entered AS TIMESTAMP) AS entered, at_px AS trigger_px, CASE WHEN at_px > 0 THEN round_even(100 * (c / at_px - 1), 2) END AS since_pct,
  CASE WHEN atr > 0 AND c > 0 THEN round_even(CASE WHEN rl <> 0 AND rl < c THEN greatest(c - atr, rl) ELSE c - atr END, 2) END AS stop FROM at3)"""


def cut_table(spark, cuts=CUTS):
    rows = [(dt.date.fromisoformat(d), dt.datetime.fromisoformat(c), _minute(t)) for d, c, t in cuts]
    return spark.createDataFrame(rows, "trade_date date, cut timestamp_ntz, minute int")


def asof(spark, sf, cuts=CUTS):
    b = B.session_bars(spark, sf)
    index = b.groupBy("trade_date", "ts").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return bd.asof_board(b, cut_table(spark, cuts), bdq._next_ref(spark, sf).drop("prev_close"), index, rg.regime_gate(B.index(spark, sf), BOARD),
                         B.calendar(spark, sf), BOARD, pace=False)


@register("asof_board", "MT6 F12", "cut:d symbol sector ltp:r btst:i action sell character clr:f day_pct:f rs_pct:f rs_cum_pct:f vol_x:f cvwap_pct:f deliv_tr:f entered:t trigger_px:r "
          "since_pct:f stop:f", ASOF_SQL)
def asof_board(spark, sf):
    return asof(spark, sf)


# --- the shortlist board on one frame ------------------------------------------------------------
TF = Signal(ret=0.001, liq_lacs=0.0001, regime_ma=10)
TF_SQL = f"""
fine AS (SELECT event_type || '-' || user_id % 6 AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
k4 AS (SELECT *, {slot_sql(240)} FROM fine), h4 AS ({agg_sql('symbol')} FROM k4 GROUP BY symbol, d, slot),
tday AS (SELECT max(CAST(ts AS DATE)) AS t FROM fine),
tq AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c, sum(volume) AS v FROM fine JOIN tday ON CAST(ts AS DATE) = t GROUP BY 1),
tp AS (SELECT symbol, arg_max(close, ts) AS tpc FROM fine JOIN tday ON CAST(ts AS DATE) < t GROUP BY 1),
tz AS (SELECT symbol, tpc, 100 * (c / tpc - 1) AS dayp, (c - l) / (h - l) AS tclr FROM tq JOIN tp USING (symbol) WHERE h <> l AND v * (h + l + c) / 3 / 100000 >= 0.0001),
short AS (SELECT * FROM (SELECT 'UP' AS list, * FROM tz WHERE dayp >= 0.1 AND tclr >= 0.5 ORDER BY tclr DESC, dayp DESC, symbol LIMIT 8)
  UNION ALL SELECT * FROM (SELECT 'DOWN' AS list, * FROM tz WHERE dayp <= -0.1 AND tclr <= 0.5 ORDER BY tclr, dayp, symbol LIMIT 4)),
tix AS (SELECT d, avg(close) AS v FROM (SELECT symbol, CAST(ts AS DATE) AS d, arg_max(close, ts) AS close FROM fine GROUP BY 1, 2) GROUP BY 1),
tiy AS (SELECT d, 100 * (v / lag(v) OVER (ORDER BY d) - 1) AS ixp, coalesce(v > CASE WHEN count(v) OVER g = 10 THEN avg(v) OVER g END, FALSE) AS up
  FROM tix WINDOW g AS (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
tnow AS (SELECT ixp, up FROM tiy JOIN tday ON d = t)""" + bdq.frame_sql("(SELECT ixp FROM tnow)") + """,
tfb AS (SELECT fb.*, list FROM fb JOIN short USING (symbol))"""


@register("timeframe_board", "MT4 F17 SC19", "symbol list ltp:r day_pct:f rs_pct:f bar_clr:f above_vwap:b rsi7:f tone entry:f stop:f t1:f action sell struct span", TF_SQL + f""",
out AS (SELECT *, CASE WHEN NOT (SELECT up FROM tnow) THEN 'AVOID' ELSE {bdq._FA} END AS action, {bdq._FS} AS sell, round_even(ltp, 2) AS entry,
  CASE WHEN atr > 0 AND ltp > 0 THEN round_even(CASE WHEN day_low <> 0 AND day_low < ltp THEN greatest(ltp - atr, day_low) ELSE ltp - atr END, 2) END AS stop,
  CASE WHEN atr > 0 AND ltp > 0 THEN round_even(ltp + atr, 2) END AS t1, strftime(ts, '%H:%M') || '-' || strftime(ts + INTERVAL 240 MINUTES, '%H:%M') AS span FROM tfb)""")
def timeframe_board(spark, sf):
    fine = stage(td.fold_ticks(td.named_ticks(spark, sf), 60))
    closes = fine.groupBy("symbol", F.to_date("ts").alias("trade_date")).agg(F.max_by("close", "ts").alias("close"))
    index = stage(closes.groupBy("trade_date").agg(F.avg("close").alias("close_val")))
    from ..functions.rolling import axis
    moves = index.select("trade_date", (100 * (F.col("close_val") / F.lag("close_val").over(axis()) - 1)).alias("idx_pct"))
    return bd.timeframe_board(fine, bo.resample(fine, 240, FULL), moves, rg.regime_gate(index, TF), 240, bq.NOW, 8, TF, FULL)


# --- live operators over replayed events ---------------------------------------------------------
DELAY = "1 hour"


def _zoned(df):
    return df.select(*[F.col(n).cast("timestamp").alias(n) if k == "timestamp_ntz" else F.col(n) for n, k in df.dtypes])


def _replayed(spark, df, order, batches=4):
    """A function that makes the stream of df's rows in order, cut into so many batches, and their number."""
    t = stage(_zoned(df).orderBy(*order))
    folder, n = t.inputFiles()[0].rsplit("/", 1)[0], t.count()
    return (lambda progress: replay(spark, folder, t.schema, max(-(-n // batches), 1), progress)), n


def _restarted(spark, make, n):
    """Run a replay for one batch, stop, and go on from the checkpoint to the end."""
    return run.Replayed(spark, make, n).run(stop_after=1).run().table()


@register("replayed_session", "STR3s SRC18 W31", "symbol ts:t run_high:f run_low:f run_vwap:f run_clr:f cum_volume:i", RUN + ", out AS (SELECT * FROM run)")
def replayed_session(spark, sf):
    source, n = _replayed(spark, td.bars(spark, sf, 60), ["ts", "symbol"])
    return _restarted(spark, lambda progress: stateful.running_session(source(progress), DELAY), n)


@register("replayed_trigger", "STR4s SRC18 W32", "symbol d:d entered:t at:r", TRIG + ", out AS (SELECT * FROM trg)")
def replayed_trigger(spark, sf):
    """All five legs: pace and relative strength read the baselines the state starts from."""
    r, _ = bq.trigger_inputs(spark, sf)
    r = stage(r)
    base = stage(_zoned(r.select("symbol", F.col("d").alias("day"), "prev_close", "ref_volume", "rs_base").distinct()))
    source, n = _replayed(spark, r.select("symbol", "ts", "high", "low", "close", "volume", "idx_ret"), ["ts", "symbol"])
    return _restarted(spark, lambda progress: stateful.first_trigger(source(progress), base, DELAY, bq.TRIGGER_P, 60), n).withColumnRenamed("day", "d")


@register("replayed_side_runs", "STR6s SRC18 W34", "symbol side run_start:t at:r", BARS + """,
sd AS (SELECT *, CASE WHEN close >= open THEN 'LONG' ELSE 'SHORT' END AS side, CAST(ts AS DATE) AS d FROM fine),
fl AS (SELECT *, lag(side) OVER (PARTITION BY symbol, d ORDER BY ts) AS ps FROM sd),
out AS (SELECT symbol, side, ts AS run_start, close AS "at" FROM fl WHERE ps IS NULL OR ps <> side)""")
def replayed_side_runs(spark, sf):
    b = td.bars(spark, sf, 60).withColumn("side", F.when(F.col("close") >= F.col("open"), "LONG").otherwise("SHORT"))
    source, n = _replayed(spark, b.select("symbol", "ts", "side", "close"), ["ts", "symbol"])
    return _restarted(spark, lambda progress: stateful.side_runs(source(progress), DELAY), n)


LATE_BATCHES = 6


@register("stream_late_rows", "STR10s SRC18", "batch:i newest:t kept:i late:i late_rows:i late_value:f4", f"""
o AS (SELECT *, row_number() OVER (ORDER BY ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL 5 HOURS ELSE INTERVAL 0 HOURS END, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
b AS (SELECT *, pos // CAST(ceil(n / {LATE_BATCHES}.0) AS BIGINT) AS batch FROM o),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) AS newest FROM b GROUP BY 1),
w AS (SELECT batch, newest, lag(newest) OVER (ORDER BY batch) - INTERVAL 1 HOUR AS bound FROM m),
out AS (SELECT b.batch, any_value(newest) AS newest, count(*) FILTER (NOT coalesce(ts < bound, FALSE)) AS kept, count(*) FILTER (coalesce(ts < bound, FALSE)) AS late,
  count(*) FILTER (coalesce(ts < bound, FALSE)) AS late_rows, coalesce(sum(value) FILTER (coalesce(ts < bound, FALSE)), 0) AS late_value FROM b JOIN w USING (batch) GROUP BY 1)""")
def stream_late_rows(spark, sf):
    """Every eleventh print comes five hours after its time; counts and rows of those behind the watermark."""
    t = td.table(spark, sf, "events")
    held = t.withColumn("_at", F.col("ts") + F.make_dt_interval(hours=F.when(F.col("event_id") % 11 == 0, 5).otherwise(0)))
    source, n = _replayed(spark, held, ["_at", "event_id"], LATE_BATCHES)
    sink = LateRows(spark, f"{shared_dir(spark)}/late-{uuid.uuid4().hex}", 3600)
    run.Replayed(spark, source, n, writer=sink).run(stop_after=2).run()
    side = sink.rows(True).groupBy("batch").agg(F.count("*").alias("late_rows"), F.sum("value").alias("late_value"))
    return sink.marks().join(side, "batch", "left").fillna(0, ["late_rows", "late_value"])


PINS = ["2024-01-20 10:00:00", "2024-01-26 16:00:00"]
_PIN_SQL = ", ".join(f"({i}, TIMESTAMP '{p}')" for i, p in enumerate(PINS))
PIN_SQL = BARS.replace("fine AS", "allbars AS") + f""",
pins AS (SELECT * FROM (VALUES {_PIN_SQL}) t(k, pin)),
fine AS (SELECT symbol || '@' || k AS symbol, ts, open, high, low, close, volume FROM allbars JOIN pins ON ts + INTERVAL 1 HOUR <= pin),
k4 AS (SELECT *, {slot_sql(240)} FROM fine), h4 AS ({agg_sql('symbol')} FROM k4 GROUP BY symbol, d, slot),
pix AS (SELECT k, d, avg(close) AS v FROM (SELECT split_part(symbol, '@', 2) AS k, symbol, CAST(ts AS DATE) AS d, arg_max(close, ts) AS close FROM fine GROUP BY 1, 2, 3) GROUP BY 1, 2),
piy AS (SELECT k, d, 100 * (v / lag(v) OVER o - 1) AS ixp, coalesce(v > CASE WHEN count(v) OVER g = 10 THEN avg(v) OVER g END, FALSE) AS up, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS b
  FROM pix WINDOW o AS (PARTITION BY k ORDER BY d), g AS (PARTITION BY k ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""" + bdq.frame_sql(
    "(SELECT ixp FROM piy WHERE b = 1 AND k = split_part(fb0.symbol, '@', 2))") + """,
quoted AS (SELECT event_type, ts, event_id, value, (SELECT max(k) FROM pins WHERE pin <= e.ts) AS k FROM events e),
lq AS (SELECT event_type || '@' || k AS symbol, arg_max(value, event_id) AS lp, max(ts) AS quote_ts FROM quoted WHERE k IS NOT NULL GROUP BY 1),
px AS (SELECT fb.*, CASE WHEN lp <> 0 THEN lp END AS lp, quote_ts, ixp, up FROM fb LEFT JOIN lq USING (symbol) JOIN piy ON b = 1 AND k = split_part(fb.symbol, '@', 2)),
rp AS (SELECT *, 100 * (lp / prev_close - 1) AS day2, CASE WHEN lp IS NULL THEN rs_pct ELSE round_even(100 * (lp / prev_close - 1) - ixp, 2) END AS rs2,
  CASE WHEN lp IS NULL THEN bar_clr WHEN greatest(bar_h, lp) > least(bar_l, lp) THEN round_even((lp - least(bar_l, lp)) / (greatest(bar_h, lp) - least(bar_l, lp)), 3) ELSE 0.5 END AS clr2,
  coalesce(lp, ltp) >= vwap AS vw2, coalesce(lp, ltp) AS p2 FROM px),
out AS (SELECT split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS version, quote_ts, CASE WHEN lp IS NULL THEN ltp ELSE round_even(lp, 2) END AS ltp,
  CASE WHEN lp IS NULL THEN day_pct ELSE round_even(day2, 2) END AS day_pct, rs2 AS rs_pct, clr2 AS bar_clr,
  round_even(CASE WHEN day_low <> 0 AND day_low < p2 THEN greatest(p2 - atr, day_low) ELSE p2 - atr END, 2) AS stop,
  CASE WHEN NOT up THEN 'AVOID' ELSE """ + bdq._RA + """ END AS action, """ + bdq._RS + """ AS sell, struct FROM rp)"""


def pinned_boards(spark, sf):
    """The frame board as it stood at each pin: bars closed by then, the index's move and gate of that day."""
    from pyspark.sql import Window
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(p).cast("timestamp_ntz").alias("pin")) for i, p in enumerate(PINS)])
    b = td.bars(spark, sf, 60).withColumn("v", F.explode(each)).where(F.col("ts") + F.make_dt_interval(hours=F.lit(1)) <= F.col("v.pin"))
    b = stage(b.select(F.concat_ws("@", "symbol", F.col("v.k").cast("string")).alias("symbol"), F.col("v.k").alias("k"), "ts", *bo.OHLCV))
    day = F.to_date("ts")
    closes = b.groupBy("k", "symbol", day.alias("d")).agg(F.max_by("close", "ts").alias("close"))
    w = Window.partitionBy("k").orderBy("d")
    ma = w.rowsBetween(-9, 0)
    index = closes.groupBy("k", "d").agg(F.avg("close").alias("v")).select(
        "k", "d", (100 * (F.col("v") / F.lag("v").over(w) - 1)).alias("idx_pct"),
        F.coalesce((F.count("v").over(ma) == 10) & (F.col("v") > F.avg("v").over(ma)), F.lit(False)).alias("risk_on"))
    index = index.groupBy("k").agg(F.max_by(F.struct("idx_pct", "risk_on"), "d").alias("i")).select(F.col("k").cast("string").alias("k"), "i.*")
    h4 = stage(bo.resample(b.drop("k"), 240, FULL))
    feat = bd.frame_features(h4, 240, bq.NOW, FULL).withColumn("k", F.element_at(F.split("symbol", "@"), 2)).join(index, "k")
    newest = h4.groupBy("symbol").agg(F.max(day).alias("_l"))
    prev = h4.join(newest, "symbol").where(day < F.col("_l")).groupBy("symbol").agg(F.max_by("close", "ts").alias("prev_close"))
    board = bd.frame_board(feat, prev, F.col("idx_pct"), F.col("risk_on"))
    pin = F.element_at(F.array(*[F.lit(p).cast("timestamp") for p in PINS]), F.col("k").cast("int") + 1)
    return _zoned(board.withColumn("symbol", F.element_at(F.split("symbol", "@"), 1)).withColumns({"pin": pin, "version": F.col("k")}).drop("k"))


@register("stream_pinned_board", "STR7s MT5 SRC18", "symbol version quote_ts:t ltp:f day_pct:f rs_pct:f bar_clr:f stop:f action sell struct", PIN_SQL)
def stream_pinned_board(spark, sf):
    """Quotes of all events against two versions of the board; a batch is offered twice on the way."""
    ticks = td.ticks(spark, sf).select("symbol", "ts", F.col("price").alias("lp"), "event_id")
    source, n = _replayed(spark, ticks, ["ts", "event_id"])
    sink = pinned.PinnedBoards(spark, f"{shared_dir(spark)}/pins-{uuid.uuid4().hex}",
                               lambda board, quotes: bd.reprice(board, quotes, F.col("idx_pct"), F.col("risk_on")))
    sink.pin(pinned_boards(spark, sf))
    run.Replayed(spark, source, n, writer=sink).run(stop_after=2).run()
    return sink.current()


@register("rescan_times", "STR9s SRC18", "day:d bucket:i ts:t", BARS + """,
c AS (SELECT CAST(ts AS DATE) AS day, CAST(floor((hour(ts) * 60 + minute(ts)) / CAST(240 AS DOUBLE)) AS INT) AS bucket, ts FROM fine),
out AS (SELECT day, bucket, min(ts) AS ts FROM c GROUP BY 1, 2)""")
def rescan_times(spark, sf):
    """The clock comes in order, so the first row of a bucket is the moment a scan is due."""
    from ..streaming import live
    source, n = _replayed(spark, td.bars(spark, sf, 60).select("ts").distinct(), ["ts"])
    return run.Replayed(spark, lambda progress: live.rescan_due(source(progress), 240, "1 day", FULL), n).run().table()
