"""Streaming operators, run over the event files to completion and compared with batch SQL."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as bo
from ..operators import shorthorizon as sh
from ..params import Signal
from ..session import stage
from ..sources import testdata as td
from ..streaming import live, run
from . import bar_queries as bq
from . import base as B
from .bar_queries import BARS, FULL, OHLC, RUN, agg_sql, slot_sql
from .base import LOOSE
from .panel_queries import LIVE_SQL
from .spec import register

DELAY = "1 hour"
CUT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _tick_stream(spark, sf):
    schema = td.table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def _stream_of(df):
    """A staged table as a stream; times become zoned, as event time needs."""
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    t = stage(df)
    path = t.inputFiles()[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(t.schema).parquet(path)


@register("stream_bars_1h", "STR1s STR8s STR10s", f"symbol ts:t {OHLC}", BARS + f", out AS (SELECT * FROM fine WHERE ts + INTERVAL 1 HOUR <= {CUT})")
def stream_bars_1h(spark, sf):
    return run.run_available(live.bars_stream(_tick_stream(spark, sf), 60, DELAY, FULL))


@register("stream_bars_7h", "STR1s STR8s RS2", f"symbol ts:t {OHLC}", f"""
k AS (SELECT event_type AS symbol, ts AS ets, event_id, value, {slot_sql(420)} FROM events),
g AS (SELECT symbol, CAST(d AS TIMESTAMP) + to_minutes(slot * 420) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*) AS volume FROM k GROUP BY symbol, d, slot),
out AS (SELECT * FROM g WHERE ts <= (SELECT max(ts) - INTERVAL 11 HOURS FROM g))""")
def stream_bars_7h(spark, sf):
    return run.run_available(live.bars_stream(_tick_stream(spark, sf), 420, "11 hours", FULL))


@register("stream_distinct_bars", "STR2s F15", f"symbol ts:t {OHLC}", BARS + ", out AS (SELECT * FROM fine)")
def stream_distinct_bars(spark, sf):
    b = td.bars(spark, sf, 60)
    twice = b.unionByName(b.where(F.hour("ts") % 2 == 0))
    return run.run_available(live.distinct_bars_stream(_stream_of(twice), DELAY))


@register("stream_running_session", "STR3s W31", "symbol ts:t run_high:f run_low:f run_vwap:f run_clr:f cum_volume:i", RUN + ", out AS (SELECT * FROM run)")
def stream_running_session(spark, sf):
    return run.run_available(live.running_session_stream(_stream_of(td.bars(spark, sf, 60)), DELAY))


@register("stream_first_trigger", "STR4s W32", "symbol d:d entered:t at:r", RUN + """,
pc AS (SELECT symbol, d, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS prev_close FROM (SELECT symbol, d, arg_max(close, ts) AS c FROM day GROUP BY 1, 2)),
out AS (SELECT symbol, d, min(ts) AS entered, arg_min(close, ts) AS "at" FROM run JOIN pc USING (symbol, d)
  WHERE prev_close <> 0 AND close / prev_close - 1 >= 0.01::DOUBLE AND run_clr >= 0.7::DOUBLE AND (close - run_vwap) / run_vwap >= 0.005::DOUBLE GROUP BY 1, 2)""")
def stream_first_trigger(spark, sf):
    b = td.bars(spark, sf, 60).withColumn("d", F.to_date("ts"))
    w = Window.partitionBy("symbol").orderBy("d")
    pc = (b.groupBy("symbol", "d").agg(F.max_by("close", "ts").alias("_c"))
          .select("symbol", "d", F.lag("_c").over(w).alias("prev_close")))
    s = _stream_of(b.join(pc, ["symbol", "d"]).where("prev_close IS NOT NULL").drop("d"))
    return run.run_available(live.first_trigger_stream(s, DELAY, Signal())).withColumnRenamed("day", "d")


@register("stream_first_seen", "STR5s SRC17", "symbol day:d first_seen:t", f"""
out AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, min(ts) AS first_seen FROM events GROUP BY 1, 2
  HAVING CAST(min(ts) AS DATE) + INTERVAL 1 DAY <= {CUT})""")
def stream_first_seen(spark, sf):
    return run.run_available(live.first_seen_stream(_tick_stream(spark, sf), DELAY))


@register("stream_side_runs", "STR6s W34", "symbol side run_start:t at:r", BARS + """,
sd AS (SELECT *, CASE WHEN close >= open THEN 'LONG' ELSE 'SHORT' END AS side, CAST(ts AS DATE) AS d FROM fine),
fl AS (SELECT *, lag(side) OVER (PARTITION BY symbol, d ORDER BY ts) AS ps FROM sd),
out AS (SELECT symbol, side, ts AS run_start, close AS "at" FROM fl WHERE ps IS NULL OR ps <> side)""")
def stream_side_runs(spark, sf):
    b = td.bars(spark, sf, 60).withColumn("side", F.when(F.col("close") >= F.col("open"), "LONG").otherwise("SHORT"))
    return run.run_available(live.side_run_stream(_stream_of(b.select("symbol", "ts", "side", "close")), DELAY))


@register("stream_latest_quotes", "STR7s SRC18", "symbol ts:t price:r", """
out AS (SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, ts) AS price FROM events GROUP BY 1)""")
def stream_latest_quotes(spark, sf):
    from ..session import shared_dir
    import uuid
    path = f"{shared_dir(spark)}/quotes-{uuid.uuid4().hex}"
    q = live.latest_quotes_stream(_tick_stream(spark, sf))
    run.run_batches(q, live.reprice_sink(None, path, lambda board, batch: batch))
    d = spark.read.parquet(path)
    newest = Window.partitionBy("symbol").orderBy(F.col("batch").desc())
    return d.withColumn("_k", F.row_number().over(newest)).where("_k = 1")


@register("stream_rescan_due", "STR9s", "day:d bucket:i", """
out AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(floor((hour(ts) * 60 + minute(ts)) / CAST(240 AS DOUBLE)) AS INT) AS bucket FROM events)""")
def stream_rescan_due(spark, sf):
    return run.run_available(live.rescan_due(_stream_of(td.bars(spark, sf, 60)), 240, "1 day", FULL))


@register("stream_live_gate", "STR11s W9", "trade_date:d live_close:f up:b", LIVE_SQL)
def stream_live_gate(spark, sf):
    ix = B.index(spark, sf)
    quotes = ix.select("trade_date", F.col("trade_date").cast("timestamp").alias("ts"),
                       (F.col("close_val") * (1 + ((F.month("trade_date") % 3) - 1) / 10.0)).alias("live_close"))
    prior = stage(live.prior_sums(ix, LOOSE))
    return run.run_available(live.gate_stream(_stream_of(quotes), prior, LOOSE))
