"""Streams in several batches give the batch answer; late rows are dropped, fired triggers stay."""
import datetime as dt

from pyspark.sql import functions as F

from tapeloom.operators import bars as bo
from tapeloom.session import shared_dir
from tapeloom.streaming import live, run

T0 = dt.datetime(2024, 1, 1, 9, 15)
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, prev_close double"


def batches(spark, groups, schema):
    """One file per batch, in order."""
    import time
    import uuid
    path = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    for g in groups:
        spark.createDataFrame(g, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return run.read_files(spark, path, spark.createDataFrame([], schema).schema, 1)


def bar(i, px, symbol="A", day=0):
    px = float(px)
    return (symbol, T0 + dt.timedelta(days=day, minutes=5 * i), px, px + 0.2, px - 0.2, px, 10.0, 100.0)


def test_running_session_over_batches_equals_batch(spark):
    rows = [bar(i, 100 + (i * 7) % 5, s, d) for d in range(2) for i in range(20) for s in "AB"]
    parts = [rows[:25], rows[25:55], rows[55:]]
    got = run.run_available(live.running_session_stream(batches(spark, parts, SCHEMA), "1 day"))
    want = bo.running_session(spark.createDataFrame(rows, SCHEMA).withColumn("d", F.to_date("ts")), ["symbol", "d"])
    cols = ["symbol", "ts", *[F.round(c, 8).alias(c) for c in ("run_high", "run_low", "run_vwap", "run_clr", "cum_volume")]]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_trigger_fires_once_per_session(spark):
    up = [bar(0, 100.0), bar(1, 101.5), bar(2, 103.0), bar(3, 104.0), bar(0, 100.0, day=1), bar(1, 102.0, day=1)]
    got = run.run_available(live.first_trigger_stream(batches(spark, [up[:2], up[2:4], up[4:]], SCHEMA), "1 day")).orderBy("day").collect()
    assert [(r.entered.hour, r.entered.minute, r["at"]) for r in got] == [(9, 20, 101.5), (9, 20, 102.0)]


def test_side_runs_continue_over_batches(spark):
    rows = [("A", T0 + dt.timedelta(minutes=i), s, 100.0 + i) for i, s in enumerate(["LONG", "LONG", "SHORT", "SHORT", "LONG"])]
    schema = "symbol string, ts timestamp, side string, close double"
    got = run.run_available(live.side_run_stream(batches(spark, [rows[:1], rows[1:3], rows[3:]], schema), "1 day")).orderBy("run_start").collect()
    assert [(r.side, r["at"]) for r in got] == [("LONG", 100.0), ("SHORT", 102.0), ("LONG", 104.0)]


def test_late_ticks_are_dropped_after_the_bar_closed(spark):
    schema = "symbol string, ts timestamp, event_id long, price double"
    t = lambda m: T0 + dt.timedelta(minutes=m)
    groups = [[("A", t(0), 1, 10.0), ("A", t(1), 2, 11.0)], [("A", t(20), 3, 12.0)], [("A", t(25), 6, 12.5)], [("A", t(2), 4, 99.0), ("A", t(40), 5, 13.0)]]
    got = run.run_available(live.bars_stream(batches(spark, groups, schema), 5, "1 minute")).orderBy("ts").collect()
    assert got[0]["high"] == 11.0 and got[0]["volume"] == 2.0
