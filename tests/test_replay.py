"""Replayed events: offsets, restarts, state over batches, late rows and pinned boards that count once."""
import datetime as dt

from pyspark.sql import functions as F

from tapeloom.operators import bars as bo
from tapeloom.params import Signal
from tapeloom.session import shared_dir, stage
from tapeloom.sources.replay import ReplayReader, replay
from tapeloom.streaming import pinned, run, stateful
from tapeloom.streaming.late import LateRows
from .test_streaming import SCHEMA, T0, bar


def stored(spark, rows, schema, files=2):
    import uuid
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    for k in range(files):
        part = rows[k * len(rows) // files:(k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
    # one folder with files in order, as a table that was written sorted has them
    out = stage(spark.read.parquet(*[f"{path}/{k}" for k in range(files)]).orderBy("ts").coalesce(1))
    return out.inputFiles()[0].rsplit("/", 1)[0], out.schema


def source(spark, rows, schema, per_batch):
    path, kind = stored(spark, rows, schema)
    return lambda progress: replay(spark, path, kind, per_batch, progress)


def test_reader_offsets_and_slices(spark, tmp_path):
    path, kind = stored(spark, [bar(i, 100 + i) for i in range(25)], SCHEMA)
    options = {"path": path, "rows": "10", "slice": "4", "progress": f"file://{tmp_path}"}
    r = ReplayReader(kind, options)
    assert r.initialOffset() == {"row": 0} and [r.latestOffset()["row"] for _ in range(4)] == [10, 20, 25, 25]
    parts = r.partitions({"row": 3}, {"row": 17})
    assert [(p.start, p.stop) for p in parts] == [(3, 7), (7, 11), (11, 15), (15, 17)] and r.partitions({"row": 5}, {"row": 5}) == []
    got = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    assert [g["close"] for g in got] == [103.0 + i for i in range(14)]
    assert ReplayReader(kind, options).latestOffset() == {"row": 25}
    assert ReplayReader(kind, {"path": str(tmp_path / "none") + "/"} | {"path": f"file://{tmp_path}"}).latestOffset() == {"row": 0}


def test_session_totals_survive_a_restart(spark):
    rows = [bar(i, 100 + (i * 7) % 5, s, d) for d in range(2) for i in range(12) for s in "AB"]
    rows.sort(key=lambda r: r[1])
    make = source(spark, rows, SCHEMA, 13)
    r = run.Replayed(spark, lambda progress: stateful.running_session(make(progress), "1 day"), len(rows)).run(stop_after=2).run()
    want = bo.running_session(spark.createDataFrame(rows, SCHEMA).withColumn("d", F.to_date("ts")), ["symbol", "d"])
    cols = ["symbol", "ts", *[F.round(c, 8).alias(c) for c in ("run_high", "run_low", "run_vwap", "run_clr", "cum_volume")]]
    assert len(r.batches) >= 3
    assert sorted(map(str, r.table().select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_batches_are_cut_alike_after_a_stop(spark):
    """A stop that comes after an offset was handed out and before Spark logged it."""
    path, kind = stored(spark, [bar(i, 100 + i) for i in range(50)], SCHEMA)
    seen = {}
    r = run.Replayed(spark, lambda progress: replay(spark, path, kind, 10, progress), 50, writer=lambda b, i: seen.update({i: b.count()}))
    r.run(stop_after=1)
    for _ in range(2):
        ReplayReader(kind, {"path": path, "rows": "10", "progress": f"{r.base}/progress"}).latestOffset()
    r.run()
    assert seen == {i: 10 for i in range(5)}


def test_trigger_reads_baselines_and_fires_once(spark):
    up = [bar(i, 100 + i) for i in range(6)] + [bar(i, 100 + i, "B") for i in range(6)] + [bar(i, 100 + i, "C") for i in range(6)]
    schema = SCHEMA + ", idx_ret double"
    rows = sorted([(*r, 0.0) for r in up], key=lambda r: r[1])
    base = spark.createDataFrame([("A", T0.date(), 100.0, None, None), ("B", T0.date(), 100.0, 1e9, None), ("C", T0.date(), 100.0, None, -5.0)],
                                 "symbol string, day date, prev_close double, ref_volume double, rs_base double")
    make = source(spark, rows, schema, 6)
    p = Signal(ret=0.02, clr=0.5, close_vs_vwap=0.0)
    got = run.Replayed(spark, lambda progress: stateful.first_trigger(make(progress), base, "1 day", p), len(rows)).run().table().collect()
    # B is not on pace, C is too weak against the index, a name without baselines has no trigger
    assert [(r["symbol"], r["entered"], r["at"]) for r in got] == [("A", T0 + dt.timedelta(minutes=10), 102.0)]


def test_late_rows_are_split_once(spark):
    schema = "symbol string, ts timestamp, price double"
    t = lambda m: T0 + dt.timedelta(minutes=m)
    sink = LateRows(spark, f"{shared_dir(spark)}/late-test", 60)
    batches = [[("A", t(0), 1.0), ("A", t(10), 2.0)], [("A", t(8), 3.0), ("A", t(9), 4.0), ("A", t(12), 5.0)], [], [("A", t(10), 6.0), ("A", None, 7.0)]]
    for i, b in enumerate(batches):
        for _ in range(2):                                   # every batch comes twice
            sink(spark.createDataFrame(b, schema), i)
    again = LateRows(spark, sink.path, 60)
    assert [(r["batch"], r["kept"], r["late"]) for r in again.marks().orderBy("batch").collect()] == [(0, 2, 0), (1, 2, 1), (2, 0, 0), (3, 1, 1)]
    assert sorted(r["price"] for r in again.rows(True).collect()) == [3.0, 6.0] and again.rows(False).count() == 5


def test_pinned_boards_count_a_batch_once(spark):
    pins = [T0, T0 + dt.timedelta(hours=1)]
    reprice = lambda board, q: board.join(q, "symbol", "left").withColumn("px", F.coalesce("lp", "px")).withColumn("hits", F.col("hits") + 1).drop("lp")
    sink = pinned.PinnedBoards(spark, f"{shared_dir(spark)}/pins-test", reprice)
    sink.pin(spark.createDataFrame([(p, s, 10.0, 0) for p in pins for s in "AB"], "pin timestamp, symbol string, px double, hits int"))
    q = lambda rows: spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), float(x)) for s, m, x in rows], "symbol string, ts timestamp, lp double")
    sink(q([("A", -5, 1), ("A", 5, 11), ("A", 9, 12)]), 0)
    sink(q([("A", 70, 13), ("A", 20, 14), ("Z", 30, 1)]), 1)
    sink(q([("A", 90, 99)]), 1)                              # a committed batch with other rows
    got = {(r["pin"], r["symbol"]): (r["px"], r["hits"]) for r in sink.current().collect()}
    assert got == {(pins[0], "A"): (14.0, 1), (pins[0], "B"): (10.0, 0), (pins[1], "A"): (13.0, 1), (pins[1], "B"): (10.0, 0)}


def test_board_of_many_cuts_equals_a_run_for_each(spark):
    """On the real session clock; a bar after the cut changes nothing."""
    from tapeloom.operators import boards as bd
    from tapeloom.params import Session
    import random
    rng = random.Random(6)
    day = lambda d: dt.date(2024, 1, d)
    rows = []
    for d in (2, 3):
        for s in "ABCD":
            px = 100.0
            for i in range(75):
                px *= 1 + rng.uniform(-0.004, 0.006)
                rows.append((s, day(d), dt.datetime(2024, 1, d, 9, 15) + dt.timedelta(minutes=5 * i), px, px * 1.002, px * 0.998, px * 1.001, float(rng.randrange(50, 200))))
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    ref = spark.createDataFrame([(day(d), s, "X", 99.0, 5000.0, 2.0, 70.0, 0.1) for d in (2, 3) for s in "ABCD"],
                                "trade_date date, symbol string, sector string, ref_close double, vol_med20 double, atr14 double, deliv_trail double, rs_cum9 double")
    index = bars.groupBy("trade_date", "ts").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    gate = spark.createDataFrame([(day(2), True), (day(3), True)], "trade_date date, up boolean")
    events = spark.createDataFrame([("D", day(4), "results")], "symbol string, date date, purpose string")
    cuts = [(day(2), dt.datetime(2024, 1, 2, 9, 14), 554), (day(2), dt.datetime(2024, 1, 2, 11, 2), 662), (day(3), dt.datetime(2024, 1, 3, 15, 25), 925)]
    schema = "trade_date date, cut timestamp_ntz, minute int"
    p = Signal(clr=0.5, vol_ratio=0.5, ret=0.001, close_vs_vwap=0.0)

    def board(b, c):
        return sorted(map(str, bd.asof_board(b, spark.createDataFrame(c, schema), ref, index, gate, events, p, Session()).drop("_tp").collect()))
    together = board(bars, cuts)
    assert len(together) == 8                                # nothing had traded at the first cut
    assert together == sorted(r for c in cuts for r in board(bars.where(F.col("ts") <= F.lit(c[1])), [c]))
    assert any("EARNINGS" in r for r in together)
