"""The state store: any order of updates gives the states of one fold; readers open the folders they need."""
import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tapeloom.session import shared_dir
from tapeloom.sources import states

SCHEMA = "symbol string, trade_date date, pos bigint, px double, qty double, value double, delivered boolean"
D0 = dt.date(2024, 1, 1)


def prints(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for pos in range(n):
        px, qty = round(rng.uniform(5, 50), 2), float(rng.randrange(1, 90))
        # one symbol has a third of all prints
        out.append((rng.choice("AAABCDEFG"), D0 + dt.timedelta(days=rng.randrange(12)), pos, px, qty, round(px * qty, 2), rng.random() < 0.5))
    return out


def store(spark, name):
    import uuid
    return states.SessionStore(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(str, df.collect()))


def test_updates_in_any_order_equal_one_fold(spark):
    p = prints()
    want = rows(states.fold(spark.createDataFrame(p, SCHEMA)).select("symbol", "trade_date", "first", "last", "high", "low", "qty", "cents", "delivered", "n"))
    shuffled = p[:]
    random.Random(4).shuffle(shuffled)
    s = store(spark, "any")
    for i in range(3):
        assert s.update(spark.createDataFrame(shuffled[i::3], SCHEMA), f"b{i}")
    assert rows(s.read()) == want
    assert not s.update(spark.createDataFrame(shuffled[0::3], SCHEMA), "b0")
    assert rows(states.SessionStore(spark, s.path).read()) == want


def test_new_sessions_leave_old_folders_alone(spark):
    p = prints()
    cut = D0 + dt.timedelta(days=9)
    s = store(spark, "new")
    s.update(spark.createDataFrame([r for r in p if r[1] < cut], SCHEMA), "old")
    s.update(spark.createDataFrame([r for r in p if r[1] >= cut], SCHEMA), "new")
    assert s.manifest()[1] == {D0 + dt.timedelta(days=i): 1 if i < 9 else 2 for i in range(12)}
    late = [("Z", D0, 10_000, 1.0, 1.0, 1.0, True)]
    s.update(spark.createDataFrame(late, SCHEMA), "late")
    assert s.manifest()[1][D0] == 3 and s.manifest()[1][D0 + dt.timedelta(days=1)] == 1
    files = s.read(cut, cut + dt.timedelta(days=1)).inputFiles()
    assert files and all("commit=2" in f and any(f"trade_date={cut + dt.timedelta(days=k)}" in f for k in (0, 1)) for f in files)
    assert s.sessions(str(cut)) == [cut + dt.timedelta(days=k) for k in range(3)]


def test_an_update_that_dies_changes_nothing(spark):
    p = prints(60)
    s = store(spark, "dies")
    s.update(spark.createDataFrame(p[:30], SCHEMA), "a")
    before = rows(s.read())
    # states written, manifest not
    spark.createDataFrame(p[30:], SCHEMA).transform(states.fold).write.partitionBy("trade_date").parquet(f"{s.path}/states/commit=2")
    again = states.SessionStore(spark, s.path)
    assert rows(again.read()) == before
    again.update(spark.createDataFrame(p[30:], SCHEMA), "b")
    want = rows(states.fold(spark.createDataFrame(p, SCHEMA)).select(*s.read().columns))
    assert rows(again.read()) == want


def test_empty_store_and_refused_prints(spark):
    s = store(spark, "empty")
    assert s.read().count() == 0 and s.sessions() == []
    s.update(spark.createDataFrame([], SCHEMA), "nothing")
    assert s.read().count() == 0 and s.manifest()[2] == {"nothing"}
    with pytest.raises(ValueError):
        s.update(spark.createDataFrame([("A", None, 1, 1.0, 1.0, 1.0, True)], SCHEMA), "bad")


def test_panel_of_states(spark):
    p = [("A", D0, 2, 11.0, 4.0, 44.0, True), ("A", D0, 1, 10.0, 6.0, 60.0, False), ("A", D0 + dt.timedelta(days=1), 9, 12.0, 1.0, 12.0, True)]
    a, b = states.panel(states.fold(spark.createDataFrame(p, SCHEMA)), F.lit("EQ")).orderBy("trade_date").collect()
    assert (a.open_price, a.close_price, a.high_price, a.low_price, a.avg_price, a.deliv_per, a.prev_close) == (10, 11, 11, 10, 10.4, 40, None)
    assert b.prev_close == 11 and b.deliv_qty == 1 and b.no_of_trades == 1


def test_prints_are_folded_without_a_sort(spark):
    d = spark.createDataFrame([("A", dt.date(2024, 1, 1), 2, 5.0, 1.0, 5.0, True), ("A", dt.date(2024, 1, 1), 1, 7.0, 2.0, 14.0, False)],
                              "symbol string, trade_date date, pos bigint, px double, qty double, value double, delivered boolean")
    f = states.fold(d)
    assert "SortAggregate" not in f._jdf.queryExecution().executedPlan().toString()
    r = f.first()
    assert (r["first"]["px"], r["last"]["px"], r["high"], r["low"], r["qty"], r["cents"], r["delivered"], r["n"]) == (7.0, 5.0, 7.0, 5.0, 3, 1900, 1, 2)
