"""Adapters that turn the driver's tables into market panels, bars and calendars.

Each adapter aggregates the raw rows to one row per (symbol, session) or (symbol, bar) first. The
aggregation buffers are all fixed width, so Spark hash-aggregates on the map side before the
shuffle and a supplier or event type that owns a third of the rows costs no more than any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import states


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_order() -> Column:
    """Position of a lineitem row inside its month, packed into one long: day, order, line."""
    return (F.dayofmonth("l_shipdate").cast("bigint") * F.lit(1 << 55)
            + F.col("l_orderkey") * 16 + F.col("l_linenumber"))


def in_sessions(li: DataFrame, start=None, end=None) -> DataFrame:
    """Prints of the sessions from `start` to `end`, by a range of the stored date, which the reader can
    use to skip row groups and files."""
    at = lambda d, n: F.add_months(F.trunc(F.lit(d).cast("date"), "month"), n).cast("timestamp_ntz")
    if start is not None:
        li = li.where(F.col("l_shipdate") >= at(start, 0))
    return li if end is None else li.where(F.col("l_shipdate") < at(end, 1))


def trades(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """One row per print: symbol, session (month), price, quantity."""
    li = in_sessions(table(spark, sf_dir, "lineitem"), start, end)
    return li.select(
        "l_suppkey",
        F.trunc("l_shipdate", "month").alias("trade_date"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_returnflag") == "N").alias("delivered"),
        trade_order().alias("pos"))


def prints(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Prints keyed by symbol and session, as the state store takes them."""
    return trades(spark, sf_dir, start, end).select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "trade_date", "pos", "px",
                                                    "qty", "value", "delivered")


def series_of(symbol: str = "symbol") -> Column:
    return F.when(F.substring(symbol, 2, 20).cast("bigint") % 10 == 9, "SM").otherwise("EQ")


def eod_panel(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """End-of-session panel straight from the prints: one row per (symbol, session). With `start`, the
    first row of a symbol has no previous close."""
    return states.panel(states.fold(prints(spark, sf_dir, start, end)), series_of())


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars inside a panel session: one row per (symbol, session, day), volume in units."""
    g = (trades(spark, sf_dir).groupBy("l_suppkey", "trade_date", "day").agg(
        F.min_by("px", "pos").alias("open"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.max_by("px", "pos").alias("close"),
        F.sum("qty").alias("volume")))
    return g.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "trade_date",
                    F.col("day").cast("timestamp_ntz").alias("ts"),
                    "open", "high", "low", "close", "volume")


def index_series(panel: DataFrame) -> DataFrame:
    """Equal-weight mean close of the valid panel rows per session; the stored percent change is
    missing for every row, so readers compute it."""
    d = panel.where("close_price > 0 AND high_price > low_price AND series = 'EQ'")
    return (d.groupBy("trade_date").agg(F.avg("close_price").alias("close_val"))
             .select(F.lit("MKT").alias("index_name"), "trade_date", "close_val",
                     F.lit(None).cast("double").alias("pct_chg")))


def sector_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> sector; one supplier in 25 has none, and one sector is an excluded one."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k).alias("symbol"),
        F.when(k % 25 == 3, F.lit(None).cast("string"))
         .when(k % 40 == 11, F.lit("ETF"))
         .otherwise(F.concat(F.lit("SEC"), (F.col("s_nationkey") % 10).cast("string"))).alias("sector"))


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar rows of the suppliers behind urgent orders: symbol, date text, purpose."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    k = F.col("o_orderkey") % 3
    return (o.join(li, o.o_orderkey == li.l_orderkey)
             .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                     F.date_format("o_orderdate", "dd-MMM-yyyy").alias("date"),
                     F.when(k == 0, "Financial Results").when(k == 1, "Board Meeting Intimation")
                      .otherwise("Dividend").alias("purpose"),
                     F.lit("").alias("bm_desc")))


def derivatives(panel: DataFrame) -> DataFrame:
    """Near and next quarterly contracts per (symbol, session), priced at the mean price of the
    following sessions, plus two contracts on the index. A stock contract keeps its expiry over the
    six sessions it is quoted in."""
    d = panel
    w = Window.partitionBy("symbol").orderBy("trade_date")
    key = F.substring("symbol", 2, 20).cast("bigint")
    near_days = (1 + key % 30).cast("int")
    legs = d.select("trade_date", "symbol", near_days.alias("near_days"),
                    *[F.lead(c, n).over(w).alias(f"{c}{n}")
                      for c in ("avg_price", "ttl_trd_qnty", "no_of_trades") for n in (1, 2)])
    stock = legs.select(
        "trade_date", F.lit("FUTSTK").alias("instrument"), "symbol",
        F.explode(F.array(*[F.struct(
            F.date_add(F.add_months(F.trunc("trade_date", "quarter"), 3 * n - 1), F.col("near_days")).alias("expiry_date"),
            F.col(f"avg_price{n}").alias("close_price"),
            F.col(f"ttl_trd_qnty{n}").alias("open_interest"),
            F.col(f"no_of_trades{n}").alias("contracts")) for n in (1, 2)])).alias("c")
    ).select("trade_date", "instrument", "symbol", "c.*").where("close_price IS NOT NULL")
    iw = Window.partitionBy("index_name").orderBy("trade_date")
    ix = index_series(panel).withColumns(
        {f"next{n}": F.lead("close_val", n).over(iw) for n in (1, 2)}).select(
        "trade_date", F.lit("FUTIDX").alias("instrument"), F.col("index_name").alias("symbol"),
        F.explode(F.array(*[F.struct(
            F.date_add("trade_date", 20 + 28 * (n - 1)).alias("expiry_date"),
            F.col(f"next{n}").alias("close_price"),
            F.lit(0).cast("bigint").alias("open_interest"),
            F.lit(0).cast("bigint").alias("contracts")) for n in (1, 2)])).alias("c")
    ).select("trade_date", "instrument", "symbol", "c.*").where("close_price IS NOT NULL")
    return stock.unionByName(ix)


def options(panel: DataFrame) -> DataFrame:
    """One call and one put per (symbol, session) on the quarter's contract. Delivered quantity stands
    for the call's open interest and the rest for the put's; the way from the close to the session's
    low and high is the premium."""
    near_days = (1 + F.substring("symbol", 2, 20).cast("bigint") % 30).cast("int")
    leg = lambda side, oi, premium: F.struct(F.lit(side).alias("option_type"), oi.alias("open_interest"), premium.alias("close_price"))
    return panel.select(
        "trade_date", "symbol", F.date_add(F.add_months(F.trunc("trade_date", "quarter"), 2), near_days).alias("expiry_date"),
        F.explode(F.array(leg("C", F.col("deliv_qty"), F.col("close_price") - F.col("low_price")),
                          leg("P", F.col("ttl_trd_qnty") - F.col("deliv_qty"), F.col("high_price") - F.col("close_price")))).alias("leg")
    ).select("trade_date", "symbol", "expiry_date", "leg.*")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints of the event stream: symbol, ts, price, volume."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


def named_ticks(spark: SparkSession, sf_dir: str, names: int = 6) -> DataFrame:
    """Prints of the event stream under more names: type and user group."""
    t = table(spark, sf_dir, "events")
    return t.select(F.concat_ws("-", "event_type", (F.col("user_id") % names).cast("string")).alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


def fold_ticks(t: DataFrame, minutes: int) -> DataFrame:
    """Prints as fine bars of `minutes` (a divisor of the day); volume counts prints."""
    micros = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("int")
    start = (F.to_date("ts").cast("timestamp_ntz")
             + F.make_dt_interval(mins=(F.floor(micros / (60 * minutes)) * minutes).cast("int")))
    # event ids rise with time, so the id orders prints inside a bar and is a plain long
    g = t.groupBy("symbol", start.alias("ts")).agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
    return g


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Event prints as fine bars."""
    return fold_ticks(ticks(spark, sf_dir), minutes)


#: Prices in front of these days are that many times what they are after them.
LISTED_EVENTS = {"click": [("2024-01-12", 5.0)], "view": [("2024-01-09", 2.0), ("2024-01-23", 10.0)], "purchase": [("2024-01-17", 1.6)]}
#: The same for suppliers by the last digit of their key.
LISTED_SUPPLIERS = {3: [("1999-06-15", 5.0)], 7: [("1998-03-01", 2.0), ("2001-05-10", 10.0)], 5: [("2001-08-20", 1.6)]}


def _scale(key: Column, day: Column, actions: dict) -> Column:
    out = F.lit(1.0)
    for name, steps in actions.items():
        for at, times in steps:
            out = out * F.when((key == name) & (day < F.lit(at).cast("date")), times).otherwise(1.0)
    return out


def listed_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Fine bars of prices that move by less than a fifth, but for the corporate actions of some symbols."""
    t = ticks(spark, sf_dir)
    price = (1000.0 + F.least("price", F.lit(400.0)) / 3) * _scale(F.col("symbol"), F.to_date("ts"), LISTED_EVENTS)
    return fold_ticks(t.withColumn("price", price), minutes)


def listed_daily(fine: DataFrame) -> DataFrame:
    """The days of fine bars as a panel, as printed."""
    return fine.groupBy("symbol", F.to_date("ts").alias("trade_date")).agg(
        F.min_by("open", "ts").alias("open_price"), F.max("high").alias("high_price"), F.min("low").alias("low_price"),
        F.max_by("close", "ts").alias("close_price"), F.sum("volume").alias("ttl_trd_qnty"))


def listed_panel(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Daily panel of the suppliers with corporate actions, as printed."""
    k, day = F.col("l_suppkey"), F.to_date("l_shipdate")
    li = in_sessions(table(spark, sf_dir, "lineitem"), start, end)
    px = (1000.0 + (F.col("l_extendedprice") % 1000) / 10) * _scale(k % 10, day, LISTED_SUPPLIERS)
    pos = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    t = li.select(F.concat(F.lit("S"), k).alias("symbol"), day.alias("trade_date"), px.alias("px"), F.col("l_quantity").alias("qty"), pos.alias("pos"))
    return t.groupBy("symbol", "trade_date").agg(
        F.min_by("px", "pos").alias("open_price"), F.max("px").alias("high_price"), F.min("px").alias("low_price"),
        F.max_by("px", "pos").alias("close_price"), F.sum("qty").alias("ttl_trd_qnty"))
