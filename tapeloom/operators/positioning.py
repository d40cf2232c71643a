"""Open-interest positioning labels and their as-of lookup."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof
from ..session import known_size

DAY = "trade_date"


def futures_label(d_oi: Column, d_px: Column, rolling: Column) -> Column:
    """Open interest x price sign: long build-up, short build-up, short covering, long unwinding."""
    up, more = d_px > 0, d_oi > 0
    return (F.when(rolling, "⟳ rolling")
             .when(up & more, "LB").when((d_px < 0) & more, "SB")
             .when(up & (d_oi < 0), "SC").when((d_px < 0) & (d_oi < 0), "LU"))


def option_leg(side: str, d_oi: Column, d_prem: Column) -> Column:
    """Open interest x premium sign of one leg ("C" or "P")."""
    return (F.when((d_oi > 0) & (d_prem > 0), f"{side}.Buying").when((d_oi > 0) & (d_prem < 0), f"{side}.Writing")
             .when((d_oi < 0) & (d_prem > 0), f"{side}.SC").when((d_oi < 0) & (d_prem < 0), f"{side}.LE"))


def option_bias(call: Column, put: Column) -> Column:
    """What both legs say together, or the two legs."""
    buys, writes = (lambda leg: leg.endswith(".Buying")), (lambda leg: leg.endswith(".Writing"))
    return (F.when(buys(call) & writes(put), "Bull").when(writes(call) & buys(put), "Bear")
             .when(writes(call) & writes(put), "Range").when(buys(call) & buys(put), "Vol Bet")
             .otherwise(F.concat_ws(" ", call, put)))


def option_read(call: Column, put: Column, call_oi: Column, put_oi: Column) -> Column:
    """Both legs in one read, with the put/call ratio as context."""
    pcr = F.when(call_oi > 0, F.format_string("PCR %.2f", put_oi / call_oi))
    return F.concat_ws(" | ", option_bias(call, put), pcr)


def futures_positions(futures: DataFrame, roll_days: int = 3, kind: str = "FUTSTK") -> DataFrame:
    """Near and next labels per (trade_date, symbol), from the change against the same contract's
    previous session."""
    rank = Window.partitionBy(DAY, "symbol").orderBy("expiry_date")
    f = futures.where((F.col("instrument") == kind) & (F.col("expiry_date") >= F.col(DAY)))
    w = Window.partitionBy("symbol", "expiry_date").orderBy(DAY)
    label = futures_label(F.col("open_interest") - F.lag("open_interest").over(w),
                          F.col("close_price") - F.lag("close_price").over(w),
                          F.datediff("expiry_date", DAY) <= roll_days)
    f = f.withColumn("label", label).withColumn("rn", F.row_number().over(rank)).where("rn <= 2")
    return f.groupBy(DAY, "symbol").agg(
        F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("fut_near"),
        F.max(F.when(F.col("rn") == 2, F.col("label"))).alias("fut_next"))


def option_positions(options: DataFrame) -> DataFrame:
    """Call and put reads per (trade_date, symbol) from options (trade_date, symbol, expiry_date,
    option_type, open_interest, close_price): each leg against its own contract's previous session,
    in the nearest expiry that is not past."""
    w = Window.partitionBy("symbol", "expiry_date", "option_type").orderBy(DAY)
    o = options.where(F.col("expiry_date") >= F.col(DAY)).withColumns({
        "d_oi": F.col("open_interest") - F.lag("open_interest").over(w), "d_prem": F.col("close_price") - F.lag("close_price").over(w)})
    near = F.min("expiry_date").over(Window.partitionBy(DAY, "symbol"))
    o = o.withColumn("near", near).where("expiry_date = near")
    side = lambda s, c: F.max(F.when(F.col("option_type") == s, c))
    g = o.groupBy(DAY, "symbol").agg(*[
        e for s in ("C", "P") for e in (side(s, option_leg(s, F.col("d_oi"), F.col("d_prem"))).alias(s), side(s, F.col("open_interest")).alias(f"{s}_oi"))])
    return g.select(DAY, "symbol", F.col("C").alias("call"), F.col("P").alias("put"), option_bias(F.col("C"), F.col("P")).alias("bias"),
                    F.when(F.col("C_oi") > 0, F.col("P_oi") / F.col("C_oi")).alias("pcr"))


def asof_labels(board: DataFrame, labels: DataFrame, cols: list[str]) -> DataFrame:
    """Labels of the newest label session at or before each board row's date, with its age. The
    as-of step runs on the distinct dates only, the rest is an equi join."""
    dates = board.select(DAY).distinct()
    used = asof(dates, labels.select(DAY).distinct(), DAY, []).withColumnRenamed(f"matched_{DAY}", "date_used")
    d = board.join(known_size(used), DAY, "left")
    lab = labels.select(F.col(DAY).alias("date_used"), "symbol", *cols)
    d = d.join(lab, ["date_used", "symbol"], "left")
    return d.withColumns({**{c: F.coalesce(c, F.lit("—")) for c in cols},
                          "stale_days": F.datediff(DAY, "date_used")})
