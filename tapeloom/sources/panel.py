"""Readers over the panel tables: projected, filtered scans with an explicit as-of."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nz

EOD_COLUMNS = ["trade_date", "symbol", "prev_close", "open_price", "high_price", "low_price",
               "close_price", "avg_price", "ttl_trd_qnty", "deliv_qty", "deliv_per",
               "turnover_lacs", "no_of_trades"]
DERIVATIVE_KINDS = ("FUTSTK", "OPTSTK")


def dated(df: DataFrame, start=None, end=None, col: str = "trade_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end))
    return df


def derivative_universe(contracts: DataFrame, kinds=DERIVATIVE_KINDS) -> DataFrame:
    return contracts.where(F.col("instrument").isin(*kinds)).select("symbol").distinct()


def load_eod(daily: DataFrame, universe: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Valid cash rows of the main series, restricted to the universe if one is given."""
    d = dated(daily, start, end).where(
        (F.col("series") == "EQ") & (F.col("close_price") > 0) & (F.col("high_price") > F.col("low_price")))
    if universe is not None:
        d = d.join(universe, "symbol", "left_semi")
    return d.select(*EOD_COLUMNS)


def load_index(index: DataFrame, name: str, start=None, end=None) -> DataFrame:
    return dated(index.where(F.col("index_name") == name), start, end).select("trade_date", "close_val")


def index_returns(index: DataFrame, name: str, end=None) -> DataFrame:
    """Full index history with `nret`: the stored percent change, or the computed one when the
    stored column is missing throughout."""
    d = dated(index.where(F.col("index_name") == name), None, end)
    whole = Window.partitionBy("index_name")
    w = whole.orderBy("trade_date")
    computed = (F.col("close_val") / nz(F.lag("close_val").over(w)) - 1) * 100
    stored = F.count("pct_chg").over(whole) > 0
    return d.select("trade_date", "close_val",
                    F.when(stored, F.col("pct_chg")).otherwise(computed).alias("nret"))


def load_sectors(master: DataFrame) -> DataFrame:
    return master.select("symbol", F.coalesce("sector", F.concat(F.lit("_"), "symbol")).alias("sector"))


def with_sector(df: DataFrame, master: DataFrame) -> DataFrame:
    """Sector of each row; a symbol without one is its own sector."""
    named = master.select("symbol", "sector")
    return (df.join(named, "symbol", "left")
              .withColumn("sector", F.coalesce("sector", F.concat(F.lit("_"), F.col("symbol")))))


def last_session(daily: DataFrame, before=None, upto=None) -> DataFrame:
    """One row: the newest session of the main series, optionally strictly before / up to a day."""
    d = daily.where(F.col("series") == "EQ")
    if before is not None:
        d = d.where(F.col("trade_date") < F.lit(before))
    if upto is not None:
        d = d.where(F.col("trade_date") <= F.lit(upto))
    return d.agg(F.max("trade_date").alias("trade_date"))


def derivative_dates(contracts: DataFrame) -> DataFrame:
    return contracts.select("trade_date").distinct()


def deliv_panel(daily: DataFrame, master: DataFrame, series, exclude, start=None, end=None) -> DataFrame:
    keep = master.where(~F.col("sector").isin(*exclude))
    return (dated(daily, start, end)
            .where(F.col("series").isin(*series) & F.col("deliv_per").isNotNull())
            .select("symbol", "trade_date", "deliv_per", "turnover_lacs")
            .join(keep, "symbol"))
