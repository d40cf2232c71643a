"""Event calendar: parsing, the hold-window guard and its availability."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_calendar(raw: DataFrame) -> DataFrame:
    """Keep result and board-meeting events with a readable date: symbol, date, purpose."""
    text = F.lower(F.concat(F.col("purpose"), F.coalesce("bm_desc", F.lit(""))))
    keep = text.contains("result") | F.lower("purpose").contains("board meeting")
    return (raw.where(keep)
               .select("symbol", F.expr("CAST(try_to_timestamp(date, 'dd-MMM-yyyy') AS DATE)").alias("date"),
                       "purpose")
               .where("date IS NOT NULL"))


def blocked_days(events: DataFrame, horizon_days: int) -> DataFrame:
    """(symbol, trade_date) pairs whose hold window (trade_date, trade_date + horizon] holds an
    event. Every event blocks the `horizon` days in front of it, so the guard is an equi join."""
    return (events.select("symbol", F.explode(F.sequence(
        F.date_sub("date", horizon_days), F.date_sub("date", 1))).alias("trade_date")).distinct())


def without_events(df: DataFrame, events: DataFrame, horizon_days: int = 3) -> DataFrame:
    return df.join(blocked_days(events, horizon_days), ["symbol", "trade_date"], "left_anti")


def with_events(df: DataFrame, events: DataFrame, horizon_days: int = 3) -> DataFrame:
    return df.join(blocked_days(events, horizon_days), ["symbol", "trade_date"], "left_semi")


def next_event(df: DataFrame, events: DataFrame, horizon_days: int = 3) -> DataFrame:
    """Earliest event date inside the hold window of each (symbol, trade_date), else NULL."""
    hits = (events.select("symbol", "date", F.explode(F.sequence(
        F.date_sub("date", horizon_days), F.date_sub("date", 1))).alias("trade_date"))
        .groupBy("symbol", "trade_date").agg(F.min("date").alias("event_date")))
    return df.join(hits, ["symbol", "trade_date"], "left")


def guard_status(events: DataFrame) -> DataFrame:
    """One row: is the calendar usable, how many rows, and the newest event in it."""
    return events.agg((F.count(F.lit(1)) > 0).alias("available"), F.count(F.lit(1)).alias("n"),
                      F.max("date").alias("asof"))
