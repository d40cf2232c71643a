"""Stored tables: bars, ledger, tilt history, result documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import SCHEMA as LEDGER_SCHEMA


def write_bars(bars: DataFrame, path: str, res: str) -> None:
    """Bars by session date and resolution. Rows are grouped by date first, so a date is written
    by few tasks and a reader of one date opens few files; only the dates at hand are replaced."""
    (bars.withColumns({"date": F.to_date("ts"), "res": F.lit(res)}).repartition("date")
         .write.partitionBy("date", "res").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_bars(spark: SparkSession, path: str, res: str, start=None, end=None) -> DataFrame:
    d = spark.read.parquet(path).where(F.col("res") == res)
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    return d


def write_tilt_history(tilt: DataFrame, path: str) -> None:
    """All sessions in one job, partitioned by year; years at hand are replaced."""
    (tilt.withColumn("year", F.year("trade_date")).repartition("year")
         .write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_tilt_history(spark: SparkSession, path: str, start_year: int | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return (d if start_year is None else d.where(F.col("year") >= start_year)).drop("year")


def write_ledger(ledger: DataFrame, path: str, version: int) -> None:
    """A ledger is rewritten as a whole under the next version, so a job may read the version it
    replaces and a failed write leaves the last one in place."""
    ledger.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_ledger(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One version of the ledger; version 0 is the empty ledger."""
    if version == 0:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/version={version}")


def write_document(result: DataFrame, path: str) -> None:
    """Small result table (measurement, calibration state) as JSON lines."""
    result.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
