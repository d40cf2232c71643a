"""Late rows as an output of their own.

A foreachBatch writer that splits each micro-batch at the watermark, which is the newest event time of the
batches before it less a delay: rows behind it go to a side table, the others on. Counts come out of the
same write by `observe`. A mark written after a batch holds its counts and newest time; it makes the
watermark survive a restart, and a batch whose mark is there is not written again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MARK = "newest timestamp, kept bigint, late bigint"


class LateRows:
    def __init__(self, spark: SparkSession, path: str, delay_seconds: int, ts: str = "ts"):
        self.spark, self.path, self.delay, self.ts = spark, path.rstrip("/"), delay_seconds, ts

    def marks(self) -> DataFrame:
        """(batch, newest, kept, late) of the batches that are done."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], MARK + ", batch bigint")
        return self.spark.read.schema(MARK + ", batch bigint").parquet(f"{self.path}/marks")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.marks()
        before = done.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        if done.where(F.col("batch") == batch_id).take(1):
            return
        behind = F.lit(False) if before is None else F.col(self.ts) < F.lit(before) - F.make_dt_interval(secs=F.lit(self.delay))
        seen = Observation()
        (batch.withColumn("late", F.coalesce(behind, F.lit(False)))
         .observe(seen, F.max(self.ts).alias("newest"), F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("late"))
         .write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/batch={batch_id}"))
        got = seen.get
        newest = max((x for x in (before, got["newest"]) if x is not None), default=None)
        self.spark.createDataFrame([(newest, got["kept"], got["late"])], MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def rows(self, late: bool) -> DataFrame:
        """Kept or late rows of the batches that are done."""
        return self.spark.read.parquet(f"{self.path}/rows").join(F.broadcast(self.marks().select("batch")), "batch", "left_semi").where(F.col("late") == late)
