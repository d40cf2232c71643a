"""Drive a streaming query over files to completion."""
from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from ..sources.replay import resume


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available now into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, writer, mode: str = "update") -> None:
    """Process everything available now through a foreachBatch writer."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).foreachBatch(writer)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


class Replayed:
    """A replay of `total` rows that is run in batches to its end, or stopped on the way and started again
    from its checkpoint. `make(progress)` gives the stream; the sink is a table, or a foreachBatch writer.

    The end is told by the offset of the last finished batch, not by idleness: a query with processing-time
    state has a batch at every trigger."""

    def __init__(self, spark: SparkSession, make, total: int, mode: str = "append", writer=None, limit_seconds: float = 600):
        self.spark, self.make, self.total, self.mode, self.writer, self.limit = spark, make, total, mode, writer, limit_seconds
        self.base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.batches: set[int] = set()

    def run(self, stop_after: int | None = None) -> "Replayed":
        """Go on to the end of what is stored, or until so many more batches with rows are done."""
        resume(self.spark, f"{self.base}/checkpoint", f"{self.base}/progress")
        stream = self.make(f"{self.base}/progress")
        self.schema = stream.schema
        w = stream.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.base}/checkpoint").trigger(processingTime="0 seconds")
        w = w.foreachBatch(self.writer) if self.writer else w.format("parquet").option("path", f"{self.base}/out")
        q = w.start()
        done, began, at = set(), time.monotonic(), 0
        try:
            while at < self.total and (stop_after is None or len(done) < stop_after):
                if q.awaitTermination(0.1):
                    break
                for p in q.recentProgress:
                    at = max([at, *(_row(s["endOffset"]) for s in p["sources"])])
                    if p["numInputRows"]:
                        done.add(p["batchId"])
                if time.monotonic() - began > self.limit:
                    raise TimeoutError(f"at row {at} of {self.total} after {self.limit} seconds")
        finally:
            q.stop()
        if q.exception():
            raise q.exception()
        self.batches |= done
        return self

    def table(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/out")


def _row(offset) -> int:
    """The row number of an offset, however the progress report spells it."""
    found = re.search(r"row\W+(\d+)", str(offset))
    return int(found[1]) if found else 0
