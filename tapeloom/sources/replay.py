"""A streaming source that replays stored events: `spark.readStream.format("replay")`.

Files of a Parquet folder, by name, are one long list of rows; an offset is a number of rows from its
start. Each micro-batch admits at most `rows` more, so a replay goes through the same batches every time.
A batch is read by tasks of up to `slice` rows straight from the files; the driver sees row counts only.

Offsets handed out are noted under `progress` (a folder that outlives the driver) before Spark gets them,
so a restarted query goes on from its checkpoint and is never offered an older offset. A query that stops
between the two leaves a note that is ahead of its checkpoint; `resume` sets the note back to the newest
offset in the checkpoint's log, so the batches of a restarted replay are cut where they would have been
without the stop. Without it the rows between the two make one larger batch.

Options: path, rows, slice, progress. The schema is the stream's. An empty folder never has a batch.
"""
from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NOTE = "replay-offset"


@dataclass
class Rows(InputPartition):
    file: str
    start: int
    stop: int


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.schema, self.limit, self.slice = schema, int(options.get("rows", 10_000)), int(options.get("slice", 50_000))
        self.progress = options.get("progress")
        self.path = options["path"]
        files, root = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=False))
        self.files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))
        sizes = []
        for f in self.files:
            with files.open_input_file(f) as opened:
                sizes.append(pq.ParquetFile(opened).metadata.num_rows)
        self.ends = list(accumulate(sizes))

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        last = min(self._noted() + self.limit, self.ends[-1] if self.ends else 0)
        if self.progress:
            files, root = _filesystem(self.progress)
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{NOTE}.new") as out:
                out.write(json.dumps({"row": last}).encode())
            files.move(f"{root}/{NOTE}.new", f"{root}/{NOTE}")
        self.at = last
        return {"row": last}

    def _noted(self) -> int:
        if not hasattr(self, "at"):
            self.at = 0
            if self.progress:
                from pyarrow import fs

                files, root = _filesystem(self.progress)
                if files.get_file_info(f"{root}/{NOTE}").type != fs.FileType.NotFound:
                    with files.open_input_stream(f"{root}/{NOTE}") as noted:
                        self.at = json.loads(noted.read())["row"]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        out, at = [], start["row"]
        while at < end["row"]:
            k = bisect_right(self.ends, at)
            base = self.ends[k] - (self.ends[k] - (self.ends[k - 1] if k else 0))
            stop = min(end["row"], self.ends[k], at + self.slice)
            out.append(Rows(self.files[k], at - base, stop - base))
            at = stop
        return out

    def read(self, partition: Rows):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = _filesystem(self.path)
        target = to_arrow_schema(self.schema)
        with files.open_input_file(partition.file) as opened:
            f, at = pq.ParquetFile(opened), 0
            for g in range(f.metadata.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                lo, hi = max(partition.start - at, 0), min(partition.stop - at, n)
                if lo < hi:
                    t = f.read_row_group(g, columns=target.names).slice(lo, hi - lo).select(target.names).cast(target)
                    yield from t.to_batches(max_chunksize=10_000)
                at += n


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(schema, self.options)


def resume(spark: SparkSession, checkpoint: str, progress: str) -> None:
    """Set the note of a stopped query to the newest offset that its checkpoint has logged, if there is one."""
    hadoop = spark._jvm.org.apache.hadoop
    log, note = hadoop.fs.Path(f"{checkpoint}/offsets"), hadoop.fs.Path(f"{progress}/{NOTE}")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    logged = [int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()] if fs.exists(log) else []
    if logged:
        # version, metadata, then one offset for each source
        lines = spark.read.text(f"{checkpoint}/offsets/{max(logged)}", wholetext=True).first()[0].splitlines()
        row = json.loads(lines[2])["row"]
    else:
        row = 0
    out = note.getFileSystem(spark._jsc.hadoopConfiguration()).create(note, True)
    out.write(bytearray(json.dumps({"row": row}).encode()))
    out.close()


def replay(spark: SparkSession, path: str, schema, rows: int, progress: str | None = None) -> DataFrame:
    """The rows of a Parquet folder as a stream of batches of at most so many rows."""
    spark.dataSource.register(ReplaySource)
    s = spark.readStream.format("replay").schema(schema).option("path", path).option("rows", rows)
    return (s.option("progress", progress) if progress else s).load()
