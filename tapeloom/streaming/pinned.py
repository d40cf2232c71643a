"""Boards pinned at points in time, repriced by a stream of quotes.

Versions of a board are stored by the time they were pinned. A foreachBatch writer gives each quote the
newest version at or before it, keeps the newest quote of a batch for each version and name, joins the
board and writes what changed. A commit file follows; a batch that is committed is not written again, and
one that died before its commit writes over its own folder, so no batch counts twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["pin", "symbol"]


class PinnedBoards:
    """Versions of a board and their repriced rows under one folder. `reprice(board, quotes)` joins by symbol
    on rows of one version, so both get the version into their key here."""

    def __init__(self, spark: SparkSession, path: str, reprice):
        self.spark, self.path, self.reprice = spark, path.rstrip("/"), reprice

    def pin(self, board: DataFrame) -> None:
        """Store versions: board has the column pin (timestamp) and, in each version, one row for a name."""
        board.write.mode("append").parquet(f"{self.path}/boards")

    def boards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/boards")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, quotes: DataFrame, batch_id: int) -> None:
        """Reprice the boards from quotes (symbol, ts, lp)."""
        if self._exists(f"{self.path}/commits/batch={batch_id}/_SUCCESS"):
            return
        boards = self.boards()
        pins = [r[0] for r in boards.select("pin").distinct().collect()]   # one for each version
        if not pins:
            return
        newest = F.array_max(F.filter(F.array(*[F.lit(p) for p in pins]), lambda p: p <= F.col("ts")))
        q = (quotes.withColumn("pin", newest).where("pin IS NOT NULL").groupBy(*KEYS)
             .agg(F.max("ts").alias("quote_ts"), F.max_by("lp", "ts").alias("lp")))
        key = F.concat_ws("@", "symbol", F.col("pin").cast("string"))
        keyed = boards.join(q.select(*KEYS), KEYS, "left_semi").withColumns({"_symbol": F.col("symbol"), "symbol": key})
        made = self.reprice(keyed, q.select(key.alias("symbol"), "lp")).drop("symbol").withColumnRenamed("_symbol", "symbol")
        made.join(q.select(*KEYS, "quote_ts"), KEYS).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")

    def current(self) -> DataFrame:
        """Every version of the board at its newest quote; names without one as pinned."""
        boards = self.boards()
        plain = boards.withColumn("quote_ts", F.lit(None).cast("timestamp"))
        if not self._exists(f"{self.path}/rows"):
            return plain
        rows = (self.spark.read.parquet(f"{self.path}/rows").join(self.spark.read.parquet(f"{self.path}/commits").select("batch").distinct(), "batch")
                .select(*plain.columns))
        newest = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in plain.columns if c not in KEYS]), "quote_ts").alias("r")).select(*KEYS, "r.*")
        return newest.unionByName(plain.join(newest.select(*KEYS), KEYS, "left_anti"))
