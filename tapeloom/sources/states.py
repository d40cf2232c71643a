"""Session states: what a panel row is folded from, kept by session and brought up to date in place.

A state (symbol, session) holds the first and last print with their positions, extremes, and exact sums
in whole units, so states of any two sets of prints merge to the state of their union, in any order. The
store keeps the states of a session in a folder of its own. An update folds the new prints, reads only
the sessions they touch, merges and writes those sessions under a new commit; a manifest written after
them says which commit holds each session and which batches are in. A reader takes the newest manifest
and opens the folders of its sessions and no others; a batch that comes again changes nothing, and an
update that dies before its manifest leaves the store as it was.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = "trade_date"
KEYS = ("symbol", SESSION)
_PRINT = "struct<pos:bigint,px:double>"
SCHEMA = (f"symbol string, {SESSION} date, first {_PRINT}, last {_PRINT}, high double, low double, qty bigint, cents bigint, "
          "delivered bigint, n bigint")
MANIFEST = f"{SESSION} date, held int, batch string"


def fold(prints: DataFrame) -> DataFrame:
    """States of prints (symbol, trade_date, pos, px, qty, value, delivered); positions are unique in a session.
    Structs are made after the fold: with one in its buffer Spark would sort all prints instead of hashing them."""
    units = F.col("qty").cast("bigint")
    return prints.groupBy(*KEYS).agg(
        F.min("pos").alias("_p0"), F.min_by("px", "pos").alias("_x0"), F.max("pos").alias("_p1"), F.max_by("px", "pos").alias("_x1"),
        F.max("px").alias("high"), F.min("px").alias("low"),
        F.sum(units).alias("qty"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.sum(F.when(F.col("delivered"), units).otherwise(F.lit(0).cast("bigint"))).alias("delivered"), F.count(F.lit(1)).alias("n")).select(
        *KEYS, F.struct(F.col("_p0").alias("pos"), F.col("_x0").alias("px")).alias("first"),
        F.struct(F.col("_p1").alias("pos"), F.col("_x1").alias("px")).alias("last"), "high", "low", "qty", "cents", "delivered", "n")


def merge(states: DataFrame) -> DataFrame:
    """One state for each (symbol, session)."""
    return states.groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"),
                                     F.min("low").alias("low"), *[F.sum(c).alias(c) for c in ("qty", "cents", "delivered", "n")])


def panel(states: DataFrame, series: Column) -> DataFrame:
    """Panel rows of states. The previous close is that of the symbol's row before it among those read."""
    w = Window.partitionBy("symbol").orderBy(SESSION)
    close, value, qty = F.col("last.px"), F.col("cents") / 100.0, F.col("qty").cast("double")
    return states.select(
        SESSION, "symbol", series.alias("series"), F.lag(close).over(w).alias("prev_close"), F.col("first.px").alias("open_price"),
        F.col("high").alias("high_price"), F.col("low").alias("low_price"), close.alias("close_price"), (value / qty).alias("avg_price"),
        F.col("qty").alias("ttl_trd_qnty"), F.col("delivered").alias("deliv_qty"),
        (100.0 * F.col("delivered").cast("double") / qty).alias("deliv_per"), (value / 1e5).alias("turnover_lacs"), F.col("n").alias("no_of_trades"))


class SessionStore:
    """States under a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: tuple[int, dict[date, int], set[str]] | None = None

    def _newest(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        done = [s.getPath() for s in fs.listStatus(folder)]
        return max([int(p.getName().partition("=")[2]) for p in done
                    if p.getName().startswith("commit=") and fs.exists(p.suffix("/_SUCCESS"))], default=0)

    def manifest(self) -> tuple[int, dict[date, int], set[str]]:
        """(newest commit, commit that holds each session, batches that are in)."""
        at = self._newest()
        if self._known is None or self._known[0] != at:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/commit={at}").collect() if at else []
            self._known = (at, {r[SESSION]: r["held"] for r in rows if r[SESSION] is not None},
                           {r["batch"] for r in rows if r["batch"] is not None})
        return self._known

    def sessions(self, start=None, end=None) -> list[date]:
        lo, hi = (d if d is None or isinstance(d, date) else date.fromisoformat(str(d)) for d in (start, end))
        return sorted(s for s in self.manifest()[1] if (lo is None or s >= lo) and (hi is None or s <= hi))

    def read(self, start=None, end=None, only: list[date] | None = None) -> DataFrame:
        """States of the sessions from start to end (or of those in `only`); just their folders are opened."""
        held = self.manifest()[1]
        by: dict[int, list[date]] = {}
        for s in self.sessions(start, end) if only is None else only:
            by.setdefault(held[s], []).append(s)
        out = self.spark.createDataFrame([], SCHEMA)
        for commit, days in by.items():
            root = f"{self.path}/states/commit={commit}"
            d = (self.spark.read.schema(SCHEMA).option("basePath", root).parquet(*[f"{root}/{SESSION}={s}" for s in days])
                 .select(*out.columns))
            out = d if commit == next(iter(by)) else out.unionByName(d)
        return out

    def update(self, prints: DataFrame, batch: str) -> bool:
        """Merge a batch of prints in; False if it was in already. Prints without a session are refused."""
        at, held, batches = self.manifest()
        if batch in batches:
            return False
        new = fold(prints)
        folder = f"{self.path}/incoming/commit={at + 1}"
        new.write.mode("overwrite").parquet(folder)
        new = self.spark.read.schema(SCHEMA).parquet(folder)
        touched = [r[0] for r in new.select(SESSION).distinct().collect()]
        if None in touched:
            raise ValueError("a print has no session")
        old = [s for s in touched if s in held]
        if old:
            new = merge(new.unionByName(self.read(only=sorted(old))))
        if touched:
            # however many prints a session has, its states are one row for each symbol
            new.repartition(SESSION).write.partitionBy(SESSION).mode("overwrite").parquet(f"{self.path}/states/commit={at + 1}")
        held = held | {s: at + 1 for s in touched}
        rows = [(s, c, None) for s, c in sorted(held.items())] + [(None, None, b) for b in sorted(batches | {batch})]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/commit={at + 1}")
        return True
