"""Session defaults. On a cluster the caller passes its own session and only the missing pieces
are filled in."""
from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tapeloom") -> SparkSession:
    """Session for tests and the bench."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", os.environ.get("TAPELOOM_DRIVER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false")
             .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
             .config("spark.local.dir", f"{scratch}/local")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the cluster's setting, or a
    temporary folder in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back, for a result that
    several branches of a plan need. Later stages, and tasks run again after a lost executor, read
    the files instead of repeating the work behind them."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_size(df: DataFrame) -> DataFrame:
    """Stage a table that is meant to be small next to the rows it is joined to (one row per
    session, per index bar). The planner then knows its size from the files: it broadcasts it while
    it is under spark.sql.autoBroadcastJoinThreshold and shuffles both sides when it is not. Without
    this a join on the session would first shuffle the whole panel by date."""
    return stage(df)


def stage_all(*dfs: DataFrame) -> list[DataFrame]:
    """Stage independent results side by side, so that a small one does not wait for a large one."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(stage, dfs))
