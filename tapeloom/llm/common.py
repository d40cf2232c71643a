"""Helpers shared by the operators of this folder."""
from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

#: Rows and bytes of a batch handed to Python. Memory of a task stays bounded by the larger of the
#: byte limit and one row.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20
#: Bits of a filter of hashes that tasks ask; a fixed size, whatever the input.
FILTER = 1 << 23


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, found by exact name (the first of several), so that other columns,
    also ones that differ in case only, cannot clash with what an operator adds."""
    at = [df.columns.index(n) for n in names]
    plain = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*plain).select(*[F.col(plain[i]).alias(n) for i, n in zip(at, names)])


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session where its owner has not set them."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Return freed memory to the system. Python workers are reused: one that keeps what a task has freed
    has it on top of the memory of all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(batches) -> batches` over the partitions of df, in bounded batches. A task gives back its memory at its end."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def filter_of(hashes: DataFrame, column: str) -> bytes:
    """The filter of the given hashes (a bigint column): FILTER bits, which Spark sums in words of 32."""
    slot, bit = F.pmod(column, F.lit(FILTER)), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {FILTER}) % 32 as int))")
    rows = (hashes.select((slot / 32).cast("int").alias("word"), bit.alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(FILTER // 32, np.uint32)
    out[rows["word"]] = rows["bits"].astype(np.uint32)
    return out.tobytes()


def in_filter(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold: all that it was made of, and few others."""
    slot = hashes % FILTER
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def may_hold(spark: SparkSession, bits: bytes):
    """The same for a column: a large table is cut down with it before it is shuffled for a join."""
    sent = spark.sparkContext.broadcast(bits)
    small_batches(spark)

    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, hashes.to_numpy()))

    run.__annotations__ = {"hashes": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def batch_of(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def list_array(flat: pa.Array, lengths: Iterable[int]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def take(rows: Iterator, n: int) -> Iterator[list]:
    """Lists of n rows."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (columns a, b); component is the smallest
    node reachable. Rounds of large-star and small-star: each node is pointed at the smallest
    neighbour it knows, until the edges form stars. Every round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most. A hub's edges are spread by
    partial minima and by joins that Spark may split."""
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == sign or now[0] == 0:
            break
        sign = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("s"))
                 .select("s.a", "s.b").where("a <> b").distinct())
        e = stage(small)
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
