"""Cross-sectional order statistics.

`pct_rank` is a plain window, for cross-sections bounded by a dimension (sectors on a date).

Cross-sections of symbols have no such bound, so everything else here cuts each group at splitter
values, sorts every piece on its own and adds the sizes of the pieces in front. Splitters are the rows
whose key hash is divisible by the piece size, a pure function of the data, so a lost task that is run
again finds the same cuts; a group smaller than a piece has none and is one piece. They only balance
the work: every row is ranked, by the same plan at every size.

The input is read more than once, so callers pass a staged table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 1_000_000


def pct_rank(value: str, by: list[str]) -> Column:
    """Average-tie rank over the non-null count; NULL stays NULL."""
    c = F.col(value)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(c.asc_nulls_last()))
    ties = F.count(c).over(Window.partitionBy(*by, value))
    n = F.count(c).over(Window.partitionBy(*by))
    return F.when(c.isNotNull(), (rank + (ties - 1) / 2.0) / n)


def prefix_counts(df: DataFrame, by: list[str], order: list[str], weight: str | None = None,
                  rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Add `_before` (total weight of the rows of the group ordered in front) and `_total`.

    `by` + `order` must be unique; rows with a NULL in the first order column are dropped.
    """
    df = df.where(F.col(order[0]).isNotNull())
    df = df.withColumn("_w", F.lit(1) if weight is None else F.col(weight))
    key = F.struct(*order)
    cuts = (df.where(F.pmod(F.xxhash64(*by, *order), F.lit(rows_per_piece)) == 0)
              .groupBy(*by).agg(F.sort_array(F.collect_set(key)).alias("_cuts")))
    piece = F.size(F.filter("_cuts", lambda c: c < key))
    rows = (df.join(cuts, by, "left")
              .withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_cuts"))
    sizes = rows.groupBy(*by, "_piece").agg(F.sum("_w").alias("_n"))
    front = Window.partitionBy(*by).orderBy("_piece")
    sizes = sizes.select(
        *by, "_piece",
        (F.sum("_n").over(front) - F.col("_n")).alias("_front"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    inside = (Window.partitionBy(*by, "_piece").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
                .join(sizes, [*by, "_piece"])
                .withColumn("_before", F.col("_front") + F.col("_in"))
                .drop("_piece", "_in", "_front", "_w"))


def spread_pct_rank(df: DataFrame, by: list[str], value: str, out: str,
                    rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Rows of `df` with a value, plus its average-tie percent rank in the group."""
    df = df.where(F.col(value).isNotNull())
    # equal values are folded for the ranks; joining them back, Spark splits the rows of a value that
    # fills a third of a group, as the other side has one row for it
    dist = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    d = prefix_counts(dist, by, [value], "_c", rows_per_piece)
    ranks = d.select(*by, value, ((F.col("_before") + (F.col("_c") + 1) / 2.0) / F.col("_total")).alias(out))
    return df.join(ranks, [*by, value])


def spread_median(df: DataFrame, by: list[str], value: str, tie: list[str], out: str,
                  rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(by, out): exact median, read off the one or two middle rows of each group."""
    d = prefix_counts(df.select(*by, value, *tie), by, [value, *tie], None, rows_per_piece)
    n = F.col("_total")
    pos = F.col("_before") + 1
    mid = (pos == F.floor((n + 1) / 2)) | (pos == F.floor((n + 2) / 2))
    return d.where(mid).groupBy(*by).agg(F.avg(value).alias(out))
