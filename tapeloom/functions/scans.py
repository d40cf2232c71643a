"""Running statistics of one long series in work that grows with its length (times its logarithm for
ranks), without a row that holds its past.

The series has one row for each step of its order column, which is unique.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import axis

#: Natural logarithm by which a block's scaled terms may grow, and the digits that blocks behind still have.
GROWTH, DIGITS = 8.0, 54 * math.log(2)


def with_ema(d: DataFrame, value: str, out: str, span: int, order: str = "trade_date") -> DataFrame:
    """Recursive exponential mean of the values so far (no bias correction; the first value starts it, a
    missing one leaves it as it is).

    A step is the affine map e -> (1 - a) e + a x. Blocks of steps are folded to one map each by a scaled
    prefix sum, the maps of the few blocks behind that still have a digit are composed, and the result is
    applied to the steps of the block in front."""
    a = 2.0 / (span + 1)
    x, w = F.col(value), axis(order)
    if a >= 1:
        return d.withColumn(out, F.last(x, ignorenulls=True).over(w))
    q = 1 - a
    size = max(1, math.ceil(GROWTH / -math.log(q)))
    back = math.ceil(DIGITS / (size * -math.log(q))) + 1
    d = d.withColumn("_ema_i", F.count(x).over(w) - 1)                       # place among the values; a missing one has the last place
    d = d.withColumns({"_ema_block": F.floor(F.greatest("_ema_i", F.lit(0)) / size).cast("int"), "_ema_at": F.pmod(F.greatest("_ema_i", F.lit(0)), F.lit(size))})
    term = F.when(x.isNotNull(), F.when(F.col("_ema_i") == 0, x).otherwise(a * x) * F.pow(F.lit(q), -F.col("_ema_at")))
    inside = Window.partitionBy(F.lit(0), "_ema_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_ema_own", F.sum(term).over(inside) * F.pow(F.lit(q), F.col("_ema_at")))
    ends = F.when((F.col("_ema_at") == size - 1) & x.isNotNull(), F.col("_ema_own"))
    blocks = Window.partitionBy(F.lit(0)).orderBy("_ema_block")
    d = d.withColumns({f"_ema_b{j}": F.max(ends).over(blocks.rangeBetween(-j, -j)) for j in range(1, back + 1)})
    start = sum((F.coalesce(F.col(f"_ema_b{j}"), F.lit(0.0)) * q ** (size * (j - 1)) for j in range(1, back + 1)), F.lit(0.0))
    made = F.when(F.col("_ema_i") >= 0, F.coalesce(F.col("_ema_own"), F.lit(0.0)) + start * F.pow(F.lit(q), F.col("_ema_at") + 1))
    return d.withColumn(out, made).drop("_ema_i", "_ema_block", "_ema_at", "_ema_own", *[f"_ema_b{j}" for j in range(1, back + 1)])


def with_rank_so_far(d: DataFrame, value: str, out: str, order: str = "trade_date") -> DataFrame:
    """Share of all rows so far (rows without a value included) whose value is at most this row's.

    Positions are halved again and again: on each level a row in the right half of its block counts the
    rows of the left half that are not above it, which is a running count in the order of values; the
    halves of all levels make up everything in front of the row. Every row stands on log2(n) levels."""
    w, whole = axis(order), Window.partitionBy(F.lit(0))
    d = d.withColumns({"_rank_p": F.row_number().over(w) - 1, "_rank_n": F.count(F.lit(1)).over(whole)})
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2("_rank_n")).cast("int") - 1, F.lit(0)))
    e = d.where(F.col(value).isNotNull()).select("_rank_p", F.col(value).alias("_v"), F.explode(levels).alias("_level"))
    e = e.select("_rank_p", "_v", "_level", F.expr("_rank_p >> (_level + 1)").alias("_block"), F.expr("(_rank_p >> _level) & 1").alias("_right"))
    below = Window.partitionBy("_level", "_block").orderBy("_v", "_right").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_left", F.sum(1 - F.col("_right")).over(below))
    counts = e.groupBy("_rank_p").agg((F.sum(F.col("_left") * F.col("_right")) + 1).alias("_rank_below"))
    return d.join(counts, "_rank_p", "left").withColumn(out, F.col("_rank_below") / (F.col("_rank_p") + 1)).drop("_rank_p", "_rank_n", "_rank_below")
