"""As-of alignment without a range join: both sides are interleaved in one ordered series per key
and the last (or first) known value is carried over. Every input row is touched once."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, cols: list[str], by: list[str] = (),
         forward: bool = False, strict: bool = False) -> DataFrame:
    """`left` plus the `cols` of the nearest `right` row at or before `on` (after, if `forward`).

    With `strict` an equal key does not match. Without `by` the axis itself is the series, so
    pass distinct axis values (dates, bar times), not fact rows.
    """
    by = list(by)
    payload = F.struct(on, *cols)
    lcols = [c for c in left.columns if c not in by and c != on]
    l_ = left.select(*by, on, F.lit(True).alias("_left"), F.struct(*lcols).alias("_row")
                     if lcols else F.lit(None).cast("int").alias("_row"),
                     F.lit(None).cast(_type(right, payload)).alias("_hit"))
    r_ = right.select(*by, on, F.lit(False).alias("_left"),
                      F.lit(None).cast(_type(l_, F.col("_row"))).alias("_row"),
                      payload.alias("_hit"))
    key = F.col(on).desc() if forward else F.col(on).asc()
    # false sorts first: a right row with the same key is seen before the left row unless strict
    side = F.col("_left").desc() if strict else F.col("_left").asc()
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    seen = part.orderBy(key, side).rowsBetween(Window.unboundedPreceding, 0)
    out = (l_.unionByName(r_)
           .withColumn("_hit", F.last("_hit", ignorenulls=True).over(seen))
           .where("_left"))
    keep = [*by, on] + [F.col(f"_row.{c}").alias(c) for c in lcols]
    return out.select(*keep, F.col(f"_hit.{on}").alias(f"matched_{on}"),
                      *[F.col(f"_hit.{c}").alias(c) for c in cols])


def _type(df: DataFrame, col):
    return df.select(col.alias("_t")).schema["_t"].dataType
