"""Ranked and capped selection."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nz
from ..params import Signal


def top_per_session(df: DataFrame, n: int, score: str = "score", by: str = "trade_date") -> DataFrame:
    """Best n rows per session. The rank filter lets Spark keep only n rows per task and session
    before the shuffle (window group limit)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), "symbol")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def capped_book(cand: DataFrame, p: Signal = Signal(), by: list[str] = ("trade_date",),
                size_mult: float | None = 1.0, score: str = "score") -> DataFrame:
    """At most `max_per_sector` names per sector and `top_n` in all, best score first, equal
    weights that sum to the gross size.

    Walking the ranking and skipping full sectors keeps exactly the first `max_per_sector` of each
    sector and then the first `top_n` of what is left, so two rank filters give the same book.
    `size_mult` may also be a column name.
    """
    by = list(by)
    order = [F.col(score).desc_nulls_last(), F.col("symbol")]
    mult = F.col(size_mult) if isinstance(size_mult, str) else F.lit(float(size_mult))
    d = cand.withColumn("_mult", mult).where("_mult > 0")
    d = (d.withColumn("_s", F.row_number().over(Window.partitionBy(*by, "sector").orderBy(*order)))
          .where(F.col("_s") <= p.max_per_sector).drop("_s"))
    d = (d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
          .where(F.col("_r") <= p.top_n))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return (d.withColumn("weight", F.bround(F.least(F.col("_mult"), F.lit(1.0)) / n, 4))
             .withColumnRenamed("_r", "position").drop("_mult"))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def two_sided_shortlist(df: DataFrame, n: int, p: Signal = Signal()) -> DataFrame:
    """Strongest closes among the risers and weakest among the fallers, behind a turnover floor."""
    liquid = df.where(F.col("turnover_lacs") >= p.liq_lacs)
    up = (liquid.where((F.col("day_pct") >= 100 * p.ret) & (F.col("clr") >= 0.5))
          .orderBy(F.col("clr").desc(), F.col("day_pct").desc(), "symbol").limit(n))
    down = (liquid.where((F.col("day_pct") <= -100 * p.ret) & (F.col("clr") <= 0.5))
            .orderBy(F.col("clr").asc(), F.col("day_pct").asc(), "symbol").limit(max(4, n // 2)))
    return up.withColumn("list", F.lit("UP")).unionByName(down.withColumn("list", F.lit("DOWN")))


def trigger_universe(ref: DataFrame, n: int, min_turn_cr: float) -> DataFrame:
    """n most volatile names by ATR percent behind a turnover gate; if the gate empties the set,
    the n most traded names ranked the same way."""
    u = ref.select("symbol",
                   (100 * F.col("atr14") / nz(F.col("ref_close"))).alias("atr_pct"),
                   (F.col("vol_med20") * F.col("ref_close") / 1e7).alias("turn_cr")).dropna()
    gated = u.where(F.col("turn_cr") >= min_turn_cr)
    fallback = u.orderBy(F.col("turn_cr").desc(), "symbol").limit(n)
    empty = gated.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    pool = gated.unionByName(fallback.where(empty))
    return pool.orderBy(F.col("atr_pct").desc(), "symbol").limit(n)
