"""Futures basis: carry board for every session in one job, market summary and history."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof
from ..functions.ranking import prefix_counts, spread_median
from ..functions.rolling import nz, yes
from ..functions.scalars import carry_tag
from ..functions.scans import with_rank_so_far
from ..params import Basis
from ..session import known_size, stage

DAY = "trade_date"


def near_next(futures: DataFrame, spot: DataFrame, kind: str = "FUTSTK") -> DataFrame:
    """Near and next contract beside the cash close: one row per (trade_date, symbol). The rank and
    the fold to one row share their partitioning."""
    w = Window.partitionBy(DAY, "symbol").orderBy("expiry_date")
    f = (futures.where((F.col("instrument") == kind) & (F.col("expiry_date") >= F.col(DAY)))
         .select(DAY, "symbol", "expiry_date", F.col("close_price").alias("fut"), "open_interest",
                 F.datediff("expiry_date", DAY).alias("dte"))
         .withColumn("rn", F.row_number().over(w)).where("rn <= 2"))

    def leg(c, n):
        return F.max(F.when(F.col("rn") == n, F.col(c)))
    legs = f.groupBy(DAY, "symbol").agg(
        leg("fut", 1).alias("fut"), leg("dte", 1).alias("dte"), leg("open_interest", 1).alias("oi"),
        leg("fut", 2).alias("fut_next"), leg("dte", 2).alias("dte_next"))
    return legs.join(spot.select(DAY, "symbol", F.col("close_price").alias("spot"), "turnover_lacs"),
                     [DAY, "symbol"])


def basis_columns(d: DataFrame, p: Basis = Basis()) -> DataFrame:
    d = d.where((F.col("dte") >= p.min_dte) & F.col("fut").isNotNull() & (F.col("spot") > 0))
    pct = (F.col("fut") / F.col("spot") - 1) * 100
    span = nz(F.col("dte_next") - F.col("dte"))
    return d.withColumns({"basis_pct": pct, "basis_ann": pct * 365 / F.col("dte"),
                          "roll_ann": (F.col("fut_next") / nz(F.col("fut")) - 1) * 100 * 365 / span})


def quintile(d: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, symbol, out): five equal cuts of the ordered cross-section, ties in symbol order; NULL
    where a cross-section has fewer than five distinct values."""
    pos = prefix_counts(d.select(by, "symbol", value), [by], [value, "symbol"])
    distinct = d.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c")).groupBy(by).agg(
        F.count(value).alias("_distinct"))
    q = F.greatest(F.lit(1), F.ceil(5 * F.col("_before") / nz(F.col("_total") - 1)))
    return pos.join(known_size(distinct), by).select(by, "symbol", F.when(F.col("_distinct") >= 5, q).alias(out))


def carry_board(futures: DataFrame, spot: DataFrame, p: Basis = Basis()) -> DataFrame:
    """Per (trade_date, symbol): basis, implied dividend against the session's median basis, ex-date
    flag, basis quintile, confirmation and tag."""
    d = stage(basis_columns(near_next(futures, spot), p))
    med = spread_median(d, [DAY], "basis_pct", ["symbol"], "_med")
    d = d.join(known_size(med), DAY).join(quintile(d, DAY, "basis_ann", "q"), [DAY, "symbol"], "left")
    d = d.withColumn("div_impl", F.col("_med") - F.col("basis_pct"))
    d = d.withColumn("exdiv", F.col("div_impl") > p.exdiv)
    d = d.withColumn("confirm", yes(F.col("q") >= p.confirm_q) & ~F.col("exdiv"))
    return d.select(DAY, "symbol", "basis_pct", "basis_ann", "roll_ann", "div_impl", "exdiv", "q", "confirm",
                    carry_tag(F.col("basis_ann"), F.col("div_impl"), F.col("exdiv"), F.col("confirm")).alias("tag"),
                    "dte", "turnover_lacs")


def index_carry(futures: DataFrame, index: DataFrame, p: Basis = Basis(), kind: str = "FUTIDX") -> DataFrame:
    """Annualised near-month index basis per session."""
    w = Window.partitionBy(DAY).orderBy("expiry_date")
    f = (futures.where((F.col("instrument") == kind) & (F.col("expiry_date") >= F.col(DAY)))
         .withColumn("rn", F.row_number().over(w)).where("rn = 1")
         .select(DAY, F.col("close_price").alias("fut"), F.datediff("expiry_date", DAY).alias("dte"))
         .where(F.col("dte") >= p.min_dte))
    return (f.join(index.select(DAY, F.col("close_val").alias("spot")), DAY)
             .select(DAY, ((F.col("fut") / F.col("spot") - 1) * 100 * 365 / F.col("dte")).alias("carry_ann")))


def carry_history(futures: DataFrame, index: DataFrame, as_of, rows: int = 500, p: Basis = Basis()) -> DataFrame:
    d = index_carry(futures, index, p).where(F.col(DAY) <= F.lit(as_of))
    return d.orderBy(F.col(DAY).desc()).limit(rows).orderBy(DAY)


def carry_market(board: DataFrame, futures: DataFrame, index: DataFrame, dates: DataFrame,
                 p: Basis = Basis()) -> DataFrame:
    """Market read for every as-of date: newest index basis with its percentile in the history so
    far and its staleness, and the medians of that session's board."""
    ix = index_carry(futures, index, p)
    ix = with_rank_so_far(ix, "carry_ann", "pctile").withColumn("pctile", 100 * F.col("pctile"))
    asked = asof(dates.select(DAY), ix, DAY, ["carry_ann", "pctile"])
    board = stage(board)
    med = spread_median(board, [DAY], "basis_pct", ["symbol"], "carry_med")
    roll = spread_median(board, [DAY], "roll_ann", ["symbol"], "roll_med")
    n = board.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"), F.count_if("exdiv").alias("n_exdiv"))
    out = asked.join(n, DAY, "left").join(med, DAY, "left").join(roll, DAY, "left")
    return out.select(DAY, F.col("carry_ann").alias("index_ann"), "pctile", F.col(f"matched_{DAY}").alias("asof"),
                      F.datediff(DAY, f"matched_{DAY}").alias("stale_days"), "roll_med", "carry_med",
                      F.coalesce("n_exdiv", F.lit(0)).alias("n_exdiv"), F.coalesce("n", F.lit(0)).alias("n"))


def annotate(board: DataFrame, context: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Attach text context columns on a unique key; missing reads as a dash and no row is lost."""
    out = board.join(context.select(*keys, *cols), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("—")) for c in cols})
