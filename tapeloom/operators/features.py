"""Per-symbol feature windows, the multi-condition signal and its score.

All windows share one partitioning (symbol) and one order (session), so Spark shuffles and sorts
the panel once for the whole feature set.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ROWS_PER_PIECE, spread_pct_rank
from ..functions.rolling import axis, nz, roll_mean, roll_median, roll_sum, series, true_range
from ..params import Signal
from ..session import known_size, stage


def add_features(panel: DataFrame, p: Signal = Signal()) -> DataFrame:
    w = series("symbol")
    rng = nz(F.col("high_price") - F.col("low_price"))
    vwap = F.when(F.col("avg_price") > 0, F.col("avg_price"))
    d = panel.withColumns({
        "clr": (F.col("close_price") - F.col("low_price")) / rng,
        "body": (F.col("close_price") - F.col("open_price")) / rng,
        "ret": F.col("close_price") / nz(F.col("prev_close")) - 1,
        "close_vs_vwap": (F.col("close_price") - vwap) / vwap,
        "vwap_in_range": (vwap - F.col("low_price")) / rng,
        "_tr": true_range(F.col("high_price"), F.col("low_price"), F.lag("close_price").over(w)),
    })
    return d.withColumns({
        "vol_ratio": F.col("ttl_trd_qnty") / nz(roll_median(F.col("ttl_trd_qnty"), w, p.lookback, 1)),
        "deliv_spike": F.col("deliv_per") - roll_median(F.col("deliv_per"), w, p.lookback, 1),
        "deliv_trail": roll_mean(F.col("deliv_per"), w, p.deliv_trail_win, 1),
        "atr14": roll_mean(F.col("_tr"), w, p.atr_win),
    }).drop("_tr")


def index_day_returns(index: DataFrame) -> DataFrame:
    w = axis()
    return index.select("trade_date",
                        (F.col("close_val") / nz(F.lag("close_val").over(w)) - 1).alias("idx_ret"))


def add_relative_strength(feat: DataFrame, index: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Daily and cumulative return in excess of the index."""
    w = series("symbol")
    d = feat.join(known_size(index_day_returns(index)), "trade_date", "left")
    d = d.withColumn("rs_idx", F.col("ret") - F.col("idx_ret"))
    return d.withColumn("rs_idx_cum", roll_sum(F.col("rs_idx"), w, p.rs_lookback))


def signal_mask(p: Signal = Signal(), require_liquidity: bool = True) -> Column:
    m = ((F.col("clr") >= p.clr) & (F.col("deliv_trail") >= p.deliv_trail)
         & (F.col("vol_ratio") >= p.vol_ratio) & (F.col("ret") >= p.ret)
         & (F.col("close_vs_vwap") >= p.close_vs_vwap) & (F.col("rs_idx_cum") > p.rs_min))
    if require_liquidity:
        m = m & (F.col("turnover_lacs") >= p.liq_lacs)
    return m


def signals(feat: DataFrame, p: Signal = Signal(), require_liquidity: bool = True) -> DataFrame:
    return feat.where(signal_mask(p, require_liquidity))


def thin_names(feat: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Rows that pass every leg except the turnover floor."""
    return feat.where(signal_mask(p, False) & (F.col("turnover_lacs") < p.liq_lacs))


SCORE_LEGS = ("clr", "deliv_trail", "vol_ratio", "ret", "rs_idx_cum")


def conviction_score(cand: DataFrame, by: list[str], keys: list[str], p: Signal = Signal(),
                     legs: dict[str, Column] | None = None,
                     rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Add `score`, the sum of the average-tie percent ranks of the legs within `by` (empty `by`
    ranks the whole set). A missing leg makes the score missing.

    The legs are stacked into one (group, leg, value) table, so all of them are ranked in one
    pass. The candidates are read several times, so they are staged once. The sum is rounded to nine decimals: equal legs give equal scores in
    whatever order they are added.
    """
    cand = stage(cand)
    legs = legs or {"clr": F.col("clr"), "deliv_trail": F.col("deliv_trail"),
                    "vol_ratio": F.least(F.col("vol_ratio"), F.lit(p.vol_cap)),
                    "ret": F.greatest(F.col("ret"), F.lit(0.0)), "rs_idx_cum": F.col("rs_idx_cum")}
    ks = list(dict.fromkeys([*by, *keys]))
    stacked = cand.select(*ks, F.explode(F.array(*[
        F.struct(F.lit(n).alias("leg"), c.cast("double").alias("value")) for n, c in legs.items()
    ])).alias("m")).select(*ks, "m.*").where("value IS NOT NULL")
    ranks = spread_pct_rank(stacked, [*by, "leg"], "value", "pct", rows_per_piece)
    scored = (ranks.groupBy(*ks).agg(F.sum("pct").alias("score"), F.count("pct").alias("_legs"))
              .select(*ks, F.when(F.col("_legs") == len(legs), F.round("score", 9)).alias("score")))
    return cand.join(scored, ks, "left")
