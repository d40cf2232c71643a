"""Bar-structure classifier, for every bar of every series in one window pass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import even, nz, yes
from ..params import Structure
from .bars import with_atr

BEARISH = ("TREND_DOWN", "BREAKOUT_DOWN")


def _bound(sorted_prior: Column, atr: Column, upper: bool, spike: float) -> Column:
    """Range bound of the earlier bars, without a lone outlier more than `spike` ATR beyond the next
    value. The array holds at most lookback - 1 values, ascending."""
    first, second = (-1, -2) if upper else (1, 2)
    a, b = F.element_at(sorted_prior, first), F.element_at(sorted_prior, second)
    lone = ((a - b) if upper else (b - a)) > spike * atr
    return F.when((F.size(sorted_prior) >= 3) & (atr > 0) & lone, b).when(F.size(sorted_prior) >= 1, a)


def structure_table(bars: DataFrame, keys: list[str], p: Structure = Structure(), forming: bool = False) -> DataFrame:
    """Add struct, box_hi, box_lo, er, coil, n, atr to every bar, read from the bars up to it.

    With `forming` each bar is taken as still printing: the coil test then reads the bars before it,
    breakout and trend still see it."""
    lb = p.lookback
    w = Window.partitionBy(*keys).orderBy("ts")
    win, prior = w.rowsBetween(-(lb - 1), 0), w.rowsBetween(-(lb - 1), -1)
    d = with_atr(bars, keys, p.atr_win).withColumns({
        "n": F.row_number().over(w), "_diff": F.abs(F.col("close") - F.lag("close").over(w)),
        "box_hi": F.max("high").over(win), "box_lo": F.min("low").over(win),
        "_c0": F.first("close").over(win),
        "_ph": F.sort_array(F.collect_list("high").over(prior)), "_pl": F.sort_array(F.collect_list("low").over(prior)),
        "_s3": F.max("high").over(w.rowsBetween(-2, 0)) - F.min("low").over(w.rowsBetween(-2, 0))})
    d = d.withColumns({"_path": F.sum("_diff").over(w.rowsBetween(-(lb - 2), 0)),
                       "_s3": F.when(F.col("n") >= 3, F.col("_s3"))})
    half = F.lit(0.5)
    now = F.col("_s3") / nz(F.percentile("_s3", half).over(w.rowsBetween(-(lb - 3), -1)))
    coil = F.when(F.least("n", F.lit(lb)) >= 8, now)
    if forming:
        before = F.lag("_s3").over(w) / nz(F.percentile("_s3", half).over(w.rowsBetween(-(lb - 3), -2)))
        coil = F.when(F.least("n", F.lit(lb)) > 8, before).otherwise(coil)
    # a frame without range falls back to its box, for the label only
    unit = F.when(F.col("atr") > 0, F.col("atr")).otherwise((F.col("box_hi") - F.col("box_lo")) / lb)
    d = d.withColumns({"coil": even(coil, 2), "_unit": unit, "net": F.col("close") - F.col("_c0")})
    d = d.withColumns({
        "er": F.when(F.col("_path") > 0, F.abs("net") / F.col("_path")).otherwise(0.0),
        "prior_hi": _bound(F.col("_ph"), F.col("_unit"), True, p.spike_atr),
        "prior_lo": _bound(F.col("_pl"), F.col("_unit"), False, p.spike_atr)})
    return d.withColumn("struct", structure_label(p)).drop("_diff", "_c0", "_path", "_ph", "_pl", "_s3", "_unit")


def structure_label(p: Structure = Structure()) -> Column:
    c, a = F.col("close"), F.col("_unit")
    margin = p.breakout_atr * a
    trend = (F.col("er") >= p.trend_er) & (F.abs("net") >= p.trend_atr * a)
    return (F.when(F.col("n") < p.min_bars, "n/a")
             .when(yes(c > F.col("prior_hi") + margin), "BREAKOUT_UP")
             .when(yes(c < F.col("prior_lo") - margin), "BREAKOUT_DOWN")
             .when(yes(trend), F.when(F.col("net") > 0, "TREND_UP").otherwise("TREND_DOWN"))
             .when(yes(F.col("coil") < p.coil), "CONSOLIDATION").otherwise("RANGE"))


def last_bar(d: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def bearish_age(structured: DataFrame, keys: list[str], lookback: int = 20, max_back: int = 180) -> DataFrame:
    """Trailing run of bearish structures at the end of each series, capped; NULL when the newest bar
    is not bearish or the series is too short."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    d = structured.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.max("n").over(Window.partitionBy(*keys))})
    limit = F.least(F.lit(max_back), F.col("_n") - lookback)
    broke = F.min(F.when(~F.col("struct").isin(*BEARISH), F.col("_k")))
    g = d.groupBy(*keys).agg(F.max("_n").alias("_n"), F.min(F.least(limit, F.lit(max_back))).alias("_limit"), broke.alias("_broke"))
    age = F.least(F.coalesce("_broke", F.col("_limit")), F.col("_limit"))
    return g.select(*keys, F.when((F.col("_n") >= lookback + 2) & (age > 0), age).cast("int").alias("dn_age"))
