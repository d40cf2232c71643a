"""Does the sector tilt condition the overnight payoff? Bucket tables and test statistics, each
computed from grouped sums; nothing is collected."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import nz
from ..params import Signal
from ..session import known_size

OW, UW = "OVERWEIGHT", "UNDERWEIGHT"


def tagged_signals(sel: DataFrame, universe: DataFrame, tilt: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Signal rows with the tilt of their sector on the same session and the night's mean gap over
    the liquid universe. `sel` carries sector, on_bps and d2_bps; `universe` is the prepared panel."""
    night = (universe.where(F.col("turnover_lacs") >= p.liq_lacs).groupBy("trade_date")
             .agg(F.avg("on_bps").alias("univ_on")))
    d = (sel.join(known_size(tilt.select("trade_date", "sector", "tilt")), ["trade_date", "sector"], "left")
            .join(known_size(night), "trade_date", "left"))
    return d.withColumns({"net": F.col("on_bps") - p.cost_bps, "excess": F.col("on_bps") - F.col("univ_on")})


def bucket_table(tagged: DataFrame, p: Signal = Signal()) -> DataFrame:
    n, sd = F.count(F.lit(1)), F.stddev_samp("net")
    return (tagged.where("tilt IS NOT NULL").groupBy("tilt").agg(
        n.alias("n"), F.avg("on_bps").alias("gross_on"), F.avg("net").alias("net_on"),
        (100 * F.avg((F.col("net") > 0).cast("double"))).alias("win_pct"),
        F.when((n > 5) & (sd > 0), F.avg("net") / (sd / F.sqrt(n))).alias("t_vs_0"),
        F.avg(F.col("d2_bps") - p.day2_cost_bps).alias("d2_net")))


def per_year(tagged: DataFrame, need: int = 5) -> DataFrame:
    a, b = (F.when(F.col("tilt") == k, F.col("net")) for k in (OW, UW))
    d = tagged.groupBy("yr").agg(F.count(a).alias("n_ow"), F.count(b).alias("n_uw"),
                                 F.avg(a).alias("ow_net"), F.avg(b).alias("uw_net"))
    return d.withColumn("ow_wins", F.when((F.col("n_ow") >= need) & (F.col("n_uw") >= need),
                                          F.col("ow_net") > F.col("uw_net"))).withColumnRenamed("yr", "year")


def welch(x: str) -> tuple[Column, Column]:
    """(difference of means, Welch t) of OVERWEIGHT minus UNDERWEIGHT, as aggregates."""
    a, b = (F.when(F.col("tilt") == k, F.col(x)) for k in (OW, UW))
    se2 = F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)
    diff = F.avg(a) - F.avg(b)
    return diff, F.when((F.count(a) >= 5) & (F.count(b) >= 5) & (se2 > 0), diff / F.sqrt(se2))


def welch_table(tagged: DataFrame) -> DataFrame:
    """One row: difference and t for the gap, the next day, the night factor and the excess."""
    out = []
    for name, col in (("on", "on_bps"), ("d2", "d2_bps"), ("night", "univ_on"), ("xs", "excess")):
        diff, t = welch(col)
        out += [diff.alias(f"diff_{name}"), t.alias(f"t_{name}")]
    nights = [F.count_distinct(F.when(F.col("tilt") == k, F.col("trade_date"))).alias(f"nights_{n}")
              for k, n in ((OW, "ow"), (UW, "uw"))]
    return tagged.agg(F.count(F.lit(1)).alias("n_signals"),
                      F.count_if(F.col("tilt").isNull()).alias("unmatched"), *out, *nights)


def cluster_t(tagged: DataFrame) -> DataFrame:
    """t of the OVERWEIGHT dummy with errors clustered by night. With two groups the fit is the two
    means, so the score of a night is its residual sum per group; the sandwich is 2x2."""
    d = tagged.where(F.col("tilt").isin(OW, UW)).withColumn("x", (F.col("tilt") == OW).cast("int"))
    means = d.groupBy("x").agg(F.avg("on_bps").alias("_m"))
    night = (d.join(means, "x").groupBy("trade_date").agg(
        F.sum(F.col("on_bps") - F.col("_m")).alias("s0"),
        F.sum(F.when(F.col("x") == 1, F.col("on_bps") - F.col("_m")).otherwise(0.0)).alias("s1"),
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("n1"),
        F.sum(F.when(F.col("x") == 1, F.col("on_bps")).otherwise(0.0)).alias("y1"), F.sum("on_bps").alias("y")))
    g = night.agg(F.sum(F.col("s0") * F.col("s0")).alias("m00"), F.sum(F.col("s0") * F.col("s1")).alias("m01"),
                  F.sum(F.col("s1") * F.col("s1")).alias("m11"), F.sum("n").alias("n"), F.sum("n1").alias("k"),
                  F.sum("y1").alias("y1"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n_nights"))
    n, k = F.col("n"), F.col("k")
    det = nz(n * k - k * k)
    a, b = -k / det, n / det                     # second row of the inverse of [[n, k], [k, k]]
    var = a * a * F.col("m00") + 2 * a * b * F.col("m01") + b * b * F.col("m11")
    beta = F.col("y1") / nz(k) - (F.col("y") - F.col("y1")) / nz(n - k)
    ok = (n > 20) & (F.col("n_nights") > 5) & (var > 0)
    return g.select(F.when(ok, beta / F.sqrt(var)).alias("t_clustered"), F.when(ok, beta).alias("beta"), "n_nights")


def paired_t(tagged: DataFrame) -> DataFrame:
    """Same-night OVERWEIGHT minus UNDERWEIGHT, over nights that have both."""
    a, b = (F.avg(F.when(F.col("tilt") == k, F.col("on_bps"))) for k in (OW, UW))
    d = (tagged.groupBy("trade_date").agg(a.alias("ow"), b.alias("uw"))
         .where("ow IS NOT NULL AND uw IS NOT NULL").withColumn("d", F.col("ow") - F.col("uw")))
    n, sd = F.count("d"), F.stddev_samp("d")
    return d.agg(n.alias("n_pair"), F.when(n > 2, F.avg("d")).alias("diff_paired"),
                 F.when((n > 2) & (sd > 0), F.avg("d") / (sd / F.sqrt(n))).alias("t_paired"))


def decide(welch_row: DataFrame, years: DataFrame, need_years: int = 5, need_t: float = 2.0) -> DataFrame:
    """Pre-registered rule: positive difference, |t| at least need_t, and enough winning years."""
    y = years.agg(F.count_if(F.coalesce("ow_wins", F.lit(False))).alias("yrs_ow_wins"),
                  F.count("ow_wins").alias("yrs_tested"))
    one = F.lit(1)
    d = welch_row.withColumn("_k", one).join(y.withColumn("_k", one), "_k")
    ok = (F.col("diff_on") > 0) & (F.abs("t_on") >= need_t) & (F.col("yrs_ow_wins") >= need_years)
    return d.select("diff_on", "t_on", "yrs_ow_wins", "yrs_tested",
                    F.when(F.coalesce(ok, F.lit(False)), "WIRE AS GATE").otherwise("DISPLAY-ONLY").alias("verdict"))
