"""Position ledger: emit, reconcile, summary, scorecard, health and calibration.

Ledger key: (date, symbol). A ledger holds at most `top_n` rows per session, so per-ledger windows
over closed positions are bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof
from ..functions.rolling import nz
from ..params import Calibration, Signal

COLUMNS = {"date": "date", "symbol": "string", "entry_px": "double", "clr": "double",
           "deliv_per": "double", "vol_ratio": "double", "score": "double", "exit_date": "date",
           "exit_px": "double", "gross_bps": "double", "net_bps": "double", "status": "string"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
_ENTRY = ("entry_px", "clr", "deliv_per", "vol_ratio", "score")


def picks(book: DataFrame) -> DataFrame:
    """Ledger-shaped OPEN rows of a screen; sessions with the gate off log nothing."""
    d = book.where("risk_on").select(
        F.col("trade_date").alias("date"), "symbol", F.col("close_price").alias("entry_px"), "clr",
        "deliv_per", "vol_ratio", "score", F.lit("OPEN").alias("status"))
    return d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c)
                      for c, t in COLUMNS.items()])


def upsert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Insert new keys, refresh the entry fields of rows still OPEN, leave CLOSED rows alone."""
    old = ledger.select("date", "symbol", F.struct(*COLUMNS).alias("o"))
    add = new.select("date", "symbol", F.struct(*COLUMNS).alias("n"))
    both = old.join(add, ["date", "symbol"], "full")
    refresh = (F.col("o.status") == "OPEN") & F.col("n").isNotNull()
    out = []
    for c in COLUMNS:
        if c in ("date", "symbol"):
            out.append(F.col(c))
        elif c in _ENTRY:
            out.append(F.when(F.col("o").isNull() | refresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def reconcile(ledger: DataFrame, panel: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Close OPEN rows at the open of the first session strictly after entry; rows without a later
    session stay OPEN."""
    fills = panel.select("symbol", F.col("trade_date").alias("date"), F.col("open_price").alias("fill_px"))
    d = asof(ledger, fills, "date", ["fill_px"], by=["symbol"], forward=True, strict=True)
    close = (F.col("status") == "OPEN") & F.col("fill_px").isNotNull()
    gross = (F.col("fill_px") / nz(F.col("entry_px")) - 1) * 1e4
    put = {"exit_date": F.col("matched_date"), "exit_px": F.col("fill_px"), "gross_bps": F.bround(gross, 1),
           "net_bps": F.bround(gross - p.cost_bps, 1), "status": F.lit("CLOSED")}
    return d.select(*[F.when(close, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c)
                      for c in COLUMNS])


def stale_opens(ledger: DataFrame, newest: DataFrame) -> DataFrame:
    """OPEN rows dated before the newest session, with their number. `newest` is one row."""
    w = Window.partitionBy("status")
    return (ledger.where(F.col("status") == "OPEN")
            .where(F.col("date") < newest.select("trade_date").scalar())
            .select("date", "symbol", F.count(F.lit(1)).over(w).alias("n_stale")))


def closed(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'CLOSED'")


def summary(ledger: DataFrame) -> DataFrame:
    p = F.col("net_bps")
    return closed(ledger).groupBy("status").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((p > 0).cast("double")).alias("win"),
        F.avg(p).alias("mean_bps"), F.sum(p).alias("total_bps"), F.min(p).alias("worst_bps"))


def equity(ledger: DataFrame) -> DataFrame:
    """Running total and drawdown of the closed positions in date order."""
    w = Window.partitionBy("status").orderBy("date", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    d = closed(ledger).withColumn("equity", F.sum("net_bps").over(w))
    return d.withColumn("drawdown", F.col("equity") - F.max("equity").over(w))


def scorecard(ledger: DataFrame) -> DataFrame:
    p = F.col("net_bps")
    sd = F.stddev_pop(p)
    return equity(ledger).groupBy("status").agg(
        F.count(F.lit(1)).alias("trades"), (100 * F.avg((p > 0).cast("double"))).alias("win_pct"),
        F.avg(p).alias("mean_bps"), F.sum(p).alias("total_bps"), F.min("drawdown").alias("max_dd"),
        F.when(sd > 0, F.avg(p) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        F.min(p).alias("worst_bps"))


def _recent(ledger: DataFrame, rows: int) -> DataFrame:
    w = Window.partitionBy("status").orderBy(F.col("date").desc(), F.col("symbol").desc())
    return (closed(ledger).where("net_bps IS NOT NULL")
            .withColumn("_recent", F.row_number().over(w) <= rows))


def health(ledger: DataFrame, window: int = 20) -> DataFrame:
    """Trailing window against the full record; needs window + 5 rows for a verdict."""
    p = F.col("net_bps")
    rec = F.when(F.col("_recent"), p)
    d = _recent(ledger, window).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("full_mean"), F.avg(rec).alias("recent_mean"),
        (100 * F.avg((rec > 0).cast("double"))).alias("recent_win"))
    bad = (F.col("recent_mean") <= 0) | ((F.col("full_mean") > 0)
                                         & (F.col("recent_mean") < 0.4 * F.col("full_mean")))
    return d.withColumn("verdict", F.when(F.col("n") < window + 5, "accruing")
                        .when(bad, "decay").otherwise("intact"))


def realized_cost(ledger: DataFrame, p: Signal = Signal()) -> DataFrame:
    """Effective cost from fills that differ from the reference prints."""
    slip = ((F.col("entry_px") / nz(F.col("ref_close")) - 1) + (F.col("ref_open") / nz(F.col("exit_px")) - 1)) * 1e4
    live = (closed(ledger).where("net_bps IS NOT NULL AND ref_close IS NOT NULL AND ref_open IS NOT NULL")
            .where("ref_close <> entry_px OR ref_open <> exit_px"))
    return live.agg(F.count(F.lit(1)).alias("n_live_fills"),
                    F.coalesce(F.avg(slip), F.lit(0.0)).alias("slippage_bps")).withColumn(
        "effective_cost_bps", F.lit(p.cost_bps) + F.col("slippage_bps"))


def posterior(mu0, tau, m, s, n):
    """Mean and sd of a normal mean under a normal prior; no data or no spread keeps the prior."""
    known = (n > 0) & (s > 0)
    var = 1.0 / (1.0 / (tau * tau) + n / (s * s))
    mean = var * (mu0 / (tau * tau) + m * n / (s * s))
    return F.when(known, mean).otherwise(mu0), F.when(known, F.sqrt(var)).otherwise(tau)


def calibrate(ledger: DataFrame, prior: DataFrame, cost: DataFrame, p: Signal = Signal(),
              c: Calibration = Calibration()) -> DataFrame:
    """One row: posterior edge net of measured cost, decay flag, size multiplier and its reason.
    `prior` and `cost` are one-row tables."""
    x = F.col("net_bps")
    rec = F.when(F.col("_recent"), x)
    stats = _recent(ledger, c.decay_rows).agg(
        F.count(F.lit(1)).alias("n_closed"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"),
        F.avg((x > 0).cast("double")).alias("win"), F.avg(rec).alias("rec_m"),
        F.coalesce(F.stddev_samp(rec) / F.sqrt(F.count(rec)), F.lit(0.0)).alias("rec_se"))
    one = F.lit(1)
    d = (stats.withColumn("_k", one).join(prior.withColumn("_k", one), "_k")
              .join(cost.withColumn("_k", one), "_k"))
    n = F.col("n_closed")
    use = (n >= c.min_read) & (F.col("s") > 0)
    pm, ps = posterior(F.col("mu0"), F.col("tau"), F.col("m"), F.col("s"), n)
    d = d.withColumns({"_pm": F.when(use, pm).otherwise(F.col("mu0")),
                       "posterior_sd": F.when(use, ps).otherwise(F.col("tau"))})
    d = d.withColumn("posterior_net", F.col("_pm") - (F.col("effective_cost_bps") - p.cost_bps))
    d = d.withColumn("decayed", F.coalesce((n >= c.decay_min) & (F.col("rec_m") + F.col("rec_se") < 0),
                                           F.lit(False)))
    dead = F.col("posterior_net") + F.col("posterior_sd") < 0
    ratio = F.when(F.col("mu0") > 0, F.col("posterior_net") / F.col("mu0")).otherwise(0.0)
    sized = F.greatest(F.lit(c.floor), F.least(F.lit(c.cap), ratio))
    forming = n < c.min_trust
    mult = (F.when(dead | F.col("decayed"), 0.0).when(n < c.min_read, c.floor)
             .when(forming, F.least(sized, F.lit(c.forming_cap))).otherwise(sized))
    trust = (F.when(dead, "posterior negative").when(F.col("decayed"), "recent decay")
              .when(n < c.min_read, "prior only").when(forming, "forming").otherwise("trusted"))
    return d.select("mu0", "mu0_mean", "tau", "n0", "n_closed", "m", "s", "win", "posterior_net",
                    "posterior_sd", "effective_cost_bps", "slippage_bps", "n_live_fills", "decayed",
                    F.bround(mult, 2).alias("size_multiplier"), trust.alias("trust"))
