"""Turnover-weighted delivery: momentum against a norm, and the recent trend cell."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nz
from ..params import Delivery
from ..session import known_size


def _usable(panel: DataFrame, as_of, days: int) -> DataFrame:
    day = F.col("trade_date")
    return panel.where((day <= F.lit(as_of)) & (day >= F.date_sub(F.lit(as_of).cast("date"), days))
                       & (F.col("turnover_lacs") > 0) & F.col("deliv_per").isNotNull())


def _weighted(cond: Column) -> Column:
    num = F.sum(F.when(cond, F.col("deliv_per") * F.col("turnover_lacs")))
    return num / nz(F.sum(F.when(cond, F.col("turnover_lacs"))))


def delivery_momentum(panel: DataFrame, as_of, p: Delivery = Delivery(), days: int = 170) -> DataFrame:
    """Weighted delivery of the last calendar days, of the last rows before the as-of session, and
    the first relative to the second in percent."""
    d = _usable(panel, as_of, days)
    before = F.col("trade_date") < F.lit(as_of)
    # rows before the as-of session, newest first; the as-of row has its own numbering
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", before).orderBy(F.col("trade_date").desc())))
    recent = F.col("trade_date") > F.date_sub(F.lit(as_of).cast("date"), p.recent_days)
    out = d.groupBy("symbol").agg(_weighted(recent).alias("wtd_recent"),
                                  _weighted(before & (F.col("_k") <= p.norm_rows)).alias("avg_norm"))
    return out.withColumn("deliv_vs_norm", F.when(F.col("avg_norm") > 0,
                                                  (F.col("wtd_recent") / F.col("avg_norm") - 1) * 100))


def week_friday(day: Column) -> Column:
    """The Friday that closes the week of a date (Saturday opens the next one)."""
    return F.date_add(day, (F.lit(4) - F.weekday(day) + 7) % 7)


def delivery_trend(panel: DataFrame, as_of, p: Delivery = Delivery(), bucket: str = "week",
                   days: int = 330) -> DataFrame:
    """Delivery per slot (oldest first, w1..wn), the symbol's own earlier norm, the newest value's
    deviation from it, and the whole as one text cell."""
    d = _usable(panel, as_of, days)
    daily = bucket == "day"
    slot_of = F.col("trade_date") if daily else week_friday(F.col("trade_date"))
    d = d.withColumn("slot", slot_of)
    # newest n slots: a short list of calendar days
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("slot").desc())
    slots = (d.select("slot").distinct().orderBy(F.col("slot").desc()).limit(p.slots)
             .withColumn("back", F.row_number().over(w))
             .withColumn("n_slots", F.max("back").over(Window.partitionBy(F.lit(0)))))
    slots = known_size(slots)
    last_slot = slots.agg(F.max("slot")).scalar()
    cut = slots.agg(F.min("slot")).scalar() if daily else slots.agg(F.date_sub(F.max("slot"), 6)).scalar()
    d = d.join(slots, "slot", "left").withColumn("_old", F.col("trade_date") < cut)
    d = d.withColumn("_k", F.row_number().over(
        Window.partitionBy("symbol", "_old").orderBy(F.col("trade_date").desc())))
    base = F.col("_old") & (F.col("_k") <= p.base_days)
    shown = F.col("back").isNotNull()
    if daily:
        value = [F.avg(F.when(F.col("back") == b, F.col("deliv_per"))) for b in range(1, p.slots + 1)]
    else:
        value = [_weighted(F.col("back") == b) for b in range(1, p.slots + 1)]
    g = d.groupBy("symbol").agg(
        F.count_if(shown).alias("_n"), *[v.alias(f"b{b}") for b, v in enumerate(value, 1)],
        F.when(F.count_if(base) >= min(p.min_hist, p.base_days), _weighted(base)).alias("norm"),
        _weighted(shown).alias("_recent"), F.count_if(F.col("back") == 1).alias("cur_days"),
        F.max("n_slots").alias("n_slots")).where("_n > 0")
    backs = [F.col(f"b{b}") for b in range(1, p.slots + 1)]
    recent = F.col("_recent") if daily else F.coalesce(*backs)
    g = g.withColumns({
        "recent": recent,
        "partial": F.lit(False) if daily else F.lit(as_of).cast("date") < last_slot,
        "cur_days": F.lit(0) if daily else F.col("cur_days")})
    g = g.withColumn("dev_pct", F.when(F.col("norm") > 0, (F.col("recent") / F.col("norm") - 1) * 100))
    return g.withColumn("cell", trend_cell(backs, p.slots)).select(
        "symbol", *[F.col(f"b{b}").alias(f"w{p.slots + 1 - b}") for b in range(p.slots, 0, -1)],
        "norm", "recent", "partial", "cur_days", "dev_pct", "cell")


def trend_cell(backs: list[Column], n: int) -> Column:
    """"51, 49, 60  Base -> (-21%)": newest first, a part-formed newest week marked with its days."""
    text = [F.when(b.isNull(), "–").otherwise(F.format_string("%.0f", F.bround(b, 0))) for b in backs]
    mark = F.when(F.col("partial") & backs[0].isNotNull(),
                  F.when(F.col("cur_days") > 0, F.concat(F.lit("*"), F.col("cur_days").cast("string"), F.lit("d")))
                   .otherwise("*")).otherwise("")
    text[0] = F.concat(text[0], mark)
    # a short calendar has fewer slots than asked for; the missing ones are not shown
    seq = F.array_join(F.slice(F.array(*text), F.lit(1), F.coalesce(F.col("n_slots"), F.lit(n))), ", ")
    base = F.when(F.col("dev_pct").isNull(), "(n/a)").otherwise(
        F.format_string("(%+.0f%%)", "dev_pct"))
    return F.when(F.coalesce(*backs).isNull(), "—").otherwise(F.concat(seq, F.lit("  Base -> "), base))
