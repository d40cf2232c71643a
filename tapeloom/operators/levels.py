"""Touch-counted support and resistance.

Levels are read from the last `lookback` bars of a series (60, or 180 for daily bars), so the
arrays folded here are bounded by a constant.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import even, fixed2, nz
from ..params import Levels, Structure
from .structure import structure_table

WALL = "array<struct<level:double,touches:int,lo:double,hi:double>>"


def cluster_walls(values: Column, tol: Column) -> Column:
    """Fold ascending pivot prices into walls: a pivot joins the first wall whose running mean is
    within `tol`, else it opens a new one. Levels are rounded at the end."""
    def step(acc, x):
        at = F.array_position(F.transform(acc, lambda c: F.abs(x - c["level"]) <= tol), F.lit(True))
        def grow(c, i):
            joined = F.struct(((c["level"] * c["touches"] + x) / (c["touches"] + 1)).alias("level"),
                              (c["touches"] + 1).cast("int").alias("touches"),
                              F.least(c["lo"], x).alias("lo"), F.greatest(c["hi"], x).alias("hi"))
            return F.when(i == at - 1, joined).otherwise(c)
        new = F.array(F.struct(x.alias("level"), F.lit(1).cast("int").alias("touches"), x.alias("lo"), x.alias("hi")))
        return F.when(at > 0, F.transform(acc, grow)).otherwise(F.concat(acc, new))
    acc = F.aggregate(F.array_sort(values), F.array().cast(WALL), step)
    return F.transform(acc, lambda c: F.struct(
        even(c["level"], 2).alias("level"), c["touches"].alias("touches"),
        even(c["lo"], 2).alias("lo"), even(c["hi"], 2).alias("hi")))


def zone_activity(bars: Column, level: Column, atr: Column, p: Levels = Levels()) -> Column:
    """Visits (runs of bars touching the zone), bars, closes and time share of a level, over an
    ordered array of struct(high, low, close)."""
    lo, hi = level - p.tol_atr * atr, level + p.tol_atr * atr
    zero = F.struct(F.lit(False).alias("prev"), F.lit(0).alias("visits"), F.lit(0).alias("bars"), F.lit(0).alias("closes"))
    def step(a, b):
        inz = (b["low"] <= hi) & (b["high"] >= lo)
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(inz.alias("prev"), (a["visits"] + one(inz & ~a["prev"])).alias("visits"),
                        (a["bars"] + one(inz)).alias("bars"),
                        (a["closes"] + one((b["close"] >= lo) & (b["close"] <= hi))).alias("closes"))
    def done(a):
        return F.struct(a["visits"].alias("visits"), a["bars"].alias("bars"), a["closes"].alias("closes"),
                        even(100.0 * a["bars"] / F.size(bars), 1).alias("time_pct"))
    return F.aggregate(bars, zero, step, done)


def frame_summary(bars: DataFrame, keys: list[str], s: Structure = Structure(), p: Levels = Levels(),
                  lookback: Column | int | None = None, forming: bool = False) -> DataFrame:
    """One row per series: structure and box at the newest bar, band width, walls of the lookback
    window, blind-zone extremes, and the window's bars for the zone reads.

    One shuffle: windows and the final fold share their partitioning. Only the bars the newest read
    depends on (the lookback and two in front of it) enter the heavy windows."""
    lb = F.lit(p.lookback) if lookback is None else (lookback if isinstance(lookback, Column) else F.lit(lookback))
    wing = p.pivot_wing
    w = Window.partitionBy(*keys).orderBy("ts")
    near = w.rowsBetween(-wing, wing)
    d = bars.withColumns({"_lb": lb, "_full": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_rn": F.row_number().over(w)})
    d = d.where(F.col("_rn") > F.col("_full") - F.greatest("_lb", F.lit(s.lookback)) - 2).drop("_rn")
    d = structure_table(d, keys, s, forming).withColumns({
        "_total": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        "_wh": F.max("high").over(near), "_wl": F.min("low").over(near)})
    back = F.col("_total") - F.col("n")                          # bars after this one
    start = F.greatest(F.lit(1), F.col("_total") - F.col("_lb") + 1)
    can = (F.col("n") >= start + wing) & (back >= wing) & (F.col("_wh") > F.col("_wl"))
    d = d.withColumn("_back", back).where((back < F.col("_lb")) | (back < s.lookback))
    inside = F.col("_back") < F.col("_lb")
    hi_pivot = F.when(inside & can & (F.col("high") >= F.col("_wh") - 1e-9), F.col("high"))
    lo_pivot = F.when(inside & can & (F.col("low") <= F.col("_wl") + 1e-9), F.col("low"))
    blind = (F.col("_back") == 1) if forming else (F.col("_back") < 2)
    recent = F.col("_back") < s.lookback
    last3 = F.col("_back") < 3
    fields = F.struct("struct", "box_hi", "box_lo", "er", "coil", F.col("_full").cast("int").alias("n"), F.col("close").alias("last"), "atr", "ts")
    g = d.groupBy(*keys).agg(
        F.max_by(fields, "ts").alias("b"),
        F.collect_list(hi_pivot).alias("_hp"), F.collect_list(lo_pivot).alias("_lp"),
        F.sort_array(F.collect_list(F.when(inside, F.struct("ts", "high", "low", "close")))).alias("window_bars"),
        F.max(F.when(blind, F.col("high"))).alias("blind_hi"), F.min(F.when(blind, F.col("low"))).alias("blind_lo"),
        (F.max(F.when(last3, F.col("high"))) - F.min(F.when(last3, F.col("low")))).alias("_tight"),
        F.percentile(F.when(recent, F.col("high")), F.lit(0.95)).alias("_p95"),
        F.percentile(F.when(recent, F.col("low")), F.lit(0.05)).alias("_p05"))
    g = g.select(*keys, "b.*", "window_bars", "blind_hi", "blind_lo", "_hp", "_lp", "_tight", "_p95", "_p05")
    span = (F.when(F.col("struct") == "CONSOLIDATION", F.col("_tight"))
             .when(F.col("n") >= 8, F.col("_p95") - F.col("_p05")).otherwise(F.col("box_hi") - F.col("box_lo")))
    enough = (F.col("n") >= p.min_bars) & (F.col("atr") > 0)
    return g.withColumns({
        "band_pct": F.when((F.col("struct") != "n/a") & (F.col("last") > 0), even(span / 2 / F.col("last") * 100, 2)),
        "walls": F.when(enough, cluster_walls(F.concat("_hp", "_lp"), p.tol_atr * F.col("atr"))).otherwise(F.array().cast(WALL)),
    }).drop("_hp", "_lp", "_tight", "_p95", "_p05")


def sr_levels(summary: DataFrame, spot: Column | None = None, p: Levels = Levels()) -> DataFrame:
    """Nearest support and resistance beyond the minimum distance, touch counts, zone activity and
    headroom (in ATR) to the nearest wall with two touches. A clear side has no value."""
    px = F.col("last") if spot is None else F.coalesce(spot, F.col("last"))
    a, md = F.col("atr"), p.min_dist_atr * F.col("atr")
    by_level = lambda c: F.struct(c["level"].alias("level"), c["touches"].alias("touches"))
    d = summary.withColumn("px", px)
    x = F.col("px")
    d = d.withColumns({
        "_res": F.array_min(F.transform(F.filter("walls", lambda c: c["level"] > x + md), by_level)),
        "_sup": F.array_max(F.transform(F.filter("walls", lambda c: c["level"] < x - md), by_level)),
        "_up2": F.array_min(F.transform(F.filter("walls", lambda c: (c["touches"] >= 2) & (c["level"] > x)), lambda c: c["level"])),
        "_dn2": F.array_max(F.transform(F.filter("walls", lambda c: (c["touches"] >= 2) & (c["level"] < x)), lambda c: c["level"]))})
    d = d.withColumns({
        "support": F.col("_sup.level"), "sup_touches": F.coalesce("_sup.touches", F.lit(0)),
        "resistance": F.col("_res.level"), "res_touches": F.coalesce("_res.touches", F.lit(0)),
        "head_up": even((F.col("_up2") - x) / nz(a), 2), "head_dn": even((x - F.col("_dn2")) / nz(a), 2)})
    for side, col in (("sup", "support"), ("res", "resistance")):
        z = zone_activity(F.col("window_bars"), F.col(col), a, p)
        d = d.withColumn("_z", F.when(F.col(col).isNotNull(), z))
        d = d.withColumns({f"{side}_{k}": F.coalesce(F.col(f"_z.{k}"), F.lit(0)) for k in ("visits", "bars", "time_pct")})
    return d.drop("_sup", "_res", "_up2", "_dn2", "_z")


def levels_report(summary: DataFrame, keys: list[str], p: Levels = Levels()) -> DataFrame:
    """Every wall of every series with its distance, touches and zone activity."""
    d = summary.select(*keys, "last", "atr", "window_bars", F.explode("walls").alias("wall"))
    d = d.withColumn("z", zone_activity(F.col("window_bars"), F.col("wall.level"), F.col("atr"), p))
    return d.select(*keys, F.col("wall.level").alias("level"), (100 * (F.col("wall.level") - F.col("last")) / nz(F.col("last"))).alias("dist_pct"),
                    F.col("wall.touches").alias("touches"), "z.*",
                    F.when(F.col("wall.level") > F.col("last"), "RES").otherwise("SUP").alias("side"))


LIVE = "array<struct<level:double,touches:int,edge:double,first:double>>"


def _merge_side(points: Column, tol: Column, cap: Column) -> Column:
    """Single-linkage merge of one side's walls: a wall joins the last cluster while it is within
    `tol` of its edge and the cluster stays within `cap` of its start; the strongest wall is the anchor."""
    def step(acc, p):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (p["level"] - last["edge"] <= tol) & (p["level"] - last["first"] <= cap)
        stronger = p["touches"] > last["touches"]
        merged = F.struct(F.when(stronger, p["level"]).otherwise(last["level"]).alias("level"),
                          F.when(stronger, p["touches"]).otherwise(last["touches"]).alias("touches"),
                          p["level"].alias("edge"), last["first"].alias("first"))
        new = F.struct(p["level"].alias("level"), p["touches"].alias("touches"), p["level"].alias("edge"), p["level"].alias("first"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(new)))
    # ascending by level; equal levels keep their incoming order
    ordered = F.array_sort(points, lambda a, b: F.when(a["level"] < b["level"], -1).when(a["level"] > b["level"], 1).otherwise(0))
    return F.aggregate(ordered, F.array().cast(LIVE), step)


def live_levels(board: DataFrame, p: Levels = Levels(), px: str = "ltp", atr: str = "sr_atr", walls: str = "wall_pair",
                side: str = "side") -> DataFrame:
    """Nearest walls, headroom and at-wall text of each row against its current price. Walls are
    merged on each side of the price on its own, so no cluster reaches across it."""
    x, a = F.col(px), F.coalesce(F.when(F.col(atr) > 0, F.col(atr)), F.lit(0.0))
    usable = F.coalesce((x > 0) & (F.size(walls) > 0), F.lit(False))
    tol, cap = p.tol_atr * a, p.cluster_cap * p.tol_atr * a
    plain = lambda arr: F.transform(arr, lambda c: F.struct(c["level"].alias("level"), c["touches"].alias("touches")))
    below0, above0 = F.filter(walls, lambda c: c["level"] < x), F.filter(walls, lambda c: c["level"] >= x)
    d = board.withColumns({
        "_below": F.when(a > 0, plain(_merge_side(below0, tol, cap))).otherwise(plain(below0)),
        "_above": F.when(a > 0, plain(_merge_side(above0, tol, cap))).otherwise(plain(above0))})
    md = p.min_dist_atr * a
    d = d.withColumns({
        "_s": F.when(usable, F.array_max(F.filter("_below", lambda c: (c["touches"] >= 2) | (c["level"] < x - md)))),
        "_r": F.when(usable, F.array_min(F.filter("_above", lambda c: (c["touches"] >= 2) | (c["level"] > x + md)))),
        "_at": F.when(usable & (a > 0), F.array_min(F.transform(
            F.filter(F.concat("_below", "_above"), lambda c: (c["touches"] >= 2) & (F.abs(c["level"] - x) <= p.at_wall_atr * a)),
            lambda c: F.struct(F.abs(c["level"] - x).alias("d"), c["level"].alias("level"), c["touches"].alias("touches")))))})
    inf = F.lit(float("inf"))
    up = F.when((a > 0) & F.col("_r").isNotNull(), even((F.col("_r.level") - x) / a, 2)).otherwise(inf)
    dn = F.when((a > 0) & F.col("_s").isNotNull(), even((x - F.col("_s.level")) / a, 2)).otherwise(inf)
    return d.withColumns({
        "sup": even("_s.level", 2), "sup_t": F.coalesce("_s.touches", F.lit(0)),
        "res": even("_r.level", 2), "res_t": F.coalesce("_r.touches", F.lit(0)),
        "headroom": F.when(F.coalesce(F.col(side) == "SHORT", F.lit(False)), dn).otherwise(up),
        "at_wall": F.when(F.col("_at").isNull(), "").otherwise(F.format_string(
            "%s %s x%d", F.when(F.col("_at.level") >= x, "RES").otherwise("SUP"), fixed2(F.col("_at.level")), F.col("_at.touches"))),
    }).drop("_below", "_above", "_s", "_r", "_at")


def big_wall(board: DataFrame, frame: str, p: Levels = Levels(), px: str = "ltp", atr: str = "sr_atr", walls: str = "up_walls",
             blind_lo: str = "up_blind_lo", blind_hi: str = "up_blind_hi", side: str = "side") -> DataFrame:
    """Nearest wall of one frame up in the direction of the trade, and the gap to it in ATR. A cluster
    around the price is quoted at its edge facing the trade; the frame's unpivoted last bars count
    as a one-touch wall marked with a tilde."""
    x, a = F.col(px), F.coalesce(F.when(F.col(atr) > 0, F.col(atr)), F.lit(0.0))
    usable = F.coalesce((x > 0) & (a > 0), F.lit(False))
    md = p.min_dist_atr * a
    short = F.coalesce(F.col(side) == "SHORT", F.lit(False))
    def pack(level, touches, mark):
        return F.struct(level.alias("level"), touches.cast("int").alias("touches"), mark.alias("mark"))
    empty = F.array().cast("array<struct<level:double,touches:int,mark:string>>")
    def blind_wall(edge, ahead):
        return F.when(F.coalesce(ahead, F.lit(False)), F.array(pack(edge, F.lit(1), F.lit("~")))).otherwise(empty)
    w = F.coalesce(F.col(walls), F.array().cast(WALL))
    up_edge = F.transform(w, lambda c: pack(F.when((c["level"] <= x) & (x < c["hi"]), c["hi"]).otherwise(c["level"]), c["touches"], F.lit("")))
    dn_edge = F.transform(w, lambda c: pack(F.when((c["level"] >= x) & (x > c["lo"]), c["lo"]).otherwise(c["level"]), c["touches"], F.lit("")))
    up = F.filter(up_edge, lambda c: ((c["touches"] >= 2) | (c["level"] > x + md)) & (c["level"] > x))
    dn = F.filter(dn_edge, lambda c: ((c["touches"] >= 2) | (c["level"] < x - md)) & (c["level"] <= x))
    up = F.concat(up, blind_wall(F.col(blind_hi), F.col(blind_hi) > x))
    dn = F.concat(dn, blind_wall(F.col(blind_lo), F.col(blind_lo) < x))
    # the first of equally near walls in list order wins
    near_up = F.element_at(F.array_sort(up, lambda p_, q: F.when(p_["level"] < q["level"], -1).when(p_["level"] > q["level"], 1).otherwise(0)), 1)
    near_dn = F.element_at(F.array_sort(dn, lambda p_, q: F.when(p_["level"] > q["level"], -1).when(p_["level"] < q["level"], 1).otherwise(0)), 1)
    pick = F.when(short, F.when(F.size(dn) > 0, near_dn)).otherwise(F.when(F.size(up) > 0, near_up))
    d = board.withColumn("_w", F.when(usable, pick))
    return d.withColumns({
        "big_wall": F.when(F.col("_w").isNull(), "").otherwise(
            F.format_string(f"{frame} %s ×%d%s", fixed2(F.col("_w.level")), "_w.touches", "_w.mark")),
        "big_gap": F.when(F.col("_w").isNull(), F.lit(float("inf"))).otherwise(even(F.abs(F.col("_w.level") - x) / a, 2)),
        "big_wall_px": F.col("_w.level")}).drop("_w")
