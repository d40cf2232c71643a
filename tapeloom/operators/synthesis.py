"""Two-frame reading: setup tag, direction, side, ranks and verdict text.

A setup is decided by the structure of the two frames and by where the price sits in the higher
frame's box; everything is a column expression.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from ..functions.rolling import yes

RANGES = ("CONSOLIDATION", "RANGE")
UPS = ("BREAKOUT_UP", "TREND_UP")
DIRECTIONAL = ("WITH-TREND CONTINUATION", "RANGE-TOP BREAK", "RANGE-FLOOR BREAK", "PULLBACK vs HTF",
               "EXTENDED (aligned)", "COIL AT THE EXTREME")
EDGE_HI, EDGE_LO = 0.72, 0.28


def location(spot: Column, lo: Column, hi: Column) -> Column:
    """Position of the price in the box, 0 at the low and 1 at the high."""
    usable = (hi != 0) & (lo != 0) & (hi > lo) & (spot != 0)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (spot - lo) / (hi - lo))))


def synthesize(hs: Column, h_hi: Column, h_lo: Column, h_n: Column, ls: Column, spot: Column) -> dict[str, Column]:
    """tag, dir and loc of a (higher structure and box, lower structure, price) row."""
    hs, ls = F.coalesce(hs, F.lit("n/a")), F.coalesce(ls, F.lit("n/a"))
    cold_h = (hs == "n/a") | (F.coalesce(h_n, F.lit(0)) < 6)
    cold_l = ls == "n/a"
    loc = location(spot, h_lo, h_hi)
    near_hi, near_lo = yes(loc >= EDGE_HI), yes(loc <= EDGE_LO)
    h_range, l_range = hs.isin(*RANGES), ls.isin(*RANGES)
    h_up, l_up = hs.isin(*UPS), ls.isin(*UPS)
    trend_dir = F.when(h_up, "UP").otherwise("DOWN")
    extreme = F.when(h_up, near_hi).otherwise(near_lo)
    coil = (hs == "CONSOLIDATION") | (ls == "CONSOLIDATION")
    up_break, dn_break = ls == "BREAKOUT_UP", ls == "BREAKOUT_DOWN"
    in_range = (F.when(l_range, F.when(coil, "NESTED SQUEEZE").otherwise("RANGE-BOUND (no setup)"))
                 .when(up_break, F.when(near_hi, "RANGE-TOP BREAK").otherwise("FALSE-BREAK TRAP"))
                 .when(dn_break, F.when(near_lo, "RANGE-FLOOR BREAK").otherwise("FALSE-BREAK TRAP"))
                 .otherwise("DRIFT-IN-RANGE"))
    in_trend = (F.when(l_range, F.when(extreme, "COIL AT THE EXTREME").otherwise("WITH-TREND CONTINUATION"))
                 .when(l_up == h_up, "EXTENDED (aligned)").otherwise("PULLBACK vs HTF"))
    tag = F.when(cold_h, "HTF warming").when(cold_l, "LTF warming").when(h_range, in_range).otherwise(in_trend)
    direction = (F.when(cold_h | cold_l, "NONE")
                  .when(h_range, F.when(up_break & near_hi, "UP").when(dn_break & near_lo, "DOWN").otherwise("NONE"))
                  .otherwise(trend_dir))
    return {"setup": tag, "dir": direction, "loc": F.when(~cold_h & ~cold_l, loc)}


def side_of(tag: Column, direction: Column) -> Column:
    return (F.when(tag.isin(*DIRECTIONAL) & (direction == "UP"), "LONG")
             .when(tag.isin(*DIRECTIONAL) & (direction == "DOWN"), "SHORT").otherwise("—"))


def _lookup(tag: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(tag == k, F.lit(v))
    return out.otherwise(F.lit(default))


def setup_rank(tag: Column) -> Column:
    return _lookup(tag, P.TAG_RANK, 9)


def _evidence(tag: Column, side: str, preset: str) -> tuple[Column, str]:
    hold = P.PRESET_HOLD.get(preset, "overnight")
    table = (P.LONG_EVIDENCE if side == "LONG" else P.SHORT_EVIDENCE)[hold]
    return _lookup(tag, table, None).cast("double"), hold


def evidence_rank(tag: Column, side: str, preset: str = "btst") -> Column:
    """Sort key, lower is better; a tag without evidence for the hold sorts last."""
    ev, _ = _evidence(tag, side, preset)
    return (-F.bround(F.coalesce(ev, F.lit(-999.0)) * 10, 0)).cast("int")


# The verdict texts of the next two functions are fixed values.
def long_verdict(tag: Column, preset: str = "btst") -> Column:
    ev, hold = _evidence(tag, "LONG", preset)
    years = _lookup(tag, P.LONG_YEARS, "")
    pct = ev / 100
    if hold == "intraday":
        return F.when(ev.isNull(), "— not measured for this hold").otherwise(F.format_string(
            "⛔ Gap is already gone — the day gives it back (%+.2f%% on the day)", (ev + P.INTRADAY_BASE) / 100))
    return (F.when(ev.isNull(), "— not measured for this hold")
             .when(ev >= 25, F.format_string("✅ BEST for this hold — %+.2f%% vs buying any stock · worked %s years", pct, years))
             .when(ev <= 0, F.format_string("⛔ LOSES money if you hold this long (%+.2f%% vs buying any stock)", pct))
             .otherwise(F.format_string("⚠️ Weak here — only %+.2f%% vs buying any stock · worked %s years", pct, years)))


def short_verdict(tag: Column, preset: str = "btst") -> Column:
    ev, hold = _evidence(tag, "SHORT", preset)
    pct = ev / 100
    last = (F.format_string("⛔ Every multi-day short LOSES — this one loses least (%+.2f%%)", pct) if hold in ("5d", "20d")
            else F.format_string("⚠️ Only %+.2f%% better than a random short — not an edge", pct))
    return (F.when(ev.isNull(), "— not measured for this hold")
             .when(ev <= -35, F.format_string("⛔ It BOUNCES — worst short here (%+.2f%% vs shorting any stock)", pct))
             .when(ev < 0, F.format_string("⛔ Worse than shorting a random stock (%+.2f%%)", pct)).otherwise(last))
