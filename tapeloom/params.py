"""Default thresholds, grouped by the operator family that reads them.

Every operator takes its parameter object as an argument; nothing reads a clock, an environment
variable or a global. The values below are fixed values: results must agree with them.
"""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signal:
    clr: float = 0.70            # close in the top 30 % of the day's range
    deliv_trail: float = 60.0    # trailing delivery percentage, known before the close
    deliv_trail_win: int = 3
    vol_ratio: float = 2.0
    ret: float = 0.01
    close_vs_vwap: float = 0.005
    rs_lookback: int = 10
    rs_min: float = 0.0
    liq_lacs: float = 2000.0
    lookback: int = 20
    atr_win: int = 14
    cost_bps: float = 22.0
    day2_cost_bps: float = 6.0
    vol_cap: float = 6.0
    regime_ma: int = 50
    max_stale_days: int = 5
    top_n: int = 5
    max_per_sector: int = 2
    event_horizon_days: int = 3
    min_year_rows: int = 20


@dataclass(frozen=True)
class Structure:
    lookback: int = 20
    breakout_atr: float = 0.5
    trend_er: float = 0.40
    trend_atr: float = 1.0
    coil: float = 0.60
    spike_atr: float = 2.0
    atr_win: int = 14
    min_bars: int = 5


@dataclass(frozen=True)
class Levels:
    tol_atr: float = 0.6
    lookback: int = 60
    daily_lookback: int = 180
    min_dist_atr: float = 0.25
    at_wall_atr: float = 0.15
    cluster_cap: float = 3.0     # width cap of a live cluster, in units of tol_atr
    min_bars: int = 12
    pivot_wing: int = 2
    gap: float = 0.25            # overnight move that counts as a corporate action
    daily_days: int = 430        # calendar days of daily history
    monthly_days: int = 2400     # and of the months' history


@dataclass(frozen=True)
class Tilt:
    mom_2w: int = 10
    mom_1w: int = 5
    dv_base: int = 100
    dv_flow: int = 5
    min_hist: int = 12
    min_sectors: int = 8
    min_names: int = 5
    panel_cal: int = 260         # calendar days: a sector needs min_hist rows in panel_cal - 1
    w_rs2: float = 0.60
    w_rs1: float = 0.25
    w_dv5: float = 0.15
    ow_rank: float = 0.75
    uw_rank: float = 0.25
    watch_breadth: float = 0.55
    watch_rank: float = 0.35
    slope_bps: float = 290.0
    disp_min: float = 1.5
    accum_r5: float = 1.05
    deliv_min_hist: int = 40
    slope_win: int = 15
    pers_cal: int = 620
    pers_fwd: int = 10
    pers_min_obs: int = 30
    min_turnover: float = 100.0
    clip_pct: float = 25.0
    drop_pct: float = 40.0
    exclude: tuple = ("ETF", "Others")
    series: tuple = ("EQ", "SM", "ST")
    tenure_cap: int = 90


@dataclass(frozen=True)
class Regime:
    ema_fast: int = 20
    ema_slow: int = 50
    vol_win: int = 20
    vol_hi: float = 0.80
    pullback: float = -3.0
    ret_short: int = 5
    ret_mid: int = 20
    trend_win: int = 40
    slope_win: int = 10
    confirm: int = 3
    er_win: int = 20
    er_strong: float = 0.50
    er_choppy: float = 0.30
    min_rows: int = 60


@dataclass(frozen=True)
class Basis:
    min_dte: int = 3
    exdiv: float = 0.25
    confirm_q: int = 5


@dataclass(frozen=True)
class Delivery:
    base_days: int = 30
    min_hist: int = 15
    slots: int = 5
    recent_days: int = 7
    norm_rows: int = 100


@dataclass(frozen=True)
class Calibration:
    min_read: int = 10
    min_trust: int = 40
    floor: float = 0.30
    cap: float = 1.00
    forming_cap: float = 0.75
    tau_floor: float = 8.0
    decay_rows: int = 20
    decay_min: int = 25


@dataclass(frozen=True)
class Charge:
    """One charge of a round trip: basis points of a leg's value, on how many of its two legs, whether
    service tax falls on it, and the most it may be for a leg, in money."""
    name: str
    bps: float
    legs: int
    taxed: bool
    most: float | None = None


@dataclass(frozen=True)
class Cost:
    position: float = 200_000.0
    price: float = 1000.0
    spread_ticks: float = 2.0
    tick: float = 0.05
    service_tax: float = 0.18
    # fixed values
    charges: tuple = (Charge("brokerage", 3.0, 2, True, 20.0), Charge("exchange", 0.297, 2, True), Charge("sebi", 0.01, 2, True),
                      Charge("stt", 2.5, 1, False), Charge("stamp", 0.3, 1, False))


@dataclass(frozen=True)
class Session:
    """Session clock in minutes after midnight."""
    open_min: int = 9 * 60 + 15
    close_min: int = 15 * 60 + 30
    carry_min: int = 15 * 60 + 10
    last30_min: int = 15 * 60


# Share of the day's volume traded by each five-minute mark from 09:15 to 15:25.
VOLUME_PROFILE_START = 9 * 60 + 15
VOLUME_PROFILE_STEP = 5
VOLUME_PROFILE = (
    0.0424, 0.0674, 0.0874, 0.1073, 0.1232, 0.1383, 0.1546, 0.1695, 0.1827, 0.1960,
    0.2104, 0.2216, 0.2340, 0.2464, 0.2586, 0.2696, 0.2813, 0.2935, 0.3047, 0.3175,
    0.3289, 0.3413, 0.3519, 0.3609, 0.3707, 0.3812, 0.3899, 0.4004, 0.4121, 0.4228,
    0.4328, 0.4428, 0.4521, 0.4648, 0.4739, 0.4842, 0.4954, 0.5052, 0.5165, 0.5269,
    0.5365, 0.5454, 0.5553, 0.5642, 0.5740, 0.5853, 0.5948, 0.6050, 0.6134, 0.6230,
    0.6335, 0.6413, 0.6512, 0.6604, 0.6715, 0.6812, 0.6911, 0.7022, 0.7110, 0.7234,
    0.7340, 0.7450, 0.7563, 0.7684, 0.7815, 0.7944, 0.8083, 0.8215, 0.8367, 0.8608,
    0.8853, 0.9115, 0.9436, 0.9742, 1.0000,
)

# Probability that a move exceeds its cost, by cost / expected-move ratio.
PAYS_RATIO = (0.25, 0.40, 0.50, 0.60, 0.75, 1.00, 1.25, 1.50, 2.00, 2.50, 3.00)
PAYS_PROB = (81.4, 72.3, 66.5, 61.0, 53.3, 42.3, 33.5, 26.5, 16.8, 10.8, 7.1)
EXP_MOVE_A, EXP_MOVE_B = 2.271, 0.854
PAYS_OK, PAYS_MARGINAL = 60.0, 45.0

# Setup quality, best first.
TAG_RANK = {
    "WITH-TREND CONTINUATION": 0,
    "RANGE-TOP BREAK": 1,
    "RANGE-FLOOR BREAK": 1,
    "PULLBACK vs HTF": 2,
    "COIL AT THE EXTREME": 3,
    "EXTENDED (aligned)": 4,
    "DRIFT-IN-RANGE": 5,
    "NESTED SQUEEZE": 6,
    "RANGE-BOUND (no setup)": 7,
    "FALSE-BREAK TRAP": 8,
    "HTF warming": 9,
    "LTF warming": 9,
    "n/a": 10,
}

# Measured excess in bps by hold and tag.
LONG_EVIDENCE = {
    "intraday": {"WITH-TREND CONTINUATION": 10.5, "COIL AT THE EXTREME": -3.8, "RANGE-TOP BREAK": -12.4},
    "overnight": {"RANGE-TOP BREAK": 25.5, "COIL AT THE EXTREME": 5.2, "WITH-TREND CONTINUATION": 3.1},
    "5d": {"WITH-TREND CONTINUATION": 41.0, "COIL AT THE EXTREME": 7.4, "RANGE-TOP BREAK": -7.3},
    "20d": {"WITH-TREND CONTINUATION": 93.2, "COIL AT THE EXTREME": 57.9, "RANGE-TOP BREAK": 24.4},
}
SHORT_EVIDENCE = {
    "intraday": {"WITH-TREND CONTINUATION": -8.7, "COIL AT THE EXTREME": -9.1, "RANGE-FLOOR BREAK": -41.3},
    "overnight": {"RANGE-FLOOR BREAK": 13.4, "WITH-TREND CONTINUATION": -1.3, "COIL AT THE EXTREME": -1.9},
    "5d": {"RANGE-FLOOR BREAK": 14.0, "WITH-TREND CONTINUATION": 5.8, "COIL AT THE EXTREME": -37.2},
    "20d": {"RANGE-FLOOR BREAK": 89.6, "WITH-TREND CONTINUATION": -23.1, "COIL AT THE EXTREME": -70.8},
}
PRESET_HOLD = {"intraday": "intraday", "btst": "overnight", "swing": "5d", "positional": "20d"}
LONG_YEARS = {"RANGE-TOP BREAK": "9 of 9", "WITH-TREND CONTINUATION": "5 of 9", "COIL AT THE EXTREME": "3 of 9"}
INTRADAY_BASE = -10.2

# Delivery baseline length and bucket by holding horizon.
DELIV_BASE_BY_HORIZON = {"intraday": 15, "btst": 30, "swing": 45, "positional": 60}
DELIV_BUCKET_BY_HORIZON = {"intraday": "day", "btst": "day", "swing": "week", "positional": "week"}
