"""Whole feature blocks over bars that recursions run through: technical set, indicator set, tick microstructure.

Each block is a function of a frame's columns in NumPy; frames are runs of rows of a key with as
many earlier rows as the slowest recursion needs to forget (stateful.frames_by_rows). Windows are
NULL until they are full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Rows before a frame: after these the slowest mean of the technical set keeps less than 1e-12 of older values.
WARMUP = 1_440
#: Lookbacks of returns, spans of exponential means, rows of the price range.
RETURNS, SPANS, RANGES = (1, 3, 6, 12, 24), (10, 20, 50, 100), (12, 24, 48)


def lagged(x: np.ndarray, k: int = 1) -> np.ndarray:
    """x k rows ago."""
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]])


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = alpha x + (1 - alpha) y_before from the first value on."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def rolled(x: np.ndarray, n: int, function) -> np.ndarray:
    """function(windows, axis=1) of the last n values; no value if one of them is missing."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        windows, at_once = np.lib.stride_tricks.sliding_window_view(x, n), max(1, 2_000_000 // n)  # functions copy their windows
        for i in range(0, len(windows), at_once):
            out[n - 1 + i : n - 1 + i + at_once] = function(windows[i : i + at_once], axis=1)
    return out


def deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation of the last n values."""
    return rolled(x, n, lambda w, axis: w.std(axis=axis, ddof=1))


def slope(x: np.ndarray, n: int) -> np.ndarray:
    """Slope of a line through the last n values."""
    at = np.arange(n) - (n - 1) / 2
    return rolled(x, n, lambda w, axis: w @ at / (at @ at))


def autocorrelation(x: np.ndarray, n: int) -> np.ndarray:
    """Correlation of the last n values with those before each; none where either hardly varies."""
    before = lagged(x)
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        a, b = (np.lib.stride_tricks.sliding_window_view(y, n) for y in (x, before))
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        va, vb = (a * a).mean(axis=1), (b * b).mean(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[n - 1 :] = np.where((va > 1e-16) & (vb > 1e-16), (a * b).mean(axis=1) / np.sqrt(va * vb), np.nan)
    return out


def flag(condition: np.ndarray) -> np.ndarray:
    """1 where the condition holds, else 0."""
    return condition.astype(float)


def technical_set(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The technical features of one clock from high, low and close.

    Returns, distance from exponential means and their slope and ratio, RSI, MACD, Bollinger place
    and width, deviations of returns, true range, range places, line slope, autocorrelation, share
    of rising bars. RSI is 50 where nothing fell.
    """
    h, l, c = bars["high"], bars["low"], bars["close"]  # noqa: E741
    out = {f"ret_{k}": c / lagged(c, k) - 1 for k in RETURNS}
    mean = {s: ewm(c, 2 / (s + 1)) for s in (*SPANS, 12, 26)}
    for s in SPANS:
        out |= {f"dist_ema{s}": c / mean[s] - 1, f"above_ema{s}": flag(c / mean[s] - 1 > 1e-12)}
    out |= {"ema20_slope": (mean[20] - lagged(mean[20])) / c, "ema_fast_slow": mean[10] / mean[50] - 1}
    move = c - lagged(c)
    up, down = ewm(np.where(np.isnan(move), np.nan, np.maximum(move, 0)), 1 / 14), ewm(np.where(np.isnan(move), np.nan, np.maximum(-move, 0)), 1 / 14)
    with np.errstate(invalid="ignore", divide="ignore"):
        rsi = np.where(down > 1e-15, 100 - 100 / (1 + up / down), 50.0)
    out |= {"rsi": (rsi - 50) / 50, "rsi_rising": flag(rsi - lagged(rsi) > 1e-9), "rsi_ob": flag(rsi > 70), "rsi_os": flag(rsi < 30)}
    macd = mean[12] - mean[26]
    signal = ewm(macd, 0.2)
    out |= {"macd_hist": (macd - signal) / c, "macd_pos": flag(macd - signal > 1e-13)}
    mid, dev = rolled(c, 20, np.mean), deviation(c, 20)
    out |= {"bb_pctb": (c - mid) / (2 * dev + 1e-6), "bb_width": 4 * dev / mid}
    ret = out["ret_1"]
    out |= {"rv_12": deviation(ret, 12), "rv_24": deviation(ret, 24)}
    past = np.where(np.isnan(lagged(c)), h, lagged(c))
    first = np.isnan(lagged(c))
    true_range = np.where(first, h - l, np.maximum(h - l, np.maximum(np.abs(h - past), np.abs(l - past))))
    out["atr_pct"] = ewm(true_range, 1 / 14) / c
    for n in RANGES:
        hi, lo = rolled(h, n, np.max), rolled(l, n, np.min)
        out |= {f"rangepos_{n}": (c - lo) / (hi - lo + 1e-9), f"dist_hi_{n}": c / hi - 1, f"dist_lo_{n}": c / lo - 1}
    out |= {"slope_20": slope(c, 20) / c, "autocorr_10": autocorrelation(ret * 1e4, 20), "upfrac_10": rolled(flag(np.nan_to_num(ret) > 0), 10, np.mean)}
    return out


#: Names of technical_set's features.
TECHNICAL = list(technical_set({x: np.ones(2) for x in ("high", "low", "close")}))


def indicator_set(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Disparity, scaled distance, relative volatility, Chande momentum, trend intensity, efficiency, volatility ratio, choppiness."""
    c = bars["close"]
    move = c - lagged(c)
    far = lambda n: c / rolled(c, n, np.mean) - 1
    still = lambda x: np.where(x < 1e-7, 0.0, x)
    dev = still(deviation(c, 10)) * 1e4
    change = dev - lagged(dev)
    ups, downs = (ewm(np.where(np.isnan(change), np.nan, np.maximum(s * change, 0)), 0.1) for s in (1, -1))
    path = np.abs(move)
    rise, fall = rolled(np.maximum(move, 0), 14, np.sum), rolled(np.maximum(-move, 0), 14, np.sum)
    mean30 = rolled(c, 30, np.mean)
    above, below = (rolled(np.where(np.isnan(mean30), np.nan, flag(x)), 30, np.sum) for x in (c - mean30 > 1e-9, c - mean30 < -1e-9))
    width = rolled(c, 14, np.max) - rolled(c, 14, np.min)
    return {
        "disp": far(14) * 100, "madz": far(20) / (2 * deviation(far(20), 20) + 1e-7), "rvivol": 100 - 100 / (1 + ups / (downs + 1e-7)),
        "cmo": (rise - fall) / (rise + fall + 1e-7) * 100, "tii": above / (above + below + 1e-12) * 100,
        "kamaer": np.abs(c - lagged(c, 10)) / (rolled(path, 10, np.sum) + 1e-7), "volr": still(deviation(c, 5)) / (still(deviation(c, 20)) + 1e-7),
        "chop": 100 * np.log10(rolled(path, 14, np.sum) / (width + 1e-7) + 1e-7) / np.log10(14),
    }


#: Names of indicator_set's features.
INDICATORS = ["disp", "madz", "rvivol", "cmo", "tii", "kamaer", "volr", "chop"]


#: Rows before a frame of the microstructure set, after which its slowest mean keeps less than 1e-12 of older values.
MICRO_WARMUP = 50_000
#: Spans and lengths of the microstructure set in rows.
IMB_SPANS, DEV_SPANS, MICRO_RETURNS, MICRO_VOLS = (3, 5, 10, 20, 40, 80), (5, 15, 30, 60), (5, 15, 30, 60, 120, 300, 600, 1_800, 3_600), (30, 60, 300, 900, 1_800, 3_600)
MEAN_SPANS, STRETCHES, PLACES = (60, 300, 900, 1_800, 3_600), (120, 300, 900, 1_800), (300, 900, 1_800, 3_600)


def microstructure_set(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Imbalance, micro-price, spread, activity, returns, volatilities, stretch and range places of short quote bars.

    bars: t, mid, micro, imb, spread, nt, tsz. Exponential means have weights that sum to one;
    windows of deviations and extremes are as long as their name says, in rows.
    """
    mid, micro, imb = (pd.Series(bars[c]) for c in ("mid", "micro", "imb"))
    mean = lambda x, span: x.ewm(span=span).mean()
    sign = np.sign(imb.round(9))
    out = {"imb": imb} | {f"imb_ema{w}": mean(imb, w) for w in IMB_SPANS}
    out |= {"imb_acc": out["imb_ema5"] - out["imb_ema40"], "imb_chg": imb.diff(3), "imb_sgn_ac30": (sign * sign.shift(1)).rolling(30).mean(), "imb_sameside30": (sign == sign.shift(1)).astype(float).rolling(30).mean()}
    change = (sign != sign.shift(1)).cumsum()
    out["imb_runlen"] = ((sign.groupby(change).cumcount() + 1) * sign).clip(-50, 50)
    dev = (micro - mid) / mid * 1e4
    out |= {"micro_dev": dev} | {f"micro_dev_ema{w}": mean(dev, w) for w in DEV_SPANS} | {f"micro_mom{w}": micro / micro.shift(w) - 1 for w in (15, 60)}
    for c in ("spread", "nt", "tsz"):
        x = pd.Series(bars[c]).astype(float)
        out |= {c: x, f"{c}_ema30": mean(x, 30)}
    ret = mid / mid.shift(1) - 1
    # window by window: running sums stay wrong long after one wild price
    vol = {w: pd.Series(deviation(ret.to_numpy(), w)) for w in sorted({*MICRO_VOLS, *STRETCHES, *PLACES})}
    far = {w: mid / mean(mid, w) - 1 for w in sorted({*MEAN_SPANS, *STRETCHES})}
    out |= {f"ret{w}": mid / mid.shift(w) - 1 for w in MICRO_RETURNS} | {f"rv{w}": vol[w] for w in MICRO_VOLS} | {f"emadist{w}": far[w] for w in MEAN_SPANS}
    out |= {f"stretch{w}": far[w] / (vol[w] * np.sqrt(w) + 1e-6) for w in STRETCHES}
    for w in PLACES:
        hi, lo = mid.rolling(w).max(), mid.rolling(w).min()
        out |= {f"rangepos{w}": (mid - lo) / (hi - lo + 1e-9), f"bbw{w}": vol[w] * np.sqrt(w)}
    out |= {"rel_ratio": out["bbw300"] / (out["bbw1800"] + 1e-9), "rel_ratio2": out["bbw900"] / (out["bbw3600"] + 1e-9)}
    hour, day = bars["t"] // 3_600 % 24, (bars["t"] // 86_400 + 3) % 7
    out |= {"hsin": np.sin(2 * np.pi * hour / 24), "hcos": np.cos(2 * np.pi * hour / 24), "dow": day.astype(float)}
    return {k: np.asarray(v, float) for k, v in out.items()}


#: Names of microstructure_set's features.
MICROSTRUCTURE = list(microstructure_set({c: np.arange(1.0, 4.0) for c in ("t", "mid", "micro", "imb", "spread", "nt", "tsz")}))
