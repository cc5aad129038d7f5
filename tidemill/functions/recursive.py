"""Recursive series: each value needs the one before, so a code's rows are walked in order.

Spark groups rows by code; these small numpy loops run inside the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_code(df: DataFrame, compute, columns: dict[str, str], code: str = "code", ts: str = "d") -> DataFrame:
    """``df`` with columns that ``compute(frame sorted by ts)`` gives for each code.

    columns: name to type.  The general extension point: any function from one
    code's frame to new columns.
    """
    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{n}` {t}" for n, t in columns.items()])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts, kind="stable")
        return frame.assign(**compute(frame))

    return df.groupBy(code).applyInPandas(run, schema)


def ema(x, n: int) -> np.ndarray:
    """Weighted mean with weights (1 - 2/(n+1))^age; null for the first n - 2 values."""
    keep, num, den, seen = 1 - 2 / (n + 1), 0.0, 0.0, 0
    out = np.full(len(x), np.nan)
    for i, v in enumerate(np.asarray(x, float)):
        if v == v:
            num, den, seen = num * keep + v, den * keep + 1, seen + 1
        elif seen:
            num, den = num * keep, den * keep
        if seen >= max(1, n - 1):
            out[i] = num / den
    return out


def sma(x, n: int, m: int = 1) -> np.ndarray:
    """y = (m x + (n - m) y') / n.  The first row is ignored; the first value k after it seeds rows k - 1 and k."""
    x, out, y = np.asarray(x, float), np.full(len(x), np.nan), None
    for i in range(1, len(x)):
        if x[i] != x[i]:
            continue
        if y is None:
            y = out[i - 1] = x[i]
        else:
            y = (m * x[i] + (n - m) * y) / n
        out[i] = y
    return out


def wilder(x, n: int) -> np.ndarray:
    """Mean of the first n values, then y = (y' (n - 1) + x) / n; leading nulls are skipped."""
    x, out = np.asarray(x, float), np.full(len(x), np.nan)
    good = np.flatnonzero(x == x)
    if len(good) < n:
        return out
    at = good[0] + n - 1
    y = out[at] = x[good[0] : at + 1].mean()
    for i in range(at + 1, len(x)):
        y = out[i] = (y * (n - 1) + x[i]) / n
    return out


def ta_ema(x, n: int) -> np.ndarray:
    """Mean of the first n values, then the usual recursion with 2/(n+1)."""
    x, out = np.asarray(x, float), np.full(len(x), np.nan)
    good = np.flatnonzero(x == x)
    if len(good) < n:
        return out
    at, a = good[0] + n - 1, 2 / (n + 1)
    y = out[at] = x[good[0] : at + 1].mean()
    for i in range(at + 1, len(x)):
        y = out[i] = y + a * (x[i] - y)
    return out


def kama(x, n: int = 30) -> np.ndarray:
    """Adaptive mean: smoothing between 2/3 and 2/31 by the efficiency of the last n moves."""
    x, out = np.asarray(x, float), np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    y = x[n - 1]
    for i in range(n, len(x)):
        noise = np.abs(np.diff(x[i - n : i + 1])).sum()
        e = abs(x[i] - x[i - n]) / noise if noise else 1.0
        y = out[i] = y + (e * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - y)
    return out


def sar(high, low, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse."""
    h, l, out = np.asarray(high, float), np.asarray(low, float), np.full(len(high), np.nan)
    if len(h) < 2:
        return out
    up = not (l[0] - l[1] > max(h[1] - h[0], 0))
    stop, best, a = (l[0], h[1], step) if up else (h[0], l[1], step)
    for i in range(1, len(h)):
        if up and l[i] <= stop or not up and h[i] >= stop:
            up, stop = not up, best
            stop = max(stop, h[i], h[i - 1]) if not up else min(stop, l[i], l[i - 1])
            out[i] = stop
            best, a = (h[i] if up else l[i]), step
        else:
            out[i] = stop
            if up and h[i] > best or not up and l[i] < best:
                best, a = (h[i] if up else l[i]), min(most, a + step)
        stop += a * (best - stop)
        stop = min(stop, l[i], l[i - 1]) if up else max(stop, h[i], h[i - 1])
    return out


def super_trend(high, low, close, n: int = 12, factor: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): bands of factor x ATR that only tighten while the trend lasts."""
    h, l, c = (np.asarray(v, float) for v in (high, low, close))
    before = np.append(np.nan, c[:-1])
    true_range = np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before)))
    band, line, side = factor * wilder(true_range, n), np.full(len(c), np.nan), np.zeros(len(c))
    top = bottom = np.nan
    way = 1
    for i in range(len(c)):
        if band[i] != band[i]:
            continue
        mid = (h[i] + l[i]) / 2
        up, down = mid + band[i], mid - band[i]
        if top == top:
            up = min(up, top) if c[i - 1] <= top else up
            down = max(down, bottom) if c[i - 1] >= bottom else down
            way = 1 if c[i] > top else -1 if c[i] < bottom else way
        top, bottom = up, down
        line[i], side[i] = (bottom if way > 0 else top), way
    return line, side


def renko(price, size: float, percent: bool = False) -> list[tuple[int, float, int]]:
    """(row, brick price, direction): one entry for each whole brick that a price completes."""
    out, last = [], None
    for i, p in enumerate(np.asarray(price, float)):
        if p != p:
            continue
        if last is None:
            last = p
            continue
        while abs(p - last) >= (step := abs(last) * size if percent else size) > 0:
            way = 1 if p > last else -1
            last += way * step
            out.append((i, last, way))
    return out


def longest_run(x, falling: bool = False) -> list[int]:
    """Places of a longest strictly rising (falling) subsequence, by patience."""
    from bisect import bisect_left

    x = -np.asarray(x, float) if falling else np.asarray(x, float)
    tails, at, before = [], [], [-1] * len(x)
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    path, i = [], at[-1] if at else -1
    while i >= 0:
        path.append(i)
        i = before[i]
    return path[::-1]


def hurst(x) -> float:
    """Rescaled-range exponent over dyadic splits."""
    x = np.asarray(x, float)
    points = []
    for level in range(max(1, int(np.log2(max(len(x), 2))) - 2)):
        parts = np.array_split(x, 2**level)
        scaled = [(np.ptp(np.cumsum(p - p.mean())) / p.std()) for p in parts if len(p) > 1 and p.std() > 0]
        if scaled:
            points.append((np.log(len(parts[0])), np.log(np.mean(scaled))))
    if len(points) < 2:
        return float("nan")
    return float(np.polyfit(*zip(*points), 1)[0])


def sar_way(high, low, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """The parabolic stop, negative while the position is short."""
    line, h = sar(high, low, step, most), np.asarray(high, float)
    return np.where(line >= h, -line, line)


def macd_fixed(x, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(difference, signal) of means with the fixed factors 0.15 and 0.075, both seeded at row 25 by means of 12 and 26 rows."""
    x, dif = np.asarray(x, float), np.full(len(x), np.nan)
    if len(x) < 26:
        return dif, dif.copy()
    fast, slow = x[14:26].mean(), x[:26].mean()
    dif[25] = fast - slow
    for i in range(26, len(x)):
        fast, slow = fast + 0.15 * (x[i] - fast), slow + 0.075 * (x[i] - slow)
        dif[i] = fast - slow
    return dif, ta_ema(dif, signal)


def hilbert(price, start: int, fast: float = 0.5, slow: float = 0.05) -> dict[str, np.ndarray]:
    """Ehlers' homodyne discriminator and what is derived from its period, from row ``start`` on.

    Keys: period, inphase, quadrature, mama, fama, phase (degrees), trendline,
    mode (1: trend).  Prices are smoothed with weights 4, 3, 2, 1; values
    before ``start`` count 0.
    """
    x = np.asarray(price, float)
    n, pad = len(x), 6
    out = {k: np.full(n, np.nan) for k in ("period", "inphase", "quadrature", "mama", "fama", "phase", "trendline", "mode")}
    smooth, detrended, quad, inner = (np.zeros(n + pad) for _ in range(4))
    period = steady = phase = before = mama = fama = re = im = i2 = q2 = 0.0
    sine = lead = 0.0
    lines, days = [0.0, 0.0, 0.0], 0

    def turned(series, i):
        return (0.0962 * (series[i] - series[i - 6]) + 0.5769 * (series[i - 2] - series[i - 4])) * (0.075 * period + 0.54)

    for t in range(start, n):
        i = t + pad
        smooth[i] = (4 * x[t] + 3 * x[t - 1] + 2 * x[t - 2] + x[t - 3]) / 10
        detrended[i] = turned(smooth, i)
        quad[i], inner[i] = turned(detrended, i), detrended[i - 3]
        old_i, old_q = i2, q2
        q2 = 0.2 * (quad[i] + turned(inner, i)) + 0.8 * old_q
        i2 = 0.2 * (inner[i] - turned(quad, i)) + 0.8 * old_i
        re = 0.2 * (i2 * old_i + q2 * old_q) + 0.8 * re
        im = 0.2 * (i2 * old_q - q2 * old_i) + 0.8 * im
        last = period
        if re and im:
            period = 2 * np.pi / np.arctan(im / re)
        period = 0.2 * min(max(max(min(period, 1.5 * last), 0.67 * last), 6.0), 50.0) + 0.8 * last
        steady = 0.33 * period + 0.67 * steady
        angle = np.degrees(np.arctan(quad[i] / inner[i])) if inner[i] else 0.0
        weight = max(fast / max(before - angle, 1.0), slow)
        before = angle
        mama = weight * x[t] + (1 - weight) * mama
        fama = weight / 2 * mama + (1 - weight / 2) * fama
        whole, was = int(steady + 0.5), phase
        ages = np.arange(min(whole, 50))
        turn, back = 2 * np.pi * ages / max(whole, 1), np.where(ages <= i, smooth[np.maximum(i - ages, 0)], 0.0)
        real, imag = float(np.sin(turn) @ back), float(np.cos(turn) @ back)
        phase = np.degrees(np.arctan(real / imag)) if imag else phase + 90 * np.sign(real)
        phase += 90 + (360 / steady if steady else 0) + (180 if imag < 0 else 0)
        phase -= 360 if phase > 315 else 0
        mean = x[max(0, t - whole + 1) : t + 1].mean() if whole else 0.0
        line = (4 * mean + 3 * lines[0] + 2 * lines[1] + lines[2]) / 10
        lines = [mean, *lines[:2]]
        old_sine, old_lead = sine, lead
        sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        mode = 1
        if sine > lead and old_sine <= old_lead or sine < lead and old_sine >= old_lead:
            days, mode = 0, 0
        days += 1
        if days < steady / 2 or steady and 0.67 * 360 / steady < phase - was < 1.5 * 360 / steady:
            mode = 0
        if line and abs((smooth[i] - line) / line) >= 0.015:
            mode = 1
        for k, v in zip(out, (steady, inner[i], quad[i], mama, fama, phase, line, mode)):
            out[k][t] = v
    return out
