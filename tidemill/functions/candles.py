"""Candlestick patterns: 100 (rising), -100 (falling), 0, as columns over a code's bars.

Sizes are judged against trailing means of the bars before: a body is long if it
is longer than the mean body of ten bars, a doji if it is a tenth of the mean
range or less, a shadow is very short if it is a tenth of the mean range or less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ordered


class Bar:
    """The bar ``back`` rows before the current one, as columns."""

    def __init__(self, w, back: int):
        self.w, self.back = w, back
        at = lambda x: F.lag(x, back).over(w) if back else F.col(x)
        self.open, self.high, self.low, self.close = (at(c) for c in ("open", "high", "low", "close"))
        mean = lambda x, n: F.avg(x).over(w.rowsBetween(-n - back, -1 - back))
        self.mean_body, self.mean_range = mean(F.abs(F.col("close") - F.col("open")), 10), mean(F.col("high") - F.col("low"), 10)
        self.near5 = mean(F.col("high") - F.col("low"), 5)
        self.body, self.range = F.abs(self.close - self.open), self.high - self.low
        self.top, self.bottom = F.greatest(self.open, self.close), F.least(self.open, self.close)
        self.upper, self.lower = self.high - self.top, self.bottom - self.low
        self.white, self.black = self.close >= self.open, self.close < self.open
        self.long, self.short = self.body > self.mean_body, self.body <= self.mean_body
        self.doji = self.body <= 0.1 * self.mean_range
        self.no_upper, self.no_lower = self.upper <= 0.1 * self.mean_range, self.lower <= 0.1 * self.mean_range
        self.mid = (self.open + self.close) / 2


def _within(inner: Bar, outer: Bar) -> Column:
    return (inner.top < outer.top) & (inner.bottom > outer.bottom)


def _gap_up(a: Bar, b: Bar) -> Column:
    return a.bottom > b.top


def _gap_down(a: Bar, b: Bar) -> Column:
    return a.top < b.bottom


def _near(a, b, bar: Bar, share: float = 0.05) -> Column:
    return F.abs(a - b) <= share * bar.near5


def _patterns(w) -> dict[str, tuple[Column, Column]]:
    """name: (rising, falling) conditions; c is the current bar, p, q, r, s the ones before."""
    c, p, q, r, s = (Bar(w, k) for k in range(5))
    no = F.lit(False)
    star_up = q.black & q.long & (p.short) & _gap_down(p, q) & c.white & (c.close > q.close + 0.3 * q.body)
    star_down = q.white & q.long & (p.short) & _gap_up(p, q) & c.black & (c.close < q.close - 0.3 * q.body)
    inside_up = q.long & q.black & p.short & _within(p, q) & c.white & (c.close > q.open)
    inside_down = q.long & q.white & p.short & _within(p, q) & c.black & (c.close < q.open)
    engulf_up = c.white & p.black & (c.close >= p.open) & (c.open <= p.close) & (c.body > p.body)
    engulf_down = c.black & p.white & (c.open >= p.close) & (c.close <= p.open) & (c.body > p.body)
    engulf_up1 = p.white & q.black & (p.close > q.open) & (p.open < q.close)
    engulf_down1 = p.black & q.white & (p.open > q.close) & (p.close < q.open)
    soldiers = q.white & p.white & c.white & (c.close > p.close) & (p.close > q.close) & c.no_upper & p.no_upper & q.no_upper & (p.open > q.open) & (p.open <= q.close + 0.2 * q.near5) & (c.open > p.open) & (c.open <= p.close + 0.2 * p.near5)
    crows = q.black & p.black & c.black & (p.open < q.open) & (p.open > q.close) & (c.open < p.open) & (c.open > p.close) & (c.close < p.close) & (p.close < q.close) & q.no_lower & p.no_lower & c.no_lower
    same = lambda bar: bar.body <= 0.1 * bar.mean_range
    maru = lambda bar: bar.long & bar.no_upper & bar.no_lower
    kick_up, kick_down = maru(p) & p.black & maru(c) & c.white & _gap_up(c, p), maru(p) & p.white & maru(c) & c.black & _gap_down(c, p)
    falling3 = s.black & s.long & r.white & r.short & q.short & p.short & c.black & c.long & (r.top < s.open) & (p.top < s.open) & (r.bottom > s.low) & (p.bottom > s.low) & (c.close < s.close)
    rising3 = s.white & s.long & r.black & r.short & q.short & p.short & c.white & c.long & (r.bottom > s.open) & (p.bottom > s.open) & (r.top < s.high) & (p.top < s.high) & (c.close > s.close)
    hammer = c.short & (c.lower > 2 * c.body) & c.no_upper
    hanging = hammer & (c.bottom >= p.high - 0.2 * p.near5)
    inverted = c.short & (c.upper > 2 * c.body) & c.no_lower
    return {
        "doji": (c.doji, no),
        "dragonfly_doji": (c.doji & c.no_upper & ~c.no_lower, no),
        "gravestone_doji": (c.doji & c.no_lower & ~c.no_upper, no),
        "long_legged_doji": (c.doji & ((c.upper > c.body) | (c.lower > c.body)) & (c.range > c.mean_range), no),
        "rickshaw_man": (c.doji & (c.upper > c.body) & (c.lower > c.body) & (F.abs(c.mid - (c.high + c.low) / 2) <= 0.1 * c.range), no),
        "takuri": (c.doji & c.no_upper & (c.lower > 2 * c.mean_body), no),
        "long_line": (c.white & c.long & (c.upper < c.body / 2) & (c.lower < c.body / 2), c.black & c.long & (c.upper < c.body / 2) & (c.lower < c.body / 2)),
        "short_line": (c.white & c.short & (c.upper < c.range / 4) & (c.lower < c.range / 4), c.black & c.short & (c.upper < c.range / 4) & (c.lower < c.range / 4)),
        "marubozu": (maru(c) & c.white, maru(c) & c.black),
        "closing_marubozu": (c.long & c.white & c.no_upper, c.long & c.black & c.no_lower),
        "belt_hold": (c.long & c.white & c.no_lower, c.long & c.black & c.no_upper),
        "spinning_top": (c.white & c.short & (c.upper > c.body) & (c.lower > c.body), c.black & c.short & (c.upper > c.body) & (c.lower > c.body)),
        "high_wave": (c.white & c.short & (c.upper > 2 * c.body) & (c.lower > 2 * c.body), c.black & c.short & (c.upper > 2 * c.body) & (c.lower > 2 * c.body)),
        "hammer": (hammer & (c.bottom <= p.low + 0.2 * p.near5), no),
        "hanging_man": (no, hanging),
        "inverted_hammer": (inverted & _gap_down(c, p), no),
        "shooting_star": (no, inverted & _gap_up(c, p)),
        "engulfing": (engulf_up, engulf_down),
        "harami": (p.long & p.black & c.short & _within(c, p), p.long & p.white & c.short & _within(c, p)),
        "harami_cross": (p.long & p.black & same(c) & _within(c, p), p.long & p.white & same(c) & _within(c, p)),
        "homing_pigeon": (p.long & p.black & c.short & c.black & _within(c, p), no),
        "doji_star": (p.long & p.black & c.doji & _gap_down(c, p), p.long & p.white & c.doji & _gap_up(c, p)),
        "piercing": (p.black & p.long & c.white & c.long & (c.open < p.low) & (c.close > p.mid) & (c.close < p.open), no),
        "dark_cloud": (no, p.white & p.long & c.black & (c.open > p.high) & (c.close < p.mid) & (c.close > p.open)),
        "counterattack": (p.black & p.long & c.white & c.long & _near(c.close, p.close, p), p.white & p.long & c.black & c.long & _near(c.close, p.close, p)),
        "separating_lines": (p.black & c.white & c.long & c.no_lower & _near(c.open, p.open, p), p.white & c.black & c.long & c.no_upper & _near(c.open, p.open, p)),
        "matching_low": (p.black & c.black & _near(c.close, p.close, p), no),
        "in_neck": (no, p.black & p.long & c.white & (c.open < p.low) & (c.close >= p.close) & (c.close <= p.close + 0.05 * p.near5)),
        "on_neck": (no, p.black & p.long & c.white & (c.open < p.low) & _near(c.close, p.low, p)),
        "thrusting": (no, p.black & p.long & c.white & (c.open < p.low) & (c.close > p.close + 0.05 * p.near5) & (c.close <= p.mid)),
        "kicking": (kick_up, kick_down),
        "kicking_by_length": ((kick_up | kick_down) & F.when(c.body > p.body, c.white).otherwise(p.white), (kick_up | kick_down) & F.when(c.body > p.body, c.black).otherwise(p.black)),
        "two_crows": (no, q.white & q.long & p.black & _gap_up(p, q) & c.black & (c.open < p.open) & (c.open > p.close) & (c.close > q.open) & (c.close < q.close)),
        "upside_gap_two_crows": (no, q.white & q.long & p.black & p.short & _gap_up(p, q) & c.black & (c.open > p.open) & (c.close < p.close) & (c.close > q.close)),
        "three_inside": (inside_up, inside_down),
        "three_outside": (engulf_up1 & (c.close > p.close), engulf_down1 & (c.close < p.close)),
        "three_white_soldiers": (soldiers, no),
        "three_black_crows": (no, r.white & crows & (q.close < r.high)),
        "identical_three_crows": (no, crows & _near(p.open, q.close, q) & _near(c.open, p.close, p)),
        "advance_block": (no, q.white & p.white & c.white & (c.close > p.close) & (p.close > q.close) & q.long & (p.open > q.open) & (c.open > p.open) & (c.body < p.body) & (p.body < q.body) & (c.upper > c.body)),
        "stalled_pattern": (no, q.white & p.white & c.white & q.long & p.long & p.no_upper & c.short & (c.close > p.close) & (p.close > q.close) & (c.open >= p.close - c.body - 0.2 * p.near5)),
        "three_stars_in_south": (q.black & p.black & c.black & q.long & (q.lower > q.body) & (p.body < q.body) & (p.open > q.close) & (p.low >= q.low) & c.short & c.no_lower & c.no_upper & (c.low > p.low) & (c.high < p.high), no),
        "morning_star": (star_up, no),
        "evening_star": (no, star_down),
        "morning_doji_star": (star_up & p.doji, no),
        "evening_doji_star": (no, star_down & p.doji),
        "abandoned_baby": (star_up & p.doji & (p.high < q.low) & (c.low > p.high), star_down & p.doji & (p.low > q.high) & (c.high < p.low)),
        "tristar": (q.doji & p.doji & c.doji & _gap_down(p, q) & (c.bottom > p.bottom), q.doji & p.doji & c.doji & _gap_up(p, q) & (c.top < p.top)),
        "stick_sandwich": (q.black & p.white & c.black & (p.low > q.close) & _near(c.close, q.close, q), no),
        "unique_three_river": (q.black & q.long & p.black & (p.close > q.close) & (p.open <= q.open) & (p.low < q.low) & c.white & c.short & (c.open > p.low), no),
        "gap_side_by_side_white": (_gap_up(p, q) & _gap_up(c, q) & p.white & c.white & _near(c.open, p.open, p), _gap_down(p, q) & _gap_down(c, q) & p.white & c.white & _near(c.open, p.open, p)),
        "tasuki_gap": (_gap_up(p, q) & p.white & c.black & (c.open < p.close) & (c.open > p.open) & (c.close < p.open) & (c.close > q.top), _gap_down(p, q) & p.black & c.white & (c.open < p.open) & (c.open > p.close) & (c.close > p.open) & (c.close < q.bottom)),
        "gap_three_methods": (q.white & p.white & c.black & _gap_up(p, q) & (c.open < p.close) & (c.open > p.open) & (c.close < q.close) & (c.close > q.open), q.black & p.black & c.white & _gap_down(p, q) & (c.open > p.close) & (c.open < p.open) & (c.close > q.close) & (c.close < q.open)),
        "three_line_strike": (r.white & q.white & p.white & (p.close > q.close) & (q.close > r.close) & c.black & (c.open > p.close) & (c.close < r.open), r.black & q.black & p.black & (p.close < q.close) & (q.close < r.close) & c.white & (c.open < p.close) & (c.close > r.open)),
        "conceal_baby_swallow": (maru(r) & r.black & maru(q) & q.black & p.black & _gap_down(p, q) & (p.upper > p.body) & (p.high > q.close) & c.black & (c.high > p.high) & (c.low < p.low), no),
        "hikkake": ((p.high < q.high) & (p.low > q.low) & (c.high < p.high) & (c.low < p.low), (p.high < q.high) & (p.low > q.low) & (c.high > p.high) & (c.low > p.low)),
        "hikkake_modified": ((q.high < r.high) & (q.low > r.low) & (p.high < q.high) & (p.low > q.low) & (p.close <= p.low + 0.2 * p.near5) & (c.high < p.high) & (c.low < p.low), (q.high < r.high) & (q.low > r.low) & (p.high < q.high) & (p.low > q.low) & (p.close >= p.high - 0.2 * p.near5) & (c.high > p.high) & (c.low > p.low)),
        "ladder_bottom": (s.black & r.black & q.black & (r.open < s.open) & (q.open < r.open) & (r.close < s.close) & (q.close < r.close) & p.black & ~p.no_upper & c.white & (c.open > p.open) & (c.close > p.high), no),
        "breakaway": (s.black & s.long & r.black & _gap_down(r, s) & (q.high < r.high) & (q.low < r.low) & p.black & c.white & (c.close > r.open) & (c.close < s.close), s.white & s.long & r.white & _gap_up(r, s) & (q.high > r.high) & (q.low > r.low) & p.white & c.black & (c.close < r.open) & (c.close > s.close)),
        "rise_fall_three_methods": (rising3, falling3),
        "mat_hold": (s.white & s.long & r.black & _gap_up(r, s) & q.short & p.short & (q.bottom < s.close) & (p.bottom < s.close) & (q.bottom > s.close - 0.5 * s.body) & (p.bottom > s.close - 0.5 * s.body) & c.white & (c.close > F.greatest(r.high, q.high, p.high)), no),
    }


def candles(bars: DataFrame, *names: str, code: str = "code", ts: str = "d") -> DataFrame:
    """bars with one column for each named pattern (all of them by default)."""
    w = ordered(code, ts)
    known = _patterns(w)
    return bars.withColumns({n: F.when(known[n][0], 100).when(known[n][1], -100).otherwise(0) for n in names or known})
