import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import filters
from tidemill.operators import peaks

DAY = datetime.date(2000, 1, 1)


def direct(b, a, x):
    """The filter as a plain loop over values, forwards and backwards."""
    pad = 3 * len(a)
    x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y, past, out = np.full(len(a), x[0]), np.full(len(a), x[0]), np.zeros(len(x))
        for i, v in enumerate(x):
            past = np.concatenate([[v], past[:-1]])
            out[i] = b @ past - a[1:] @ y[: len(a) - 1]
            y = np.concatenate([[out[i]], y[:-1]])
        x = out[::-1]
    return x[pad:-pad]


def slow_turns(line, smooth, price):
    t = sum((v > a and v > b) or (v < a and v < b) for a, v, b in zip(smooth, smooth[1:], smooth[2:]))
    if not t:
        return {}
    n, out = len(price) // t * 2, {}
    for sign in (1, -1):  # highs, then lows of the line as highs of its mirror image
        y = sign * line
        least = 0.01 / price.max() * (y.max() - y.min()) + y.min()
        found, i = [], 0
        while i < len(y):
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if i and j + 1 < len(y) and y[i - 1] < y[i] > y[j + 1] and y[i] > least:
                found.append((y[i], (i + j) // 2))
            i = j + 1
        kept = []
        for _, k in sorted(found, reverse=True):
            if all(abs(k - q) > n for q in kept):
                kept.append(k)
        out |= {k: -sign for k in kept}
    return out


def frame(spark, series):
    return spark.createDataFrame([(c, DAY + datetime.timedelta(days=k), float(x)) for c, xs in series.items() for k, x in enumerate(xs)], "code string, d date, close double")


def test_low_pass_passes_constants_and_halves_power_at_its_cutoff():
    b, a = filters.low_pass(3, 0.05)
    at = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * w)) / np.polyval(a[::-1], np.exp(-1j * w)))
    assert at(0) == pytest.approx(1) and at(0.05 * np.pi) == pytest.approx(0.5**0.5) and at(np.pi) == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("rows", [7, 64, 512])
def test_zero_phase_equals_a_loop_for_any_blocks(spark, rows):
    rng = np.random.default_rng(rows)
    series = {"a": rng.normal(0, 1, 300).cumsum() + 50, "b": rng.normal(0, 1, 13), "short": rng.normal(0, 1, 12), None: rng.normal(0, 1, 70)}
    df = spark.createDataFrame([(c, k, float(x)) for c, xs in series.items() for k, x in enumerate(xs)], "code string, k long, v double")
    b, a = filters.low_pass(3, 0.05)
    got = {}
    for r in filters.zero_phase(df, b, a, rows).collect():
        got.setdefault(r.code, {})[r.k] = r.v
    assert set(got) == {"a", "b", None}
    for c, found in got.items():
        assert sorted(found) == list(range(len(series[c])))
        np.testing.assert_allclose([found[k] for k in sorted(found)], direct(b, a, series[c]), atol=1e-9)


def test_turning_points_equal_a_greedy_loop(spark):
    rng = np.random.default_rng(5)
    series = {f"w{k}": np.round(rng.normal(0, 1, 400).cumsum() + 80, 1) for k in range(4)}  # one decimal: plateaus and ties
    series |= {"saw": 50 + np.arange(200) * 0.1 + np.arange(200) % 2, "fall": 90 - np.arange(300) * 0.2 + 3 * (np.arange(300) % 3 == 0), "flat": np.full(50, 3.0), "few": np.arange(9.0) % 2}
    df = frame(spark, series)
    b, a = filters.low_pass(3, 0.05)
    for eager in (False, True):
        got = {c: {} for c in series}
        for r in peaks.turning_points(df, eager=eager).where("turn is not null").collect():
            got[r.code][(r.d - DAY).days] = r.turn
        for c, x in series.items():
            if c == "flat":
                continue  # rounding decides whether a smoothed constant has extremes; the line itself has none
            if eager:
                fit = lambda y, t: np.polyval(np.polyfit(np.arange(5), y, 1), t)
                s = np.array([fit(x[:5], i) if i < 2 else fit(x[-5:], i - len(x) + 5) if i > len(x) - 3 else x[i - 2 : i + 3].mean() for i in range(len(x))])
                s = np.round(s, 9)
                assert got[c] == slow_turns(s, s, x), c
            else:
                assert got[c] == (slow_turns(x, direct(b, a, x), x) if len(x) > 12 else {}), c
        assert got["flat"] == {}


def test_nulls_empty_tables_and_a_null_code(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 120).cumsum() + 40
    df = frame(spark, {"a": x, None: x}).withColumn("extra", F.lit(1))
    holes = df.union(spark.createDataFrame([("a", DAY + datetime.timedelta(days=500), None, 1), ("a", None, 5.0, 1)], df.schema))
    whole = {(r.code, r.d): r.turn for r in peaks.turning_points(df).collect()}
    got = {(r.code, r.d): r.turn for r in peaks.turning_points(holes).collect()}
    assert len(got) == 242 and {k: v for k, v in got.items() if k in whole} == whole and any(whole.values())
    assert {d: t for (c, d), t in whole.items() if c is None} == {d: t for (c, d), t in whole.items() if c == "a"}
    for f in (peaks.price_trend, peaks.mean_turns, peaks.macd_crosses):
        assert f(df.limit(0)).collect() == []
