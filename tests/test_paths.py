"""Series that SQL does not say, against other computations."""

import numpy as np
import pytest

from tidemill.functions import recursive as R
from tidemill.operators import backtest


def test_longest_runs_equal_quadratic_search():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x = rng.integers(0, 30, int(rng.integers(1, 60))).astype(float)
        for falling in (False, True):
            v, best = (-x if falling else x), []
            for i in range(len(v)):
                best.append(1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0))
            at = R.longest_run(x, falling)
            assert len(at) == max(best) and all(a < b and v[a] < v[b] for a, b in zip(at, at[1:]))


def test_hurst_tells_trends_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=4096)
    assert 0.4 < R.hurst(noise) < 0.65 and R.hurst(np.cumsum(noise)) > 0.85 and R.hurst([1.0]) != R.hurst([1.0])


@pytest.mark.parametrize("length", [12, 20, 33])
def test_hilbert_finds_the_period_and_phase_of_a_wave(length):
    t = np.arange(900)
    x = 100 + 10 * np.sin(2 * np.pi * t / length)
    got = R.hilbert(x, 12)
    assert np.abs(got["period"][300:] - length).max() < 0.12 * length
    late = R.hilbert(x, 37)
    turn = np.radians(late["phase"][400:] - 360 * t[400:] / length)  # the wave's own phase, but for a constant lag
    assert np.abs(np.mean(np.exp(1j * turn))) > 0.95
    assert np.abs(late["trendline"][400:] - 100).max() < 3
    assert np.abs(got["inphase"][300:]).max() > 1 and np.isnan(got["period"][:12]).all()


def test_hilbert_equals_its_formulas():
    x = 50 + np.cumsum(np.random.default_rng(2).normal(size=200))
    s, d, q, i1 = {}, {}, {}, {}
    at = lambda m, t: m.get(t, 0.0)
    period, steady, i2, q2, re, im, before, mama, fama = 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(12, 200):
        s[t] = np.dot([4, 3, 2, 1], x[t : t - 4 : -1]) / 10
        turn = lambda m, t: (0.0962 * at(m, t) + 0.5769 * at(m, t - 2) - 0.5769 * at(m, t - 4) - 0.0962 * at(m, t - 6)) * (0.075 * period + 0.54)
        d[t] = turn(s, t)
        q[t], i1[t] = turn(d, t), at(d, t - 3)
        now_i, now_q = 0.2 * (i1[t] - turn(q, t)) + 0.8 * i2, 0.2 * (q[t] + turn(i1, t)) + 0.8 * q2
        re, im = 0.2 * (now_i * i2 + now_q * q2) + 0.8 * re, 0.2 * (now_i * q2 - now_q * i2) + 0.8 * im
        i2, q2, last = now_i, now_q, period
        new = 2 * np.pi / np.arctan(im / re) if re and im else last
        new = np.clip(np.clip(new, 0.67 * last, 1.5 * last), 6, 50)
        period = 0.2 * new + 0.8 * last
        steady = 0.33 * period + 0.67 * steady
        angle = np.degrees(np.arctan(q[t] / i1[t])) if i1[t] else 0.0
        a = max(0.5 / max(1.0, before - angle), 0.05)
        before, mama = angle, a * x[t] + (1 - a) * mama
        fama = a / 2 * mama + (1 - a / 2) * fama
    got = R.hilbert(x, 12)
    assert [got[k][-1] for k in ("period", "inphase", "quadrature", "mama", "fama")] == pytest.approx([steady, i1[199], q[199], mama, fama])


def test_attention_sees_no_later_rows(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, *map(float, rng.normal(size=2))) for i in range(60)]
    df = spark.createDataFrame(rows, "code string, d int, x double, y double")
    whole = {r.d: r.score for r in backtest.attention_scores(df, ["x", "y"], 8).collect()}
    part = {r.d: r.score for r in backtest.attention_scores(df.where("d < 30"), ["x", "y"], 8).collect()}
    assert all(whole[d] == pytest.approx(part[d]) for d in part) and len(set(part.values())) > 20
