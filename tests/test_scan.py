import datetime

import numpy as np
import pytest

from tidemill.functions import recursive as R
from tidemill.functions import scan


def rows(seed, codes=("a", None, "b", "c"), n=90):
    rng = np.random.default_rng(seed)
    out = []
    for code in codes:
        x = rng.normal(0, 1, n).cumsum()
        x[rng.random(n) < 0.2] = np.nan
        x[: {"b": 17, "c": n}.get(code, 0)] = np.nan  # values that start late, and none
        day = datetime.date(2019, 11, 1)
        for v in x:
            day += datetime.timedelta(days=int(rng.integers(1, 9)))
            out.append((code, day, None if v != v else float(v), "kept"))
    return out


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"period": "month", "rows": 3}), (3, {"period": "quarter", "rows": 1})])
def test_scans_equal_plain_recursions(spark, seed, how):
    data = rows(seed)
    df = spark.createDataFrame(data, "code string, d date, x double, __y string").repartition(7)
    out = scan.emas(df, {"e1": ("x", 1), "e2": ("x", 2), "e12": ("x", 12)}, **how)
    out = scan.smas(out, {"s3": ("x", 3, 1), "s9": ("x", 9, 2), "s1": ("x", 1, 1)}, **how)
    assert out.columns == ["code", "d", "x", "__y", "e1", "e2", "e12", "s3", "s9", "s1"]
    got = {(r.code, r.d): r for r in out.collect()}
    assert len(got) == len(data)
    for code in {r[0] for r in data}:
        own = sorted(r[1:3] for r in data if r[0] == code)
        x = np.array([np.nan if v is None else v for _, v in own])
        want = {"e1": R.ema(x, 1), "e2": R.ema(x, 2), "e12": R.ema(x, 12), "s3": R.sma(x, 3), "s9": R.sma(x, 9, 2), "s1": R.sma(x, 1)}
        for name, series in want.items():
            found = np.array([np.nan if got[code, d][name] is None else got[code, d][name] for d, _ in own])
            assert np.allclose(found, series, rtol=1e-9, atol=1e-9, equal_nan=True), (code, name)


def test_long_codes_fast_weights_and_odd_rows(spark):
    day = datetime.datetime(2020, 1, 1)
    data = [("hot", day + datetime.timedelta(minutes=i), float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame([*data, ("hot", None, 1.0), ("odd", day, float("nan")), ("odd", day + datetime.timedelta(days=900), 2.0)], "code string, ts timestamp, x double")
    out = scan.emas(df, {"e": ("x", 2)}, ts="ts", period="day")
    got = {(r.code, r.ts): r.e for r in out.collect()}
    assert np.allclose([got["hot", t] for _, t, _ in data], R.ema([x for *_, x in data], 2)) and got["hot", None] is None
    assert got["odd", data[0][1]] is None and got["odd", day + datetime.timedelta(days=900)] == 2.0
    assert scan.emas(df.limit(0), {"e": ("x", 9)}, ts="ts").collect() == [] and scan.smas(df.limit(0), {"e": ("x", 9, 1)}, ts="ts").collect() == []
    with pytest.raises(ValueError):
        scan.decayed(df, {"y": scan.Decay(0.0, "x")}, ts="ts")


def test_one_code_is_the_work_of_many_tasks(spark):
    df = spark.createDataFrame([("hot", datetime.date(1950 + k, 1, 1), 1.0) for k in range(60)], "code string, d date, x double")
    plan = scan.emas(df, {"e": ("x", 5)})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__b#" in line.rsplit("], [", 2)[-2] for line in windows), windows
