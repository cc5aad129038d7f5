"""Exact values of market rules, portfolio weights and risk figures."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import market, portfolio, risk


def test_limits_by_segment(spark):
    rows = [(c, d, 10.0, 10.5, 9.8, 10.0) for c in ("000001", "600001", "688001", "300001", "833333") for d in (1, 2)]
    bars = spark.createDataFrame([*rows, ("000002", 1, 0.0, 0.0, 0.0, 0.0)], "code string, d int, open double, high double, low double, close double")
    got = {r.code: (r.limit_up, r.limit_down) for r in market.with_limits(bars).where("d = 2 or code = '000002'").collect()}
    assert got["000001"] == got["600001"] == (11.0, 9.0)
    assert got["688001"] == got["300001"] == (12.0, 8.0)
    assert got["833333"] == (13.0, 7.0) and got["000002"] == (0.0, 0.0)


def test_slippage(spark):
    df = spark.createDataFrame([("BUY",), ("SELL",)], "side string")
    fixed = [r.p for r in df.select(market.slippage(F.lit(10.0), "side", "fixed", 0.02).alias("p")).collect()]
    share = [r.p for r in df.select(market.slippage(F.lit(10.0), "side", "percent", 0.001).alias("p")).collect()]
    assert fixed == pytest.approx([10.02, 9.98]) and share == pytest.approx([10.01, 9.99])
    with pytest.raises(ValueError):
        market.slippage(F.lit(10.0), "side", "other")


def grid(n, step, high):
    """All weights of n assets in multiples of step, none above high."""
    if n == 1:
        return [(1.0,)]
    out = [()]
    for _ in range(n - 1):
        out = [(*w, x) for w in out for x in np.arange(0, high + 1e-9, step) if sum(w) + x <= 1 + 1e-9]
    return [(*w, 1 - sum(w)) for w in out if -1e-9 <= 1 - sum(w) <= high + 1e-9]


def test_weights(spark):
    x = np.random.default_rng(42).normal(0.001, 0.02, (252, 4)) * [1, 2, 0.5, 1.5]
    assets = [f"a{k}" for k in range(4)]
    wide = spark.createDataFrame(pd.DataFrame(x, columns=assets))
    mu, cov = x.mean(axis=0), portfolio.shrunk(np.cov(x, rowvar=False, bias=True))
    got = {m: np.array(list(portfolio.optimize(wide, assets, m, 0.6, aversion=3.0, views={0: 0.01}).values())) for m in ("risk_parity", "mvo", "hrp", "max_div", "black_litterman")}
    assert all(w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= 0.6 + 1e-9 for w in got.values())
    all_ = np.array(grid(4, 0.02, 0.6))
    risk_of = lambda w: np.einsum("...i,ij,...j->...", w, cov, w)
    utility = lambda w, m=mu, c=None: w @ m - 1.5 * (risk_of(w) if c is None else np.einsum("...i,ij,...j->...", w, c, w))
    spread = lambda w: w @ np.sqrt(np.diag(cov)) / np.sqrt(risk_of(w))
    assert utility(got["mvo"]) >= utility(all_).max() - 1e-9 and spread(got["max_div"]) >= spread(all_).max() - 1e-9
    # the view is a row of evidence beside the prior: both means weighed by their precisions
    prior, doubt = 3.0 * cov @ np.full(4, 0.25), 1.0
    precision = np.linalg.inv(0.05 * cov)
    pick = np.eye(4)[[0]]
    posterior = np.linalg.inv(precision + pick.T @ pick / doubt) @ (precision @ prior + pick.T @ [0.01] / doubt)
    wide_cov = cov + np.linalg.inv(precision + pick.T @ pick / doubt)
    assert utility(got["black_litterman"], posterior, wide_cov) >= utility(all_, posterior, wide_cov).max() - 1e-9
    p = portfolio.risk_parity(cov)
    assert p * (cov @ p) / (p @ cov @ p) == pytest.approx(np.full(4, 0.25), abs=1e-3)
    ab = np.array([cov[1, 1], cov[0, 0]]) / (cov[0, 0] + cov[1, 1])
    cd = np.array([cov[3, 3], cov[2, 2]]) / (cov[2, 2] + cov[3, 3])
    va, vc = ab @ cov[:2, :2] @ ab, cd @ cov[2:, 2:] @ cd
    assert portfolio.hierarchical(cov) == pytest.approx(np.concatenate([vc * ab, va * cd]) / (va + vc), abs=1e-6)
    assert portfolio.optimize(wide.select("a0"), ["a0"]) == {"a0": 1.0} and portfolio.optimize(wide.select("a0"), []) == {}


def test_exposures_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(300, 3))
    y = 0.5 + f @ [1.0, -2.0, 0.0] + rng.normal(size=300)
    got = risk.exposures(spark.createDataFrame(pd.DataFrame(np.c_[y, f], columns=["y", "a", "b", "c"])), "y", ["a", "b", "c"])
    design = np.c_[np.ones(300), f]
    beta, rest, _, _ = np.linalg.lstsq(design, y, rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rest[0] / 296)
    assert got["beta"] == pytest.approx(beta) and got["t"] == pytest.approx(beta / error) and got["r2"] == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum())


def test_bootstrap_draws_from_all_returns(spark):
    rows = [("x", float(r)) for r in [-0.5] * 30 + [0.0] * 50 + [0.1] * 20] + [("x", None)]
    df = spark.createDataFrame(rows, "code string, ret double")
    got = risk.monte_carlo(df, paths=4000, horizon=1).first()
    assert got.n == 4000 and got["mean"] == pytest.approx(-0.13, abs=0.02) and got["var"] == got.cvar == pytest.approx(0.5)
    two = risk.monte_carlo(df, paths=4000, horizon=2).first()
    assert two["mean"] == pytest.approx(0.87**2 - 1, abs=0.02)
    assert risk.monte_carlo(df, paths=4000, horizon=2).first() == two
    assert risk.monte_carlo(df.where("ret is null")).first().n == 0


def test_as_of_replaces_and_scan_keeps_the_greatest(spark):
    from tidemill.operators.joins import as_of
    from tidemill.sources.tables import scan_bars

    left = spark.createDataFrame([("a", 1, 9.0), ("a", 3, 9.0)], "code string, d int, adj double")
    right = spark.createDataFrame([("a", 2, 0.5)], "code string, d int, adj double")
    assert sorted((r.d, r.adj) for r in as_of(left, right, ["adj"]).collect()) == [(1, None), (3, 0.5)]
    bars = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 1, 7.0, 1.0), ("b", 1, 2.0, 3.0)], "code string, d int, close double, volume double")
    assert sorted(map(tuple, scan_bars(bars, columns=["code", "close"]).collect())) == [("a", 7.0), ("b", 2.0)]


def test_drawdown(spark):
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate([100_000, 105_000, 90_000, 95_000])], "code string, d int, equity double")
    row = risk.drawdown(df, "equity").where("d = 2").first().asDict()
    assert any(v == pytest.approx(15 / 105) or v == pytest.approx(-15 / 105) for v in row.values() if isinstance(v, float))


def test_runs_of_accounts_equal_a_plain_ledger(spark):
    from tidemill.operators.backtest import run_accounts

    rng = np.random.default_rng(7)
    rows = []
    for a in ("p", "q"):
        for d in range(40):
            for c in "abcdef":
                if rng.random() < 0.9:
                    o, z = float(rng.uniform(5, 15)), float(rng.uniform(5, 15))
                    rows.append((a, d, c, o, z, float(rng.integers(0, 4)), 14.0, 6.0, float(rng.choice([0.0, 0.3]))))
    df = spark.createDataFrame(rows, "account string, d int, code string, open double, close double, volume double, limit_up double, limit_down double, weight double")
    got = {(r.account, r.d): r for r in run_accounts(df.repartition(5), 10_000.0, 10.0, 0.01, 0.001, 2.0, 0.001).collect()}
    refused = 0
    for a in ("p", "q"):
        cash, amount, price = 10_000.0, {c: 0.0 for c in "abcdef"}, {}
        for d in range(40):
            today = {r[2]: r for r in rows if r[0] == a and r[1] == d}
            worth = cash + sum(n * price[c] for c, n in amount.items() if n)
            fees = 0.0
            for c in sorted(today):
                r, sale = today[c], today[c][3] * 0.99
                if amount[c] and r[8] == 0:
                    if r[5] == 0 or sale <= r[7]:
                        refused += 1
                        continue
                    fee = max(2.0, amount[c] * sale * 0.001) + amount[c] * sale * 0.001
                    cash, fees, amount[c] = cash + amount[c] * sale - fee, fees + fee, 0.0
            for c in sorted(today):
                r, buy = today[c], today[c][3] * 1.01
                if r[8] and not amount[c]:
                    if r[5] == 0 or buy >= r[6]:
                        refused += 1
                        continue
                    n = np.floor(min(r[8] * worth, cash) / (buy * 10)) * 10
                    while n > 0 and n * buy + max(2.0, n * buy * 0.001) > cash:
                        n -= 10
                    if n > 0:
                        fee = max(2.0, n * buy * 0.001)
                        cash, fees, amount[c] = cash - n * buy - fee, fees + fee, n
            price |= {c: r[4] for c, r in today.items()}
            r = got[a, d]
            assert (r.cash, r.fees, r.held) == (pytest.approx(cash), pytest.approx(fees), sum(n > 0 for n in amount.values()))
            assert r.equity == pytest.approx(cash + sum(n * price[c] for c, n in amount.items() if n)) and r.cash >= 0
    assert sum(r.refused for r in got.values()) == refused > 10


def test_equal_sums_are_equal_in_any_order_of_rows(spark, tmp_path):
    """21 suppliers of one month with 0.1 + 0.2 + 0.3 each, one of them dealt over two files: none is above the quantile."""
    from datetime import datetime

    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemill.functions.series import exact_sum
    from tidemill.plans import queries

    def part(name, rows):
        f = pd.DataFrame([(k, datetime(1996, 3, 1 + i), v) for i, (k, v) in enumerate(rows)], columns=["l_suppkey", "l_shipdate", "l_extendedprice"]).assign(l_discount=0.01, l_quantity=1.0)
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pandas(f, preserve_index=False), tmp_path / "lineitem.parquet" / name, coerce_timestamps="us")

    for k in range(20):
        part(f"{k:02}.parquet", [(k, v) for v in (0.3, 0.2, 0.1)])
    part("20.parquet", [(20, v) for v in (0.1, 0.2, 0.3)])
    assert (0.1 + 0.2) + 0.3 > (0.3 + 0.2) + 0.1
    assert queries.QUERIES["above_quantile"](spark, str(tmp_path)).collect() == []

    odd = spark.createDataFrame([("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", 1.0), ("huge", 1e300), ("none", None), ("some", None), ("some", 0.1), ("some", 0.2)], "k string, x double")
    got = {r.k: r.x for r in odd.groupBy("k").agg(exact_sum("x").alias("x")).collect()}
    assert got["nan"] != got["nan"] and got["inf"] == float("inf") and got["huge"] == 1e300 and got["none"] is None and got["some"] == 0.3


@pytest.mark.parametrize("name", ["stock_turnover", "suspensions", "reindex_nearest"])
def test_parts_grow_with_the_table(spark, monkeypatch, capsys, name):
    """What one task holds is bounded by rows: a table of more rows is dealt into more parts."""
    from tidemill.plans import queries
    from tidemill.sources import tables

    monkeypatch.setattr(tables, "PART_ROWS", 100)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    n = -(-tables.table(spark, "/root/testdata/sf0.001", "lineitem").count() // 100)
    assert re.search(rf"hashpartitioning\(code#\w+(, d#\w+)?, {n}\), REPARTITION_BY_NUM", capsys.readouterr().out)


def test_turnover_of_stocks(spark):
    from tidemill.operators.factors import stock_turnover

    bars = spark.createDataFrame([(1, 1, 30.0), (1, 2, None), (2, 1, 5.0), (3, 1, 5.0)], "code int, d int, volume double")
    shares = spark.createDataFrame([(1, 60.0), (2, 0.0)], "code int, shares double")
    assert sorted(tuple(r) for r in stock_turnover(bars, shares).collect()) == [(1, 1, 0.5), (1, 2, None), (2, 1, None)]


def test_suspensions_lie_between_bars(spark):
    """Gaps, bars without volume or with none, bars twice, and a life whose first bar is off the calendar."""
    cal = spark.createDataFrame([(10 * k, k) for k in range(8)], "d int, idx int")
    bars = [("a", 10, 5.0), ("a", 20, 0.0), ("a", 50, 1.0), ("a", 60, None), ("b", 30, 1.0), ("c", 5, 1.0), ("c", 20, 1.0), ("c", 40, 1.0), ("d", 0, 0.0), ("d", 0, 0.0), ("d", 20, 1.0), ("e", 5, 1.0)]
    got = market.suspensions(spark.createDataFrame(bars, "code string, d int, volume double").repartition(3), cal)
    assert got.columns == ["code", "d", "reason"]
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", 20, "no_volume"), ("a", 30, "missing"), ("a", 40, "missing"), ("a", 60, "missing"), ("c", 30, "missing"), ("d", 0, "no_volume"), ("d", 0, "no_volume"), ("d", 10, "missing"),
    ]


def test_bars_that_count_for_nothing_stay_out_of_an_accounts_stream(spark):
    """Of 400 codes an account wants one, on two days: its stream gets that code's bars till it is sold, and a bar for each other day."""
    from tidemill.operators.backtest import run_accounts

    rows = [("p", d, f"c{k:03}", 10.0, 11.0, 0.0 if d == 4 and k == 7 else 1.0, 14.0, 6.0, 0.5 if k == 7 and d in (2, 3) else 0.0) for d in range(9) for k in range(400)]
    df = spark.createDataFrame(rows, "account string, d int, code string, open double, close double, volume double, limit_up double, limit_down double, weight double")
    seen, real = [], type(df).repartition
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "repartition", lambda self, *by: seen.append(self) or real(self, *by))
        got = sorted(run_accounts(df, 10_000.0, 10.0, 0.0, 0.0, 0.0, 0.0).collect(), key=lambda r: r.d)
    assert [r.d for r in got] == list(range(9))
    assert [(r.held, r.bought, r.sold, r.refused) for r in got] == [(0, 0, 0, 0)] * 2 + [(1, 5000, 0, 0), (1, 0, 0, 0), (1, 0, 0, 1), (0, 0, 5000, 0)] + [(0, 0, 0, 0)] * 3
    stream = seen[-1].collect()
    assert {r.d for r in stream if r.code == "c007"} >= {2, 3, 4, 5}
    assert len(stream) <= 4 + 9 * 8
