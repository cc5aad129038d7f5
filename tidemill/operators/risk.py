"""Risk and performance of return series (by, d, ret) and equity curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import corr


def returns(values: DataFrame, x: str, by: str = "code", ts: str = "d") -> DataFrame:
    w = Window.partitionBy(by).orderBy(ts)
    return values.withColumn("ret", F.col(x) / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1)


def drawdown(values: DataFrame, x: str, by: str = "code", ts: str = "d") -> DataFrame:
    """Running peak and drawdown (0 or less)."""
    w = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("peak", F.max(x).over(w)).withColumn("drawdown", F.col(x) / F.col("peak") - 1)


def longest_true(rows: DataFrame, cond, name: str, by: str = "code", ts: str = "d") -> DataFrame:
    """(by, name): longest run of consecutive rows on which the condition holds."""
    w = Window.partitionBy(by).orderBy(ts)
    s = rows.withColumn("__c", F.coalesce(cond, F.lit(False))).withColumn("__i", F.sum((~F.col("__c")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = s.groupBy(by, "__i").agg(F.sum(F.col("__c").cast("int")).alias("n"))
    return per.groupBy(by).agg(F.max("n").alias(name))


def tail_risk(rows: DataFrame, confidence: float = 0.95, by: str = "code", ret: str = "ret") -> DataFrame:
    """(by, var, cvar): minus the linear quantile, and minus the mean of what is at or below it."""
    q = rows.groupBy(by).agg((-F.percentile(ret, F.lit(1 - confidence))).alias("var"))
    return rows.join(q, by).groupBy(by, "var").agg((-F.avg(F.when(F.col(ret) <= -F.col("var"), F.col(ret)))).alias("cvar"))


def ratios(rows: DataFrame, bars_per_year: int = 252, target: float = 0.0, by: str = "code", ret: str = "ret") -> DataFrame:
    """Sharpe, Sortino, volatility, win rate, profit factor, skew and kurtosis (bias-corrected)."""
    r, n = F.col(ret), F.col("n")
    s = rows.groupBy(by).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_pop(F.when(r < target, r)).alias("down"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(r > 0, r)).alias("gain"), F.sum(F.when(r < 0, -r)).alias("loss"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.exp(F.sum(F.ln(1 + r))).alias("gross"),
    )
    year = bars_per_year**0.5
    annual = F.pow(F.col("gross"), bars_per_year / n) - 1
    return s.select(
        by, "n", (F.col("gross") - 1).alias("total_return"), annual.alias("annual_return"), (F.col("sd") * year).alias("volatility"),
        (F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * year).alias("sharpe"), ((F.col("mean") - target) / F.nullif(F.col("down"), F.lit(0.0)) * year).alias("sortino"),
        "win_rate", (F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0))).alias("profit_factor"),
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"),
    )


def report(values: DataFrame, x: str, bars_per_year: int = 252, by: str = "code", ts: str = "d") -> DataFrame:
    """One row for each equity curve: ratios, tail risk, drawdown depth and length, calmar, losing streak, recovery."""
    r = returns(values, x, by, ts).where("ret is not null")
    d = drawdown(values, x, by, ts)
    depth = d.groupBy(by).agg(F.min("drawdown").alias("max_drawdown"), (F.max_by(x, ts) - F.min_by(x, ts)).alias("__profit"), F.max(F.col("peak") - F.col(x)).alias("__deep"))
    under = longest_true(d, F.col("drawdown") < 0, "longest_drawdown", by, ts)
    losses = longest_true(r, F.col("ret") < 0, "losing_streak", by, ts)
    out = ratios(r, bars_per_year, by=by).join(tail_risk(r, by=by), by).join(depth, by).join(under, by).join(losses, by)
    return out.withColumns({"calmar": F.col("annual_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)), "recovery": F.col("__profit") / F.nullif(F.col("__deep"), F.lit(0.0))}).drop("__profit", "__deep")


def against_benchmark(rows: DataFrame, by: str = "code", ret: str = "ret", bench: str = "bench", least: int = 20) -> DataFrame:
    """Beta (sample covariance over population variance), alpha, capture, correlation; zeros below ``least`` rows."""
    p = rows.where(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    s = p.groupBy(by).agg(
        F.count("*").alias("n"), (F.covar_samp(ret, bench) / F.nullif(F.var_pop(bench), F.lit(0.0))).alias("beta"), F.avg(ret).alias("__r"), F.avg(bench).alias("__b"), corr(ret, bench).alias("correlation"),
        (F.avg(F.when(F.col(bench) > 0, F.col(ret))) / F.nullif(F.avg(F.when(F.col(bench) > 0, F.col(bench))), F.lit(0.0))).alias("up_capture"),
        (F.avg(F.when(F.col(bench) < 0, F.col(ret))) / F.nullif(F.avg(F.when(F.col(bench) < 0, F.col(bench))), F.lit(0.0))).alias("down_capture"),
        F.avg((F.col(ret) > F.col(bench)).cast("double")).alias("win_rate"),
    )
    s = s.withColumn("alpha", F.col("__r") - F.col("beta") * F.col("__b")).drop("__r", "__b")
    keep = lambda c: F.when(F.col("n") >= least, F.col(c)).otherwise(0.0).alias(c)
    return s.select(by, "n", *(keep(c) for c in ("beta", "alpha", "correlation", "up_capture", "down_capture", "win_rate")))


def stress(rows: DataFrame, scenarios: list[tuple[str, str, str]], by: str = "code", ret: str = "ret", ts: str = "d") -> DataFrame:
    """(by, scenario, n, total, volatility, max_drawdown) in each dated window."""
    table = rows.sparkSession.createDataFrame(scenarios, "scenario string, a string, b string")
    j = rows.where(F.col(ret).isNotNull()).join(F.broadcast(table), F.col(ts).between(F.to_date("a"), F.to_date("b")))
    w = Window.partitionBy(by, "scenario").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__v", F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)))
    j = j.withColumn("__dd", F.col("__v") / F.max("__v").over(w) - 1)
    return j.groupBy(by, "scenario").agg(F.count("*").alias("n"), (F.exp(F.sum(F.ln(1 + F.col(ret)))) - 1).alias("total"), F.stddev_samp(ret).alias("volatility"), F.min("__dd").alias("max_drawdown"))


def correlations(rows: DataFrame, by: str = "code", ts: str = "d", ret: str = "ret") -> DataFrame:
    """(a, b, corr, n): correlation of each pair of series over shared days."""
    x = rows.where(F.col(ret).isNotNull()).select(F.col(by).alias("a"), ts, F.col(ret).alias("__x"))
    y = x.select(F.col("a").alias("b"), ts, F.col("__x").alias("__y"))
    return x.join(y, ts).where("a < b").groupBy("a", "b").agg(corr("__x", "__y").alias("corr"), F.count("*").alias("n"))


def exposures(rows: DataFrame, ret: str, factors: list[str]) -> dict:
    """Least-squares betas, t statistics, R² and adjusted R²; Spark sums, the driver solves k numbers."""
    cols = [F.lit(1.0), *(F.col(f) for f in factors)]
    good = rows.where(" and ".join(f"`{c}` is not null" for c in [ret, *factors]))
    k = len(cols)
    s = good.agg(F.count("*").alias("n"), F.sum(F.col(ret) ** 2).alias("yy"), F.sum(ret).alias("y"), *(F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)), *(F.sum(cols[i] * F.col(ret)).alias(f"t{i}") for i in range(k))).first()
    n = s["n"]
    if n <= k:
        return {"n": n, "beta": [0.0] * k, "t": [0.0] * k, "r2": 0.0, "adjusted_r2": 0.0}
    gram, t = np.array([[s[f"g{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([s[f"t{i}"] for i in range(k)])
    inverse = np.linalg.pinv(gram)
    b = inverse @ t
    rss, tss = s["yy"] - b @ t, s["yy"] - s["y"] ** 2 / n
    r2 = 1 - rss / tss if tss else 0.0
    se = np.sqrt(np.maximum(np.diag(inverse) * rss / (n - k), 1e-300))
    return {"n": n, "beta": b.tolist(), "t": (b / se).tolist(), "r2": float(r2), "adjusted_r2": float(1 - (1 - r2) * (n - 1) / (n - k))}


def monte_carlo(rows: DataFrame, paths: int = 10_000, horizon: int = 21, confidence: float = 0.95, seed: int = 42, ret: str = "ret", levels: int = 1 << 12) -> DataFrame:
    """(n, var, cvar, mean) of paths bootstrapped from all returns.

    Returns are numbered from 0 by value within ``levels`` groups by hash, and
    groups are told apart by their sizes (one number a group); each draw is a
    number from a hash of seed, path and step, joined to its return.  Equal
    input gives equal draws.  No returns: no paths.
    """
    known = rows.where(F.col(ret).isNotNull()).select(F.col(ret).alias("r"))
    # of equal returns, any may be drawn for any other: they are numbered as a run
    runs = known.groupBy("r").agg(F.count("*").alias("n")).withColumn("g", F.pmod(F.xxhash64("r"), F.lit(levels)))
    total, before = 0, []
    for g, n in sorted(map(tuple, runs.groupBy("g").agg(F.sum("n")).collect())):  # one row a group
        before.append((g, total))
        total += n
    if not total:
        return rows.sparkSession.createDataFrame([(0, None, None, None)], "n long, var double, cvar double, mean double")
    before = rows.sparkSession.createDataFrame(before, "g long, before long")
    inner = Window.partitionBy("g").orderBy("r")
    first = runs.withColumn("first", F.sum("n").over(inner) - F.col("n")).join(F.broadcast(before), "g")
    numbered = first.select("r", F.explode(F.sequence(F.col("before") + F.col("first"), F.col("before") + F.col("first") + F.col("n") - 1)).alias("i"))
    steps = rows.sparkSession.range(paths * horizon).select((F.col("id") / horizon).cast("long").alias("path"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("i"))
    totals = steps.join(numbered, "i").groupBy("path").agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("total"))
    q = totals.agg(F.percentile("total", F.lit(1 - confidence)).alias("q")).first()["q"]
    return totals.agg(F.count("*").alias("n"), F.lit(-q).alias("var"), (-F.avg(F.when(F.col("total") <= q, F.col("total")))).alias("cvar"), F.avg("total").alias("mean"))
