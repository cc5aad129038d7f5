"""Factor research: forward returns, ranks, information coefficients, quantiles, neutral residuals."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import corr, ordered


def forward_returns(bars: DataFrame, days: int = 5, model: str = "next_open", name: str = "ret", code: str = "code", ts: str = "d") -> DataFrame:
    """next_open: from the next open over ``days`` bars; close: from this close."""
    w = ordered(code, ts)
    if model == "close":
        return bars.withColumn(name, F.lead("close", days).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1)
    return bars.withColumn(name, F.lead("open", days + 1).over(w) / F.nullif(F.lead("open", 1).over(w), F.lit(0.0)) - 1)


def average_rank(x: str, *by: str) -> Column:
    """Rank within groups, ties sharing their mean rank; null for null."""
    own, ties = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()), Window.partitionBy(*by, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(own) + (F.count(x).over(ties) - 1) / 2)


def ic(rows: DataFrame, factor: str = "factor", ret: str = "ret", by: str = "d", least: int = 2) -> DataFrame:
    """(by, n, ic, rank_ic): Pearson and Spearman per day, null below ``least`` pairs."""
    pairs = rows.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    ranked = pairs.withColumns({"__f": average_rank(factor, by), "__r": average_rank(ret, by)})
    enough = F.count("*") >= least
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.when(enough, corr(factor, ret)).alias("ic"), F.when(enough, corr("__f", "__r")).alias("rank_ic"))


def pooled_ic(rows: DataFrame, factor: str = "factor", ret: str = "ret", least: int = 10) -> DataFrame:
    """One row (n, ic): Pearson over all pairs, 0 below ``least``."""
    pairs = rows.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    return pairs.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.coalesce(corr(factor, ret), F.lit(0.0))).otherwise(0.0).alias("ic"))


def ic_decay(bars: DataFrame, factor: str, lags=(1, 2, 3, 5, 10), code: str = "code", ts: str = "d") -> DataFrame:
    """(lag, ic): correlation of the factor with the return ``lag`` bars on, within each code."""
    w = ordered(code, ts)
    moved = bars.select(factor, *(F.struct(F.lit(k).alias("lag"), (F.lead("close", k).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1).alias("ret")).alias(f"__{k}") for k in lags))
    long = moved.select(F.col(factor).alias("factor"), F.explode(F.array(*(f"__{k}" for k in lags))).alias("x")).select("factor", "x.lag", "x.ret")
    return long.where("factor is not null and ret is not null").groupBy("lag").agg(corr("factor", "ret").alias("ic"))


def standardize(rows: DataFrame, x: str, by: str = "d") -> DataFrame:
    w = Window.partitionBy(by)
    return rows.withColumn(f"{x}_z", (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)))


def winsorize(rows: DataFrame, x: str, low: float = 0.01, high: float = 0.99, by: str = "d") -> DataFrame:
    """x clipped to its quantiles by group; quantiles are one small grouped aggregate."""
    edges = rows.groupBy(by).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__q"))
    return rows.join(edges, by).withColumn(f"{x}_w", F.least(F.greatest(F.col(x), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def quantile_bins(rows: DataFrame, x: str, k: int = 5, by: str = "d") -> DataFrame:
    """Right-closed quantile bin 1..k of x by group (linear quantiles)."""
    edges = rows.groupBy(by).agg(F.percentile(x, F.array(*(F.lit(i / k) for i in range(1, k)))).alias("__q"))
    bin_ = F.aggregate("__q", F.lit(1), lambda n, e: n + (F.col(x) > e).cast("int"))
    return rows.join(edges, by).withColumn("bin", F.when(F.col(x).isNotNull(), bin_)).drop("__q")


def quantile_returns(rows: DataFrame, x: str = "factor", ret: str = "ret", k: int = 5, by: str = "d") -> DataFrame:
    """(bin, ret, n): mean return by quantile bin."""
    return quantile_bins(rows, x, k, by).where("bin is not null").groupBy("bin").agg(F.avg(ret).alias("ret"), F.count(ret).alias("n"))


def above_quantile(rows: DataFrame, x: str, q: float = 0.998, by: str = "d") -> DataFrame:
    """Rows strictly above the day's quantile."""
    edge = rows.groupBy(by).agg(F.percentile(x, F.lit(q)).alias("__q"))
    return rows.join(edge, by).where(F.col(x) > F.col("__q")).drop("__q")


def neutral(rows: DataFrame, y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """rows with the residual of a (weighted) least-squares fit of y on xs and a constant.

    Spark sums the normal equations; only (len(xs) + 1)² numbers reach the driver.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    terms = [F.lit(1.0), *(F.col(x) for x in xs)]
    good = rows.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    pairs = list(itertools.combinations_with_replacement(range(len(terms)), 2))
    sums = good.agg(*(F.sum(w * terms[i] * terms[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(w * terms[i] * F.col(y)).alias(f"t{i}") for i in range(len(terms)))).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(terms))] for i in range(len(terms))])
    beta = np.linalg.lstsq(gram, np.array([sums[f"t{i}"] or 0.0 for i in range(len(terms))]), rcond=None)[0]
    fitted = sum((float(b) * t for b, t in zip(beta, terms)), F.lit(0.0))
    return rows.withColumn("residual", F.col(y) - fitted)


def combine(factors: DataFrame, names: list[str], ret: str = "ret", top: int = 10) -> DataFrame:
    """rows with ``combined``: the best factors by |IC|, weighted by |IC| and signed."""
    found = factors.agg(*(corr(n, ret).alias(n) for n in names)).first().asDict()
    best = sorted(((n, v) for n, v in found.items() if v is not None), key=lambda p: -abs(p[1]))[:top]
    total = sum(abs(v) for _, v in best) or 1.0
    return factors.withColumn("combined", sum((F.col(n) * (v / total) for n, v in best), F.lit(0.0)))


def turnover(rows: DataFrame, factor: str = "factor", by: str = "idx", code: str = "code") -> DataFrame:
    """(idx, turnover): 1 - correlation of the factor's ranks on consecutive days."""
    r = rows.withColumn("__r", average_rank(factor, by)).select(code, by, "__r")
    old = r.select(code, (F.col(by) + 1).alias(by), F.col("__r").alias("__o"))
    return r.join(old, [code, by]).groupBy(by).agg((1 - corr("__r", "__o")).alias("turnover"))


def folds(n: int, train: int, test: int, step: int | None = None) -> list[tuple[int, int, int, int]]:
    """Walk-forward folds as (train from, train to, test from, test to), half open."""
    return [(a, a + train, a + train, a + train + test) for a in range(0, n - train - test + 1, step or test)]


def walk_forward(rows: DataFrame, index: str, fold_list, factor: str = "factor", ret: str = "ret") -> DataFrame:
    """(fold, beta, oos): slope fitted on each train range and its mean signed return on the test range."""
    table = rows.sparkSession.createDataFrame([(k, *f) for k, f in enumerate(fold_list)], "fold int, a long, b long, c long, e long")
    j = rows.join(F.broadcast(table), (F.col(index) >= F.col("a")) & (F.col(index) < F.col("e")))
    train, test = F.col(index) < F.col("b"), F.col(index) >= F.col("c")
    slopes = j.groupBy("fold").agg(F.regr_slope(F.when(train, F.col(ret)), F.when(train, F.col(factor))).alias("beta"))
    scored = j.where(test).join(F.broadcast(slopes), "fold").groupBy("fold", "beta").agg(F.avg(F.signum(F.col("beta") * F.col(factor)) * F.col(ret)).alias("oos"))
    return scored.select("fold", "beta", "oos")


def grid_search(rows: DataFrame, score, grid: dict[str, list]) -> DataFrame:
    """(params, score) of every combination, best first; ``score(rows, **params)`` is a one-row frame with ``score``."""
    from functools import reduce

    made = [score(rows, **dict(zip(grid, values))).select(F.lit(repr(dict(zip(grid, values)))).alias("params"), "score") for values in itertools.product(*grid.values())]
    return reduce(DataFrame.unionByName, made).orderBy(F.desc_nulls_last("score"), "params")


def ic_statistics(daily: DataFrame, x: str = "ic", periods: int = 252) -> DataFrame:
    """One row (n, mean, sd, ir, t, positive) of daily coefficients: ir is annualised by ``periods``."""
    s = daily.where(F.col(x).isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))
    ratio = F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    return s.select("n", "mean", "sd", (ratio * periods**0.5).alias("ir"), (ratio * F.sqrt("n")).alias("t"), "positive")


def inflation(rows: DataFrame, factors: list[str]) -> dict[str, float]:
    """Variance inflation of each factor by the others, from their correlations over complete rows; Spark sums, the driver inverts k x k."""
    good = rows.where(" and ".join(f"`{f}` is not null" for f in factors))
    pairs = [(i, j) for i in range(len(factors)) for j in range(i)]
    row = good.agg(F.count("*").alias("n"), *(corr(factors[i], factors[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    matrix = np.eye(len(factors))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"] or 0.0
    return dict(zip(factors, np.diag(np.linalg.pinv(matrix)).tolist()))


def dummies(rows: DataFrame, x: str, values: list) -> DataFrame:
    """``rows`` with a 0/1 column ``x_value`` for each of the values (of a group or an industry)."""
    return rows.withColumns({f"{x}_{v}": (F.coalesce(F.col(x) == v, F.lit(False))).cast("int") for v in values})


def block_turnover(bars: DataFrame, members: DataFrame, shares: DataFrame, by: str = "d", code: str = "code") -> DataFrame:
    """(block, d, turnover): volume traded in a block's members over their shares."""
    j = bars.select(code, by, "volume").join(shares.select(code, "shares"), code).join(members.select("block", code), code)
    return j.groupBy("block", by).agg((F.sum("volume") / F.nullif(F.sum("shares"), F.lit(0.0))).alias("turnover"))


def stock_turnover(bars: DataFrame, shares: DataFrame, by: str = "d", code: str = "code") -> DataFrame:
    """(code, d, turnover) of bars, one a code and day: volume over the code's shares."""
    return bars.join(shares.select(code, "shares"), code).select(code, by, (F.col("volume") / F.nullif(F.col("shares"), F.lit(0.0))).alias("turnover"))


def register(factors: DataFrame, path: str, version: int) -> DataFrame:
    """Store factor values (name, code, d, value) as a version in a table; of one key the last version counts."""
    from ..sources.sinks import upsert

    return upsert(factors.select("name", "code", "d", "value"), path, ["name", "code", "d"], version)


def unregister(spark, path: str, name: str, version: int) -> DataFrame:
    """The factor table without a factor: its rows are rewritten as deleted (null) in a new version, and left out on reading."""
    from ..sources.sinks import read_latest, upsert

    gone = read_latest(spark, path, ["name", "code", "d"]).where(F.col("name") == name).withColumn("value", F.lit(None).cast("double"))
    return upsert(gone.select("name", "code", "d", "value"), path, ["name", "code", "d"], version).where("value is not null")


def factor_names(stored: DataFrame) -> DataFrame:
    """(name, n, first, last) of the stored factors."""
    return stored.where("value is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


def factor_values(stored: DataFrame, names: list[str]) -> DataFrame:
    """One column a factor, by code and day."""
    return stored.where(F.col("name").isin(names)).groupBy("code", "d").pivot("name", names).agg(F.first("value"))
