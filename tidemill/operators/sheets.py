"""Tear sheets of a factor, and grids of rule parameters, each in one pass over the rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import corr, ordered
from .factors import average_rank, quantile_bins


def with_horizons(rows: DataFrame, periods=(1, 5, 10), x: str = "close", z: float | None = 20.0, code: str = "code", ts: str = "d") -> DataFrame:
    """``rows`` with ret_p: the relative change of x over the next p rows of the code.

    Returns farther than ``z`` standard deviations from their code's mean are null.
    """
    w = ordered(code, ts)
    s = rows.withColumns({f"ret_{p}": F.lead(x, p).over(w) / F.nullif(F.col(x), F.lit(0.0)) - 1 for p in periods})
    if z is None:
        return s
    own = Window.partitionBy(code)
    far = lambda c: F.abs(F.col(c) - F.avg(c).over(own)) > z * F.stddev_samp(c).over(own)
    return s.withColumns({f"ret_{p}": F.when(~F.coalesce(far(f"ret_{p}"), F.lit(False)), F.col(f"ret_{p}")) for p in periods})


def clean_factor(rows: DataFrame, factor: str = "factor", periods=(1, 5, 10), quantiles: int = 10, max_loss: float | None = 0.35, ts: str = "d") -> DataFrame:
    """Rows with a factor and all returns, and ``bin``: the factor's quantile on its day.

    Raises if a larger share of the rows than ``max_loss`` has to go.
    """
    whole = " and ".join(f"`{c}` is not null" for c in [factor, *(f"ret_{p}" for p in periods)])
    if max_loss is not None:
        n = rows.agg(F.count("*").alias("all"), F.count_if(F.expr(whole)).alias("kept")).first()
        if n["all"] - n.kept > max_loss * n["all"]:
            raise ValueError(f"{n['all'] - n.kept} of {n['all']} rows lack a factor or a return")
    return quantile_bins(rows.where(whole), factor, quantiles, ts)


def horizons(rows: DataFrame, periods, *keep: str) -> DataFrame:
    """The columns, and one row for each (horizon, ret)."""
    pairs = F.array(*(F.struct(F.lit(p).alias("horizon"), F.col(f"ret_{p}").alias("ret")) for p in periods))
    return rows.select(*keep, F.explode(pairs).alias("h")).select(*keep, "h.horizon", "h.ret")


def tear_sheet(clean: DataFrame, periods=(1, 5, 10), group: str | None = None, ts: str = "d") -> DataFrame:
    """(horizon, bin, group, n, ret, error, excess, best, worst): returns by horizon, by quantile, by group and by both.

    ``excess`` is over the mean of the day; ``error`` is the mean's standard
    error.  A column that is summed over is null, and ``by_bin`` and ``by_group``
    tell it from a group that is null.  One pass with grouping sets.
    """
    named = clean.withColumn("group", F.col(group) if group else F.lit("all"))
    long = horizons(named, periods, ts, "bin", "group").withColumn("excess", F.col("ret") - F.avg("ret").over(Window.partitionBy(ts, "horizon")))
    h, b, g = F.col("horizon"), F.col("bin"), F.col("group")
    sets = long.groupingSets([(h, b, g), (h, b), (h, g), (h,)], h, b, g).agg(
        (1 - F.grouping("bin")).cast("int").alias("by_bin"), (1 - F.grouping("group")).cast("int").alias("by_group"), F.count("*").alias("n"), F.avg("ret").alias("ret"),
        (F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("error"), F.avg("excess").alias("excess"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
    )
    return sets


def spreads(clean: DataFrame, periods=(1, 5, 10), ts: str = "d") -> DataFrame:
    """(horizon, n, spread, sd, t): mean daily return of the top quantile over that of the bottom one."""
    edge = clean.agg(F.min("bin").alias("__low"), F.max("bin").alias("__high"))
    daily = horizons(clean, periods, ts, "bin").groupBy("horizon", ts, "bin").agg(F.avg("ret").alias("m")).crossJoin(edge)
    day = daily.groupBy("horizon", ts).agg(F.max(F.when(F.col("bin") == F.col("__high"), F.col("m"))).alias("a"), F.max(F.when(F.col("bin") == F.col("__low"), F.col("m"))).alias("b"))
    out = day.where("a is not null and b is not null").withColumn("s", F.col("a") - F.col("b")).groupBy("horizon").agg(F.count("*").alias("n"), F.avg("s").alias("spread"), F.stddev_samp("s").alias("sd"))
    return out.withColumn("t", F.col("spread") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt("n"))


def information(clean: DataFrame, factor: str = "factor", periods=(1, 5, 10), ts: str = "d") -> DataFrame:
    """(horizon, n, mean, sd, ir, t, positive): rank correlations of factor and return by day, over all days."""
    long = horizons(clean, periods, ts, factor).withColumns({"__f": average_rank(factor, ts, "horizon"), "__r": average_rank("ret", ts, "horizon")})
    daily = long.groupBy("horizon", ts).agg(corr("__f", "__r").alias("ic")).where("ic is not null")
    s = daily.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive"))  # rank correlations of 0 may miss it by a rounding
    ir = F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    return s.select("horizon", "n", "mean", "sd", ir.alias("ir"), (ir * F.sqrt("n")).alias("t"), "positive")


def turnover(clean: DataFrame, periods=(1, 5, 10), factor: str = "factor", code: str = "code", ts: str = "d") -> DataFrame:
    """(horizon, bin, days, turnover, stay): share of a quantile's names that were not in it ``horizon`` days before, and the rank correlation of the factor with itself then.

    Days are counted among those of ``clean``; the first ``horizon`` of them have
    no day before and are left out.  Quantiles of one horizon share ``stay``.
    """
    days = clean.select(ts).distinct().withColumn("__i", F.row_number().over(Window.orderBy(ts)))  # one row a day
    now = clean.join(days, ts).select(code, "__i", "bin", average_rank(factor, ts).alias("__r"))
    moved = now.select("*", F.explode(F.array(*map(F.lit, periods))).alias("horizon")).where(F.col("__i") > F.col("horizon"))
    old = now.select(code, F.col("__i").alias("__j"), F.col("bin").alias("__b"), F.col("__r").alias("__q"))
    j = moved.withColumn("__j", F.col("__i") - F.col("horizon")).join(old, [code, "__j"], "left")
    share = j.groupBy("horizon", "bin", "__i").agg(F.avg((~F.coalesce(F.col("bin") == F.col("__b"), F.lit(False))).cast("double")).alias("new"))
    by_bin = share.groupBy("horizon", "bin").agg(F.count("*").alias("days"), F.avg("new").alias("turnover"))
    stay = j.groupBy("horizon", "__i").agg(corr("__r", "__q").alias("c")).groupBy("horizon").agg(F.avg("c").alias("stay"))
    return by_bin.join(stay, "horizon")


# ---- grids of parameters ------------------------------------------------------------------------


def crossing_grid(bars: DataFrame, sets: list[tuple[int, int]], tick: float = 0.01, per_year: int = 252, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, fast, slow, n, mean, sd, sharpe, total, trades) of each rule "hold while the fast mean is above the slow one".

    One plan for any number of sets: a running sum of prices in whole ticks, its
    value each needed number of rows ago, and then one row for each bar and
    set, summed where they arise.  A bar's return is earned if the rule held at
    the bar before, so both means must exist there.
    """
    if any(f < 1 or s < 1 for f, s in sets):
        raise ValueError("means are over one row or more")
    spans = sorted({n for pair in sets for n in pair})
    w = ordered(code, ts)
    s = bars.withColumns({"__p": F.sum(F.round(F.col("close") / tick).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__i": F.row_number().over(w), "__ret": F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1})
    window_sum = lambda n: F.when(F.col("__i") >= n, F.col("__p") - F.coalesce(F.lag("__p", n).over(w), F.lit(0).cast("long")))
    s = s.withColumn("__now", F.array(*(window_sum(n) for n in spans))).withColumn("__old", F.lag("__now").over(w)).withColumn("__older", F.lag("__now", 2).over(w))
    at = {n: k for k, n in enumerate(spans)}
    told = F.from_json(F.lit(json.dumps([{"fast": f, "slow": g, "a": at[f], "b": at[g]} for f, g in sets])), "array<struct<fast: int, slow: int, a: int, b: int>>")
    x = s.where("__old is not null and __ret is not null").select(code, "__ret", "__old", "__older", F.explode(told).alias("p"))
    above = lambda c: F.col(c)[F.col("p.a")] * F.col("p.slow") > F.col(c)[F.col("p.b")] * F.col("p.fast")
    x = x.select(code, "p.fast", "p.slow", "__ret", above("__old").alias("held"), F.coalesce(above("__older"), F.lit(False)).alias("before")).where("held is not null")
    got = F.when(F.col("held"), F.col("__ret")).otherwise(0.0)
    out = x.groupBy(code, "fast", "slow").agg(F.count("*").alias("n"), F.avg(got).alias("mean"), F.stddev_samp(got).alias("sd"), (F.exp(F.sum(F.ln(1 + got))) - 1).alias("total"), F.sum((F.col("held") & ~F.col("before")).cast("long")).alias("trades"))
    return out.withColumn("sharpe", F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * per_year**0.5)


def importance(scored: DataFrame, keys: list[str], score: str = "sharpe") -> DataFrame:
    """(parameter, best, importance): each parameter's value in the best set, and the spread of its values' mean scores."""
    long = scored.where(F.col(score).isNotNull()).select(score, F.struct(*keys).alias("set"), F.explode(F.array(*(F.struct(F.lit(k).alias("parameter"), F.col(k).cast("string").alias("value")) for k in keys))).alias("p")).select(score, "set", "p.*")
    best = long.groupBy("parameter").agg(F.max_by("value", F.struct(score, "set")).alias("best"))
    means = long.groupBy("parameter", "value").agg(F.avg(score).alias("m")).groupBy("parameter").agg(F.stddev_pop("m").alias("importance"))
    return best.join(means, "parameter")
