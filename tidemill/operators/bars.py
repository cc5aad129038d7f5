"""Projections, filters, aggregates, set operations and ordering of bar tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import PCT, REF, ordered


# ---- projections --------------------------------------------------------------------------------


def price() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def derived(bars: DataFrame, lot: int = 100) -> DataFrame:
    """Per-bar measures: price, avg, pct_change within the bar, amplitude, shadows and body."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    amount = F.col("amount") if "amount" in bars.columns else F.col("volume") * price() * lot
    return bars.withColumns({
        "price": price(), "avg": F.try_divide(amount, F.col("volume")), "bar_pct_change": F.try_divide(F.col("close") - F.col("open"), F.col("open")),
        "amplitude": F.try_divide(F.col("high") - F.col("low"), F.col("low")), "lower_shadow": F.abs(F.col("low") - bottom), "upper_shadow": F.abs(F.col("high") - top),
        "body": F.col("close") - F.col("open"), "body_abs": F.abs(F.col("open") - F.col("close")),
    })


def limits(bars: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    """Day limits from the close before (high_limit, low_limit) and for the next day."""
    w = ordered(code, ts)
    at = lambda x, f: F.round((x + 0.0002) * f, 2)
    before = REF("close", 1, w)
    return bars.withColumns({"high_limit": at(before, 1.1), "low_limit": at(before, 0.9), "next_high_limit": at(F.col("close"), 1.1), "next_low_limit": at(F.col("close"), 0.9)})


def changes(bars: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    """Differences and relative changes from the row before, and columns relative to the first row."""
    w = ordered(code, ts)
    p = bars.withColumn("price", price())
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumns({"price_diff": F.col("price") - REF("price", 1, w), "pct_change": PCT("price", 1, w), "close_pct_change": PCT("close", 1, w), "normalized": F.try_divide(F.col("close"), F.first("close").over(first))})


# ---- filters ------------------------------------------------------------------------------------


def select_time_with_gap(bars: DataFrame, time, n: int, method: str, code: str = "code", ts: str = "d") -> DataFrame:
    """n rows of each code before (lt, lte), after (gt, gte) or at (eq) a time.

    gt and lt leave out the row nearest to the time.
    """
    at = F.lit(time).cast(dict(bars.dtypes)[ts])
    if method in ("eq", "="):
        return bars.where(F.col(ts) == at)
    forward = method in ("gt", "gte", ">", ">=")
    skip = 1 if method in ("gt", "lt", ">", "<") else 0
    side = bars.where(F.col(ts) >= at if forward else F.col(ts) <= at)
    k = F.row_number().over(Window.partitionBy(code).orderBy(F.col(ts) if forward else F.desc(ts)))
    return side.withColumn("__k", k).where(F.col("__k").between(1 + skip, n + skip)).drop("__k")


def size_bands(trades: DataFrame, small: float = 200_000, big: float = 1_000_000) -> dict[str, DataFrame]:
    """Orders by amount; the edges belong to both bands."""
    a = F.col("amount")
    return {"big": trades.where(a >= big), "medium": trades.where(a.between(small, big)), "small": trades.where(a <= small)}


def find_bar(bars: DataFrame, code_value, time, code: str = "code", ts: str = "d") -> DataFrame:
    return bars.where((F.col(code) == code_value) & (F.col(ts) == F.lit(time).cast(dict(bars.dtypes)[ts])))


def match(bars: DataFrame, **wanted) -> DataFrame:
    """Rows that equal, or are among, the values given by column."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items()]
    return bars.where(reduce(Column.__and__, tests)) if tests else bars


def in_all_blocks(members: DataFrame, blocks: list) -> DataFrame:
    """Codes that belong to each of the blocks."""
    return members.where(F.col("block").isin(*blocks)).groupBy("code").agg(F.count_distinct("block").alias("n")).where(F.col("n") == len(set(blocks))).select("code")


# ---- aggregates ---------------------------------------------------------------------------------


def statistics(rows: DataFrame, x: str, by: str = "code") -> DataFrame:
    """Moments of x by group; skewness and kurtosis are the bias-corrected sample values."""
    n, c = F.col("n"), F.col(x)
    base = rows.groupBy(by).agg(
        F.count(c).alias("n"), F.max(c).alias("max"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.var_pop(c).alias("pvariance"),
        F.stddev_samp(c).alias("stdev"), F.stddev_pop(c).alias("pstdev"), F.try_divide(F.count(c), F.sum(1 / F.nullif(c, F.lit(0.0)))).alias("mean_harmonic"),
        F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"),
    )
    return base.select(
        by, "n", "max", "min", "mean", "variance", "pvariance", "stdev", "pstdev", "mean_harmonic", ((F.col("max") - F.col("min")) / F.nullif(F.col("min"), F.lit(0.0))).alias("amplitude"),
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"),
    )


def mean_deviation(rows: DataFrame, x: str, by: str = "code") -> DataFrame:
    """Mean absolute deviation from the group's mean."""
    mean = rows.groupBy(by).agg(F.avg(x).alias("__m"))
    return rows.join(mean, by).groupBy(by).agg(F.avg(F.abs(F.col(x) - F.col("__m"))).alias("mad"))


def most_frequent(rows: DataFrame, x: str, by: str = "code") -> DataFrame:
    """The most frequent value by group; of equals the smallest."""
    counted = rows.groupBy(by, x).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(x).alias("v"))).alias("b")).select(by, F.col("b.v").alias("mode"), (-F.col("b.k")).alias("n"))


def pivot(bars: DataFrame, x: str, codes: list, ts: str = "d", code: str = "code") -> DataFrame:
    """Rows by time, one column a code (mean of x if there are several)."""
    return bars.groupBy(ts).pivot(code, codes).agg(F.avg(x))


def block_index(bars: DataFrame, weight: str | None = None, ts: str = "d") -> DataFrame:
    """Weighted mean close by day, the first day being 1000."""
    w = F.col(weight) if weight else F.lit(1.0)
    day = bars.groupBy(ts).agg((F.sum(F.col("close") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("level"))
    first = day.agg(F.min_by("level", ts).alias("base"))
    return day.crossJoin(F.broadcast(first)).select(ts, (F.col("level") / F.col("base") * 1000).alias("index"))


# ---- set operations and order -------------------------------------------------------------------


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def difference(a: DataFrame, b: DataFrame, key=("code", "d")) -> DataFrame:
    """Rows of a whose key b lacks."""
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def latest(rows: DataFrame, key, seq) -> DataFrame:
    """The last row of each key by ``seq`` (last write wins)."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), seq).alias("__r")).select("__r.*")


def top_by_group(rows: DataFrame, x: str, k: int, per_group: int, group: str, by: str = "d", held: str | None = None, code: str = "code") -> DataFrame:
    """Each day's k best rows, held ones first on ties, with at most ``per_group`` new ones of a group."""
    keep = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    best = [F.desc(x), F.desc("__held"), F.col(code)]
    ranked = rows.withColumn("__held", keep)
    ranked = ranked.withColumn("__g", F.row_number().over(Window.partitionBy(by, group, "__held").orderBy(*best))).where((F.col("__g") <= per_group) | F.col("__held"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best))).where(F.col("rank") <= k).drop("__held", "__g")
