"""Turning points of a line, and the signals that count from them.

A smooth line tells how far apart extremes lie; of the line's own extremes the
highest stands first and lower ones nearer than that distance go.  An extreme
that is the highest within the distance stands whatever the others do, so the
rows between two such extremes are decided by themselves: small groups, not a
history.
"""

from __future__ import annotations

from bisect import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import low_pass, zero_phase
from ..functions.indicators import C, W, stage
from ..functions.scan import begun_means
from ..functions.series import CROSS, DIFF, MA
from ..sources.kept import cut
from .signals import since_last

#: Order and cutoff of the smooth line, share of the range that extremes must exceed.
ORDER, CUTOFF, SHARE = 3, 0.05, 0.01


def _spacing(line: DataFrame) -> DataFrame:
    """(code, n): twice the whole rows an extreme of the line; codes without extremes are left out."""
    w = Window.partitionBy("code").orderBy("k")
    v, a, b = F.col("v"), F.lag("v").over(w), F.lead("v").over(w)
    turns = line.withColumn("__t", (((v > a) & (v > b)) | ((v < a) & (v < b))).cast("int"))
    return turns.groupBy("code").agg(F.count("*").alias("n"), F.sum("__t").alias("t")).where("t > 0").select("code", (F.floor(F.col("n") / F.col("t")) * 2).alias("n"))


def _standing(found: pd.Series, n: pd.Series, after: pd.Series) -> pd.Series:
    """Places that stay of one group: from the highest on, those farther than n from all that stay, and from ``after``."""

    def keep(group, n, after):
        kept = []
        for one in sorted(group, key=lambda p: (p["height"], p["k"]), reverse=True):
            k = one["k"]
            i = bisect(kept, k)
            near = (i and k - kept[i - 1] <= n) or (i < len(kept) and kept[i] - k <= n) or (after >= 0 and after - k <= n)
            if not near:
                kept.insert(i, k)
        return kept

    return pd.Series([keep(*x) for x in zip(found, n, after)], dtype=object)


def _extremes(line: DataFrame, spacing: DataFrame, most: DataFrame) -> DataFrame:
    """(code, k, turn): -1 at highs and 1 at lows of (code, k, v); of equal neighbours the middle one, of equally high near ones the later.

    ``most`` is (code, most), the highest price, of which the threshold is a share.
    """
    w = Window.partitionBy("code").orderBy("k")
    runs = line.withColumn("__new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy("code", "__r").agg((F.min("k") + F.floor((F.count("*") - 1) / 2)).alias("k"), F.first("v").alias("v"))
    r = Window.partitionBy("code").orderBy("__r")
    v, a, b = F.col("v"), F.lag("v").over(r), F.lead("v").over(r)
    found = flat.withColumn("turn", F.when((v > a) & (v > b), -1).when((v < a) & (v < b), 1)).where("turn is not null")

    reach = line.groupBy("code").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    same = lambda name: F.col("__code").eqNullSafe(F.col(name))
    codes = reach.withColumnRenamed("code", "__code").join(spacing.withColumnRenamed("code", "__c1"), same("__c1")).join(most.withColumnRenamed("code", "__c2"), same("__c2"))
    codes = codes.select("__code", "hi", "lo", "n", (F.lit(SHARE) / F.col("most") * (F.col("hi") - F.col("lo"))).alias("least"))
    found = found.join(codes, same("code")).where("CASE WHEN turn = -1 THEN v > lo + least ELSE v < hi - least END")
    found = found.select("code", "turn", "k", "n", (-F.col("turn") * F.col("v")).alias("height"), (F.col("k") / F.col("n")).alias("__at"))

    # a frame a little wider than n finds fewer of those that surely stand, and no wrong ones
    near = "OVER (PARTITION BY code, turn ORDER BY __at RANGE BETWEEN 1.0000001D PRECEDING AND 1.0000001D FOLLOWING)"
    sure = found.withColumn("__sure", F.expr(f"max(struct(height, k)) {near} = struct(height, k)").cast("int"))
    sure = sure.withColumn("__g", F.sum("__sure").over(Window.partitionBy("code", "turn").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    groups = sure.groupBy("code", "turn", "__g").agg(F.collect_list(F.struct("height", "k")).alias("found"), F.first("n").alias("n"), F.min(F.when(F.col("__sure") == 1, F.col("k"))).alias("__head"))
    groups = groups.withColumn("after", F.coalesce(F.lead("__head").over(Window.partitionBy("code", "turn").orderBy("__g")), F.lit(-1)))
    return groups.select("code", F.explode(F.pandas_udf(_standing, "array<long>")("found", "n", "after")).alias("k"), "turn")


def _numbered(df: DataFrame, x: str, code: str, ts: str) -> DataFrame:
    good = df.select(F.col(code).alias("code"), F.col(ts).alias("__ts"), F.col(x).cast("double").alias("v")).where("v is not null and not isnan(v) and __ts is not null")
    return good.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("__ts")) - 1)


def _five_mean(rows: DataFrame) -> DataFrame:
    """(code, k, v) by lines through five rows, to nine decimals, so that equal ones are equal; at either end the line of the five outer rows."""
    w = Window.partitionBy("code").orderBy("k")
    five = w.rowsBetween(-2, 2)
    n = F.count("*").over(Window.partitionBy("code"))
    slope = sum(F.lag("v", -t).over(w) * t for t in (-2, -1, 1, 2)) / 10
    s = rows.select("code", "k", "v", n.alias("n"), F.avg("v").over(five).alias("m"), slope.alias("b")).where("n >= 5")
    ends = s.withColumns({"m2": F.lead("m", 2).over(w), "b2": F.lead("b", 2).over(w), "m1": F.lead("m", 1).over(w), "b1": F.lead("b", 1).over(w), "l2": F.lag("m", 2).over(w), "d2": F.lag("b", 2).over(w), "l1": F.lag("m", 1).over(w), "d1": F.lag("b", 1).over(w)})
    return ends.select("code", "k", F.expr("round(CASE WHEN k = 0 THEN m2 - 2 * b2 WHEN k = 1 THEN m1 - b1 WHEN k = n - 1 THEN l2 + 2 * d2 WHEN k = n - 2 THEN l1 + d1 ELSE m END, 9)").alias("v"))


def turning_points(df: DataFrame, x: str = "close", name: str = "turn", eager: bool = False, code: str = "code", ts: str = "d") -> DataFrame:
    """``df`` with ``name``: 1 at a low, -1 at a high of ``x``, else null.

    The spacing comes from a zero-phase low-pass of ``x``; ``eager`` takes the
    five-row mean for the spacing and for the line itself.  Null values and rows
    without a time take no part; codes with 12 values or fewer (eager: 4) or
    without an extreme of the smooth line have no turning points; times within a
    code differ.
    """
    rows = cut(_numbered(df, x, code, ts))  # read many times below
    line = rows.select("code", "k", "v")
    smooth = cut(_five_mean(line) if eager else zero_phase(line, *low_pass(ORDER, CUTOFF), cut=cut))
    found = _extremes(smooth if eager else line, _spacing(smooth), line.groupBy("code").agg(F.max("v").alias("most")))
    found = cut(found).withColumnsRenamed({"code": "__c", "k": "__k"})
    at = rows.join(found, F.col("code").eqNullSafe(F.col("__c")) & (F.col("k") == F.col("__k"))).select("__c", F.col("__ts").alias("__t"), F.col("turn").alias(name))
    return df.drop(name).join(at, F.col(code).eqNullSafe(F.col("__c")) & (F.col(ts) == F.col("__t")), "left").drop("__c", "__t")


def ta_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """dif, dea, macd = 2 (dif - dea) and delta, its change; both means begin at row ``slow``, and all are null before dea is there."""
    s = begun_means(bars, {"__fast": ("close", fast, slow), "__slow": ("close", slow, slow)})
    s = begun_means(stage(s, dif=F.col("__fast") - F.col("__slow")), {"dea": ("dif", signal, signal)})
    s = stage(s, dif=F.when(F.col("dea").isNotNull(), F.col("dif")), macd=2 * (F.col("dif") - F.col("dea")))
    return stage(s, delta=DIFF("macd", 1, W())).drop("__fast", "__slow")


def macd_crosses(bars: DataFrame) -> DataFrame:
    """macd_cross, 1 at lows and -1 at highs of dea; macd_jx, rows since dif last came up through dea or dea was low; macd_sx, rows since dea was high."""
    s = turning_points(cut(ta_macd(bars)), "dea", "__turn")
    s = stage(s, macd_cross=F.col("__turn"), __u=F.greatest(F.coalesce(CROSS("dif", "dea", W()), F.lit(0)), F.coalesce(F.col("__turn"), F.lit(0))), __v=F.coalesce(-F.col("__turn"), F.lit(0)))
    return since_last(since_last(s, "__u", "macd_jx"), "__v", "macd_sx").drop("__turn", "__u", "__v")


def price_trend(bars: DataFrame) -> DataFrame:
    """``macd_crosses`` with price_cross, a low's row number from 0 or a high's below 0, and price_jx and price_sx, the rows since either.

    Turning points are those of the price, and while macd_jx is below macd_sx
    the eager ones too, which go before the others on the same row.
    """
    s = turning_points(turning_points(macd_crosses(bars), "close", "__p"), "close", "__e", eager=True)
    s = stage(s, __k=F.row_number().over(W()) - 1, __e=F.when(F.col("macd_jx") < F.col("macd_sx"), F.col("__e")))
    s = stage(s, price_cross=F.coalesce(F.col("__e"), F.col("__p")) * F.col("__k"))
    flag = lambda way: F.greatest(*(F.coalesce((F.col(c) == way).cast("int"), F.lit(0)) for c in ("__p", "__e")))
    s = stage(s, __u=flag(1), __v=flag(-1))
    return since_last(since_last(s, "__u", "price_jx"), "__v", "price_sx").drop("__p", "__e", "__k", "__u", "__v")


def mean_turns(bars: DataFrame, n: int = 30) -> DataFrame:
    """turn_jx and turn_sx: rows since the mean of n closes was last at a low and at a high."""
    s = turning_points(stage(bars, __m=MA(C(), n, W())), "__m", "__turn")
    s = stage(s, __u=(F.col("__turn") == 1).cast("int"), __v=(F.col("__turn") == -1).cast("int"))
    return since_last(since_last(s, "__u", "turn_jx"), "__v", "turn_sx").drop("__m", "__turn", "__u", "__v")
