"""Column builders over one code's ordered rows.  A window that is not full gives null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ordered(code: str = "code", ts: str = "d"):
    return Window.partitionBy(code).orderBy(ts)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_n(w, n: int):
    """The current row and the n - 1 before it; 0: all rows so far."""
    return w.rowsBetween(-(n - 1), 0) if n else w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(aggregate, x, n: int, w, least: int | None = None) -> Column:
    """aggregate over the last n rows, null while fewer than ``least`` (n) of them have values."""
    x = col(x)
    value = aggregate(x).over(last_n(w, n))
    need = n if least is None else least
    return F.when(F.count(x).over(last_n(w, n)) >= need, value) if need > 1 else value


def MA(x, n, w):
    return rolling(F.avg, x, n, w)


def HHV(x, n, w):
    return rolling(F.max, x, n, w)


def LLV(x, n, w):
    return rolling(F.min, x, n, w)


def SUM(x, n, w):
    return rolling(F.sum, x, n, w)


def STD(x, n, w):
    return rolling(F.stddev_samp, x, n, w)


def STDP(x, n, w):
    return rolling(F.stddev_pop, x, n, w)


def REF(x, n, w):
    return F.lag(col(x), n).over(w)


def DIFF(x, n, w):
    return col(x) - REF(x, n, w)


def PCT(x, n, w):
    return col(x) / F.nullif(REF(x, n, w), F.lit(0.0)) - 1


def MAX(a, b):
    """a if a > b else b; b where either is null."""
    return F.when(col(a) > col(b), col(a)).otherwise(col(b))


def MIN(a, b):
    return F.when(col(a) < col(b), col(a)).otherwise(col(b))


def IF(cond, a, b):
    return F.when(cond, a).otherwise(b)


def IFAND(one, two, a, b):
    return IF(one & two, a, b)


def IFOR(one, two, a, b):
    return IF(F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False)), a, b)


def AVEDEV(x, n, w):
    """Mean absolute deviation from the window's own mean."""
    xs = F.collect_list(col(x)).over(last_n(w, n))
    mean = F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / n
    return F.when(F.size(xs) >= n, F.aggregate(F.transform(xs, lambda v: F.abs(v - mean)), F.lit(0.0), lambda s, v: s + v) / n)


def COUNT(cond, n, w):
    return SUM(F.coalesce(cond, F.lit(False)).cast("int"), n, w)


def EXIST(cond, n, w):
    return F.coalesce(COUNT(cond, n, w) > 0, F.lit(False))


def EVERY(cond, n, w):
    return F.coalesce(COUNT(cond, n, w) == n, F.lit(False))


def CROSS(a, b, w):
    """1 where a was below b and no longer is."""
    below = F.coalesce(col(a) < col(b), F.lit(False))
    return (F.lag(below).over(w) & ~below).cast("int")


def CROSS_STATUS(a, b):
    return F.coalesce((col(a) > col(b)).cast("int"), F.lit(0))


def WMA(x, n, w):
    """Linearly weighted mean, the last row heaviest."""
    xs = F.collect_list(col(x)).over(last_n(w, n))
    total = F.aggregate(F.transform(xs, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(xs) >= n, total / (n * (n + 1) / 2))


def pct_rank(x, n, w, default=0.5):
    """Average rank of the row among its window's values, as a share of them."""
    xs = F.collect_list(col(x)).over(last_n(w, n))
    below = F.size(F.filter(xs, lambda v: v < col(x)))
    same = F.size(F.filter(xs, lambda v: v == col(x)))
    return F.coalesce(F.try_divide(below + (same + 1) / 2, F.size(xs)), F.lit(default))


def zscore(x, n, w):
    """(x - mean) / sample deviation of the last n rows; 0 with too few rows or no spread."""
    least = max(5, n // 4)
    spread = rolling(F.stddev_samp, x, n, w, least)
    return F.coalesce((col(x) - rolling(F.avg, x, n, w, least)) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def regression(x, n, w, position):
    """(slope, intercept, end) of the least-squares line through the last n rows; ``position`` numbers them."""
    x, t = col(x), col(position)
    full = F.count(x).over(last_n(w, n)) >= n
    slope = F.when(full, F.regr_slope(x, t).over(last_n(w, n)))
    level = F.when(full, F.avg(x).over(last_n(w, n)))
    middle = (n - 1) / 2
    return slope, level - slope * middle, level + slope * middle


def corr(a, b, w=None) -> Column:
    """Pearson correlation of complete pairs; null where either side does not vary."""
    a, b = col(a), col(b)
    on = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    spread = on(F.stddev_pop(F.when(b.isNotNull(), a))) * on(F.stddev_pop(F.when(a.isNotNull(), b)))
    return on(F.covar_pop(a, b)) / F.nullif(spread, F.lit(0.0))


def exact_sum(x) -> Column:
    """Sum of doubles by their decimal digits (10 behind the point), the same in any order of rows.

    Equal sums come out equal, so comparisons and ranks do not hang on how rows
    were dealt.  NaN, infinite and huge values are no such decimals; with one the sum is the plain one.
    """
    digits = col(x).try_cast("decimal(28,10)")
    return F.when(F.count(digits) == F.count(col(x)), F.sum(digits).cast("double")).otherwise(F.sum(col(x)))


def bars_since(cond, w, position):
    """Rows since ``cond`` was last true; null before."""
    return col(position) - F.max(F.when(cond, col(position))).over(last_n(w, 0))


def XARROUND(x, tick):
    """x to the nearest multiple of a tick, two decimals."""
    return F.round(F.floor(col(x) / tick + 0.5) * tick, 2)
