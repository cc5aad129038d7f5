"""As-of and calendar joins, price adjustment, market value, gaps in a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import corr


def as_of(left: DataFrame, right: DataFrame, values: list[str], by: str = "code", ts: str = "d") -> DataFrame:
    """left with the right side's values at its latest time at or before each row.

    One union and one window: both sides move once, in time order within a key.
    A column of left that is called like a value is replaced.
    """
    left = left.drop(*values)
    empty = [F.lit(None).cast(t).alias(n) for n, t in right.select(*values).dtypes]
    own = left.select(*left.columns, *empty, F.lit(1).alias("__side"))
    other = right.select(*(F.col(c) if c in (by, ts) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), *values, F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = own.unionByName(other).withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return filled.where("__side = 1").drop("__side")


def adjust(bars: DataFrame, factors: DataFrame, by: str = "code", ts: str = "d") -> DataFrame:
    """Prices times the adjustment factor in force (1 before any); prices keep their names."""
    joined = as_of(bars, factors, ["adj"], by, ts).withColumn("adj", F.coalesce("adj", F.lit(1.0)))
    return joined.withColumns({c: F.col(c) * F.col("adj") for c in ("open", "high", "low", "close", "high_limit", "low_limit") if c in bars.columns})


def adjustment_factors(bars: DataFrame, events: DataFrame, by: str = "code", ts: str = "d") -> DataFrame:
    """(code, d, preclose, qfq, hfq) from corporate actions.

    events: dividend (per ten shares), bonus and rights (shares for ten), rights_price.
    preclose is the close before, corrected for an event of the day; qfq scales
    earlier prices down to the latest, hfq later prices up to the first.
    """
    w = Window.partitionBy(by).orderBy(ts)
    e = events.select(by, ts, *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"__{c}") for c in ("dividend", "bonus", "rights", "rights_price")))
    j = bars.join(e, [by, ts], "left").na.fill(0.0, ["__dividend", "__bonus", "__rights", "__rights_price"])
    before = F.lag("close").over(w)
    j = j.withColumn("preclose", (before * 10 - F.col("__dividend") + F.col("__rights") * F.col("__rights_price")) / (10 + F.col("__rights") + F.col("__bonus")))
    step = F.coalesce(F.lead("preclose").over(w) / F.nullif(F.col("close"), F.lit(0.0)), F.lit(1.0))
    j = j.withColumn("__ln", F.ln(step))
    later = F.sum("__ln").over(w.rowsBetween(0, Window.unboundedFollowing))
    earlier = F.coalesce(F.sum("__ln").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return j.select(by, ts, "preclose", F.exp(later).alias("qfq"), F.exp(-earlier).alias("hfq"))


def market_value(bars: DataFrame, shares: DataFrame, by: str = "code", ts: str = "d", lot: float = 10_000) -> DataFrame:
    """bars with mv and liquidity_mv: close times the shares (in lots of 10,000) in force."""
    j = as_of(bars, shares, ["shares", "liquidity"], by, ts)
    return j.withColumns({"mv": F.col("close") * F.col("shares") * lot, "liquidity_mv": F.col("close") * F.col("liquidity") * lot})


def neighbours(rows: DataFrame, calendar: DataFrame, x: str, by: str = "code", ts: str = "d") -> DataFrame:
    """(idx, corr): correlation over codes of x on each trade day with x on the day before."""
    now = rows.join(calendar.select(F.col("d").alias(ts), "idx"), ts).select(by, "idx", x)
    old = now.select(by, (F.col("idx") + 1).alias("idx"), F.col(x).alias("__before"))
    return now.join(old, [by, "idx"]).groupBy("idx").agg(corr(x, "__before").alias("corr"), F.count("*").alias("n"))


def missing_ranges(bars: DataFrame, grid: DataFrame, by: str = "code", ts: str = "d", position: str = "idx") -> DataFrame:
    """(code, from, to, n): runs of grid times for which a code has no bar, within its life.

    A life begins and ends on grid times; its positions are spelled out, so all joins are on equality.
    """
    at = grid.select(F.col(ts).alias("__t"), F.col(position).alias("__at"))
    life = bars.groupBy(by).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    ends = life.join(at.toDF("__a", "__i"), "__a").join(at.toDF("__b", "__j"), "__b")
    want = ends.select(by, F.explode(F.sequence("__i", "__j")).alias("__at")).join(at, "__at").select(by, F.col("__t").alias(ts), F.col("__at").alias(position))
    lost = want.join(bars.select(by, ts).distinct(), [by, ts], "left_anti")
    island = F.col(position) - F.row_number().over(Window.partitionBy(by).orderBy(position))
    return lost.withColumn("__i", island).groupBy(by, "__i").agg(F.min(ts).alias("from"), F.max(ts).alias("to"), F.count("*").alias("n")).drop("__i")


def natural_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on every shared column."""
    return a.join(b, [c for c in a.columns if c in b.columns], "left")


def unpivoted(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Columns other than the keys as (name, value) rows."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def reindexed(grid: DataFrame, rows: DataFrame, values: list[str], direction: str = "nearest", tolerance=None, by: str = "code", ts: str = "d") -> DataFrame:
    """``grid`` (by, ts, ..) with the values of the row of the same key that its time is matched to, and its time as ``matched``.

    direction: "exact", "backward" (the latest at or before), "forward" (the
    first at or after) or "nearest" (the later one of two equally near).  Rows
    farther away than ``tolerance`` (seconds; days for dates) are no match.  No
    match: nulls.  Of rows that repeat a key and time the greatest by their
    values counts.  One union, read once in each direction it needs.
    """
    if direction not in ("exact", "backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    grid = grid.drop(*values, "matched")
    once = rows.groupBy(by, ts).agg(F.max(F.struct(*values)).alias("__v"))
    kind = dict(grid.dtypes)[ts]
    number = lambda c: F.unix_date(c) if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))
    scale = 1 if kind == "date" else 1_000_000
    rest = [c for c in grid.columns if c not in (by, ts)]
    match = F.struct(F.col(ts).alias("at"), "__v").alias("__m")
    kinds = dict(grid.select(by, F.struct(*rest).alias("__g") if rest else F.lit(True).alias("__g")).dtypes) | dict(once.select(match).dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    # a row carries its own side's columns alone, as all rows of a key are sorted once in each direction
    own = grid.select(by, F.col(ts).alias("__t"), F.struct(*rest).alias("__g") if rest else none("__g"), none("__m"), F.lit(1).alias("__side"))
    other = once.select(by, F.col(ts).alias("__t"), none("__g"), match, F.lit(0).alias("__side"))
    s = own.unionByName(other)
    so_far = lambda *order: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__back", F.last("__m", ignorenulls=True).over(so_far(F.asc("__t"), "__side")))
    if direction in ("forward", "nearest"):
        s = s.withColumn("__back", F.when(F.col("__side") == 1, F.col("__back")))
        s = s.withColumn("__fore", F.last("__m", ignorenulls=True).over(so_far(F.desc("__t"), "__side")))
    gap = lambda c: F.abs(number(F.col(c)["at"]) - number(F.col("__t")))
    found = {
        "exact": lambda: F.when(gap("__back") == 0, F.col("__back")), "backward": lambda: F.col("__back"), "forward": lambda: F.col("__fore"),
        "nearest": lambda: F.when(F.col("__back").isNull() | (gap("__fore") <= gap("__back")), F.col("__fore")).otherwise(F.col("__back")),
    }[direction]()
    s = s.where("__side = 1").withColumn("__f", found)
    if tolerance is not None:
        s = s.withColumn("__f", F.when(gap("__f") <= tolerance * scale, F.col("__f")))
    own_columns = [F.col("__t").alias(c) if c == ts else F.col(c) if c == by else F.col("__g")[c].alias(c) for c in grid.columns]
    return s.select(*own_columns, *(F.col("__f.__v")[v].alias(v) for v in values), F.col("__f.at").alias("matched"))
