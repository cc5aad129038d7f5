"""Dates, trade calendars and codes as columns and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_days(days: DataFrame, d: str = "d") -> DataFrame:
    """(d, idx): distinct days with their positions from 0.

    Years are numbered apart, then shifted by the counts of the years before,
    so no task orders more than a year.
    """
    days = days.select(F.col(d).alias("d")).where("d is not null").distinct().withColumn("y", F.year("d"))
    years = days.groupBy("y").agg(F.count("*").alias("n"))
    before = years.alias("a").join(years.alias("b"), F.col("b.y") < F.col("a.y"), "left").groupBy(F.col("a.y").alias("y")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    inner = Window.partitionBy("y").orderBy("d")
    return days.withColumn("k", F.row_number().over(inner) - 1).join(F.broadcast(before), "y").select("d", (F.col("k") + F.col("before")).cast("long").alias("idx"))


def shift_days(dates: DataFrame, calendar: DataFrame, n: int, d: str = "d") -> DataFrame:
    """``dates`` with ``shifted``: the trade day n positions on; a day off is first snapped back (n >= 0) or forward."""
    snapped = snap(dates, calendar, d, "back" if n >= 0 else "forward")
    at = calendar.select(F.col("d").alias("__d"), F.col("idx").alias("__idx"))
    to = calendar.select(F.col("d").alias("shifted"), F.col("idx").alias("__to"))
    return snapped.join(at, F.col("snapped") == F.col("__d"), "left").join(to, F.col("__to") == F.col("__idx") + n, "left").drop("__d", "__idx", "__to", "snapped")


def snap(dates: DataFrame, calendar: DataFrame, d: str = "d", towards: str = "back") -> DataFrame:
    """``dates`` with ``snapped``: the nearest trade day at or before (after) each date."""
    both = dates.select(F.col(d).alias("__at")).distinct().withColumn("__day", F.lit(None).cast("date")).union(calendar.select("d", "d").toDF("__at", "__day"))
    w = Window.partitionBy(F.year("__at")).orderBy("__at")
    back = towards == "back"
    w = w.rangeBetween(Window.unboundedPreceding, 0) if back else w.rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumn("snapped", (F.max if back else F.min)("__day").over(w))
    edges = calendar.groupBy(F.year("d").alias("__y")).agg((F.max if back else F.min)("d").alias("__edge"))
    found = near.where("__day is null").select("__at", "snapped").distinct()
    other = found.alias("f").join(F.broadcast(edges), F.col("__y") < F.year("__at") if back else F.col("__y") > F.year("__at"), "left")
    found = other.groupBy("__at", "snapped").agg((F.max if back else F.min)("__edge").alias("__edge")).select("__at", F.coalesce("snapped", "__edge").alias("snapped"))
    return dates.join(found, dates[d] == F.col("__at"), "left").drop("__at")


def gap(pairs: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """``pairs`` with ``days``: trade days from start to end, both counted."""
    a = calendar.select(F.col("d").alias("__a"), F.col("idx").alias("__i"))
    b = calendar.select(F.col("d").alias("__b"), F.col("idx").alias("__j"))
    return pairs.join(a, F.col(start) == F.col("__a"), "left").join(b, F.col(end) == F.col("__b"), "left").withColumn("days", F.col("__j") - F.col("__i") + 1).drop("__a", "__b", "__i", "__j")


def date_to_int(d) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def int_to_date(i) -> Column:
    return F.to_date(F.col(i).cast("string") if isinstance(i, str) else i.cast("string"), "yyyyMMdd")


def epoch_to_timestamp(x) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970, told apart by size."""
    x = F.col(x) if isinstance(x, str) else x
    micros = F.when(x < 10**11, x * 1_000_000).when(x < 10**14, x * 1000).when(x < 10**17, x).otherwise(F.floor(x / 1000))
    return F.timestamp_micros(micros.cast("long"))


def is_date(text) -> Column:
    """Whether a string is a date yyyy-MM-dd."""
    return F.coalesce(F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def hours_between(ts, gt=None, lt=None, gte=None, lte=None, unit=F.hour) -> Column:
    """Conjunction of bounds on the hour (or ``unit=F.minute``) of a time."""
    part = unit(ts)
    tests = [t for t, on in ((lambda: part > gt, gt), (lambda: part < lt, lt), (lambda: part >= gte, gte), (lambda: part <= lte, lte)) if on is not None]
    if not tests:
        raise ValueError("give at least one bound")
    out = tests[0]()
    for t in tests[1:]:
        out = out & t()
    return out


def next_period(ts, unit: str) -> Column:
    """Start of the period after ts: minutes (1min .. 60min), D, W, M, Q or Y."""
    names = {"D": ("day", "1 day"), "W": ("week", "7 days"), "M": ("month", "1 month"), "Q": ("quarter", "3 months"), "Y": ("year", "1 year")}
    if unit in names:
        trunc, step = names[unit]
        return (F.date_trunc(trunc, ts) + F.expr(f"interval {step}")).cast("timestamp_ntz")
    n = int(unit.removesuffix("min")) * 60
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
    return F.timestamp_seconds((F.floor(seconds / n) + 1) * n).cast("timestamp_ntz")


def months_between_days(first, last) -> Column:
    """Array of (start, end) of the months from one day to another."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(m.alias("start"), F.last_day(m).alias("end")))


def quarters_between_days(first, last) -> Column:
    quarters = F.sequence(F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("interval 3 months"))
    return F.transform(quarters, lambda q: F.struct(q.alias("start"), F.last_day(F.add_months(q, 2)).alias("end")))


def code_text(code) -> Column:
    """Six-digit code from an integer or one of the usual vendor spellings."""
    c = (F.col(code) if isinstance(code, str) else code).cast("string")
    return F.when(F.length(c) <= 6, F.lpad(c, 6, "0")).when(F.length(c) == 8, F.substring(c, -6, 6)).when(F.length(c) == 9, F.substring(c, 1, 6)).when(F.length(c) == 11, F.substring(c, 1, 6))


def with_exchange(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.concat(c, F.when(c.startswith("6"), F.lit(".XSHG")).otherwise(F.lit(".XSHE")))


def segment(code) -> Column:
    """Market segment by prefix."""
    c = F.col(code) if isinstance(code, str) else code
    starts = lambda *p: F.substring(c, 1, len(p[0])).isin(*p)
    return F.when(starts("688", "689"), "star").when(starts("300", "301"), "gem").when(starts("8") | starts("43"), "bse").otherwise("main")


# Code prefixes of the two exchanges.
SHANGHAI_STOCK = ("6",)
SHANGHAI_INDEX = ("000", "880")
SHANGHAI_FUND = ("51", "58")
SHANGHAI_BOND = ("102", "110", "113", "120", "122", "124", "130", "132", "133", "134", "135", "136", "140", "141", "143", "144", "147", "148")
SHENZHEN_STOCK = ("00", "30", "02")
SHENZHEN_INDEX = ("39",)
SHENZHEN_FUND = ("15", "16")
SHENZHEN_BOND = ("101", "104", "105", "106", "107", "108", "109", "111", "112", "114", "115", "116", "117", "118", "119", "123", "127", "128", "131", "139")
SHENZHEN_B = ("20",)


def security_kind(code, shanghai: bool) -> Column:
    """Kind of security on one exchange, by prefix."""
    c = F.col(code) if isinstance(code, str) else code
    rules = [("stock_cn", SHANGHAI_STOCK), ("index_cn", SHANGHAI_INDEX), ("etf_cn", SHANGHAI_FUND), ("bond_cn", SHANGHAI_BOND)]
    if not shanghai:
        rules = [("stock_cn", SHENZHEN_STOCK), ("index_cn", SHENZHEN_INDEX), ("etf_cn", SHENZHEN_FUND), ("bond_cn", SHENZHEN_BOND), ("stockB_cn", SHENZHEN_B)]
    out = F.lit("undefined")
    for kind, prefixes in reversed(rules):
        out = F.when(F.substring(c, 1, len(prefixes[0])).isin(*prefixes), kind).otherwise(out)
    return out


def direction(order) -> Column:
    """(side, offset) of a signed order direction."""
    o = F.col(order) if isinstance(order, str) else order
    offset = F.when(o.isin(1, 2, -2), "OPEN").when(o.isin(-1, 3, -3), "CLOSE").when(o.isin(4, -4), "CLOSETODAY")
    return F.struct(F.when(o > 0, "BUY").otherwise("SELL").alias("side"), offset.alias("offset"))


def cache_key(*parts) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
