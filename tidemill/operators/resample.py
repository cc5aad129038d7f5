"""Time buckets: ticks to bars, bars to longer bars, days to weeks, months, quarters, years.

Everything is one shuffle on (code, bucket), with partial aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trading sessions as (first minute, last minute) of the day.
DAY_SESSIONS = ((570, 690), (780, 900))
FUTURES_SESSIONS = ((0, 690), (810, 900), (1260, 1439))


def _seconds(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def _time(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def bucket(ts, minutes: int, closed: str = "left", label: str | None = None, origin_minutes: int = 0) -> Column:
    """Bucket of a time; labelled by its closed edge unless told otherwise.

    Origin: minutes after midnight from which buckets count.
    """
    n, off = minutes * 60, origin_minutes * 60
    x = (_seconds(ts) - off) / n
    left = F.floor(x) if closed == "left" else F.ceil(x) - 1
    return _time((left + (1 if (label or closed) == "right" else 0)) * n + off)


def in_sessions(ts, sessions=DAY_SESSIONS) -> Column:
    """Number of the session that holds a time (right-closed), null outside of all."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    minute = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(sessions))):
        out = F.when((minute > a) & (minute <= b), k).otherwise(out)
    return out


def _ohlc(order: str | Column, extra: list[Column]) -> list[Column]:
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), *extra]


def bars_from_ticks(ticks: DataFrame, minutes: int, closed: str = "left", label: str | None = None, code: str = "code", lot: float = 1.0) -> DataFrame:
    """(code, ts, open, high, low, close, volume, amount) of ticks (code, ts, tick_id, price, vol)."""
    order = F.struct("ts", "tick_id")
    t = ticks.withColumn("__b", bucket("ts", minutes, closed, label))
    return t.groupBy(code, F.col("__b").alias("b")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        (F.sum("vol") * lot).alias("volume"), F.sum(F.col("price") * F.col("vol")).alias("amount"),
    ).withColumnRenamed("b", "ts")


def auction_merged(ticks: DataFrame, minutes: int = 1, code: str = "code") -> DataFrame:
    """Minute bars of a session day: right-labelled, the 9:25 auction counted into the 9:31 bar."""
    start = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    minute = F.hour("ts") * 60 + F.minute("ts")
    moved = ticks.withColumn("ts", F.when((minute >= 555) & (minute < 570), start + F.expr("interval 570 minutes")).otherwise(F.col("ts")))
    kept = moved.withColumn("__m", F.hour("ts") * 60 + F.minute("ts")).where(" or ".join(f"(__m between {a} and {b})" for a, b in DAY_SESSIONS))
    return bars_from_ticks(kept, minutes, "left", "right", code)


def bars_from_cumulative(ticks: DataFrame, minutes: int, code: str = "code", day: str = "trading_day") -> DataFrame:
    """Bars of ticks whose vol counts up over the trading day."""
    from pyspark.sql import Window

    w = Window.partitionBy(code, day).orderBy("ts", "tick_id")
    step = F.col("vol") - F.coalesce(F.lag("vol").over(w), F.lit(0.0))
    return bars_from_ticks(ticks.withColumn("vol", step), minutes, code=code)


def minutes(bars: DataFrame, n: int, closed: str = "right", label: str | None = None, sessions=None, code: str = "code") -> DataFrame:
    """n-minute bars of shorter ones; with sessions, buckets start at each session and never cross it."""
    t = bars
    if sessions is None:
        t = t.withColumn("__b", bucket("ts", n, closed, label)).withColumn("__s", F.lit(0))
    else:
        t = t.withColumn("__s", in_sessions("ts", sessions)).where("__s is not null")
        origin = F.element_at(F.array(*(F.lit(a) for a, _ in sessions)), F.col("__s") + 1) * 60
        day = _seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
        x = (_seconds("ts") - day - origin) / (n * 60)
        left = F.floor(x) if closed == "left" else F.ceil(x) - 1
        t = t.withColumn("__b", _time(day + origin + (left + (1 if (label or closed) == "right" else 0)) * n * 60))
    sums = [F.sum(c).alias(c) for c in ("volume", "amount", "trade") if c in bars.columns]
    lasts = [F.max_by(c, "ts").alias(c) for c in ("position", "tradetime") if c in bars.columns]
    return t.groupBy(code, "__s", F.col("__b").alias("bucket")).agg(*_ohlc("ts", sums + lasts)).drop("__s").withColumnRenamed("bucket", "ts")


def to_day(bars: DataFrame, code: str = "code") -> DataFrame:
    """Day bars of intraday ones; midnight belongs to the day that ends."""
    t = bars.withColumn("__d", F.to_date(F.col("ts") - F.expr("interval 1 microsecond")))
    return t.groupBy(code, F.col("__d").alias("d")).agg(*_ohlc("ts", [F.sum("volume").alias("volume"), F.sum("amount").alias("amount")]))


def by_trading_date(bars: DataFrame, tradetime: str = "tradetime", code: str = "code") -> DataFrame:
    """Day bars by the trading date that starts the tradetime text."""
    t = bars.withColumn("__d", F.to_date(F.substring(tradetime, 1, 10)))
    return t.groupBy(code, F.col("__d").alias("d")).agg(*_ohlc("ts", [F.sum("volume").alias("volume"), F.sum("amount").alias("amount")]))


def days(bars: DataFrame, unit: str, code: str = "code") -> DataFrame:
    """Week, month, quarter or year bars of day bars; d is the last trading day in each."""
    name = {"w": "week", "M": "month", "Q": "quarter", "Y": "year"}.get(unit, unit)
    t = bars.withColumn("__p", F.to_date(F.date_trunc(name, "d")))
    sums = [F.sum(c).alias(c) for c in ("volume", "amount", "position") if c in bars.columns]
    return t.groupBy(code, F.col("__p").alias("period")).agg(*_ohlc("d", [F.max("d").alias("d"), *sums]))


def month_ends(values: DataFrame, x: str, by: str, d: str = "d") -> DataFrame:
    """(by, month, x, profit): last value of each month and its change, the first from the first value."""
    from pyspark.sql import Window

    m = values.groupBy(by, F.to_date(F.date_trunc("month", d)).alias("month")).agg(F.max_by(x, d).alias(x), F.min_by(x, d).alias("__first"))
    w = Window.partitionBy(by).orderBy("month")
    return m.withColumn("profit", F.col(x) - F.coalesce(F.lag(x).over(w), F.col("__first"))).drop("__first")
