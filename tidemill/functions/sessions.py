"""Times of trading sessions: which day a time belongs to, and the bars a day is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dates import number_days, shift_days, snap

EPOCH = "timestamp_ntz'1970-01-01'"
#: Morning and afternoon of a stock exchange, and a future's night session, as minutes of the day.
STOCK = ((570, 690), (780, 900))
FUTURE = ((540, 615), (630, 690), (810, 900), (1260, 1380))
CLOSE, NIGHT = 900, 1260


def epoch(ts, unit: str = "SECOND") -> Column:
    """Seconds (or milliseconds, ..) from 1970 to a time without zone; the session's zone plays no part."""
    return F.timestamp_diff(unit, F.expr(EPOCH), F.col(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts.cast("timestamp_ntz"))


def from_epoch(n, unit: str = "SECOND") -> Column:
    return F.timestamp_add(unit, F.col(n) if isinstance(n, str) else n, F.expr(EPOCH))


def minute_of_day(ts) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def trade_days(times: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """``times`` with trade_day (this day before the close of a trade day, else the next), order_day (else the one before) and
    future_day (a night session counts to the next trade day).

    Days of ``calendar`` (d, idx) alone are joined, each once.
    """
    days = times.select(F.to_date(ts).alias("__day0")).distinct()
    near = shift_days(days, calendar, 1, "__day0").withColumnRenamed("shifted", "__next")
    near = snap(shift_days(near, calendar, -1, "__day0"), calendar, "__day0")
    near = near.join(calendar.select(F.col("d").alias("__t")), F.col("__day0") == F.col("__t"), "left")
    near = near.withColumn("__before", F.when(F.col("__t").isNotNull(), F.col("shifted")).otherwise(F.col("snapped"))).drop("shifted", "snapped")
    open_ = F.col("__t").isNotNull()
    joined = times.join(near, F.to_date(ts) == F.col("__day0"))
    early, night = minute_of_day(ts) < CLOSE, minute_of_day(ts) >= NIGHT
    return joined.withColumns({
        "trade_day": F.when(open_ & early, F.col("__day0")).otherwise(F.col("__next")), "order_day": F.when(open_ & early, F.col("__day0")).otherwise(F.col("__before")),
        "future_day": F.when(night, F.col("__next")).otherwise(F.col("__day0")),
    }).drop("__day0", "__next", "__before", "__t")


def session_index(days: DataFrame, minutes: int, sessions=STOCK, d: str = "d") -> DataFrame:
    """(d, ts): ends of the bars of ``minutes`` in each session of each day, right-closed."""
    ends = [m for a, b in sessions for m in range(a + minutes, b + 1, minutes)]
    at = F.explode(F.array(*(F.lit(m) for m in ends)))
    return days.select(d, at.alias("__m")).select(d, F.timestamp_add("MINUTE", F.col("__m"), F.col(d).cast("timestamp_ntz")).alias("ts"))


def first_trading_day(bars: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    return bars.groupBy(code).agg(F.min(ts).alias("first_day"))


def aligned(accounts: DataFrame, account: str, ts: str, value: str) -> DataFrame:
    """(ts, account, value): every account at every day that any has, from its first on, its last value carried on.

    Days are numbered and each account's numbers spelled out, so all joins are on equality.
    """
    days = number_days(accounts, ts).select(F.col("d").alias("__t"), F.col("idx").alias("__i"))
    whole = days.agg(F.max("__i").alias("__last"))
    have = accounts.join(days, F.col(ts) == F.col("__t")).select(account, F.col("__i"), value)
    lives = have.groupBy(account).agg(F.min("__i").alias("__from")).join(F.broadcast(whole))  # one row
    grid = lives.select(account, F.explode(F.sequence("__from", "__last")).alias("__i"))
    full = grid.join(have, [account, "__i"], "left").join(days, "__i").select(F.col("__t").alias(ts), account, value)
    order = Window.partitionBy(account).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn(value, F.last(value, ignorenulls=True).over(order))
