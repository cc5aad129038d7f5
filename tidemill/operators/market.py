"""Market rules and order checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import segment

# Daily limit by segment.
LIMITS = {"main": 0.10, "gem": 0.20, "star": 0.20, "bse": 0.30}


def limit_share(code) -> Column:
    seg = segment(code)
    out = F.lit(LIMITS["main"])
    for name, share in LIMITS.items():
        out = F.when(seg == name, share).otherwise(out)
    return out


def with_limits(bars: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    """prev_close (the open where there is none), limit_up and limit_down (0 without a price before)."""
    w = Window.partitionBy(code).orderBy(ts)
    j = bars.withColumn("prev_close", F.coalesce(F.lag("close").over(w), F.col("open")))
    at = lambda way: F.when(F.col("prev_close") > 0, F.bround(F.col("prev_close") * (1 + way * limit_share(code)), 2)).otherwise(0.0)
    return j.withColumns({"limit_up": at(1), "limit_down": at(-1), "price_range": F.round(F.col("high") - F.col("low"), 8)})


def slippage(price, side, model: str = "fixed", value: float = 0.0, size=None, volume=None) -> Column:
    """Fill price: fixed or percent against the taker, or impact value * (size / volume)^0.6."""
    p, way = F.col(price) if isinstance(price, str) else price, F.when(F.col(side) == "BUY", 1).otherwise(-1)
    if model == "fixed":
        moved = p + way * value
    elif model == "percent":
        moved = p * (1 + way * value)
    elif model == "impact":
        moved = p * (1 + way * value * F.pow(F.col(size) / F.nullif(F.col(volume), F.lit(0.0)), 0.6))
    else:
        raise ValueError(f"unknown slippage model {model}")
    return F.round(moved, 3)


def can_trade(side, fill) -> Column:
    """suspended, limit_up, limit_down or ok for bars with limits."""
    return F.when(F.col("volume") <= 0, "suspended").when((F.col(side) == "BUY") & (fill >= F.col("limit_up")) & (F.col("limit_up") > 0), "limit_up").when((F.col(side) == "SELL") & (fill <= F.col("limit_down")) & (F.col("limit_down") > 0), "limit_down").otherwise("ok")


def impact(value, volume, price, volatility, model: str = "square_root", k: float = 0.1, part: float = 0.15, gamma: float = 0.05, eta: float = 0.1) -> Column:
    """Expected cost of a trade per share, at most 5% of the price; ``part`` is the largest share of volume that is thought viable."""
    share = F.least(F.col(value) / F.greatest(F.col(volume) * F.col(price), F.lit(1.0)), F.lit(1.0))
    cost = {
        "none": F.lit(0.0), "square_root": k * F.col(volatility) * F.sqrt(share / part), "linear": k * F.col(volatility) * share,
        "almgren_chriss": F.col(volatility) * (gamma + eta * F.sqrt(share / 0.01)),
    }[model]
    bounded = F.least(F.greatest(cost * part * F.col(price), F.lit(0.0)), 0.05 * F.col(price))
    return F.when((F.col(volume) > 0) & (F.col(value) > 0), bounded).otherwise(0.0)


def walked_impact(bars, total_bars, temporary: float = 0.0002) -> Column:
    """Temporary impact left when an order is worked over ``bars`` of ``total_bars`` bars."""
    return F.when(F.col(total_bars) <= 1, temporary * 0.5).otherwise(temporary * (0.5 + 0.5 / F.greatest(F.col(bars), F.lit(1))))


def in_windows(ts, windows: list[tuple[str, str]]) -> Column:
    """Whether a time of day lies in one of the closed windows (HH:mm, HH:mm); without windows it does."""
    clock = F.date_format(ts, "HH:mm:ss.SSSSSS")
    out = F.lit(not windows)
    for a, b in windows:
        out = out | clock.between(f"{a}:00.000000", f"{b}:00.000000")
    return out


def suspensions(bars: DataFrame, calendar: DataFrame, by: str = "code", ts: str = "d") -> DataFrame:
    """(code, d, reason): trade days in a code's life without a bar (missing) or with one of no volume (no_volume).

    A life begins and ends with a bar on a trade day.  Days without a bar are
    spelled out between two bars that follow each other, as they are told, so
    no task holds or moves the days of all lives.
    """
    at = F.broadcast(calendar.select(F.col("d").alias("__t"), F.col("idx").cast("long").alias("__at")))
    next_ = F.lead("__at").over(Window.partitionBy(by).orderBy("__at"))
    placed = bars.select(by, F.col(ts).alias("__t"), "volume").join(at, "__t").withColumn("__next", next_)
    own = F.when(F.col("volume").isNull(), "missing").when(F.col("volume") == 0, "no_volume")
    gap = F.when(F.col("__next") > F.col("__at") + 1, F.sequence(F.col("__at") + 1, F.col("__next") - 1))
    # position 0 of what a bar tells is its own day, the rest are the days behind it
    days = placed.where(own.isNotNull() | gap.isNotNull()).select(by, own.alias("reason"), F.posexplode(F.concat(F.array("__at"), F.coalesce(gap, F.array().cast("array<bigint>")))).alias("__k", "__at"))
    told = days.select(by, "__at", F.when(F.col("__k") > 0, "missing").otherwise(F.col("reason")).alias("reason")).where("reason is not null")
    return told.join(at, "__at").select(by, F.col("__t").alias(ts), "reason")


def pending(orders: DataFrame, done=("FILLED", "CANCELLED", "REJECTED"), status: str = "status") -> DataFrame:
    """Orders that still wait; a null status waits."""
    return orders.where(F.col(status).isNull() | ~F.col(status).isin(*done))


def settled(positions: DataFrame) -> DataFrame:
    """Positions (.., held_before, held_today, frozen) after the day's settlement: today's become earlier ones, nothing is frozen."""
    return positions.withColumns({"held_before": F.col("held_before") + F.col("held_today"), "held_today": F.lit(0.0), "frozen": F.lit(0.0)})


def commission(price, amount, rate: float = 0.00025, least: float = 5.0, duty: float = 0.001, side: str = "side") -> Column:
    """Broker fee of at least ``least``, and stamp duty on sales."""
    worth = F.col(price) * F.col(amount)
    return F.greatest(worth * rate, F.lit(least)) + F.when(F.col(side) == "SELL", worth * duty).otherwise(0.0)


def check_orders(orders: DataFrame, most_value: float, most_daily: int, most_weight: float, seq: str = "seq", account: str = "account", day: str = "d") -> DataFrame:
    """orders with ``verdict``: halted, order_value, daily_trades, position_weight or ok, by the first rule broken.

    A halt in an account holds for all of its later orders.
    """
    w = Window.partitionBy(account).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    daily = F.row_number().over(Window.partitionBy(account, day).orderBy(seq))
    value = F.col("price") * F.col("amount")
    return orders.withColumn("verdict", F.when(F.max("halted").over(w) == 1, "halted").when(value > most_value, "order_value").when(daily > most_daily, "daily_trades").when(value > most_weight * F.col("equity"), "position_weight").otherwise("ok"))


def account_equity(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """(account, equity): cash and quantities at the last price, or at cost where there is none."""
    last = prices.select(F.col("code").alias("__c"), F.col("price").alias("__p"))
    j = positions.join(last, F.col("code") == F.col("__c"), "left")
    return j.groupBy("account").agg((F.first("cash") + F.sum(F.col("quantity") * F.coalesce("__p", "avg_price"))).alias("equity"))


def regime(signals: DataFrame, by: str = "d", breadth: float = 0.5, event: float = 0.0, volume: float = 0.0, score: float = 0.0) -> DataFrame:
    """(by, breadth, event, activity, score, gate) of rows (by, signal, event, active, volume_score).

    breadth: share of rising signals; event and volume: means of what is above
    0; activity: share of active rows.  score weighs what lies above the
    thresholds; the gate is open if each threshold is met and a fifth is active.
    """
    above = lambda c: F.avg(F.greatest(F.col(c), F.lit(0.0)))
    s = signals.groupBy(by).agg(F.avg((F.col("signal") > 0).cast("double")).alias("breadth"), above("event").alias("event"), above("volume_score").alias("volume"), F.avg(F.col("active").cast("double")).alias("activity"))
    over = lambda c, bound: F.greatest(F.col(c) - bound, F.lit(0.0))
    s = s.withColumn("score", over("breadth", breadth) * 0.7 + over("event", event) * 0.9 + over("volume", volume) * 0.5 + F.col("activity") * 0.15)
    met = (F.col("breadth") >= breadth) & (F.col("event") >= event) & (F.col("volume") >= volume)
    return s.withColumn("gate", met & (F.col("activity") >= 0.2) & (F.col("score") >= score))


def cross_section_z(rows: DataFrame, x: str, by: str = "d") -> DataFrame:
    """x_z: population z-score within a day, 0 without spread."""
    w = Window.partitionBy(by)
    spread = F.stddev_pop(x).over(w)
    return rows.withColumn(f"{x}_z", F.when(spread > 1e-9, (F.col(x) - F.avg(x).over(w)) / spread).otherwise(0.0))


def softmax_weights(rows: DataFrame, x: str, temperature: float = 1.0, cap: float = 1.0, by: str = "d") -> DataFrame:
    """weight: softmax of x within a day, capped."""
    w = Window.partitionBy(by)
    e = F.exp((F.col(x) - F.max(x).over(w)) / temperature)
    return rows.withColumn("__e", e).withColumn("weight", F.least(F.col("__e") / F.sum("__e").over(w), F.lit(cap))).drop("__e")
