"""Rule-based backtests: the cross-section in Spark, the path of an account in one ordered walk per account."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_positions(scores: DataFrame, k: int, by: str = "d", code: str = "code") -> DataFrame:
    """(d, code, weight): equal weights of each day's k best scores."""
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), code))
    return scores.where("score is not null").withColumn("__k", best).where(F.col("__k") <= k).select(by, code, (F.lit(1.0) / k).alias("weight"))


def vector_backtest(bars: DataFrame, weights: DataFrame, cost: float = 0.0, code: str = "code", ts: str = "d") -> DataFrame:
    """(d, ret, traded): weights decided at a close earn the next bar's close-to-close return less costs."""
    w = Window.partitionBy(code).orderBy(ts)
    r = bars.select(code, ts, (F.lead("close").over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1).alias("fwd"))
    held = r.join(weights.select(code, ts, "weight"), [code, ts], "left").na.fill(0.0, ["weight"])
    held = held.withColumn("traded", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    return held.groupBy(ts).agg((F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))) - cost * F.sum("traded")).alias("ret"), F.sum("traded").alias("traded"))


def holding_backtest(bars: DataFrame, signals: DataFrame, days: int = 5, cash: float = 1_000_000.0, lot: int = 100, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, d, lots, pnl): buy signals at the next open in whole lots, sell at the close ``days`` bars on."""
    w = Window.partitionBy(code).orderBy(ts)
    b = bars.select(code, ts, F.lead("open").over(w).alias("buy"), F.lead("close", days).over(w).alias("sell"))
    n = signals.groupBy(ts).agg(F.count("*").alias("__n"))
    j = b.join(signals.select(code, ts), [code, ts]).join(n, ts).where("buy is not null and sell is not null")
    lots = F.floor(F.lit(cash) / days / F.col("__n") / F.col("buy") / lot) * lot
    return j.withColumn("lots", lots).select(code, ts, "lots", (F.col("lots") * (F.col("sell") - F.col("buy"))).alias("pnl"))


def accounts(orders: DataFrame, cash: float = 1_000_000.0, rate: float = 0.00025, least: float = 5.0, duty: float = 0.001, account: str = "account", seq: str = "seq") -> DataFrame:
    """orders (account, seq, code, side, price, amount) with status, cash, position and realised profit after each.

    An account's orders depend on each other, so each account is walked in
    order, as a sorted stream that holds its cash and positions alone; Spark
    deals the accounts out.  Buys beyond the cash and sales beyond
    the position are refused.
    """
    columns = {"status": "string", "cash": "double", "position": "double", "avg_price": "double", "realized": "double"}

    def run(batches):
        now = money = held = cost = won = None
        for batch in batches:
            out = []
            for key, code, side, price, amount in zip(*(batch.column(c).to_pylist() for c in (account, "code", "side", "price", "amount"))):
                if held is None or key != now:
                    now, money, held, cost, won = key, cash, {}, {}, 0.0
                worth = price * amount
                fee = max(worth * rate, least) + (worth * duty if side == "SELL" else 0.0)
                have = held.get(code, 0.0)
                if side == "BUY" and worth + fee <= money:
                    cost[code] = (cost.get(code, 0.0) * have + worth) / (have + amount)
                    held[code], money, status = have + amount, money - worth - fee, "FILLED"
                elif side == "SELL" and amount <= have:
                    held[code], money, status = have - amount, money + worth - fee, "FILLED"
                    won += (price - cost[code]) * amount - fee
                else:
                    status = "REJECTED"
                out.append((status, money, held.get(code, 0.0), cost.get(code, 0.0), won))
            if out:
                made = [pa.array(v, pa.string() if k == "string" else pa.float64()) for v, k in zip(zip(*out), columns.values())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns])

    schema = ", ".join([f"`{n}` {t}" for n, t in orders.dtypes] + [f"{n} {t}" for n, t in columns.items()])
    return orders.repartition(account).sortWithinPartitions(account, seq).mapInArrow(run, schema)


def run_accounts(rows: DataFrame, cash: float = 1_000_000.0, lot: float = 100.0, slip: float = 0.0, rate: float = 0.0003, least: float = 0.0, duty: float = 0.001, account: str = "account", ts: str = "d", code: str = "code") -> DataFrame:
    """(account, d, cash, equity, held, bought, sold, fees, refused): the run of each account through its bars.

    rows: account, d, code, open, close, volume, limit_up, limit_down and
    ``weight``, the share of equity that the row's code shall have that day
    (null or 0: none), as decided before.  In order of code, what is no longer
    wanted is sold at the open and what is wanted anew is bought in whole lots
    for weight x the equity at the last closes, as far as cash goes.  Prices
    slip against the account; suspended bars (no volume) do not trade, buys
    are refused at the upper limit and sales at the lower.  Held codes without
    a bar keep their last close.  An account is a parameter set: Spark deals
    accounts out, and each is a sorted stream of days that holds its positions
    and one day's bars alone.  Bars of codes that an account can not hold and
    does not want change nothing; codes are looked at side by side, and only
    the other bars, and one a task for a day to be told, go to the account's stream.
    """
    kinds = dict(rows.dtypes)
    columns = ("cash", "equity", "held", "bought", "sold", "fees", "refused")
    schema = f"`{account}` {kinds[account]}, `{ts}` {kinds[ts]}, " + ", ".join(f"{c} double" for c in columns)

    def day(state, bars):
        held, last, money = state["held"], state["last"], state["cash"]
        equity = money + sum(n * last[c] for c, n in held.items())
        bought = sold = fees = refused = 0.0
        for c, open_, _, volume, _, low, weight in bars:
            if c in held and not weight:
                price = open_ * (1 - slip)
                if volume <= 0 or low and price <= low:
                    refused += 1
                    continue
                worth = held.pop(c) * price
                fee = max(worth * rate, least) + worth * duty
                money, sold, fees = money + worth - fee, sold + worth, fees + fee
        for c, open_, _, volume, high, _, weight in bars:
            if weight and c not in held:
                price = open_ * (1 + slip)
                if volume <= 0 or high and price >= high:
                    refused += 1
                    continue
                n = min(weight * equity, money, money / (1 + rate), money - least) // (price * lot) * lot
                if n > 0:
                    worth = n * price
                    fee = max(worth * rate, least)
                    held[c], money, bought, fees = n, money - worth - fee, bought + worth, fees + fee
        for c, _, close, *_ in bars:
            last[c] = close
        for c in [c for c in last if c not in held]:
            del last[c]
        state["cash"] = money
        return money, money + sum(n * last[c] for c, n in held.items()), float(len(held)), bought, sold, fees, refused

    def run(batches):
        now = when = state = None
        bars: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for who, at, *bar in zip(*(batch.column(c).to_pylist() for c in (account, ts, code, "open", "close", "volume", "limit_up", "limit_down", "weight"))):
                if state is None or who != now or at != when:
                    if bars:
                        out.append((now, when, *day(state, bars)))
                        bars = []
                    if state is None or who != now:
                        state = {"cash": cash, "held": {}, "last": {}}
                    now, when = who, at
                bars.append(tuple(bar))
            if len(out) > 10_000:
                yield to_batch(out)
                out = []
        if bars:
            out.append((now, when, *day(state, bars)))
        if out:
            yield to_batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))

    def to_batch(found):
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), made)], schema=made)

    def telling(batches):
        told = set()
        for batch in batches:
            keep = batch.column("__counts").to_numpy(zero_copy_only=False).copy()
            days = pa.table({"who": batch.column(account), "at": batch.column(ts), "row": pa.array(np.arange(len(keep)))}).group_by(["who", "at"]).aggregate([("row", "min")])
            for who, at, row in zip(*(days.column(c).to_pylist() for c in ("who", "at", "row_min"))):
                if (who, at) not in told:
                    told.add((who, at))
                    keep[row] = True
            yield batch.filter(pa.array(keep))

    wanted = F.coalesce(F.col("weight"), F.lit(0.0)) != 0
    stuck = (F.coalesce(F.col("limit_down"), F.lit(0.0)) != 0) & (F.col("open") * (1 - slip) <= F.col("limit_down"))
    sold = F.coalesce((F.col("volume") > 0) & ~stuck, F.lit(False))  # a held code is surely gone after such a bar, if unwanted
    before = Window.partitionBy(account, code).orderBy(ts, wanted).rowsBetween(Window.unboundedPreceding, -1)
    may_hold = F.coalesce(F.last(F.when(wanted, True).when(sold, False), ignorenulls=True).over(before), F.lit(False))
    used = rows.select(account, ts, code, "open", "close", "volume", "limit_up", "limit_down", "weight")
    counting = used.withColumn("__counts", wanted | may_hold)
    few = counting.mapInArrow(telling, counting.schema).drop("__counts")
    return few.repartition(account).sortWithinPartitions(account, ts, code).mapInArrow(run, schema)


def attention_scores(bars: DataFrame, features: list[str], window: int = 32, weights: list[float] | None = None, temperature: float = 1.0, hidden: int = 8, decay: float = 0.7, code: str = "code", ts: str = "d") -> DataFrame:
    """bars with ``score``: a recurrent state fed by attention over the last ``window`` feature rows.

    A row's heat is the weighted sum of its features times ``temperature``;
    the softmax of the heats mixes the rows, a fixed projection takes the
    mixture to ``hidden`` numbers that decay into each other, and a fixed
    readout sums them.  Null features count 0; no row sees a later one.
    """
    lean = np.array(weights if weights is not None else [1.0] * len(features))
    # Projection and readout.
    projection = np.sin(np.arange(len(features) * hidden).reshape(len(features), hidden) / (len(features) + hidden + 1.0)) * 0.6
    readout = np.linspace(-0.35, 0.35, hidden)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ts)
        x = np.nan_to_num(f[features].to_numpy(float))
        heat = np.clip(x @ lean * temperature, -20, 20)
        state, out = np.zeros(hidden), np.zeros(len(x))
        for i in range(len(x)):
            seen = slice(max(0, i - window + 1), i + 1)
            a = np.exp(heat[seen] - heat[seen].max())
            state = decay * state + (1 - decay) * np.tanh((a / a.sum()) @ x[seen] @ projection)
            out[i] = state @ readout
        return f.assign(score=out)

    return bars.groupBy(code).applyInPandas(run, ", ".join([f"`{n}` {t}" for n, t in bars.dtypes] + ["score double"]))


def history(assets: DataFrame, account: str = "account", ts: str = "d", value: str = "assets") -> DataFrame:
    """Account history with ``ret``, the change of its assets since its row before."""
    before = F.lag(value).over(Window.partitionBy(account).orderBy(ts))
    return assets.withColumn("ret", F.col(value) / F.nullif(before, F.lit(0.0)) - 1)


def ranking(assets: DataFrame, most: int, least_rows: int = 2, account: str = "account", ts: str = "d", value: str = "assets") -> DataFrame:
    """(account, total, months, orders, place): the ``most`` accounts with the largest change from first to last."""
    s = assets.groupBy(account).agg((F.max_by(value, ts) / F.nullif(F.min_by(value, ts), F.lit(0.0)) - 1).alias("total"), F.count("*").alias("months"), F.sum("orders").alias("orders")).where(F.col("months") >= least_rows)
    best = s.orderBy(F.desc("total"), account).limit(most)  # few rows, of which one task numbers the places
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("total"), account)))
