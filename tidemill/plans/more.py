"""Registered queries of fetching, times, streams and reports, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, sessions as N
from ..functions.series import exact_sum
from ..operators import backtest, factors as Q, market as M
from ..sources import catalog as C, tables as D
from ..streaming import streams as Z
from . import oracles as O
from .queries import BARS, CAL, FACTOR, MONTHS, PER, TICKS, TRADES, factor_rows, lag, over, query, rounded

# ---- fetching -----------------------------------------------------------------------------------


@query("fetch_day", f"WITH {BARS} SELECT code, d, open, high, low, close, volume FROM bars WHERE code = '5-LOW' AND d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def _(spark, sf):
    return C.fetch(D.day_bars(spark, sf), "5-LOW", "1997-01-01", "1997-06-30", ["code", "d", "open", "high", "low", "close", "volume"])


HOURS = "hours AS (SELECT code, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, (ts, tick_id)) AS open, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"


@query("fetch_minute", f"WITH {TICKS}, {HOURS}, s AS (SELECT min(ts) + INTERVAL 2 DAY AS a FROM hours) SELECT code, ts, open, close, volume FROM hours, s WHERE code IN ('view', 'click') AND ts >= a")
def _(spark, sf):
    b = D.hour_bars(spark, sf)
    start = b.agg(F.min("ts") + F.expr("interval 2 days")).first()[0]
    return C.fetch(b, ["view", "click"], start, None, ["code", "ts", "open", "close", "volume"], ts="ts")


@query("fetch_minute_close", f"WITH {TICKS}, {HOURS} SELECT code, max(ts) AS ts, arg_max(close, ts) AS close FROM hours GROUP BY 1")
def _(spark, sf):
    return C.fetch(D.hour_bars(spark, sf), columns=["code", "ts", "close"], ts="ts", only_last=True)


@query("fetch_tick", f"WITH {TICKS}, s AS (SELECT min(ts) + INTERVAL 1 DAY AS b FROM ticks) SELECT code, ts, tick_id, price FROM ticks, s WHERE code = 'purchase' AND ts <= b")
def _(spark, sf):
    t = D.ticks(spark, sf)
    end = t.agg(F.min("ts") + F.expr("interval 1 day")).first()[0]
    return C.fetch(t, "purchase", None, end, ["code", "ts", "tick_id", "price"], ts="ts")


@query("fetch_transactions", f"WITH {TRADES} SELECT code, d, price, volume, side FROM trades WHERE code IN (3, 5) AND d >= DATE '1998-01-01'")
def _(spark, sf):
    return C.fetch(D.trades(spark, sf), [3, 5], "1998-01-01", None, ["code", "d", "price", "volume", "side"])


@query("fetch_list", f"WITH {BARS} SELECT code, min(d) AS first, max(d) AS last, count(*) AS n FROM bars GROUP BY 1")
def _(spark, sf):
    return C.listings(D.day_bars(spark, sf))


@query("fetch_to_market", f"WITH {TRADES} SELECT code, min(d) AS first_day FROM trades GROUP BY 1")
def _(spark, sf):
    return N.first_trading_day(D.trades(spark, sf))


@query("fetch_terminated", "WITH t AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT code, min(d) AS first, max(d) AS last, count(*) AS n FROM t GROUP BY 1 HAVING max(d) < DATE '2000-06-01'")
def _(spark, sf):
    t = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("d"))
    return C.terminated(t, "2000-06-01")


@query("fetch_names", "SELECT n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey IN (1, 5, 9)")
def _(spark, sf):
    return C.names(D.table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "code", "n_name": "name"}), [1, 5, 9])


@query("fetch_info", "SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    t = lambda n: D.table(spark, sf, n)
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("area"))


@query("fetch_blocks", "SELECT DISTINCT l_partkey AS block, l_suppkey AS code FROM lineitem WHERE l_suppkey IN (1, 2)")
def _(spark, sf):
    return C.fetch(D.membership(spark, sf), [1, 2], columns=["block", "code"])


@query("fetch_index_weight", f"WITH {TRADES}, m AS (SELECT side AS index, code, sum(amount) AS a FROM trades GROUP BY 1, 2) SELECT index, code, round(a / sum(a) OVER (PARTITION BY index), 6) AS weight FROM m")
def _(spark, sf):
    return rounded(C.weights(D.trades(spark, sf).withColumnRenamed("side", "index"), "amount"), digits=6)


@query("fetch_reports", f"WITH {TRADES} SELECT code, CAST(last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period, round(sum(amount), 2) AS total, count(*) AS n FROM trades GROUP BY 1, 2")
def _(spark, sf):
    return rounded(C.reports(D.trades(spark, sf), "amount"), digits=2)


@query("fetch_report_calendar", f"WITH {TRADES} SELECT DISTINCT code, CAST(last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period FROM trades WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def _(spark, sf):
    return C.reports(C.fetch(D.trades(spark, sf), None, "1998-01-01", "1998-12-31"), "amount").select("code", "period")


@query("fetch_yields", f"WITH {BARS}, v AS (SELECT code, CAST(date_trunc('year', d) AS DATE) + 180 AS d, round(avg(volume), 2) AS dividend FROM bars GROUP BY 1, 2) SELECT v.code, v.d, round(dividend / nullif(b.close, 0), 6) AS yield FROM v ASOF LEFT JOIN bars b ON v.code = b.code AND v.d >= b.d")
def _(spark, sf):
    b = D.day_bars(spark, sf)
    v = b.groupBy("code", F.date_add(F.trunc("d", "year"), 180).alias("d")).agg(F.round(F.avg("volume"), 2).alias("dividend"))
    return rounded(C.yields(v, b.select("code", "d", "close")), "code", "d", "yield", digits=6)


@query("fetch_top_list", f"WITH {BARS}, k AS (SELECT code, d, amount, row_number() OVER (PARTITION BY d ORDER BY (high - low) / low DESC, code) AS k FROM bars) SELECT code, d, amount FROM k WHERE k <= 2")
def _(spark, sf):
    b = D.day_bars(spark, sf).withColumn("amplitude", (F.col("high") - F.col("low")) / F.col("low"))
    best = b.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("amplitude"), "code")))
    return best.where("k <= 2").select("code", "d", "amount")


@query("fetch_trade_date", f"WITH {CAL} SELECT d FROM cal WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(spark, sf):
    return D.calendar(spark, sf).where(F.col("d").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("d")


# ---- times --------------------------------------------------------------------------------------


@query("time_forms", """SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS day_number, strftime(ts, '%Y-%m-%d') AS day_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text, strftime(ts, '%H:%M:%S') AS clock, CAST(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS DATE) AS day,
  CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_stamp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time_stamp, epoch_us(ts) // 1000 AS ms_stamp, date_trunc('second', ts) AS back_from_seconds, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000000 AS ns_stamp,
  hour(ts) > 9 AND hour(ts) <= 15 AS in_hours, minute(ts) >= 30 AND minute(ts) < 45 AS in_minutes, CAST(date_trunc('quarter', ts) AS DATE) AS quarter_start, CAST(last_day(CAST(date_trunc('quarter', ts) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
  regexp_matches(strftime(ts, '%Y-%m-%d'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS valid, false AS invalid, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute FROM events""")
def _(spark, sf):
    e = D.table(spark, sf, "events").withColumn("text", F.date_format("ts", "yyyy-MM-dd")).withColumn("wrong", F.concat("text", F.lit("x")))
    number, seconds = dates.date_to_int("ts"), N.epoch(F.date_trunc("second", "ts"))
    return e.select(
        "event_id", number.alias("day_number"), F.date_format("ts", "yyyy-MM-dd").alias("day_text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_text"), F.date_format("ts", "HH:mm:ss").alias("clock"), dates.int_to_date(number).alias("day"),
        N.epoch(F.date_trunc("day", "ts")).alias("day_stamp"), seconds.alias("time_stamp"), N.epoch("ts", "MILLISECOND").alias("ms_stamp"), N.from_epoch(seconds).alias("back_from_seconds"), (seconds * 1_000_000_000).alias("ns_stamp"),
        dates.hours_between("ts", gt=9, lte=15).alias("in_hours"), dates.hours_between("ts", gte=30, lt=45, unit=F.minute).alias("in_minutes"), F.trunc("ts", "quarter").alias("quarter_start"), F.last_day(F.add_months(F.trunc("ts", "quarter"), 2)).alias("quarter_end"),
        dates.is_date("text").alias("valid"), dates.is_date("wrong").alias("invalid"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"),
    )


@query("trade_times", f"""WITH {CAL}, e AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_custkey % 24) + to_days(CAST(o_custkey % 3 AS INT)) AS ts FROM orders), e2 AS (SELECT *, CAST(ts AS DATE) AS d FROM e), u AS (SELECT d, exists(SELECT 1 FROM cal c WHERE c.d = x.d) AS open, (SELECT min(c.d) FROM cal c WHERE c.d > x.d) AS nxt, (SELECT max(c.d) FROM cal c WHERE c.d < x.d) AS prv FROM (SELECT DISTINCT d FROM e2) x)
SELECT event_id, CASE WHEN open AND hour(ts) < 15 THEN d ELSE nxt END AS trade_day, CASE WHEN open AND hour(ts) < 15 THEN d ELSE prv END AS order_day, CASE WHEN hour(ts) >= 21 THEN nxt ELSE d END AS future_day FROM e2 JOIN u USING (d)""")
def _(spark, sf):
    hours = F.col("o_custkey") % 24 + 24 * (F.col("o_custkey") % 3)
    times = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.timestamp_add("HOUR", hours, F.col("o_orderdate").cast("timestamp_ntz")).alias("ts"))
    return N.trade_days(times, D.calendar(spark, sf)).select("event_id", "trade_day", "order_day", "future_day")


def _index_sql(minutes, parts):
    ends = ", ".join(f"({m})" for a, b in parts for m in range(a + minutes, b + 1, minutes))
    return f"WITH {CAL} SELECT d, CAST(d AS TIMESTAMP) + to_minutes(m) AS ts FROM cal, (VALUES {ends}) v(m)"


for _name, _minutes, _parts in (("minute_index", 30, N.STOCK), ("hour_index", 60, N.STOCK), ("future_index", 15, N.FUTURE)):
    query(_name, _index_sql(_minutes, _parts))(lambda spark, sf, m=_minutes, p=_parts: N.session_index(D.calendar(spark, sf).select("d"), m, p))


@query("accounts_aligned", """WITH a AS (SELECT o_custkey AS account, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT DISTINCT d FROM a), n AS (SELECT account, min(d) AS f FROM a GROUP BY 1), g AS (SELECT t.d, n.account FROM t JOIN n ON t.d >= f)
SELECT g.d, g.account, last_value(a.v IGNORE NULLS) OVER (PARTITION BY g.account ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM g LEFT JOIN a ON a.account = g.account AND a.d = g.d""")
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    return N.aligned(o.groupBy(F.col("o_custkey").alias("account"), F.trunc("o_orderdate", "month").alias("d")).agg(F.max("o_totalprice").alias("v")), "account", "d", "v")


# ---- streams: run over what is there, checked against the same rows as a batch ------------------


def _events(spark, sf):
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")  # a pattern, as a table may be one file
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark):
    from tempfile import mkdtemp

    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(mkdtemp(prefix="spark-"))


def _ran(spark, stream, mode="complete"):
    _folder(spark)
    return Z.available_rows(stream, mode)


@query("stream_bars", "SELECT event_type AS code, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return _ran(spark, Z.micro_bars(_events(spark, sf), 3600)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_counts", "SELECT event_type AS code, time_bucket(INTERVAL 30 SECOND, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return _ran(spark, Z.tick_counts(_events(spark, sf), 30)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_latest", "SELECT event_type AS code, arg_max(value, (ts, event_id)) AS price, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, sf):
    return _ran(spark, Z.latest_price(_events(spark, sf))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, i""")
def _(spark, sf):
    s = _ran(spark, Z.sessions(_events(spark, sf), "30 minutes"))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_routing", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'click')")
def _(spark, sf):
    return _ran(spark, Z.by_key(_events(spark, sf), "event_type", "^(view|click)$"), "append").select("event_id", "event_type", "user_id")


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(spark, sf):
    import uuid

    _folder(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/upsert-{uuid.uuid4().hex}"
    Z.write_batches(_events(spark, sf), f"{base}/rows", f"{base}/state", ["user_id"], "event_id").awaitTermination()
    return Z.read_batches(spark, f"{base}/rows", ["user_id"], "event_id").select("user_id", "event_id", "value")


# ---- account history ----------------------------------------------------------------------------


def _history(spark, sf):
    """Per customer and month: what was ordered."""
    o = D.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("account"), F.trunc("o_orderdate", "month").alias("d")).agg(F.sum("o_totalprice").alias("assets"), F.count("*").alias("orders"))


HISTORY = "h AS (SELECT o_custkey AS account, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS assets, count(*) AS orders FROM orders GROUP BY 1, 2)"


@query("history_assets", f"WITH {HISTORY} SELECT account, d, round(assets, 2) AS assets, orders, round(assets / lag(assets) OVER (PARTITION BY account ORDER BY d) - 1, 4) AS ret FROM h")
def _(spark, sf):
    return rounded(rounded(backtest.history(_history(spark, sf)), digits=4).withColumn("assets", F.round("assets", 2)))


@query("strategy_ranking", f"WITH {HISTORY}, r AS (SELECT account, arg_max(assets, d) / arg_min(assets, d) - 1 AS total, count(*) AS months, sum(orders) AS orders FROM h GROUP BY 1 HAVING count(*) >= 3) SELECT account, round(total, 4) AS total, months, CAST(orders AS BIGINT) AS orders, rank() OVER (ORDER BY total DESC, account) AS place FROM r QUALIFY place <= 20")
def _(spark, sf):
    return rounded(backtest.ranking(_history(spark, sf), 20, 3))


# ---- market rules and runs ----------------------------------------------------------------------


@query("suspensions", f"""WITH {TRADES}, {CAL}, b AS (SELECT code, d, CASE WHEN count(*) > 1 THEN sum(volume) ELSE 0 END AS volume FROM trades WHERE d IN (SELECT d FROM cal) GROUP BY 1, 2), l AS (SELECT code, min(d) AS a, max(d) AS z FROM b GROUP BY 1), g AS (SELECT code, cal.d FROM l JOIN cal ON cal.d BETWEEN a AND z)
SELECT g.code, g.d, CASE WHEN b.volume IS NULL THEN 'missing' ELSE 'no_volume' END AS reason FROM g LEFT JOIN b ON g.code = b.code AND g.d = b.d WHERE b.volume IS NULL OR b.volume = 0""")
def _(spark, sf):
    cal = D.calendar(spark, sf)
    t = D.trades(spark, sf).select("code", "d", "volume")
    b = D.dealt(t, "code").join(F.broadcast(cal.select("d")), "d", "left_semi").groupBy("code", "d").agg(F.when(F.count("*") > 1, F.sum("volume")).otherwise(0.0).alias("volume"))
    return M.suspensions(b, cal)


@query("trade_windows", "SELECT event_id, CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '11:30:00' OR CAST(ts AS TIME) BETWEEN TIME '13:00:00' AND TIME '15:00:00' AS open FROM events")
def _(spark, sf):
    return D.table(spark, sf, "events").select("event_id", M.in_windows("ts", [("09:30", "11:30"), ("13:00", "15:00")]).alias("open"))


IMPACT = "CASE WHEN volume > 0 THEN least(greatest({0} * 0.15 * close, 0), 0.05 * close) ELSE 0 END"
_share = "least(100000.0 / greatest(volume * close, 1), 1)"


@query("impact_costs", f"""WITH {BARS}, v AS (SELECT code, d, close, volume, stddev_samp(r) OVER ({PER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, close / {lag('close')} - 1 AS r FROM bars))
SELECT code, d, round({IMPACT.format(f'0.1 * s * sqrt({_share} / 0.15)')}, 4) AS square_root, round({IMPACT.format(f'0.1 * s * {_share}')}, 4) AS linear, round({IMPACT.format(f's * (0.05 + 0.1 * sqrt({_share} / 0.01))')}, 4) AS almgren, round(0.0002 * (0.5 + 0.5 / greatest(day(d) % 5, 1)), 6) AS walked FROM v WHERE s IS NOT NULL""")
def _(spark, sf):
    w = Window.partitionBy("code").orderBy("d")
    b = D.day_bars(spark, sf).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    b = b.withColumns({"s": F.stddev_samp("r").over(w.rowsBetween(-19, 0)), "value": F.lit(100_000.0), "k": F.dayofmonth("d") % 5, "all": F.lit(5)}).where("s is not null")
    cost = lambda m: F.round(M.impact("value", "volume", "close", "s", m), 4)
    return b.select("code", "d", cost("square_root").alias("square_root"), cost("linear").alias("linear"), cost("almgren_chriss").alias("almgren"), F.round(M.walked_impact("k", "all"), 6).alias("walked"))


@query("market_regime", f"""WITH {BARS}, s AS (SELECT d, close / {lag('close')} - 1 AS signal, (close - open) / open AS event, volume > 700 AS active, volume / 1000 - 1 AS vs FROM bars), g AS (SELECT d, avg(CASE WHEN signal > 0 THEN 1.0 ELSE 0 END) AS breadth, avg(greatest(event, 0)) AS event, avg(greatest(vs, 0)) AS volume, avg(CASE WHEN active THEN 1.0 ELSE 0 END) AS activity FROM s WHERE signal IS NOT NULL GROUP BY 1)
SELECT d, round(breadth, 4) AS breadth, round(event, 4) AS event, round(activity, 4) AS activity, round(greatest(breadth - 0.5, 0) * 0.7 + greatest(event - 0.1, 0) * 0.9 + greatest(volume - 0.05, 0) * 0.5 + activity * 0.15, 7) AS score, breadth >= 0.5 AND event >= 0.1 AND volume >= 0.05 AND activity >= 0.2 AND greatest(breadth - 0.5, 0) * 0.7 + greatest(event - 0.1, 0) * 0.9 + greatest(volume - 0.05, 0) * 0.5 + activity * 0.15 >= 0.3 AS gate FROM g""")
def _(spark, sf):
    w = Window.partitionBy("code").orderBy("d")
    s = D.day_bars(spark, sf).select("d", (F.col("close") / F.lag("close").over(w) - 1).alias("signal"), ((F.col("close") - F.col("open")) / F.col("open")).alias("event"), (F.col("volume") > 700).alias("active"), (F.col("volume") / 1000 - 1).alias("volume_score"))
    m = M.regime(s.where("signal is not null"), "d", 0.5, 0.1, 0.05, 0.3)
    return m.select("d", *(F.round(c, 4).alias(c) for c in ("breadth", "event", "activity")), F.round("score", 7).alias("score"), "gate")


@query("pending_orders", "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('F')")
def _(spark, sf):
    return M.pending(D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), ("F",))


@query("settled_positions", f"WITH {TRADES} SELECT code, sum(CASE WHEN d < DATE '1998-01-01' THEN volume ELSE 0 END) + sum(CASE WHEN d >= DATE '1998-01-01' THEN volume ELSE 0 END) AS held_before, 0.0 AS held_today, 0.0 AS frozen FROM trades GROUP BY 1")
def _(spark, sf):
    late = F.col("d") >= F.lit("1998-01-01").cast("date")
    p = D.trades(spark, sf).groupBy("code").agg(F.sum(F.when(~late, F.col("volume")).otherwise(0.0)).alias("held_before"), F.sum(F.when(late, F.col("volume")).otherwise(0.0)).alias("held_today"), F.lit(3.0).alias("frozen"))
    return M.settled(p)


def ranked_rows(spark, sf):
    """Supplier by month as bars of three accounts, that want the 3, 5 and 10 codes with the least mean discount of the month before."""
    t = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "month").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", "l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    b = D.dealt(t, "code").groupBy("code", "d").agg(F.min_by("p", "at").alias("open"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"), (exact_sum("l_discount") / F.count("l_discount")).alias("score"))  # ties are many: none hangs on the order of rows
    w = Window.partitionBy("code").orderBy("d")
    b = b.withColumns({"before": F.lag("close").over(w), "wish": F.lag("score").over(w)})
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.col("wish").asc_nulls_last(), "code"))
    b = b.withColumns({"place": F.when(F.col("wish").isNotNull(), place), "limit_up": F.round(F.col("before") * 1.6, 2), "limit_down": F.round(F.col("before") * 0.5, 2)})
    sets = F.explode(F.array(*(F.struct(F.lit(f"best {k}").alias("account"), F.lit(k).alias("k")) for k in (3, 5, 10))))
    return b.withColumn("s", sets).select("s.account", "code", "d", "open", "close", "volume", "limit_up", "limit_down", F.when(F.col("place") <= F.col("s.k"), 1 / F.col("s.k")).otherwise(0.0).alias("weight"))


@query("backtest_runs")
def _(spark, sf):
    return rounded(backtest.run_accounts(ranked_rows(spark, sf), lot=1.0, slip=0.001), digits=2)


# ---- factors ------------------------------------------------------------------------------------

IC = f"WITH {FACTOR}, p AS (SELECT * FROM f WHERE factor IS NOT NULL AND ret IS NOT NULL), q AS (SELECT d, corr(factor, ret) AS ic FROM p GROUP BY 1 HAVING count(*) > 2)"


@query("ic_statistics", f"{IC} SELECT count(*) AS n, round(avg(ic), 4) AS mean, round(stddev_samp(ic), 4) AS sd, round(avg(ic) / stddev_samp(ic) * sqrt(12), 4) AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 4) AS positive FROM q WHERE isfinite(ic)")
def _(spark, sf):
    return rounded(Q.ic_statistics(Q.ic(factor_rows(spark, sf)).where("n > 2"), periods=12))


@query("factor_inflation", f"WITH {FACTOR}, c AS (SELECT corr(factor, size) AS r FROM f) SELECT unnest(['factor', 'size']) AS factor, round(1 / (1 - r * r), 6) AS vif FROM c")
def _(spark, sf):
    found = Q.inflation(factor_rows(spark, sf), ["factor", "size"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "factor string, vif double")


@query("industry_dummies", "SELECT s_suppkey AS code, n_regionkey AS region, " + ", ".join(f"CAST(n_regionkey = {k} AS INT) AS region_{k}" for k in range(5)) + " FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    s = D.table(spark, sf, "supplier").join(F.broadcast(D.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return Q.dummies(s.select(F.col("s_suppkey").alias("code"), F.col("n_regionkey").alias("region")), "region", list(range(5)))


TURN = "m AS (SELECT DISTINCT s_nationkey AS block, s_suppkey AS code FROM supplier), h AS (SELECT ps.code, 1000.0 + ps.code AS shares FROM (SELECT DISTINCT code FROM trades) ps)"


@query("block_turnover", f"WITH {TRADES}, {TURN}, b AS (SELECT code, d, sum(volume) AS volume FROM trades GROUP BY 1, 2) SELECT block, d, round(sum(volume) / sum(shares), 6) AS turnover FROM b JOIN h USING (code) JOIN m USING (code) GROUP BY 1, 2")
def _(spark, sf):
    t = D.trades(spark, sf)
    members = D.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_suppkey").alias("code"))
    shares = t.select("code").distinct().withColumn("shares", 1000.0 + F.col("code"))
    return rounded(Q.block_turnover(t.groupBy("code", "d").agg(F.sum("volume").alias("volume")), members, shares), digits=6)


@query("stock_turnover", f"WITH {TRADES} SELECT code AS block, d, round(sum(volume) / (1000.0 + code), 6) AS turnover FROM trades GROUP BY code, d")
def _(spark, sf):
    t = D.trades(spark, sf).select("code", "d", "volume")
    shares = t.select("code").distinct().withColumn("shares", 1000.0 + F.col("code"))
    own = Q.stock_turnover(D.dealt(t, "code", "d").groupBy("code", "d").agg(F.sum("volume").alias("volume")), shares)
    return rounded(own.select(F.col("code").alias("block"), "d", "turnover"), digits=6)


def _store(spark, sf):
    """Two versions of two factors in a table of the checkpoint folder."""
    import uuid

    _folder(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/factors-{uuid.uuid4().hex}"
    f = factor_rows(spark, sf)
    named = lambda n, x: f.select(F.lit(n).alias("name"), "code", "d", F.col(x).cast("double").alias("value"))
    Q.register(named("discount", "factor").union(named("size", "size")), path, 1)
    return Q.register(named("size", "size").withColumn("value", F.col("value") * 2), path, 2), path


@query("factor_store", f"WITH {FACTOR} SELECT code, d, round(factor, 6) AS discount, round(size * 2, 6) AS size FROM f")
def _(spark, sf):
    stored, _ = _store(spark, sf)
    return rounded(Q.factor_values(stored, ["discount", "size"]), digits=6)


@query("factor_registry", f"WITH {FACTOR} SELECT 'discount' AS name, count(*) AS n, min(d) AS first, max(d) AS last FROM f")
def _(spark, sf):
    _, path = _store(spark, sf)
    return Q.factor_names(Q.unregister(spark, path, "size", 3))


# ---- SQL of queries registered elsewhere --------------------------------------------------------

O.SQL["portfolio_risk"] = f"""WITH {MONTHS}, x AS (SELECT 'a' || (dense_rank() OVER (ORDER BY code) - 1) AS asset, d, ret FROM r), cv AS (SELECT x.asset AS i, y.asset AS j, covar_pop(x.ret, y.ret) AS c FROM x JOIN x y ON x.d = y.d AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2),
t AS (SELECT sqrt(sum(0.04 * c)) AS v, (SELECT sum(0.2 * sqrt(c)) FROM cv WHERE i = j) AS s FROM cv) SELECT i AS asset, round(any_value(v), 4) AS volatility, round(sum(0.2 * c) / any_value(v), 4) AS marginal, round(0.2 * sum(0.2 * c) / any_value(v) / any_value(v), 4) AS contribution, round(any_value(s) / any_value(v), 4) AS diversification FROM cv, t GROUP BY 1"""
O.SQL["risk_report"] = f"""WITH {MONTHS}, q AS (SELECT code, -quantile_cont(ret, 0.05) AS var FROM r WHERE ret IS NOT NULL GROUP BY 1), cv AS (SELECT q.code, any_value(var) AS var, -avg(ret) FILTER (ret <= -var) AS cvar FROM r JOIN q ON r.code = q.code GROUP BY 1),
m AS (SELECT code, count(ret) AS n, exp(sum(ln(1 + ret))) AS g, stddev_samp(ret) AS sd, avg(ret) AS mu, stddev_pop(ret) FILTER (ret < 0) AS dn, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(ret) FILTER (ret > 0) / -(sum(ret) FILTER (ret < 0)) AS pf, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM r WHERE ret IS NOT NULL GROUP BY 1),
dd AS (SELECT code, d, v, max(v) {over(0)} AS peak FROM c), de AS (SELECT code, min(v / peak - 1) AS mdd, max(peak - v) AS deep, arg_max(v, d) - arg_min(v, d) AS profit FROM dd GROUP BY 1),
ui AS (SELECT code, v < peak AS u, sum(CASE WHEN v < peak THEN 0 ELSE 1 END) {over(0)} AS i FROM dd), un AS (SELECT code, max(n) AS under FROM (SELECT code, i, count(*) FILTER (u) AS n FROM ui GROUP BY 1, 2) GROUP BY 1),
li AS (SELECT code, ret < 0 AS u, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) {over(0)} AS i FROM r WHERE ret IS NOT NULL), ln_ AS (SELECT code, max(n) AS losing FROM (SELECT code, i, count(*) FILTER (u) AS n FROM li GROUP BY 1, 2) GROUP BY 1)
SELECT m.code, n, round(g - 1, 4) AS total_return, round(power(g, 12.0 / n) - 1, 4) AS annual_return, round(sd * sqrt(12), 4) AS volatility, round(mu / sd * sqrt(12), 4) AS sharpe, round(mu / dn * sqrt(12), 4) AS sortino, round(win_rate, 4) AS win_rate, round(pf, 4) AS profit_factor, round(skew, 4) AS skew, round(kurt, 4) AS kurt,
  round(var, 4) AS var, round(cvar, 4) AS cvar, round(mdd, 4) AS max_drawdown, under AS longest_drawdown, losing AS losing_streak, round((power(g, 12.0 / n) - 1) / abs(mdd), 4) AS calmar, round(profit / nullif(deep, 0), 4) AS recovery FROM m JOIN cv USING (code) JOIN de USING (code) JOIN un USING (code) JOIN ln_ USING (code)"""
_due = "abs(b.p - b.level) >= abs(b.level) * CAST('0.1' AS DOUBLE) AND abs(b.level) * CAST('0.1' AS DOUBLE) > 0"
O.SQL["renko_percent"] = f"""{O.ROWS}, b AS (SELECT code, k, close AS p, close AS level, 0 AS n, 0 AS way FROM r WHERE k = 1 UNION ALL
SELECT r.code, r.k, r.close, CASE WHEN {_due} THEN b.level + sign(b.p - b.level) * (abs(b.level) * CAST('0.1' AS DOUBLE)) ELSE b.level END, CASE WHEN {_due} THEN b.n + 1 ELSE b.n END, CASE WHEN {_due} THEN CAST(sign(b.p - b.level) AS INT) ELSE 0 END FROM b JOIN r ON r.code = b.code AND r.k = b.k + CASE WHEN {_due} THEN 0 ELSE 1 END)
SELECT b.code, r.d, CAST(n - 1 AS BIGINT) AS brick, round(level, 4) AS price, CAST(way AS BIGINT) AS way FROM b JOIN r USING (code, k) WHERE way <> 0"""

_CODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_pick = lambda c: "CASE r.code " + " ".join(f"WHEN '{x}' THEN w.{c}{i}" for i, x in enumerate(_CODES)) + " END"
_worth = "r.price * r.amount"
_fee = f"(greatest({_worth} * 0.00025e0, 5e0) + CASE WHEN r.side = 'SELL' THEN {_worth} * 0.001e0 ELSE 0e0 END)"
_buy = lambda money, h: f"(r.side = 'BUY' AND {_worth} + {_fee} <= {money})"
_sell = lambda h: f"(r.side = 'SELL' AND r.amount <= {h})"


def _accounts_sql() -> str:
    """The walk of an account: money and, for each of five codes, holding and mean price."""
    first, step = [], []
    start = "CAST(1000000 AS DOUBLE)"
    for money, h, cost, won, out, w in ((start, "0e0", "0e0", "0e0", first, False), ("w.cash", f"({_pick('h')})", f"({_pick('c')})", "w.won", step, True)):
        out.append(f"CASE WHEN {_buy(money, h)} OR {_sell(h)} THEN 'FILLED' ELSE 'REJECTED' END AS status")
        out.append(f"CASE WHEN {_buy(money, h)} THEN {money} - {_worth} - {_fee} WHEN {_sell(h)} THEN {money} + {_worth} - {_fee} ELSE {money} END AS cash")
        out.append(f"CASE WHEN NOT {_buy(money, h)} AND {_sell(h)} THEN {won} + ((r.price - {cost}) * r.amount - {_fee}) ELSE {won} END AS won")
        for i, x in enumerate(_CODES):
            own_h, own_c = (f"w.h{i}", f"w.c{i}") if w else ("0e0", "0e0")
            out.append(f"CASE WHEN r.code = '{x}' AND {_buy(money, own_h)} THEN {own_h} + r.amount WHEN r.code = '{x}' AND {_sell(own_h)} THEN {own_h} - r.amount ELSE {own_h} END AS h{i}")
            out.append(f"CASE WHEN r.code = '{x}' AND {_buy(money, own_h)} THEN ({own_c} * {own_h} + {_worth}) / ({own_h} + r.amount) ELSE {own_c} END AS c{i}")
    return f"""WITH RECURSIVE r AS (SELECT o_custkey AS account, o_orderkey AS seq, o_orderpriority AS code, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS price, 1e0 AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
w AS (SELECT r.account, r.k, {', '.join(first)} FROM r WHERE k = 1 UNION ALL SELECT r.account, r.k, {', '.join(step)} FROM r JOIN w ON r.account = w.account AND r.k = w.k + 1)
SELECT r.account, r.seq, w.status, round(w.cash, 7) AS cash, {_pick('h')} AS position, round({_pick('c')}, 7) AS avg_price, round(w.won, 7) AS realized FROM r JOIN w ON r.account = w.account AND r.k = w.k"""


O.SQL["accounts"] = _accounts_sql()


def _rank(x: str, n: int) -> str:
    """Mean rank of a row among its last n values, as a share."""
    values = f"list_filter(list({x}) OVER ({PER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL)"
    return f"coalesce((len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2e0) / nullif(len({values}), 0), 0.5e0)"


def _z(x: str, n: int) -> str:
    least, w = max(5, n // 4), f"OVER ({PER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN coalesce(({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0), 0) ELSE 0 END"


_w = lambda n: f"OVER ({PER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
O.SQL["alphas"] = f"""WITH {BARS}, a AS (SELECT *, close / {lag('close')} - 1 AS r1, CASE WHEN count(volume) {_w(20)} >= 5 THEN avg(volume) {_w(20)} END AS adv FROM bars), v AS (SELECT *, sum((high + low + close) / 3 * volume) {_w(20)} / nullif(sum(volume) {_w(20)}, 0) AS vw FROM a),
s AS (SELECT *, vw - close AS g, open - avg(vw) {_w(10)} AS vm, abs(close - vw) AS cv, volume - {lag('volume', 3)} AS dv, {_rank('volume', 20)} AS vr, -r1 * adv * vw * (high - close) AS p25, greatest(high - open, close - low) AS p7, (close - open) / (high - low + 1e-3) + (high - low) / (high - low + 1e-3) AS p20 FROM v),
t AS (SELECT *, max(g) {_w(3)} AS mx, min(g) {_w(3)} AS mn, CASE WHEN isfinite(corr(open, vr) {_w(10)}) THEN corr(open, vr) {_w(10)} END AS co, p7 * vr AS p7r FROM s)
SELECT code, d, round(-({_rank('co', 20)}), 4) AS alpha_04, round({_rank('vm', 20)} * (1 - {_rank('cv', 20)}) * 2 - 1, 6) AS alpha_05, round({_z('p7r', 20)}, 4) AS alpha_07, round(({_rank('mx', 20)} + {_rank('mn', 20)}) * {_rank('dv', 20)} - 1, 6) AS alpha_11, round(CASE WHEN close >= open THEN 1 ELSE -1 END * ln(nullif(volume / nullif(adv, 0), 0)), 4) AS alpha_12,
  round({_z('p20', 20)}, 4) AS alpha_20, round({_z('p25', 20)}, 4) AS alpha_25, round((close - open) * (volume / nullif(adv, 0)), 2) AS alpha_54, round((close - open) * sqrt(volume / nullif(adv, 0)), 2) AS alpha_60 FROM t"""
