"""Registered queries over the given tables, each with an independent DuckDB form where SQL can say it.

Doubles are rounded on both sides, so that summation order does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candles, dates, indicators as I, series as S
from ..operators import backtest, bars as B, factors as Q, joins as J, market as M, portfolio as P, resample as T, risk as K, signals as G
from ..sources import tables as D
from . import features as X, oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The columns (all by default), doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns or df.columns))


def plain(sql: str) -> str:
    """Rounding to zero gives 0.0 in Spark and may give -0.0 in DuckDB; adding 0.0 makes them one."""
    return sql.replace("round(", "0.0 + round(")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = plain(sql)
        return f

    return keep


# ---- pieces of SQL ------------------------------------------------------------------------------

BARS = """bars AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(sum(o_custkey) AS DOUBLE) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)"""
TICKS = "ticks AS (SELECT event_type AS code, ts, event_id AS tick_id, value AS price, 1.0 AS vol FROM events)"
TRADES = "trades AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS amount, l_returnflag AS side FROM lineitem)"
CAL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))"
PER = "PARTITION BY code ORDER BY d"


def over(n: int, by: str = PER) -> str:
    return f"OVER ({by} ROWS BETWEEN {n - 1 if n else 'UNBOUNDED'} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, by: str = PER) -> str:
    return f"CASE WHEN count({x}) {over(n, by)} >= {n} THEN {f}({x}) {over(n, by)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PER})"


def last_if_full(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {n} THEN {value} {over(n)} END"


# ---- bars, projections, filters -----------------------------------------------------------------


@query("flagship_daily_ma", f"""WITH {TICKS}, day AS (SELECT code, CAST(ts AS DATE) AS d, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, tick_id)) AS close, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT code, d, open, high, low, close, n, round({roll("avg", "close", 5)}, 4) AS ma5, round({roll("avg", "close", 10)}, 4) AS ma10 FROM day""")
def flagship(spark, sf):
    order = F.struct("ts", "tick_id")
    day = D.ticks(spark, sf).groupBy("code", F.to_date("ts").alias("d")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n"))
    return rounded(I.ma(day, 5, 10))


@query("bars_scan", f"WITH {BARS} SELECT code, d, open, close, volume FROM bars WHERE code IN ('1-URGENT', '2-HIGH') AND d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND volume > 1000")
def _(spark, sf):
    return D.scan_bars(D.day_bars(spark, sf), ["1-URGENT", "2-HIGH"], "1996-01-01", "1997-12-31", 1000.0, ["code", "d", "open", "close", "volume"])


@query("bars_derived", f"""WITH {BARS} SELECT code, d, round((open + high + low + close) / 4, 4) AS price, round(amount / nullif(volume, 0), 4) AS avg, round((close - open) / open, 4) AS bar_pct_change,
  round((high - low) / low, 4) AS amplitude, round(abs(low - least(open, close)), 4) AS lower_shadow, round(abs(high - greatest(open, close)), 4) AS upper_shadow, round(close - open, 4) AS body, round(abs(open - close), 4) AS body_abs FROM bars""")
def _(spark, sf):
    return rounded(B.derived(D.day_bars(spark, sf)), "code", "d", "price", "avg", "bar_pct_change", "amplitude", "lower_shadow", "upper_shadow", "body", "body_abs")


@query("bars_changes", f"""WITH {BARS}, p AS (SELECT *, (open + high + low + close) / 4 AS price FROM bars)
SELECT code, d, round(price - {lag("price")}, 4) AS price_diff, round(price / {lag("price")} - 1, 4) AS pct_change, round(close / {lag("close")} - 1, 4) AS close_pct_change, round(close / first_value(close) OVER ({PER}), 4) AS normalized FROM p""")
def _(spark, sf):
    return rounded(B.changes(D.day_bars(spark, sf)), "code", "d", "price_diff", "pct_change", "close_pct_change", "normalized")


@query("bars_limits", f"""WITH {BARS} SELECT code, d, round(({lag("close")} + 0.0002) * 1.1, 1) AS high_limit, round(({lag("close")} + 0.0002) * 0.9, 1) AS low_limit, round((close + 0.0002) * 1.1, 1) AS next_high_limit FROM bars""")
def _(spark, sf):
    b = B.limits(D.day_bars(spark, sf))
    w = F.lag("close").over(I.W())
    return b.select("code", "d", F.round((w + 0.0002) * 1.1, 1).alias("high_limit"), F.round((w + 0.0002) * 0.9, 1).alias("low_limit"), F.round((F.col("close") + 0.0002) * 1.1, 1).alias("next_high_limit"))


@query("bars_around_time", f"""WITH {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '1998-01-01') SELECT code, d, close FROM a WHERE k BETWEEN 2 AND 6""")
def _(spark, sf):
    return B.select_time_with_gap(D.day_bars(spark, sf), "1998-01-01", 5, "lt").select("code", "d", "close")


@query("bars_select_month", f"WITH {BARS} SELECT code, d, close FROM bars WHERE date_trunc('month', d) = DATE '1997-03-01'")
def _(spark, sf):
    return D.day_bars(spark, sf).where(F.trunc("d", "month") == F.lit("1997-03-01").cast("date")).select("code", "d", "close")


@query("fast_moving", f"WITH {BARS} SELECT code, d, round((close - open) / open, 4) AS bar_pct_change FROM bars WHERE (close - open) / open > 1.5")
def _(spark, sf):
    return rounded(B.derived(D.day_bars(spark, sf)).where("bar_pct_change > 1.5"), "code", "d", "bar_pct_change")


@query("trade_size_bands", f"WITH {TRADES} SELECT 'big' AS band, count(*) AS n, round(sum(amount), 2) AS amount FROM trades WHERE amount >= 70000 UNION ALL SELECT 'medium', count(*), round(sum(amount), 2) FROM trades WHERE amount BETWEEN 30000 AND 70000 UNION ALL SELECT 'small', count(*), round(sum(amount), 2) FROM trades WHERE amount <= 30000")
def _(spark, sf):
    bands = B.size_bands(D.trades(spark, sf), 30_000, 70_000)
    one = [b.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).select(F.lit(k).alias("band"), "n", "amount") for k, b in bands.items()]
    return one[0].union(one[1]).union(one[2])


@query("feature_select", f"WITH {TRADES} SELECT code, d, price FROM trades WHERE side IN ('A', 'R') AND code = 7")
def _(spark, sf):
    return B.match(D.trades(spark, sf), side=["A", "R"], code=7).select("code", "d", "price")


@query("blocks_in_all", "SELECT l_suppkey AS code FROM lineitem WHERE l_partkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_partkey) = 2")
def _(spark, sf):
    return B.in_all_blocks(D.membership(spark, sf), [1, 2])


@query("blocks_view", "SELECT l_suppkey AS code, count(DISTINCT l_partkey) AS n, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY 1")
def _(spark, sf):
    return D.membership(spark, sf).groupBy("code").agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))


# ---- aggregates ---------------------------------------------------------------------------------


@query("group_statistics", f"""WITH {BARS} SELECT code, count(close) AS n, max(close) AS max, min(close) AS min, round(avg(close), 4) AS mean, round(var_samp(close), 1) AS variance, round(var_pop(close), 1) AS pvariance, round(stddev_samp(close), 4) AS stdev,
  round(stddev_pop(close), 4) AS pstdev, round(count(close) / sum(1 / close), 4) AS mean_harmonic, round((max(close) - min(close)) / min(close), 4) AS amplitude, round(skewness(close), 4) AS skew, round(kurtosis(close), 4) AS kurt FROM bars GROUP BY 1""")
def _(spark, sf):
    s = rounded(B.statistics(D.day_bars(spark, sf), "close"))
    return s.withColumns({c: F.round(c, 1) for c in ("variance", "pvariance")})


@query("group_mad_mode", """WITH m AS (SELECT l_suppkey AS code, avg(l_quantity) AS m FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey AS code, round(avg(abs(l_quantity - m)), 4) AS mad FROM lineitem JOIN m ON l_suppkey = code GROUP BY 1),
c AS (SELECT l_suppkey AS code, l_quantity AS mode, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT code, mad, mode, n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, mode) AS k FROM c) JOIN a USING (code) WHERE k = 1""")
def _(spark, sf):
    t = D.trades(spark, sf)
    return rounded(B.mean_deviation(t, "volume").join(B.most_frequent(t, "volume"), "code"))


@query("close_panel", f"""WITH {BARS} SELECT d, avg(close) FILTER (code = '1-URGENT') AS "1-URGENT", avg(close) FILTER (code = '2-HIGH') AS "2-HIGH", avg(close) FILTER (code = '5-LOW') AS "5-LOW" FROM bars GROUP BY 1""")
def _(spark, sf):
    return B.pivot(D.day_bars(spark, sf), "close", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("block_index", f"""WITH {BARS}, day AS (SELECT d, sum(close * volume) / sum(volume) AS level FROM bars GROUP BY 1) SELECT d, round(level / (SELECT arg_min(level, d) FROM day) * 1000, 4) AS "index" FROM day""")
def _(spark, sf):
    return rounded(B.block_index(D.day_bars(spark, sf), "volume"))


# ---- windows ------------------------------------------------------------------------------------


@query("window_basics", f"""WITH {BARS} SELECT code, d, round({roll("avg", "close", 20)}, 4) AS ma, round({roll("max", "high", 9)}, 4) AS hhv, round({roll("min", "low", 9)}, 4) AS llv, round({roll("sum", "volume", 5)}, 2) AS sum5, round(sum(volume) {over(0)}, 2) AS sum0,
  round({roll("stddev_samp", "close", 10)}, 4) AS std, {lag("close", 3)} AS ref, round(close - {lag("close", 2)}, 4) AS diff FROM bars""")
def _(spark, sf):
    return rounded(D.day_bars(spark, sf).select("code", "d", S.MA("close", 20, I.W()).alias("ma"), S.HHV("high", 9, I.W()).alias("hhv"), S.LLV("low", 9, I.W()).alias("llv"), S.SUM("volume", 5, I.W()).alias("sum5"), S.SUM("volume", 0, I.W()).alias("sum0"), S.STD("close", 10, I.W()).alias("std"), S.REF("close", 3, I.W()).alias("ref"), S.DIFF("close", 2, I.W()).alias("diff")))


@query("window_conditions", f"""WITH {BARS}, c AS (SELECT *, CASE WHEN close > open THEN 1 ELSE 0 END AS up FROM bars), s AS (SELECT *, {roll("sum", "up", 5)} AS n FROM c)
SELECT code, d, CAST(n AS BIGINT) AS n, coalesce(n > 0, false) AS some, coalesce(n = 5, false) AS every, CASE WHEN open > close THEN open ELSE close END AS top, CASE WHEN open < close THEN open ELSE close END AS bottom FROM s""")
def _(spark, sf):
    up = F.col("close") > F.col("open")
    return D.day_bars(spark, sf).select("code", "d", S.COUNT(up, 5, I.W()).alias("n"), S.EXIST(up, 5, I.W()).alias("some"), S.EVERY(up, 5, I.W()).alias("every"), S.MAX("open", "close").alias("top"), S.MIN("open", "close").alias("bottom"))


@query("window_avedev", f"""WITH {BARS}, r AS (SELECT *, row_number() OVER ({PER}) AS k FROM bars), m AS (SELECT a.code, a.d, avg(b.close) AS mean, count(*) AS n FROM r a JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 13 AND a.k GROUP BY 1, 2)
SELECT a.code, a.d, CASE WHEN any_value(m.n) = 14 THEN round(avg(abs(b.close - m.mean)), 4) END AS avedev FROM r a JOIN m ON a.code = m.code AND a.d = m.d JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 13 AND a.k GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(D.day_bars(spark, sf).select("code", "d", S.AVEDEV("close", 14, I.W()).alias("avedev")))


@query("window_cross", f"""WITH {BARS}, m AS (SELECT code, d, {roll("avg", "close", 5)} AS a, {roll("avg", "close", 30)} AS b FROM bars), c AS (SELECT *, coalesce(a < b, false) AS below, coalesce(b < a, false) AS above, row_number() OVER ({PER}) AS p FROM m),
g AS (SELECT *, CAST(coalesce(lag(below) OVER ({PER}) AND NOT below, false) AS INT) AS golden, CAST(coalesce(lag(above) OVER ({PER}) AND NOT above, false) AS INT) AS dead FROM c)
SELECT code, d, golden, dead, p - coalesce(max(CASE WHEN golden = 1 THEN p END) {over(0)}, 0) AS since_golden, p - coalesce(max(CASE WHEN dead = 1 THEN p END) {over(0)}, 0) AS since_dead FROM g""")
def _(spark, sf):
    m = I.ma(D.day_bars(spark, sf), 5, 30)
    return G.crosses(m, "ma5", "ma30").select("code", "d", "golden", "dead", "since_golden", "since_dead")


@query("window_filter", f"""WITH {BARS}, c AS (SELECT code, d, close > 1.2 * open AS c, row_number() OVER ({PER}) AS p FROM bars), b AS (SELECT *, max(CASE WHEN c THEN p END) OVER ({PER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
SELECT code, d, c AND (b IS NULL OR p - b >= 4) AS kept FROM b""")
def _(spark, sf):
    return G.spaced(D.day_bars(spark, sf), F.col("close") > 1.2 * F.col("open"), 4).select("code", "d", "kept")


@query("window_pct_rank", f"""WITH {BARS}, r AS (SELECT *, row_number() OVER ({PER}) AS k FROM bars)
SELECT a.code, a.d, round((count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2) / count(*), 4) AS pr FROM r a JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 59 AND a.k GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(D.day_bars(spark, sf).select("code", "d", S.pct_rank("close", 60, I.W()).alias("pr")))


@query("window_zscore", f"""WITH {BARS} SELECT code, d, round(coalesce(CASE WHEN count(close) {over(20)} >= 5 THEN (close - avg(close) {over(20)}) / nullif(stddev_samp(close) {over(20)}, 0) END, 0), 4) AS z FROM bars""")
def _(spark, sf):
    return rounded(D.day_bars(spark, sf).select("code", "d", S.zscore("close", 20, I.W()).alias("z")))


@query("bars_since", f"""WITH {BARS}, c AS (SELECT code, close > open AS c, row_number() OVER ({PER}) AS p FROM bars) SELECT code, max(p) - max(CASE WHEN c THEN p END) AS since, max(p) - max(CASE WHEN NOT c THEN p END) AS since_not FROM c GROUP BY 1""")
def _(spark, sf):
    return G.bars_since(D.day_bars(spark, sf), F.col("close") > F.col("open"))


@query("last_rows_hold", f"""WITH {BARS}, c AS (SELECT code, high > low AS c, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS k FROM bars) SELECT code, bool_and(c) AS holds FROM c WHERE k BETWEEN 2 AND 4 GROUP BY 1""")
def _(spark, sf):
    return G.last_rows(D.day_bars(spark, sf), F.col("high") > F.col("low"), 2, 4)


# ---- recursive series: closed forms and recursions as oracles -----------------------------------

EMA12 = f"""WITH {BARS}, r AS (SELECT *, row_number() OVER ({PER}) AS k FROM bars), e AS (SELECT a.code, a.d, any_value(a.k) AS k, sum(power(11.0 / 13, a.k - b.k) * b.close) / sum(power(11.0 / 13, a.k - b.k)) AS e FROM r a JOIN r b ON a.code = b.code AND b.k <= a.k AND b.k > a.k - 400 GROUP BY 1, 2)"""


@query("ema", EMA12 + " SELECT code, d, CASE WHEN k >= 11 THEN round(e, 4) END AS ema12 FROM e")
def _(spark, sf):
    return rounded(I.ema(D.day_bars(spark, sf), 12), "code", "d", "ema12")


def smoothed(x: str, n: int, name: str) -> str:
    """SQL of the seeded recursion y = (x + (n - 1) y') / n over r(code, k, x): the first row is ignored and the second seeds both."""
    return f"""{name} AS (SELECT code, k, {x} AS y FROM r WHERE k = 2 UNION ALL SELECT r.code, r.k, ({x} + {n - 1} * {name}.y) / {n} FROM r JOIN {name} ON r.code = {name}.code AND r.k = {name}.k + 1)"""


@query("sma", f"""WITH RECURSIVE {BARS}, r AS (SELECT code, d, close, row_number() OVER ({PER}) AS k FROM bars), {smoothed("r.close", 9, "y").replace("SELECT code, k, r.close", "SELECT code, k, close")}
SELECT r.code, r.d, round(coalesce(y.y, s.y), 4) AS sma FROM r LEFT JOIN y ON r.code = y.code AND r.k = y.k LEFT JOIN y s ON r.code = s.code AND r.k = 1 AND s.k = 2""")
def _(spark, sf):
    return rounded(I.sma(D.day_bars(spark, sf), 9), "code", "d", "sma")


@query("rsi", f"""WITH RECURSIVE {BARS}, r AS (SELECT code, d, row_number() OVER ({PER}) AS k, close - {lag("close")} AS m FROM bars),
u AS (SELECT code, k, greatest(m, 0) AS y, abs(m) AS z FROM r WHERE k = 2 UNION ALL SELECT r.code, r.k, (greatest(m, 0) + 11 * u.y) / 12, (abs(m) + 11 * u.z) / 12 FROM r JOIN u ON r.code = u.code AND r.k = u.k + 1)
SELECT r.code, r.d, round(coalesce(u.y / u.z, s.y / s.z) * 100, 4) AS rsi12 FROM r LEFT JOIN u ON r.code = u.code AND r.k = u.k LEFT JOIN u s ON r.code = s.code AND r.k = 1 AND s.k = 2""")
def _(spark, sf):
    return rounded(I.rsi(D.day_bars(spark, sf), 12), "code", "d", "rsi12")


for _name, _f, _columns in (
    ("macd", I.macd, ("dif", "dea", "macd")), ("kdj", I.kdj, ("rsv", "k", "kd", "j")), ("skdj", I.skdj, ("sk", "sd")), ("pbx", I.pbx, ("pbx3", "pbx5", "pbx8", "pbx13", "pbx18", "pbx24")),
    ("osc", I.osc, ("osc", "maosc")), ("ddi", I.ddi, ("ddi", "addi", "ad")), ("expma", lambda b: I.ema(b, 5, 10, 20, 60), ("ema5", "ema10", "ema20", "ema60")), ("vrsi", lambda b: I.rsi(b, 6, x="volume"), ("rsi6",)),
    ("ta_recursive", I.recursive_set, ("atr_w", "dx", "adx_w", "rsi_w", "cmo", "kama", "dema", "sar", "adosc", "trend_line", "trend")), ("hull", I.hull, ("hma",)), ("beta", I.beta, ("beta",)),
):
    QUERIES[_name] = lambda spark, sf, f=_f, c=_columns: rounded(f(D.day_bars(spark, sf)), "code", "d", *c)

QUERIES["ta_more"] = lambda spark, sf: rounded(I.atr_stops(I.stoch_rsi(I.macd_of_means(I.recursive_more(D.day_bars(spark, sf)), x="volume"))), "code", "d", "adxr", "macd_fix", "macd_fix_signal", "sarext", "stochrsi_k", "stochrsi_d", "macdext", "macdext_signal", "stop_ma", "stop_way", "stop_line")
QUERIES["volume_hull"] = lambda spark, sf: rounded(I.volume_hull(D.day_bars(spark, sf)), "code", "d", "vhma", "vhma_way")
QUERIES["adx_hull"] = lambda spark, sf: rounded(I.adx_of_means(D.day_bars(spark, sf)), "code", "d", "adx_hull", "adx_way")
QUERIES["hilbert"] = lambda spark, sf: rounded(I.hilbert_set(D.day_bars(spark, sf)), "code", "d", "ht_period", "ht_inphase", "ht_quadrature", "mama", "fama", "ht_phase", "ht_sine", "ht_lead", "ht_trendline", "ht_mode")

# ---- windowed indicators ------------------------------------------------------------------------


def indicator(name: str, build, columns: tuple[str, ...], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(build(D.day_bars(spark, sf)), "code", "d", *columns)
    SQL[name] = plain(f"WITH {BARS} {sql}")


indicator("boll", I.boll, ("boll", "ub", "lb"), f"SELECT code, d, round({roll('avg', 'close', 20)}, 4) AS boll, round({roll('avg', 'close', 20)} + 2 * {roll('stddev_samp', 'close', 20)}, 4) AS ub, round({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)}, 4) AS lb FROM bars".replace("END + 2 *", "END + 2 * (").replace("END - 2 *", "END - 2 * (").replace("END, 4) AS ub", "END), 4) AS ub").replace("END, 4) AS lb", "END), 4) AS lb"))
indicator("bbands", I.bbands, ("upper", "middle", "lower"), f", s AS (SELECT code, d, {roll('avg', 'close', 5)} AS m, {roll('stddev_pop', 'close', 5)} AS s FROM bars) SELECT code, d, round(m + 2 * s, 4) AS upper, round(m, 4) AS middle, round(m - 2 * s, 4) AS lower FROM s")
# sums of cents over 96 lie halfway between two fourth digits now and then, but never between two seventh ones
indicator("bbi", I.bbi, ("bbi",), f", s AS (SELECT code, d, {roll('avg', 'close', 3)} AS a, {roll('avg', 'close', 6)} AS b, {roll('avg', 'close', 12)} AS c, {roll('avg', 'close', 24)} AS e FROM bars) SELECT code, d, round((a + b + c + e) / 4, 7) AS bbi FROM s")
QUERIES["bbi"] = lambda spark, sf: rounded(I.bbi(D.day_bars(spark, sf)), "code", "d", "bbi", digits=7)
indicator("dma", I.dma, ("ddd", "ama"), f", s AS (SELECT code, d, ({roll('avg', 'close', 10)}) - ({roll('avg', 'close', 50)}) AS ddd FROM bars) SELECT code, d, round(ddd, 4) AS ddd, round({roll('avg', 'ddd', 10)}, 4) AS ama FROM s")
indicator("mtm", I.mtm, ("mtm", "mtmma"), f", s AS (SELECT code, d, close - {lag('close', 12)} AS mtm FROM bars) SELECT code, d, round(mtm, 4) AS mtm, round({roll('avg', 'mtm', 6)}, 4) AS mtmma FROM s")
indicator("roc", I.roc, ("roc", "rocma"), f", s AS (SELECT code, d, 100 * (close - {lag('close', 12)}) / {lag('close', 12)} AS roc FROM bars) SELECT code, d, round(roc, 4) AS roc, round({roll('avg', 'roc', 6)}, 4) AS rocma FROM s")
indicator("bias", lambda b: I.bias(b, 6, 12), ("bias6", "bias12"), f", s AS (SELECT code, d, close, {roll('avg', 'close', 6)} AS a, {roll('avg', 'close', 12)} AS b FROM bars) SELECT code, d, round((close - a) * 100 / a, 4) AS bias6, round((close - b) * 100 / b, 4) AS bias12 FROM s")
indicator("wr", lambda b: I.wr(b, 10, 6), ("wr10", "wr6"), f", s AS (SELECT code, d, close, {roll('max', 'high', 10)} AS h, {roll('min', 'low', 10)} AS l, {roll('max', 'high', 6)} AS h6, {roll('min', 'low', 6)} AS l6 FROM bars) SELECT code, d, round(100 * (h - close) / nullif(h - l, 0), 4) AS wr10, round(100 * (h6 - close) / nullif(h6 - l6, 0), 4) AS wr6 FROM s")
TR = f"CASE WHEN abs({lag('close')} - low) IS NULL THEN NULL ELSE greatest(high - low, abs({lag('close')} - high), abs({lag('close')} - low)) END"
indicator("atr", I.atr, ("tr", "atr"), f", s AS (SELECT code, d, {TR} AS tr FROM bars) SELECT code, d, round(tr, 4) AS tr, round({roll('avg', 'tr', 14)}, 4) AS atr FROM s")
indicator("vstd", I.vstd, ("vstd",), f"SELECT code, d, round({roll('stddev_samp', 'volume', 10)}, 4) AS vstd FROM bars")
indicator("vr", I.vr, ("vr",), f", s AS (SELECT code, d, CASE WHEN close > {lag('close')} THEN volume ELSE 0.0 END AS u, CASE WHEN close <= {lag('close')} THEN volume ELSE 0.0 END AS n FROM bars) SELECT code, d, round(({roll('sum', 'u', 26)}) / nullif({roll('sum', 'n', 26)}, 0) * 100, 4) AS vr FROM s")
indicator("arbr", I.arbr, ("ar", "br"), f", s AS (SELECT code, d, high - open AS a, open - low AS b, CASE WHEN 0.0 > high - {lag('close')} THEN 0.0 ELSE high - {lag('close')} END AS c, CASE WHEN 0.0 > {lag('close')} - low THEN 0.0 ELSE {lag('close')} - low END AS e FROM bars) SELECT code, d, round(({roll('sum', 'a', 26)}) / nullif({roll('sum', 'b', 26)}, 0) * 100, 4) AS ar, round(({roll('sum', 'c', 26)}) / nullif({roll('sum', 'e', 26)}, 0) * 100, 4) AS br FROM s")
indicator("mfi", I.mfi, ("mfi",), f", t AS (SELECT *, (high + low + close) / 3 AS t FROM bars), s AS (SELECT code, d, CASE WHEN t > {lag('t')} THEN t * volume ELSE 0.0 END AS p, CASE WHEN t < {lag('t')} THEN t * volume ELSE 0.0 END AS n FROM t) SELECT code, d, round(100 - 100 / (1 + ({roll('sum', 'p', 14)}) / nullif({roll('sum', 'n', 14)}, 0)), 4) AS mfi FROM s")
indicator("obv", I.obv, ("obv",), f", s AS (SELECT code, d, CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0.0 END AS m FROM bars) SELECT code, d, round(sum(m) {over(0)} / 10000, 4) AS obv FROM s")
indicator("pvt", I.pvt, ("pvt", "vpt", "mavpt"), f", s AS (SELECT code, d, coalesce(volume * (close - {lag('close')}) / {lag('close')}, 0) AS m FROM bars), v AS (SELECT code, d, sum(m) {over(0)} AS pvt, {roll('sum', 'm', 51)} AS vpt FROM s) SELECT code, d, round(pvt, 2) AS pvt, round(vpt, 2) AS vpt, round({roll('avg', 'vpt', 6)}, 2) AS mavpt FROM v")
QUERIES["pvt"] = lambda spark, sf: rounded(I.pvt(D.day_bars(spark, sf)), "code", "d", "pvt", "vpt", "mavpt", digits=2)
indicator("cho", I.cho, ("cho", "macho"), f", s AS (SELECT code, d, coalesce(volume * (2 * close - high - low) / nullif(high + low, 0), 0) AS v FROM bars), m AS (SELECT code, d, sum(v) {over(0)} AS m FROM s), c AS (SELECT code, d, ({roll('avg', 'm', 10)}) - ({roll('avg', 'm', 20)}) AS cho FROM m) SELECT code, d, round(cho, 4) AS cho, round({roll('avg', 'cho', 6)}, 4) AS macho FROM c")
indicator("mike", I.mike, ("wr_", "mr", "sr", "ws", "ms", "ss"), f", s AS (SELECT code, d, (high + low + close) / 3 AS t, {roll('max', 'high', 12)} AS h, {roll('min', 'low', 12)} AS l FROM bars) SELECT code, d, round(t + t - l, 4) AS wr_, round(t + h - l, 4) AS mr, round(2 * h - l, 4) AS sr, round(t - (h - t), 4) AS ws, round(t - (h - l), 4) AS ms, round(2 * l - h, 4) AS ss FROM s")
indicator("cci", I.cci, ("cci",), f""", r AS (SELECT *, (high + low + close) / 3 AS t, row_number() OVER ({PER}) AS k FROM bars), m AS (SELECT a.code, a.d, any_value(a.t) AS t, avg(b.t) AS mean, count(*) AS n FROM r a JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 13 AND a.k GROUP BY 1, 2)
SELECT a.code, a.d, CASE WHEN any_value(m.n) = 14 THEN round((any_value(m.t) - any_value(m.mean)) / (0.015 * avg(abs(b.t - m.mean)) + 1e-8), 4) END AS cci FROM r a JOIN m ON a.code = m.code AND a.d = m.d JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 13 AND a.k GROUP BY 1, 2""")
indicator("dmi", I.dmi, ("di1", "di2", "adx", "adxr"), f""", x AS (SELECT code, d, {TR} AS tr, high - {lag('high')} AS hd, {lag('low')} - low AS ld FROM bars), y AS (SELECT code, d, tr, CASE WHEN hd > 0 AND hd > ld THEN hd ELSE 0.0 END AS u, CASE WHEN ld > 0 AND ld > hd THEN ld ELSE 0.0 END AS w FROM x),
z AS (SELECT code, d, ({roll('sum', 'u', 14)}) * 100 / nullif({roll('sum', 'tr', 14)}, 0) AS di1, ({roll('sum', 'w', 14)}) * 100 / nullif({roll('sum', 'tr', 14)}, 0) AS di2 FROM y), q AS (SELECT *, abs(di2 - di1) / nullif(di1 + di2, 0) * 100 AS dx FROM z), v AS (SELECT *, {roll('avg', 'dx', 6)} AS adx FROM q)
SELECT code, d, round(di1, 4) AS di1, round(di2, 4) AS di2, round(adx, 4) AS adx, round((adx + {lag('adx', 6)}) / 2, 4) AS adxr FROM v""")
indicator("cr", I.cr, ("cr", "crma1", "crma2", "crma3"), f""", m AS (SELECT *, (high + low + close) / 3 AS m FROM bars), s AS (SELECT code, d, CASE WHEN 0.0 > high - {lag('m')} THEN 0.0 ELSE high - {lag('m')} END AS a, CASE WHEN 0.0 > {lag('m')} - low THEN 0.0 ELSE {lag('m')} - low END AS b FROM m),
c AS (SELECT code, d, ({roll('sum', 'a', 26)}) / nullif({roll('sum', 'b', 26)}, 0) * 100 AS cr FROM s), v AS (SELECT *, {roll('avg', 'cr', 5)} AS a, {roll('avg', 'cr', 10)} AS b, {roll('avg', 'cr', 20)} AS e FROM c) SELECT code, d, round(cr, 4) AS cr, round({lag('a', 3)}, 4) AS crma1, round({lag('b', 5)}, 4) AS crma2, round({lag('e', 9)}, 4) AS crma3 FROM v""")
indicator("adtm", I.adtm, ("adtm", "maadtm"), f""", s AS (SELECT code, d, CASE WHEN open <= {lag('open')} THEN 0.0 ELSE greatest(high - open, open - {lag('open')}) END AS x, CASE WHEN open >= {lag('open')} THEN 0.0 ELSE greatest(open - low, open - {lag('open')}) END AS y FROM bars), t AS (SELECT code, d, {roll('sum', 'x', 23)} AS a, {roll('sum', 'y', 23)} AS b FROM s),
v AS (SELECT code, d, CASE WHEN a > b THEN (a - b) / nullif(a, 0) WHEN a = b THEN 0.0 ELSE (a - b) / nullif(b, 0) END AS adtm FROM t) SELECT code, d, round(adtm, 4) AS adtm, round({roll('avg', 'adtm', 8)}, 4) AS maadtm FROM v""")
indicator("asi", I.asi, ("asi", "asit"), f""", l AS (SELECT *, {lag('close')} AS lc, {lag('open')} AS lo, {lag('low')} AS ll FROM bars), a AS (SELECT code, d, abs(high - lc) AS aa, abs(low - lc) AS bb, abs(high - ll) AS cc, abs(lc - lo) AS dd, close - lc + (close - open) / 2 + lc - lo AS x FROM l),
s AS (SELECT code, d, 16 * x / nullif(CASE WHEN aa > bb AND aa > cc THEN aa + bb / 2 + dd / 4 WHEN bb > cc AND bb > aa THEN bb + aa / 2 + dd / 4 ELSE cc + dd / 4 END, 0) * greatest(aa, bb) AS si FROM a), v AS (SELECT code, d, {roll('sum', 'si', 26)} AS asi FROM s) SELECT code, d, round(asi, 2) AS asi, round({roll('avg', 'asi', 10)}, 2) AS asit FROM v""")
QUERIES["asi"] = lambda spark, sf: rounded(I.asi(D.day_bars(spark, sf)), "code", "d", "asi", "asit", digits=2)
indicator("stoch", I.stoch, ("fastk", "slowk", "slowd"), f", s AS (SELECT code, d, (close - ({roll('min', 'low', 5)})) * 100 / nullif(({roll('max', 'high', 5)}) - ({roll('min', 'low', 5)}), 0) AS fastk FROM bars), k AS (SELECT *, {roll('avg', 'fastk', 3)} AS slowk FROM s) SELECT code, d, round(fastk, 4) AS fastk, round(slowk, 4) AS slowk, round({roll('avg', 'slowk', 3)}, 4) AS slowd FROM k")
indicator("linear_regression", I.linear, ("linearreg", "slope", "intercept", "angle"), f", r AS (SELECT *, row_number() OVER ({PER}) AS k FROM bars), s AS (SELECT code, d, {last_if_full('regr_slope(close, k)', 'close', 14)} AS s, {roll('avg', 'close', 14)} AS m FROM r) SELECT code, d, round(m + 6.5 * s, 3) AS linearreg, round(s, 3) AS slope, round(m - 6.5 * s, 3) AS intercept, round(degrees(atan(s)), 3) AS angle FROM s")
QUERIES["linear_regression"] = lambda spark, sf: rounded(I.linear(D.day_bars(spark, sf)), "code", "d", "linearreg", "slope", "intercept", "angle", digits=3)
indicator("correlation", I.correlation, ("correl",), f"SELECT code, d, round({last_if_full('corr(high, low)', 'close', 5)}, 4) AS correl FROM bars")
indicator("ad_line", I.ad_line, ("ad",), f", s AS (SELECT code, d, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS f FROM bars) SELECT code, d, round(sum(f) {over(0)}, 4) AS ad FROM s")
indicator("price_transforms", I.price_transforms, ("avgprice", "bop"), "SELECT code, d, round((open + high + low + close) / 4, 4) AS avgprice, round(coalesce((close - open) / nullif(high - low, 0), 0), 4) AS bop FROM bars")
indicator("aroon", I.aroon, ("aroonup", "aroondown", "aroonosc"), f""", r AS (SELECT *, row_number() OVER ({PER}) AS k FROM bars), s AS (SELECT a.code, a.d, count(*) AS n, arg_max(b.k, (b.high, b.k)) - any_value(a.k) AS u, arg_min(b.k, (b.low, -b.k)) - any_value(a.k) AS v FROM r a JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 14 AND a.k GROUP BY 1, 2)
SELECT code, d, CASE WHEN n > 14 THEN round(100.0 * (14 + u) / 14, 4) END AS aroonup, CASE WHEN n > 14 THEN round(100.0 * (14 + v) / 14, 4) END AS aroondown, CASE WHEN n > 14 THEN round(100.0 * (14 + u) / 14 - 100.0 * (14 + v) / 14, 4) END AS aroonosc FROM s""")
QUERIES["candles"] = lambda spark, sf: candles.candles(D.day_bars(spark, sf)).drop("open", "high", "low", "close", "volume", "amount")
B1 = "abs(close - open) AS body, high - low AS rng"
indicator("candles_basic", lambda b: candles.candles(b, "doji", "engulfing", "marubozu", "piercing"), ("doji", "engulfing", "marubozu", "piercing"), f""", m AS (SELECT *, {B1} FROM bars),
n AS (SELECT *, avg(body) OVER ({PER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mb, avg(rng) OVER ({PER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mr, {lag('open')} AS po, {lag('close')} AS pc, {lag('low')} AS pl, {lag('body')} AS pb FROM m),
o AS (SELECT *, {lag('mb')} AS pmb, high - greatest(open, close) <= 0.1 * mr AS nu, least(open, close) - low <= 0.1 * mr AS nl FROM n)
SELECT code, d, CASE WHEN body <= 0.1 * mr THEN 100 ELSE 0 END AS doji, CASE WHEN close >= open AND pc < po AND close >= po AND open <= pc AND body > pb THEN 100 WHEN close < open AND pc >= po AND open >= pc AND close <= po AND body > pb THEN -100 ELSE 0 END AS engulfing,
  CASE WHEN body > mb AND nu AND nl AND close >= open THEN 100 WHEN body > mb AND nu AND nl AND close < open THEN -100 ELSE 0 END AS marubozu, CASE WHEN pc < po AND pb > pmb AND close >= open AND body > mb AND open < pl AND close > (po + pc) / 2 AND close < po THEN 100 ELSE 0 END AS piercing FROM o""")


# ---- resampling ---------------------------------------------------------------------------------


@query("ticks_to_hours", f"""WITH {TICKS} SELECT code, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume, round(sum(price * vol), 4) AS amount FROM ticks GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(D.hour_bars(spark, sf))


FOUR = """SELECT code, time_bucket(INTERVAL 240 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 240 MINUTE AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume, round(sum(price), 4) AS amount FROM ticks GROUP BY 1, 2"""


@query("ticks_right_closed", f"WITH {TICKS} {FOUR}")
def _(spark, sf):
    return rounded(T.bars_from_ticks(D.ticks(spark, sf), 240, "right"))


HOURS = "hours AS (SELECT code, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume, sum(price * vol) AS amount FROM ticks GROUP BY 1, 2)"


@query("bars_to_longer_bars", f"WITH {TICKS}, {HOURS} SELECT code, time_bucket(INTERVAL 240 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 240 MINUTE AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, round(sum(amount), 4) AS amount FROM hours GROUP BY 1, 2")
def _(spark, sf):
    return rounded(T.minutes(D.hour_bars(spark, sf), 240))


@query("session_bars", f"""WITH {TICKS}, m AS (SELECT *, hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60 AS m, date_trunc('day', ts) AS day FROM ticks), s AS (SELECT *, CASE WHEN m > 570 AND m <= 690 THEN 570 WHEN m > 780 AND m <= 900 THEN 780 END AS o FROM m),
b AS (SELECT *, CAST(ceil((epoch_us(ts) - epoch_us(CAST(day AS TIMESTAMP)) - o * 60000000.0) / 1800000000.0) AS BIGINT) AS k FROM s WHERE o IS NOT NULL)
SELECT code, CAST(day AS TIMESTAMP) + to_minutes(o + 30 * k) AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume FROM b GROUP BY code, day, o, k""")
def _(spark, sf):
    t = D.ticks(spark, sf)
    one = t.select("code", "ts", F.col("price").alias("open"), F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), F.col("vol").alias("volume"))
    return T.minutes(one, 30, sessions=T.DAY_SESSIONS)


@query("auction_bars", f"""WITH {TICKS}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM ticks), k AS (SELECT code, tick_id, price, vol, CASE WHEN m >= 555 AND m < 570 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 570 MINUTE ELSE ts END AS ts, CASE WHEN m >= 555 AND m < 570 THEN 570 ELSE m END AS m FROM m)
SELECT code, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(vol) AS DOUBLE) AS volume, round(sum(price), 4) AS amount FROM k WHERE m BETWEEN 570 AND 690 OR m BETWEEN 780 AND 900 GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(T.auction_merged(D.ticks(spark, sf)))


for _unit, _trunc in (("w", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year")):
    query(f"days_to_{_trunc}s", f"WITH {BARS} SELECT code, CAST(date_trunc('{_trunc}', d) AS DATE) AS period, max(d) AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(volume) AS volume, round(sum(amount), 2) AS amount FROM bars GROUP BY 1, 2")(
        lambda spark, sf, unit=_unit: rounded(T.days(D.day_bars(spark, sf), unit), digits=2)
    )


@query("month_ends", f"""WITH {BARS}, m AS (SELECT code, CAST(date_trunc('month', d) AS DATE) AS month, arg_max(close, d) AS close, arg_min(close, d) AS f FROM bars GROUP BY 1, 2) SELECT code, month, close, round(close - coalesce(lag(close) OVER (PARTITION BY code ORDER BY month), f), 4) AS profit FROM m""")
def _(spark, sf):
    return rounded(T.month_ends(D.day_bars(spark, sf), "close", "code"))


# ---- joins and calendars ------------------------------------------------------------------------

SHARES = "shares AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, CAST(sum(o_custkey) AS DOUBLE) AS shares, CAST(count(*) AS DOUBLE) AS liquidity FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"


def shares(spark, sf):
    o = D.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return o.groupBy(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_custkey").cast("double").alias("shares"), F.count("*").cast("double").alias("liquidity"))


@query("as_of_market_value", f"WITH {BARS}, {SHARES} SELECT b.code, b.d, s.shares, round(close * s.shares * 10000, 0) AS mv, round(close * s.liquidity * 10000, 0) AS liquidity_mv FROM bars b ASOF LEFT JOIN shares s ON b.code = s.code AND b.d >= s.d")
def _(spark, sf):
    return rounded(J.market_value(D.day_bars(spark, sf), shares(spark, sf)), "code", "d", "shares", "mv", "liquidity_mv", digits=0)


@query("adjusted_bars", f"WITH {BARS}, {SHARES} SELECT b.code, b.d, round(close * coalesce(1 / (1 + liquidity), 1), 4) AS close, round(coalesce(1 / (1 + liquidity), 1), 4) AS adj FROM bars b ASOF LEFT JOIN shares s ON b.code = s.code AND b.d >= s.d")
def _(spark, sf):
    return rounded(J.adjust(D.day_bars(spark, sf), shares(spark, sf).select("code", "d", (1 / (1 + F.col("liquidity"))).alias("adj"))), "code", "d", "close", "adj")


@query("adjustment_factors", f"""WITH {BARS}, {SHARES}, j AS (SELECT b.code, b.d, b.close, coalesce(s.liquidity, 0) AS div FROM bars b LEFT JOIN shares s USING (code, d)), p AS (SELECT *, (lag(close) OVER ({PER}) * 10 - div) / 10 AS preclose FROM j),
s AS (SELECT *, ln(coalesce(lead(preclose) OVER ({PER}) / close, 1)) AS l FROM p) SELECT code, d, round(preclose, 4) AS preclose, round(exp(sum(l) OVER ({PER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS qfq, round(exp(-coalesce(sum(l) OVER ({PER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 4) AS hfq FROM s""")
def _(spark, sf):
    events = shares(spark, sf).select("code", "d", F.col("liquidity").alias("dividend"), F.lit(0.0).alias("bonus"), F.lit(0.0).alias("rights"), F.lit(0.0).alias("rights_price"))
    return rounded(J.adjustment_factors(D.day_bars(spark, sf), events))


@query("missing_ranges", f"""WITH {BARS}, {CAL}, l AS (SELECT code, min(d) AS a, max(d) AS b FROM bars GROUP BY 1), m AS (SELECT l.code, c.d, c.idx FROM l JOIN cal c ON c.d BETWEEN a AND b ANTI JOIN bars x ON x.code = l.code AND x.d = c.d),
i AS (SELECT *, idx - row_number() OVER (PARTITION BY code ORDER BY idx) AS i FROM m) SELECT code, min(d) AS "from", max(d) AS "to", count(*) AS n FROM i GROUP BY code, i""")
def _(spark, sf):
    return J.missing_ranges(D.day_bars(spark, sf), D.calendar(spark, sf))


@query("calendar", f"WITH {CAL} SELECT d, idx FROM cal")
def _(spark, sf):
    return D.calendar(spark, sf)


EVENT_DAYS = "e AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def event_days(spark, sf):
    return D.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()


@query("calendar_snap", f"WITH {CAL}, {EVENT_DAYS} SELECT e.d, (SELECT max(c.d) FROM cal c WHERE c.d <= e.d) AS back, (SELECT min(c.d) FROM cal c WHERE c.d >= e.d) AS forward FROM e")
def _(spark, sf):
    cal = D.calendar(spark, sf)
    back = dates.snap(event_days(spark, sf), cal).withColumnRenamed("snapped", "back")
    return dates.snap(back, cal, towards="forward").withColumnRenamed("snapped", "forward")


@query("calendar_shift", f"WITH {CAL}, {EVENT_DAYS}, s AS (SELECT e.d, (SELECT max(c.idx) FROM cal c WHERE c.d <= e.d) AS i FROM e) SELECT s.d, c.d AS shifted FROM s LEFT JOIN cal c ON c.idx = s.i + 5")
def _(spark, sf):
    return dates.shift_days(event_days(spark, sf), D.calendar(spark, sf), 5)


@query("calendar_gap", f"WITH {CAL} SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b, (SELECT c.idx FROM cal c WHERE c.d = max(CAST(o_orderdate AS DATE))) - (SELECT c.idx FROM cal c WHERE c.d = min(CAST(o_orderdate AS DATE))) + 1 AS days FROM orders GROUP BY 1")
def _(spark, sf):
    life = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return dates.gap(life, D.calendar(spark, sf), "a", "b")


@query("neighbour_correlation", f"WITH {BARS}, {CAL}, x AS (SELECT code, idx, close FROM bars JOIN cal USING (d)) SELECT a.idx, CASE WHEN isnan(corr(a.close, b.close)) THEN NULL ELSE round(corr(a.close, b.close), 4) END AS corr, count(*) AS n FROM x a JOIN x b ON a.code = b.code AND b.idx = a.idx - 1 GROUP BY 1 HAVING count(*) > 2")
def _(spark, sf):
    return rounded(J.neighbours(D.day_bars(spark, sf).select("code", "d", "close"), D.calendar(spark, sf), "close").where("n > 2"))


@query("natural_left_join", "SELECT n_nationkey, n_name, n_regionkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2, 3")
def _(spark, sf):
    s = D.table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").select("n_nationkey", "s_suppkey")
    return J.natural_left(D.table(spark, sf, "nation"), s).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count("s_suppkey").alias("n"))


@query("unpivot_prices", f"WITH {BARS} SELECT code, d, field, price FROM (UNPIVOT (SELECT code, d, open, high, low, close FROM bars) ON open, high, low, close INTO NAME field VALUE price)")
def _(spark, sf):
    return J.unpivoted(D.day_bars(spark, sf).select("code", "d", "open", "high", "low", "close"), ["code", "d"], "field", "price")


# ---- sets, order, scalars -----------------------------------------------------------------------


@query("union_distinct", f"WITH {BARS} SELECT code, d FROM bars WHERE d < DATE '1997-01-01' UNION SELECT code, d FROM bars WHERE d < DATE '1998-01-01' AND code = '5-LOW'")
def _(spark, sf):
    b = D.day_bars(spark, sf).select("code", "d")
    return B.union_distinct(b.where("d < '1997-01-01'"), b.where("d < '1998-01-01' and code = '5-LOW'"))


@query("difference_by_key", f"WITH {BARS} SELECT code, d, close FROM bars WHERE NOT (d BETWEEN DATE '1996-01-01' AND DATE '2000-01-01')")
def _(spark, sf):
    b = D.day_bars(spark, sf)
    return B.difference(b.select("code", "d", "close"), b.where("d between '1996-01-01' and '2000-01-01'"))


@query("latest_by_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _(spark, sf):
    o = D.table(spark, sf, "orders").withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return B.latest(o, "o_custkey", "seq").select("o_custkey", "o_orderkey", "o_totalprice")


@query("top_by_group", """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS grp, o_orderkey AS code, o_totalprice AS score FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY d, grp ORDER BY score DESC, code) AS g FROM t)
SELECT d, grp, code, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rank FROM g WHERE g <= 1) WHERE rank <= 3""")
def _(spark, sf):
    t = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("code"), F.col("o_totalprice").alias("score"))
    return B.top_by_group(t, "score", 3, 1, "grp")


@query("date_scalars", """SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS i, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month, CAST(date_trunc('week', ts) + INTERVAL 7 DAY AS TIMESTAMP) AS next_week,
  time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS next_quarter_hour, hour(ts) >= 9 AND hour(ts) < 15 AS in_hours FROM events""")
def _(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select("event_id", dates.date_to_int("ts").alias("i"), dates.next_period("ts", "M").alias("next_month"), dates.next_period("ts", "W").alias("next_week"), dates.next_period("ts", "15min").alias("next_quarter_hour"), dates.hours_between("ts", gte=9, lt=15).alias("in_hours"))


@query("code_scalars", """WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 397 % 1000000 AS VARCHAR), 6, '0') AS code FROM part) SELECT p_partkey, code, code || CASE WHEN starts_with(code, '6') THEN '.XSHG' ELSE '.XSHE' END AS full_code,
  CASE WHEN code[1:3] IN ('688', '689') THEN 'star' WHEN code[1:3] IN ('300', '301') THEN 'gem' WHEN code[1:1] = '8' OR code[1:2] = '43' THEN 'bse' ELSE 'main' END AS segment,
  CASE WHEN code[1:1] = '6' THEN 'stock_cn' WHEN code[1:3] IN ('000', '880') THEN 'index_cn' WHEN code[1:2] IN ('51', '58') THEN 'etf_cn' WHEN code[1:3] IN ('102', '110', '113', '120', '122', '124', '130', '132', '133', '134', '135', '136', '140', '141', '143', '144', '147', '148') THEN 'bond_cn' ELSE 'undefined' END AS kind FROM c""")
def _(spark, sf):
    c = D.table(spark, sf, "part").select("p_partkey", dates.code_text(F.col("p_partkey") * 397 % 1_000_000).alias("code"))
    return c.select("p_partkey", "code", dates.with_exchange("code").alias("full_code"), dates.segment("code").alias("segment"), dates.security_kind("code", True).alias("kind"))


@query("json_and_keys", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha1(event_type || '|' || CAST(user_id AS VARCHAR))[1:16] AS cache_key FROM events")
def _(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), dates.cache_key("event_type", F.col("user_id").cast("string")).alias("cache_key"))


@query("order_directions", "WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 9 AS INT) - 4 AS k FROM orders) SELECT o_orderkey, CASE WHEN k > 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN k IN (1, 2, -2) THEN 'OPEN' WHEN k IN (-1, 3, -3) THEN 'CLOSE' WHEN k IN (4, -4) THEN 'CLOSETODAY' END AS \"offset\" FROM o".replace("\\", ""))
def _(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", dates.direction((F.col("o_orderkey") % 9).cast("int") - 4).alias("x"))
    return o.select("o_orderkey", "x.side", "x.offset")


@query("months_between", "SELECT code, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))::DATE AS start FROM (SELECT o_orderpriority AS code, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)")
def _(spark, sf):
    life = D.day_bars(spark, sf).groupBy("code").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return life.select("code", F.explode(dates.months_between_days("a", "b")).alias("m")).select("code", "m.start")


# ---- signals ------------------------------------------------------------------------------------


@query("run_lengths", f"""WITH {BARS}, c AS (SELECT code, d, CASE WHEN close > open THEN 1 ELSE 0 END AS x FROM bars), i AS (SELECT *, sum(1 - x) {over(0)} AS i, row_number() OVER ({PER}) AS p FROM c)
SELECT code, d, CASE WHEN x = 1 THEN CAST(sum(x) OVER (PARTITION BY code, i ORDER BY d) AS BIGINT) ELSE 0 END AS run, p - coalesce(max(CASE WHEN x = 1 THEN p END) {over(0)}, 0) AS since FROM i""")
def _(spark, sf):
    b = D.day_bars(spark, sf).withColumn("x", (F.col("close") > F.col("open")).cast("int"))
    return G.since_last(G.run_length(b, "x"), "x").select("code", "d", F.col("run").cast("long").alias("run"), "since")


@query("momentum", f"WITH {BARS} SELECT code, d, round(close / {lag('close', 24)} - 1 - 0.02, 4) AS momentum FROM bars")
def _(spark, sf):
    return rounded(G.momentum(D.day_bars(spark, sf)), "code", "d", "momentum")


@query("peaks", f"""WITH {BARS}, m AS (SELECT code, d, avg(close) OVER ({PER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM bars), e AS (SELECT *, max(m) OVER x AS t, min(m) OVER x AS b, count(m) OVER x AS n FROM m WINDOW x AS ({PER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT code, d, CAST(n = 11 AND m = t AS INT) AS peak, CAST(n = 11 AND m = b AS INT) AS trough FROM e""")
def _(spark, sf):
    return G.peaks(D.day_bars(spark, sf)).select("code", "d", "peak", "trough")


QUERIES["longest_sequences"] = lambda spark, sf: rounded(G.longest_sequences(D.day_bars(spark, sf)))
QUERIES["renko"] = lambda spark, sf: rounded(G.renko_bricks(D.day_bars(spark, sf), 20_000.0))
QUERIES["renko_percent"] = lambda spark, sf: rounded(G.renko_bricks(D.day_bars(spark, sf), 0.1, True))

# ---- factors ------------------------------------------------------------------------------------


def factor_rows(spark, sf):
    """Supplier by month: factor = mean discount, return = next month's relative change of revenue."""
    l = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "month").alias("d")).agg(F.avg("l_discount").alias("factor"), S.exact_sum("l_extendedprice").alias("close"), F.avg("l_quantity").alias("size"))
    return l.withColumn("ret", F.lead("close").over(I.W()) / F.col("close") - 1)


FACTOR = f"f AS (SELECT *, lead(close) OVER ({PER}) / close - 1 AS ret FROM (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_discount) AS factor, sum(l_extendedprice) AS close, avg(l_quantity) AS size FROM lineitem GROUP BY 1, 2))"


@query("forward_returns", f"WITH {BARS} SELECT code, d, round(lead(open, 6) OVER ({PER}) / lead(open, 1) OVER ({PER}) - 1, 4) AS ret, round(lead(close, 5) OVER ({PER}) / close - 1, 4) AS ret_close FROM bars")
def _(spark, sf):
    return rounded(Q.forward_returns(Q.forward_returns(D.day_bars(spark, sf)), 5, "close", "ret_close"), "code", "d", "ret", "ret_close")


@query("information_coefficient", f"""WITH {FACTOR}, p AS (SELECT * FROM f WHERE factor IS NOT NULL AND ret IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY factor) + (count(*) OVER (PARTITION BY d, factor) - 1) / 2 AS a, rank() OVER (PARTITION BY d ORDER BY ret) + (count(*) OVER (PARTITION BY d, ret) - 1) / 2 AS b FROM p)
SELECT d, count(*) AS n, round(corr(factor, ret), 4) AS ic, round(corr(a, b), 4) AS rank_ic FROM r GROUP BY 1 HAVING count(*) > 2""")
def _(spark, sf):
    return rounded(Q.ic(factor_rows(spark, sf)).where("n > 2"))


@query("pooled_ic", f"WITH {FACTOR} SELECT count(*) AS n, round(corr(factor, ret), 4) AS ic FROM f WHERE ret IS NOT NULL")
def _(spark, sf):
    return rounded(Q.pooled_ic(factor_rows(spark, sf)))


@query("ic_decay", f"WITH {FACTOR}, x AS (SELECT factor, unnest([1, 2, 3, 5, 10]) AS lag, unnest([lead(close, 1) OVER w, lead(close, 2) OVER w, lead(close, 3) OVER w, lead(close, 5) OVER w, lead(close, 10) OVER w]) / close - 1 AS ret FROM f WINDOW w AS ({PER})) SELECT lag, round(corr(factor, ret), 4) AS ic FROM x WHERE ret IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rounded(Q.ic_decay(factor_rows(spark, sf), "factor"))


@query("standardized", f"WITH {FACTOR} SELECT code, d, round((factor - avg(factor) OVER (PARTITION BY d)) / nullif(stddev_samp(factor) OVER (PARTITION BY d), 0), 4) AS factor_z FROM f")
def _(spark, sf):
    return rounded(Q.standardize(factor_rows(spark, sf), "factor"), "code", "d", "factor_z")


@query("winsorized", f"WITH {FACTOR}, q AS (SELECT d, quantile_cont(factor, 0.01) AS a, quantile_cont(factor, 0.99) AS b FROM f GROUP BY 1) SELECT code, f.d, round(least(greatest(factor, a), b), 7) AS factor_w FROM f JOIN q ON f.d = q.d")
def _(spark, sf):
    return rounded(Q.winsorize(factor_rows(spark, sf), "factor"), "code", "d", "factor_w", digits=7)


@query("quantile_returns", f"WITH {FACTOR}, q AS (SELECT d, quantile_cont(size, [0.2, 0.4, 0.6, 0.8]) AS q FROM f GROUP BY 1), b AS (SELECT ret, 1 + (size > q[1])::INT + (size > q[2])::INT + (size > q[3])::INT + (size > q[4])::INT AS bin FROM f JOIN q ON f.d = q.d) SELECT bin, round(avg(ret), 4) AS ret, count(ret) AS n FROM b GROUP BY 1")
def _(spark, sf):
    return rounded(Q.quantile_returns(factor_rows(spark, sf), "size"))


@query("above_quantile", f"WITH {FACTOR}, q AS (SELECT d, quantile_cont(close, 0.95) AS q FROM f GROUP BY 1) SELECT code, f.d, round(close, 2) AS close FROM f JOIN q ON f.d = q.d WHERE close > q")
def _(spark, sf):
    return rounded(Q.above_quantile(factor_rows(spark, sf), "close", 0.95), "code", "d", "close", digits=2)


@query("neutral_residual", f"WITH {FACTOR}, s AS (SELECT regr_slope(factor, size) AS b, regr_intercept(factor, size) AS a FROM f) SELECT code, d, round(factor - a - b * size, 4) AS residual FROM f, s")
def _(spark, sf):
    return rounded(Q.neutral(factor_rows(spark, sf), "factor", ["size"]), "code", "d", "residual")


@query("combined_factor", f"WITH {FACTOR}, c AS (SELECT corr(factor, ret) AS a, corr(size, ret) AS b FROM f) SELECT code, d, round(factor * a / (abs(a) + abs(b)) + size * b / (abs(a) + abs(b)), 4) AS combined FROM f, c")
def _(spark, sf):
    return rounded(Q.combine(factor_rows(spark, sf), ["factor", "size"]), "code", "d", "combined")


@query("factor_turnover", f"""WITH {FACTOR}, r AS (SELECT code, (year(d) - 1995) * 12 + month(d) AS idx, rank() OVER (PARTITION BY d ORDER BY factor) + (count(*) OVER (PARTITION BY d, factor) - 1) / 2 AS r FROM f) SELECT a.idx, round(1 - corr(a.r, b.r), 4) AS turnover FROM r a JOIN r b ON a.code = b.code AND b.idx = a.idx - 1 GROUP BY 1 HAVING count(*) > 2""")
def _(spark, sf):
    rows = factor_rows(spark, sf).withColumn("idx", (F.year("d") - 1995) * 12 + F.month("d"))
    return rounded(Q.turnover(rows).where("turnover is not null and not isnan(turnover)"))


@query("walk_forward", f"""WITH {FACTOR}, r AS (SELECT factor, ret, (year(d) - 1995) * 12 + month(d) AS idx FROM f WHERE ret IS NOT NULL), w AS (SELECT k AS fold, 12 * k AS a, 12 * k + 24 AS b, 12 * k + 36 AS e FROM generate_series(0, 3) g(k)),
s AS (SELECT fold, a, b, e, (SELECT regr_slope(ret, factor) FROM r WHERE idx >= a AND idx < b) AS beta FROM w) SELECT CAST(fold AS INT) AS fold, round(beta, 4) AS beta, round((SELECT avg(sign(beta * factor) * ret) FROM r WHERE idx >= b AND idx < e), 4) AS oos FROM s""")
def _(spark, sf):
    rows = factor_rows(spark, sf).where("ret is not null").withColumn("idx", (F.year("d") - 1995) * 12 + F.month("d"))
    return rounded(Q.walk_forward(rows, "idx", Q.folds(72, 24, 12)))


# ---- risk ---------------------------------------------------------------------------------------

MONTHS = f"c AS (SELECT o_orderpriority AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, v / lag(v) OVER ({PER}) - 1 AS ret FROM c)"


def curves(spark, sf):
    return D.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.trunc("o_orderdate", "month").alias("d")).agg(F.sum("o_totalprice").alias("v"))


def monthly(spark, sf):
    return K.returns(curves(spark, sf), "v").where("ret is not null")


@query("drawdown", f"WITH {MONTHS} SELECT code, d, round(v / max(v) {over(0)} - 1, 4) AS drawdown FROM c")
def _(spark, sf):
    return rounded(K.drawdown(curves(spark, sf), "v"), "code", "d", "drawdown")


@query("tail_risk", f"WITH {MONTHS}, q AS (SELECT code, -quantile_cont(ret, 0.05) AS var FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT q.code, round(any_value(var), 4) AS var, round(-avg(ret) FILTER (ret <= -var), 4) AS cvar FROM r JOIN q ON r.code = q.code GROUP BY 1")
def _(spark, sf):
    return rounded(K.tail_risk(monthly(spark, sf)))


@query("performance_ratios", f"""WITH {MONTHS} SELECT code, count(ret) AS n, round(exp(sum(ln(1 + ret))) - 1, 4) AS total_return, round(power(exp(sum(ln(1 + ret))), 12.0 / count(ret)) - 1, 4) AS annual_return, round(stddev_samp(ret) * sqrt(12), 4) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(12), 4) AS sharpe,
  round(avg(ret) / stddev_pop(ret) FILTER (ret < 0) * sqrt(12), 4) AS sortino, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(sum(ret) FILTER (ret > 0) / -(sum(ret) FILTER (ret < 0)), 4) AS profit_factor, round(skewness(ret), 4) AS skew, round(kurtosis(ret), 4) AS kurt FROM r WHERE ret IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rounded(K.ratios(monthly(spark, sf), 12))


QUERIES["risk_report"] = lambda spark, sf: rounded(K.report(curves(spark, sf), "v", 12))


@query("losing_streaks", f"WITH {MONTHS}, i AS (SELECT code, ret < 0 AS c, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) {over(0)} AS i FROM r WHERE ret IS NOT NULL), n AS (SELECT code, i, count(*) FILTER (c) AS n FROM i GROUP BY 1, 2) SELECT code, max(n) AS losing_streak FROM n GROUP BY 1")
def _(spark, sf):
    return K.longest_true(monthly(spark, sf), F.col("ret") < 0, "losing_streak")


@query("against_benchmark", f"""WITH {MONTHS}, b AS (SELECT d, avg(ret) AS bench FROM r GROUP BY 1), p AS (SELECT code, ret, bench FROM r JOIN b USING (d) WHERE ret IS NOT NULL)
SELECT code, count(*) AS n, round(covar_samp(ret, bench) / var_pop(bench), 4) AS beta, round(avg(ret) - covar_samp(ret, bench) / var_pop(bench) * avg(bench), 4) AS alpha, round(corr(ret, bench), 4) AS correlation, round(avg(ret) FILTER (bench > 0) / avg(bench) FILTER (bench > 0), 4) AS up_capture,
  round(avg(ret) FILTER (bench < 0) / avg(bench) FILTER (bench < 0), 4) AS down_capture, round(avg(CASE WHEN ret > bench THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM p GROUP BY 1""")
def _(spark, sf):
    m = monthly(spark, sf)
    return rounded(K.against_benchmark(m.join(m.groupBy("d").agg(F.avg("ret").alias("bench")), "d")))


SCENARIOS = [("early", "1996-01-01", "1996-12-31"), ("middle", "1998-01-01", "1998-12-31"), ("late", "2000-01-01", "2001-12-31")]


@query("stress_scenarios", f"""WITH {MONTHS}, s AS (SELECT * FROM (VALUES ('early', DATE '1996-01-01', DATE '1996-12-31'), ('middle', DATE '1998-01-01', DATE '1998-12-31'), ('late', DATE '2000-01-01', DATE '2001-12-31')) v(scenario, a, b)),
j AS (SELECT code, scenario, d, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY code, scenario ORDER BY d)) AS v FROM r JOIN s ON d BETWEEN a AND b WHERE ret IS NOT NULL), k AS (SELECT *, v / max(v) OVER (PARTITION BY code, scenario ORDER BY d) - 1 AS dd FROM j)
SELECT code, scenario, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 4) AS total, round(stddev_samp(ret), 4) AS volatility, round(min(dd), 4) AS max_drawdown FROM k GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(K.stress(monthly(spark, sf), SCENARIOS))


@query("correlation_pairs", f"WITH {MONTHS} SELECT x.code AS a, y.code AS b, round(corr(x.ret, y.ret), 4) AS corr, count(*) AS n FROM r x JOIN r y ON x.d = y.d AND x.code < y.code WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return rounded(K.correlations(monthly(spark, sf)))


QUERIES["monte_carlo"] = lambda spark, sf: rounded(K.monte_carlo(monthly(spark, sf)))


def wide_returns(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    w = monthly(spark, sf).groupBy("d").pivot("code", names).agg(F.first("ret"))
    return w.toDF("d", "a0", "a1", "a2", "a3", "a4"), ["a0", "a1", "a2", "a3", "a4"]


def _weights(spark, sf):
    wide, assets = wide_returns(spark, sf)
    rows = [(m, a, w) for m in ("mvo", "risk_parity", "hrp", "max_div", "black_litterman") for a, w in P.optimize(wide, assets, m, 0.5).items()]
    return rounded(spark.createDataFrame(rows, "method string, asset string, weight double"))


QUERIES["portfolio_weights"] = _weights


def _risk(spark, sf):
    wide, assets = wide_returns(spark, sf)
    r = P.portfolio_risk(wide, dict.fromkeys(assets, 0.2))
    return rounded(spark.createDataFrame([(a, r["volatility"], r["marginal"][a], r["contribution"][a], r["diversification"]) for a in assets], "asset string, volatility double, marginal double, contribution double, diversification double"))


QUERIES["portfolio_risk"] = _risk


def _exposures(spark, sf):
    wide, assets = wide_returns(spark, sf)
    e = K.exposures(wide, "a0", assets[1:])
    return rounded(spark.createDataFrame([(n, b, t, e["r2"]) for n, b, t in zip(["const", *assets[1:]], e["beta"], e["t"])], "factor string, beta double, t double, r2 double"))


QUERIES["factor_exposures"] = _exposures

# ---- market rules and backtests -----------------------------------------------------------------


@query("market_limits", f"WITH {BARS}, p AS (SELECT *, coalesce({lag('close')}, open) AS pc FROM bars) SELECT code, d, round(pc, 2) AS prev_close, round(pc * 1.1, 1) AS up1, round(high - low, 4) AS price_range FROM p")
def _(spark, sf):
    m = M.with_limits(D.day_bars(spark, sf))
    return m.select("code", "d", F.round("prev_close", 2).alias("prev_close"), F.round(F.col("prev_close") * 1.1, 1).alias("up1"), F.round("price_range", 4).alias("price_range"))


@query("slippage_and_fees", f"""WITH {TRADES}, s AS (SELECT price, volume, CASE WHEN side = 'A' THEN 'BUY' ELSE 'SELL' END AS s FROM trades) SELECT s AS side, count(*) AS n, round(sum(CASE WHEN s = 'BUY' THEN price + 0.02 ELSE price - 0.02 END), 0) AS fixed, round(sum(CASE WHEN s = 'BUY' THEN price * 1.001 ELSE price * 0.999 END), 0) AS percent,
  round(sum(greatest(price * volume * 0.00025, 5.0) + CASE WHEN s = 'SELL' THEN price * volume * 0.001 ELSE 0 END), 1) AS fees FROM s GROUP BY 1""")
def _(spark, sf):
    t = D.trades(spark, sf).withColumn("s", F.when(F.col("side") == "A", "BUY").otherwise("SELL"))
    raw = lambda m, v: F.sum(F.when(F.col("s") == "BUY", F.col("price") + v if m == "fixed" else F.col("price") * (1 + v)).otherwise(F.col("price") - v if m == "fixed" else F.col("price") * (1 - v)))
    g = t.withColumnsRenamed({"side": "flag", "s": "side"}).withColumn("s", F.col("side"))
    return g.groupBy("side").agg(F.count("*").alias("n"), F.round(raw("fixed", 0.02), 0).alias("fixed"), F.round(raw("percent", 0.001), 0).alias("percent"), F.round(F.sum(M.commission("price", "volume")), 1).alias("fees"))


@query("order_checks", """WITH o AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq, o_totalprice AS price, CAST(o_totalprice < 5000 AS INT) AS halted FROM orders), h AS (SELECT *, max(halted) OVER (PARTITION BY account ORDER BY seq) AS h, row_number() OVER (PARTITION BY account, d ORDER BY seq) AS k FROM o)
SELECT seq, CASE WHEN h = 1 THEN 'halted' WHEN price > 400000 THEN 'order_value' WHEN k > 1 THEN 'daily_trades' WHEN price > 0.3 * 1000000 THEN 'position_weight' ELSE 'ok' END AS verdict FROM h""")
def _(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1).alias("amount"), F.lit(1_000_000.0).alias("equity"), (F.col("o_totalprice") < 5000).cast("int").alias("halted"))
    return M.check_orders(o, 400_000, 1, 0.3).select("seq", "verdict")


@query("account_equity", """SELECT c_custkey AS account, round(c_acctbal + sum(o_shippriority_qty * price), 2) AS equity FROM (SELECT c_custkey, c_acctbal, o_orderpriority, 1.0 AS o_shippriority_qty, coalesce(p.price, o_totalprice) AS price FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT o_orderpriority AS code, max(o_totalprice) AS price FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) p ON p.code = o_orderpriority) GROUP BY c_custkey, c_acctbal""")
def _(spark, sf):
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer")
    pos = c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"), F.col("o_orderpriority").alias("code"), F.lit(1.0).alias("quantity"), F.col("o_totalprice").alias("avg_price"))
    price = o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("code")).agg(F.max("o_totalprice").alias("price"))
    return rounded(M.account_equity(pos, price), digits=2)


@query("cross_section_weights", f"WITH {FACTOR} SELECT code, d, round(CASE WHEN stddev_pop(size) OVER p > 1e-9 THEN (size - avg(size) OVER p) / stddev_pop(size) OVER p ELSE 0 END, 4) AS size_z, round(least(exp(size - max(size) OVER p) / sum(e) OVER p, 0.5), 4) AS weight FROM (SELECT *, exp(size - max(size) OVER (PARTITION BY d)) AS e FROM f) WINDOW p AS (PARTITION BY d)")
def _(spark, sf):
    return rounded(M.softmax_weights(M.cross_section_z(factor_rows(spark, sf), "size"), "size", 1.0, 0.5), "code", "d", "size_z", "weight")


@query("vector_backtest", f"""WITH {FACTOR}, t AS (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY factor DESC, code) AS k FROM f), h AS (SELECT f.code, f.d, coalesce(f.ret, 0) AS ret, CASE WHEN t.k <= 10 THEN 0.1 ELSE 0.0 END AS w FROM f JOIN t ON f.code = t.code AND f.d = t.d),
c AS (SELECT *, abs(w - coalesce(lag(w) OVER ({PER}), 0)) AS traded FROM h) SELECT d, round(sum(w * ret) - 0.001 * sum(traded), 4) AS ret, round(sum(traded), 4) AS traded FROM c GROUP BY 1""")
def _(spark, sf):
    f = factor_rows(spark, sf)
    return rounded(backtest.vector_backtest(f, backtest.target_positions(f.withColumn("score", F.col("factor")), 10), 0.001))


@query("holding_backtest", f"""WITH {BARS}, b AS (SELECT code, d, lead(open) OVER ({PER}) AS buy, lead(close, 5) OVER ({PER}) AS sell, close > 2 * open AS s FROM bars), n AS (SELECT d, count(*) AS n FROM b WHERE s GROUP BY 1)
SELECT code, b.d, CAST(floor(100000000.0 / 5 / n / buy / 100) * 100 AS BIGINT) AS lots, round(floor(100000000.0 / 5 / n / buy / 100) * 100 * (sell - buy), 2) AS pnl FROM b JOIN n ON b.d = n.d WHERE s AND buy IS NOT NULL AND sell IS NOT NULL""")
def _(spark, sf):
    b = D.day_bars(spark, sf)
    return rounded(backtest.holding_backtest(b, b.where("close > 2 * open").select("code", "d"), 5, 1e8), digits=2)


def account_orders(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("amount"))


QUERIES["accounts"] = lambda spark, sf: rounded(backtest.accounts(account_orders(spark, sf)), "account", "seq", "status", "cash", "position", "avg_price", "realized", digits=7)  # fees are multiples of 0.0000025
QUERIES["attention_scores"] = lambda spark, sf: rounded(backtest.attention_scores(X.base_features(D.day_bars(spark, sf)), ["return_1", "volume_z", "range_ratio"]), "code", "d", "score")

# ---- features -----------------------------------------------------------------------------------


@query("base_features", f"""WITH {BARS}, a AS (SELECT *, close / {lag('close')} - 1 AS r1 FROM bars), f AS (SELECT *, count(close) OVER c AS n, max(high) OVER c AS hh, min(low) OVER c AS ll FROM a WINDOW c AS ({PER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT code, d, round(r1, 4) AS return_1, round(close / {lag('close', 5)} - 1, 4) AS return_5, round(close / {lag('close', 10)} - 1, 4) AS return_10, round((high - low) / nullif(close, 0), 4) AS range_ratio, round(CASE WHEN count(r1) {over(20)} >= 5 THEN stddev_samp(r1) {over(20)} END, 4) AS volatility,
  round(CASE WHEN count(volume) {over(20)} >= 5 THEN avg(volume) {over(20)} END, 2) AS adv20, CAST(n = 5 AND high = hh AS INT) AS top, CAST(n = 5 AND low = ll AS INT) AS bottom FROM f""")
def _(spark, sf):
    x = rounded(X.base_features(D.day_bars(spark, sf)), "code", "d", "return_1", "return_5", "return_10", "range_ratio", "volatility", "adv20", "top", "bottom")
    return x.withColumn("adv20", F.round("adv20", 2))


#: Digits of each: products of ranks lie halfway between two fourth digits, money is large.
ALPHAS = {"alpha_04": 4, "alpha_05": 6, "alpha_07": 4, "alpha_11": 6, "alpha_12": 4, "alpha_20": 4, "alpha_25": 4, "alpha_54": 2, "alpha_60": 2}
QUERIES["alphas"] = lambda spark, sf: X.alphas(X.base_features(D.day_bars(spark, sf))).select("code", "d", *(F.round(c, n).alias(c) for c, n in ALPHAS.items()))


@query("alphas_basic", f"""WITH {BARS}, v AS (SELECT *, sum((high + low + close) / 3 * volume) {over(20)} / nullif(sum(volume) {over(20)}, 0) AS v FROM bars) SELECT code, d, round((sqrt(high * low) - v) / nullif(close, 0), 4) AS alpha_41, round((v - close) / nullif(abs(v + close), 0), 4) AS alpha_42, round((close - open) / (high - low + 1e-3), 4) AS alpha_101,
  round(coalesce(100 * (close - min(low) {over(9)}) / nullif(max(high) {over(9)} - min(low) {over(9)}, 0), 50), 4) AS alpha_28, round((high - low) / (avg(close) {over(10)} + 1e-3) * 100, 4) AS alpha_51 FROM v""")
def _(spark, sf):
    return rounded(X.alphas(X.base_features(D.day_bars(spark, sf))), "code", "d", "alpha_41", "alpha_42", "alpha_101", "alpha_28", "alpha_51")


@query("session_features", f"""WITH {TICKS}, {HOURS}, b AS (SELECT *, CAST(ts AS DATE) AS day FROM hours), k AS (SELECT *, row_number() OVER (PARTITION BY code, day ORDER BY ts) AS k, coalesce(close / lag(close) OVER (PARTITION BY code, day ORDER BY ts) - 1, 0) AS r FROM b),
o AS (SELECT *, max(CASE WHEN k <= 4 THEN high END) OVER (PARTITION BY code, day) AS t, min(CASE WHEN k <= 4 THEN low END) OVER (PARTITION BY code, day) AS u FROM k)
SELECT code, ts, round(close / (sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w) - 1, 4) AS vwap_gap, CASE WHEN k <= 4 THEN 0 WHEN close > t THEN 1 WHEN close < u THEN -1 ELSE 0 END AS range_break, round(sum(r) OVER w, 4) AS session_momentum FROM o WINDOW w AS (PARTITION BY code, day ORDER BY ts)""")
def _(spark, sf):
    return rounded(X.session_features(D.hour_bars(spark, sf)), "code", "ts", "vwap_gap", "range_break", "session_momentum")


QUERIES["spectrum"] = lambda spark, sf: rounded(X.spectrum(X.base_features(D.day_bars(spark, sf))), "code", "d", "fft_high", "fft_peak", "fft_entropy")
QUERIES["strokes"] = lambda spark, sf: X.strokes(D.day_bars(spark, sf))


from . import more as _more, studies as _studies  # noqa: E402, F401  they register their queries, and need the names above

SQL |= {name: plain(sql) for name, sql in O.SQL.items()}
