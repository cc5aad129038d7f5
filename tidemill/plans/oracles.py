"""DuckDB forms of recursive series, candlestick patterns and paths: what windows alone do not say.

A recursion walks each code's rows by their number, so it repeats the very
operations of the series it checks; patterns are written over a bar and the four
bars before it.
"""

from __future__ import annotations

BARS = """bars AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(sum(o_custkey) AS DOUBLE) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)"""
ROWS = f"WITH RECURSIVE {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) AS k FROM bars)"
PER = "PARTITION BY code ORDER BY k"


def num(x: float) -> str:
    """A double, not a decimal, in SQL."""
    return f"CAST({x!r} AS DOUBLE)"


def prev(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PER})"


def trailing(f: str, x: str, n: int, whole: bool = True) -> str:
    """A window function of the last n rows; null with fewer values if ``whole``."""
    w = f"OVER ({PER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END)" if whole else f"({f}({x}) {w})"


def walk(name: str, source: str, columns: dict[str, tuple[str, str]]) -> str:
    """A recursion over source(code, k, ..): of each column its first value and its next, from ``r`` (this row) and ``w`` (the state)."""
    first = ", ".join(f"{a} AS {c}" for c, (a, _) in columns.items())
    step = ", ".join(b for _, b in columns.values())
    return f"{name} AS (SELECT r.code, r.k, {first} FROM {source} r WHERE r.k = 1 UNION ALL SELECT r.code, r.k, {step} FROM {source} r JOIN {name} w ON r.code = w.code AND r.k = w.k + 1)"


def means(*series: tuple[str, str, int]) -> dict[str, tuple[str, str]]:
    """State of weighted means (name, column, n): numerator, denominator and values seen; nulls come first only."""
    out = {}
    for name, x, n in series:
        keep = num(1 - 2 / (n + 1))
        out[f"{name}_n"] = (f"r.{x}", f"CASE WHEN r.{x} IS NULL THEN w.{name}_n WHEN w.{name}_n IS NULL THEN r.{x} ELSE w.{name}_n * {keep} + r.{x} END")
        out[f"{name}_d"] = (f"CASE WHEN r.{x} IS NOT NULL THEN CAST(1 AS DOUBLE) END", f"CASE WHEN r.{x} IS NULL THEN w.{name}_d WHEN w.{name}_d IS NULL THEN 1 ELSE w.{name}_d * {keep} + 1 END")
        out[f"{name}_s"] = (f"CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END", f"w.{name}_s + CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END")
    return out


def mean_of(name: str, n: int) -> str:
    return f"CASE WHEN {name}_s >= {max(1, n - 1)} THEN {name}_n / {name}_d END"


def ewm(cte: str, source: str, x: str, n: int) -> str:
    """(code, k, y): one weighted mean over source.x."""
    return f"{walk(cte + '_w', source, means(('e', x, n)))}, {cte} AS (SELECT code, k, {mean_of('e', n)} AS y FROM {cte}_w)"


def seeded(cte: str, source: str, x: str, n: int, m: int = 1) -> str:
    """(code, k, y): y = (m x + (n - m) y') / n, seeded by the first value after the first row, which the row before shows too."""
    state = walk(cte + "_w", source, {"y": ("CAST(NULL AS DOUBLE)", f"CASE WHEN r.{x} IS NULL THEN w.y WHEN w.y IS NULL THEN r.{x} ELSE ({m} * r.{x} + {n - m} * w.y) / {n} END")})
    return f"{state}, {cte} AS (SELECT code, k, coalesce(y, lead(y) OVER ({PER})) AS y FROM {cte}_w)"


def wilder(cte: str, source: str, x: str, n: int) -> str:
    """(code, k, y): mean of the first n values, then y = (y' (n - 1) + x) / n."""
    state = walk(cte + "_w", source, {
        "c": (f"CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END", f"w.c + CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END"),
        "y": (f"coalesce(r.{x}, CAST(0 AS DOUBLE))", f"CASE WHEN r.{x} IS NULL THEN w.y WHEN w.c + 1 < {n} THEN w.y + r.{x} WHEN w.c + 1 = {n} THEN (w.y + r.{x}) / {n} ELSE (w.y * {n - 1} + r.{x}) / {n} END"),
    })
    return f"{state}, {cte} AS (SELECT code, k, CASE WHEN c >= {n} THEN y END AS y FROM {cte}_w)"


def ta_mean(cte: str, source: str, x: str, n: int) -> str:
    """(code, k, y): mean of the first n values, then y' + 2 / (n + 1) (x - y')."""
    state = walk(cte + "_w", source, {
        "c": (f"CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END", f"w.c + CASE WHEN r.{x} IS NULL THEN 0 ELSE 1 END"),
        "y": (f"coalesce(r.{x}, CAST(0 AS DOUBLE))", f"CASE WHEN r.{x} IS NULL THEN w.y WHEN w.c + 1 < {n} THEN w.y + r.{x} WHEN w.c + 1 = {n} THEN (w.y + r.{x}) / {n} ELSE w.y + {num(2 / (n + 1))} * (r.{x} - w.y) END"),
    })
    return f"{state}, {cte} AS (SELECT code, k, CASE WHEN c >= {n} THEN y END AS y FROM {cte}_w)"


def joined(*ctes: str) -> str:
    return " ".join(f"JOIN {c} ON {c}.code = r.code AND {c}.k = r.k" for c in ctes)


def low_passed(cte: str, source: str) -> str:
    """(code, k, v): source(code, k, v), k from 1, through the zero-phase low-pass of turning points; ends continued by 12 reflected values."""
    from ..functions.filters import low_pass, settled
    from ..operators.peaks import CUTOFF, ORDER

    b, a = low_pass(ORDER, CUTOFF)
    z = settled(b, a)
    b, a, z = ([num(float(x)) for x in xs] for xs in (b, a, z))
    first = f"(r.v * ({b[0]} + {z[0]}))"
    step = f"({b[0]} * r.v + w.z0)"
    state = {"y": (first, step)} | {
        f"z{i}": (f"r.v * {b[i + 1]} - {a[i + 1]} * {first}" + (f" + r.v * {z[i + 1]}" if i < 2 else ""), f"r.v * {b[i + 1]} - {a[i + 1]} * {step}" + (f" + w.z{i + 1}" if i < 2 else "")) for i in range(3)
    }
    return f"""{cte}_n AS (SELECT code, max(k) AS n, arg_min(v, k) AS f, arg_max(v, k) AS l FROM {source} GROUP BY 1 HAVING max(k) > 12),
{cte}_x AS (SELECT code, k + 12 AS k, v FROM {source} JOIN {cte}_n USING (code) UNION ALL SELECT code, 14 - k, 2 * f - v FROM {source} JOIN {cte}_n USING (code) WHERE k BETWEEN 2 AND 13 UNION ALL SELECT code, 2 * n - k + 12, 2 * l - v FROM {source} JOIN {cte}_n USING (code) WHERE k BETWEEN n - 12 AND n - 1),
{walk(f"{cte}_f", f"{cte}_x", state)}, {cte}_y AS (SELECT code, n + 25 - k AS k, y AS v FROM {cte}_f JOIN {cte}_n USING (code)), {walk(f"{cte}_b", f"{cte}_y", state)},
{cte} AS (SELECT code, n + 13 - k AS k, y AS v FROM {cte}_b JOIN {cte}_n USING (code) WHERE k BETWEEN 13 AND n + 12)"""


def turned(cte: str, line: str, smooth: str, price: str) -> str:
    """(code, k, turn): turning points of line(code, k, v), spaced by the extremes of ``smooth``, kept from the highest on."""
    w = "OVER (PARTITION BY code ORDER BY k)"
    runs = f"""{cte}_r AS (SELECT code, i, min(k) + (count(*) - 1) // 2 AS k, any_value(v) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY k ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN v = lag(v) {w} THEN 0 ELSE 1 END AS new FROM {line})) GROUP BY 1, 2)"""
    return f"""{cte}_s AS (SELECT code, (count(*) // sum(t)) * 2 AS n FROM (SELECT code, CASE WHEN (v > lag(v) {w} AND v > lead(v) {w}) OR (v < lag(v) {w} AND v < lead(v) {w}) THEN 1 ELSE 0 END AS t FROM {smooth}) GROUP BY 1 HAVING sum(t) > 0),
{cte}_m AS (SELECT l.code, any_value(n) AS n, max(v) AS hi, min(v) AS lo, 0.01 / any_value(p) * (max(v) - min(v)) AS least FROM {line} l JOIN {cte}_s s ON l.code = s.code JOIN (SELECT code, max(v) AS p FROM {price} GROUP BY 1) q ON q.code = l.code GROUP BY 1), {runs},
{cte}_c AS (SELECT code, k, v, CASE WHEN v > lag(v) {w} AND v > lead(v) {w} THEN -1 WHEN v < lag(v) {w} AND v < lead(v) {w} THEN 1 END AS turn FROM {cte}_r),
{cte}_o AS (SELECT code || ' ' || turn AS code, code AS c, turn, c.k AS at, n, row_number() OVER (PARTITION BY code, turn ORDER BY -turn * v DESC, c.k DESC) AS k FROM {cte}_c c JOIN {cte}_m USING (code) WHERE (turn = -1 AND v > lo + least) OR (turn = 1 AND v < hi - least)),
{walk(f"{cte}_k", f"{cte}_o", {"kept": ("[r.at]", "CASE WHEN len(list_filter(w.kept, lambda q: abs(q - r.at) <= r.n)) = 0 THEN list_append(w.kept, r.at) ELSE w.kept END")})},
{cte} AS (SELECT c AS code, unnest(kept) AS k, turn FROM (SELECT code, arg_max(kept, k) AS kept FROM {cte}_k GROUP BY 1) JOIN (SELECT DISTINCT code, c, turn FROM {cte}_o) USING (code))"""


SQL: dict[str, str] = {}

_several = lambda x, prefix, *ns: f"{ROWS}, {walk('e', 'r', means(*((f'{prefix}{n}', x, n) for n in ns)))}"
SQL["expma"] = _several("close", "e", 5, 10, 20, 60) + " SELECT r.code, r.d, " + ", ".join(f"round({mean_of(f'e{n}', n)}, 4) AS ema{n}" for n in (5, 10, 20, 60)) + f" FROM r {joined('e')}"
_pbx = (3, 5, 8, 13, 18, 24)
SQL["pbx"] = _several("close", "e", *sorted({m * n for n in _pbx for m in (1, 2, 4)})) + " SELECT r.code, r.d, " + ", ".join(f"round(({mean_of(f'e{n}', n)} + {mean_of(f'e{2 * n}', 2 * n)} + {mean_of(f'e{4 * n}', 4 * n)}) / 3, 4) AS pbx{n}" for n in _pbx) + f" FROM r {joined('e')}"
SQL["macd"] = f"{_several('close', 'e', 12, 26)}, m AS (SELECT code, k, ({mean_of('e12', 12)}) - ({mean_of('e26', 26)}) AS dif FROM e), {ewm('dea', 'm', 'dif', 9)} SELECT r.code, r.d, round(dif, 4) AS dif, round(dea.y, 4) AS dea, round(2 * (dif - dea.y), 4) AS macd FROM r {joined('m', 'dea')}"
_RSV = f"(close - {trailing('min', 'low', 9)}) * 100 / nullif({trailing('max', 'high', 9)} - {trailing('min', 'low', 9)}, 0)"
SQL["kdj"] = f"{ROWS}, v AS (SELECT code, k, last_value(x IGNORE NULLS) OVER ({PER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rsv FROM (SELECT code, k, {_RSV} AS x FROM r)), {seeded('a', 'v', 'rsv', 3)}, {seeded('b', 'a', 'y', 3)} SELECT r.code, r.d, round(rsv, 4) AS rsv, round(a.y, 4) AS k, round(b.y, 4) AS kd, round(3 * a.y - 2 * b.y, 4) AS j FROM r {joined('v', 'a', 'b')}"
SQL["skdj"] = f"{ROWS}, v AS (SELECT code, k, {_RSV} AS x FROM r), {ewm('a', 'v', 'x', 3)}, {ewm('b', 'a', 'y', 3)}, s AS (SELECT code, k, y, {trailing('avg', 'y', 3)} AS m FROM b) SELECT r.code, r.d, round(s.y, 4) AS sk, round(s.m, 4) AS sd FROM r {joined('s')}"
SQL["osc"] = f"{ROWS}, v AS (SELECT code, k, (close - {trailing('avg', 'close', 20)}) * 100 AS osc FROM r), {ewm('a', 'v', 'osc', 6)} SELECT r.code, r.d, round(osc, 4) AS osc, round(a.y, 4) AS maosc FROM r {joined('v', 'a')}"
_MOVE = f"greatest(abs(high - {prev('high')}), abs(low - {prev('low')}))"
SQL["ddi"] = f"""{ROWS}, u AS (SELECT code, k, CASE WHEN high + low <= {prev('high')} + {prev('low')} THEN 0.0 WHEN {prev('high')} IS NULL THEN NULL ELSE {_MOVE} END AS z, CASE WHEN high + low >= {prev('high')} + {prev('low')} THEN 0.0 WHEN {prev('high')} IS NULL THEN NULL ELSE {_MOVE} END AS f FROM r),
v AS (SELECT code, k, {trailing('sum', 'z', 13)} AS a, {trailing('sum', 'f', 13)} AS b FROM u), x AS (SELECT code, k, a / nullif(a + b, 0) - b / nullif(a + b, 0) AS ddi FROM v), {seeded('s', 'x', 'ddi', 26)}, t AS (SELECT code, k, y, {trailing('avg', 'y', 5)} AS m FROM s)
SELECT r.code, r.d, round(ddi, 4) AS ddi, round(t.y, 4) AS addi, round(t.m, 4) AS ad FROM r {joined('x', 't')}"""
SQL["vrsi"] = f"{ROWS}, v AS (SELECT code, k, coalesce(greatest(volume - {prev('volume')}, 0), 0) AS u, abs(volume - {prev('volume')}) AS m FROM r), {seeded('a', 'v', 'u', 6)}, {seeded('b', 'v', 'm', 6)} SELECT r.code, r.d, CASE WHEN b.y <> 0 THEN round(a.y / b.y * 100, 4) END AS rsi6 FROM r {joined('a', 'b')}"

_wma = lambda x, n: "(CASE WHEN count(%s) OVER (%s ROWS BETWEEN %d PRECEDING AND CURRENT ROW) >= %d THEN (%s) / %s END)" % (x, PER, n - 1, n, " + ".join(f"{n - i} * {prev(x, i) if i else x}" for i in range(n)), num(n * (n + 1) / 2))
SQL["hull"] = f"{ROWS}, v AS (SELECT code, k, d, 2 * {_wma('close', 4)} - {_wma('close', 9)} AS x FROM r) SELECT code, d, round({_wma('x', 3)}, 4) AS hma FROM v"
SQL["beta"] = f"{ROWS}, v AS (SELECT code, k, d, (high - {prev('high')}) / {prev('high')} AS a, (low - {prev('low')}) / {prev('low')} AS b FROM r) SELECT code, d, round(CASE WHEN count(a) OVER w >= 5 THEN covar_pop(b, a) OVER w / nullif(var_pop(a) OVER w, 0) END, 4) AS beta FROM v WINDOW w AS ({PER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"

# ---- the usual library's recursive indicators ---------------------------------------------------

_KAMA = f"""kn AS (SELECT code, k, close, sum(m) OVER (PARTITION BY code ORDER BY k ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS noise, abs(close - lag(close, 14) OVER ({PER})) AS way FROM (SELECT *, abs(close - {prev('close')}) AS m FROM r)),
{walk('kama', 'kn', {'y': ('r.close', "CASE WHEN r.k <= 14 THEN r.close ELSE w.y + power(CASE WHEN r.noise <> 0 THEN r.way / r.noise ELSE 1 END * " + num(2 / 3 - 2 / 31) + " + " + num(2 / 31) + ", 2) * (r.close - w.y) END")})}"""

_FLIP = "(w.up AND r.low <= w.stop OR NOT w.up AND r.high >= w.stop)"
_NEXT_UP = f"(w.up <> {_FLIP})"
_NOW = f"CASE WHEN {_FLIP} THEN CASE WHEN w.up THEN greatest(w.best, r.high, r.ph) ELSE least(w.best, r.low, r.pl) END ELSE w.stop END"
_MORE = "(w.up AND r.high > w.best OR NOT w.up AND r.low < w.best)"
_BEST = f"CASE WHEN {_FLIP} THEN CASE WHEN {_NEXT_UP} THEN r.high ELSE r.low END WHEN {_MORE} THEN CASE WHEN w.up THEN r.high ELSE r.low END ELSE w.best END"
_A = f"CASE WHEN {_FLIP} THEN {num(0.02)} WHEN {_MORE} THEN least({num(0.2)}, w.a + {num(0.02)}) ELSE w.a END"
_AHEAD = f"(({_NOW}) + ({_A}) * (({_BEST}) - ({_NOW})))"
_SAR = f"""sn AS (SELECT *, {prev('high')} AS ph, {prev('low')} AS pl, lead(high) OVER ({PER}) AS nh, lead(low) OVER ({PER}) AS nl FROM r),
{walk('sar', 'sn', {
    'up': ('NOT (r.low - r.nl > greatest(r.nh - r.high, 0))', _NEXT_UP),
    'stop': ('CASE WHEN NOT (r.low - r.nl > greatest(r.nh - r.high, 0)) THEN r.low ELSE r.high END', f'CASE WHEN {_NEXT_UP} THEN least({_AHEAD}, r.low, r.pl) ELSE greatest({_AHEAD}, r.high, r.ph) END'),
    'best': ('CASE WHEN NOT (r.low - r.nl > greatest(r.nh - r.high, 0)) THEN r.nh ELSE r.nl END', _BEST),
    'a': (num(0.02), _A),
    'shown': ('CAST(NULL AS DOUBLE)', _NOW),
})}"""  # fmt: skip

_UP, _DOWN = "((r.high + r.low) / 2 + r.band)", "((r.high + r.low) / 2 - r.band)"
_TOP = f"CASE WHEN r.band IS NULL THEN NULL WHEN w.hi IS NULL THEN {_UP} WHEN r.pc <= w.hi THEN least({_UP}, w.hi) ELSE {_UP} END"
_BOT = f"CASE WHEN r.band IS NULL THEN NULL WHEN w.hi IS NULL THEN {_DOWN} WHEN r.pc >= w.lo THEN greatest({_DOWN}, w.lo) ELSE {_DOWN} END"
_WAY = "CASE WHEN r.band IS NULL OR w.hi IS NULL THEN w.way WHEN r.close > w.hi THEN 1 WHEN r.close < w.lo THEN -1 ELSE w.way END"
_TREND = f"""tb AS (SELECT r.*, {num(3.0)} * t12.y AS band, {prev('r.close').replace('code', 'r.code').replace('ORDER BY k', 'ORDER BY r.k')} AS pc FROM r {joined('t12')}),
{walk('st', 'tb', {'hi': ('CAST(NULL AS DOUBLE)', _TOP), 'lo': ('CAST(NULL AS DOUBLE)', _BOT), 'way': ('1', _WAY)})}"""

_TR = f"greatest(high - low, abs(high - {prev('close')}), abs(low - {prev('close')}))"
_UPM, _DNM = f"(high - {prev('high')})", f"({prev('low')} - low)"
SQL["ta_recursive"] = f"""{ROWS}, q AS (SELECT code, k, high, low, close, volume, CASE WHEN {prev('close')} IS NOT NULL THEN {_TR} END AS tr, greatest(high - low, coalesce(abs(high - {prev('close')}), 0), coalesce(abs(low - {prev('close')}), 0)) AS tr0,
  CASE WHEN {prev('high')} IS NULL THEN NULL WHEN {_UPM} > {_DNM} AND {_UPM} > 0 THEN {_UPM} ELSE 0 END AS plus, CASE WHEN {prev('high')} IS NULL THEN NULL WHEN {_DNM} > {_UPM} AND {_DNM} > 0 THEN {_DNM} ELSE 0 END AS minus,
  greatest(close - {prev('close')}, 0) AS gain0, close - {prev('close')} AS move,
  sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER ({PER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flow FROM r),
p AS (SELECT *, CASE WHEN move IS NOT NULL THEN greatest(move, 0) END AS gain, CASE WHEN move IS NOT NULL THEN greatest(-move, 0) END AS loss FROM q),
{wilder('a', 'p', 'tr', 14)}, {wilder('t12', 'p', 'tr0', 12)}, {wilder('pl', 'p', 'plus', 14)}, {wilder('mi', 'p', 'minus', 14)}, {wilder('g', 'p', 'gain', 14)}, {wilder('l', 'p', 'loss', 14)},
z AS (SELECT a.code, a.k, 100 * pl.y / a.y AS pp, 100 * mi.y / a.y AS mm FROM a JOIN pl USING (code, k) JOIN mi USING (code, k)), x AS (SELECT code, k, 100 * abs(pp - mm) / nullif(pp + mm, 0) AS dx FROM z), {wilder('ax', 'x', 'dx', 14)},
{ta_mean('o', 'p', 'close', 14)}, {ta_mean('oo', 'o', 'y', 14)}, {ta_mean('f3', 'p', 'flow', 3)}, {ta_mean('f10', 'p', 'flow', 10)}, {_KAMA}, {_SAR}, {_TREND}
SELECT r.code, r.d, round(a.y, 4) AS atr_w, round(x.dx, 4) AS dx, round(ax.y, 4) AS adx_w, round(100 * g.y / nullif(g.y + l.y, 0), 4) AS rsi_w, round(100 * (g.y - l.y) / nullif(g.y + l.y, 0), 4) AS cmo, CASE WHEN r.k > 14 THEN round(kama.y, 4) END AS kama,
  round(2 * o.y - oo.y, 4) AS dema, round(sar.shown, 4) AS sar, round(f3.y - f10.y, 4) AS adosc, round(CASE WHEN st.way > 0 THEN st.lo ELSE st.hi END, 4) AS trend_line, CAST(CASE WHEN st.hi IS NULL THEN 0 ELSE st.way END AS DOUBLE) AS trend
FROM r {joined('a', 'x', 'ax', 'g', 'l', 'kama', 'o', 'oo', 'sar', 'f3', 'f10', 'st')}"""

_FAST, _SLOW = "w.fast + " + num(0.15) + " * (r.close - w.fast)", "w.slow + " + num(0.075) + " * (r.close - w.slow)"
_FIX = f"""fx AS (SELECT code, k, close, avg(close) OVER (PARTITION BY code ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m12, avg(close) OVER (PARTITION BY code ORDER BY k ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS m26 FROM r),
{walk('mf', 'fx', {'fast': ('r.m12', f'CASE WHEN r.k <= 26 THEN r.m12 ELSE {_FAST} END'), 'slow': ('r.m26', f'CASE WHEN r.k <= 26 THEN r.m26 ELSE {_SLOW} END')})}, md AS (SELECT code, k, CASE WHEN k >= 26 THEN fast - slow END AS dif FROM mf)"""
SQL["ta_more"] = SQL["ta_recursive"].split("SELECT r.code, r.d, round(a.y")[0] + f""", {wilder('t10', 'p', 'tr', 10)}, v AS (SELECT code, k, (open + high + low + close) / 4 AS x FROM r), {ta_mean('o10', 'v', 'x', 10)}, {_FIX}, {ta_mean('ms', 'md', 'dif', 9)},
y AS (SELECT g.code, g.k, 100 * g.y / nullif(g.y + l.y, 0) AS rsi FROM g JOIN l USING (code, k)), yk AS (SELECT code, k, (rsi - {trailing('min', 'rsi', 5)}) * 100 / nullif({trailing('max', 'rsi', 5)} - {trailing('min', 'rsi', 5)}, 0) AS kk FROM y), yd AS (SELECT code, k, kk, {trailing('avg', 'kk', 3)} AS dd FROM yk),
ar AS (SELECT code, k, (y + {prev('y', 13)}) / 2 AS adxr FROM ax), e1 AS (SELECT code, k, {trailing('avg', 'volume', 12)} - {trailing('avg', 'volume', 26)} AS x FROM r), e2 AS (SELECT code, k, x, {trailing('avg', 'x', 9)} AS s FROM e1),
c0 AS (SELECT r.code, r.k, o10.y AS m, t10.y AS w, close < o10.y + t10.y AS u, o10.y - t10.y < close AS dn FROM r {joined('o10', 't10')}), c1 AS (SELECT *, CASE WHEN {prev('dn')} AND NOT dn THEN -1.0 WHEN {prev('u')} AND NOT u THEN 1.0 END AS x FROM c0),
c2 AS (SELECT *, last_value(x IGNORE NULLS) OVER ({PER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS way FROM c1)
SELECT r.code, r.d, round(ar.adxr, 4) AS adxr, round(md.dif, 4) AS macd_fix, round(ms.y, 4) AS macd_fix_signal, round(CASE WHEN sar.shown >= r.high THEN -sar.shown ELSE sar.shown END, 4) AS sarext, round(yd.kk, 4) AS stochrsi_k, round(yd.dd, 4) AS stochrsi_d, round(e2.x, 4) AS macdext, round(e2.s, 4) AS macdext_signal,
  round(c2.m, 4) AS stop_ma, round(c2.way, 4) AS stop_way, round(m - way * w, 4) AS stop_line FROM r {joined('ar', 'md', 'ms', 'sar', 'yd', 'e2', 'c2')}"""
SQL["volume_hull"] = f"""{ROWS}, v AS (SELECT code, k, close * volume AS cv, volume FROM r), {ta_mean('a', 'v', 'cv', 5)}, {ta_mean('b', 'v', 'volume', 5)}, s AS (SELECT a.code, a.k, a.y / b.y AS x FROM a JOIN b USING (code, k)),
h AS (SELECT code, k, 2 * {_wma('x', 2)} - {_wma('x', 5)} AS y FROM s), z AS (SELECT code, k, {_wma('y', 2)} AS v FROM h)
SELECT r.code, r.d, round(v, 4) AS vhma, CASE WHEN v > vp THEN 1 ELSE -1 END + CASE WHEN v > vq THEN 1 ELSE -1 END AS vhma_way FROM r JOIN (SELECT *, {prev('v')} AS vp, {prev('v', 2)} AS vq FROM z) z USING (code, k)"""
_hull = lambda x, n, to: (f"2 * {_wma(x, n // 2)} - {_wma(x, n)} AS {to}_", f"{_wma(to + '_', int(n**0.5))} AS {to}")
_h = [_hull(x, 14, to) for x, to in (("tr", "t"), ("a", "h"), ("b", "l"))]
SQL["adx_hull"] = f"""{ROWS}, m AS (SELECT code, k, CASE WHEN {prev('close')} IS NOT NULL THEN {_TR} END AS tr, (high - {prev('high')}) / {prev('high')} AS up, -(low - {prev('low')}) / {prev('low')} AS dn FROM r),
n AS (SELECT code, k, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS a, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS b FROM m), h1 AS (SELECT code, k, {', '.join(x for x, _ in _h)} FROM n), h2 AS (SELECT code, k, {', '.join(x for _, x in _h)} FROM h1),
p AS (SELECT code, k, CASE WHEN k > 16 THEN coalesce(100 * h / nullif(t, 0), 0) ELSE 0 END AS plus, CASE WHEN k > 16 THEN coalesce(100 * l / nullif(t, 0), 0) ELSE 0 END AS minus FROM h2), x AS (SELECT *, abs(plus - minus) / CASE WHEN plus + minus = 0 THEN 1 ELSE plus + minus END AS x FROM p),
y AS (SELECT *, {_hull('x', 14, 'y')[0]} FROM x), z AS (SELECT *, {_hull('x', 14, 'y')[1]} FROM y), q AS (SELECT *, CASE WHEN k > 16 THEN 100 * y ELSE 0 END AS adx FROM z)
SELECT r.code, r.d, round(adx, 4) AS adx_hull, CASE WHEN adx > 18 AND plus > minus THEN 1 WHEN adx > 18 AND plus < minus THEN -1 ELSE 0 END AS adx_way FROM r JOIN q USING (code, k)"""

# ---- candlestick patterns -----------------------------------------------------------------------

_BACK = lambda x, n: f"avg({x}) OVER ({PER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
CANDLE = f"""{ROWS}, b0 AS (SELECT code, d, k, open, high, low, close, abs(close - open) AS body, high - low AS rng, greatest(open, close) AS top, least(open, close) AS bot, (open + close) / 2 AS mid FROM r),
b1 AS (SELECT *, {_BACK('body', 10)} AS mb, {_BACK('rng', 10)} AS mr, {_BACK('rng', 5)} AS n5, high - top AS up, bot - low AS lo, close >= open AS white, close < open AS black FROM b0),
x AS (SELECT *, body > mb AS long, body <= mb AS short, body <= 0.1 * mr AS doji, up <= 0.1 * mr AS nou, lo <= 0.1 * mr AS nol, body > mb AND up <= 0.1 * mr AND lo <= 0.1 * mr AS maru FROM b1)"""

_IN = lambda a, b: f"{a}.top < {b}.top AND {a}.bot > {b}.bot"
_GUP = lambda a, b: f"{a}.bot > {b}.top"
_GDN = lambda a, b: f"{a}.top < {b}.bot"
_NEAR = lambda a, b, bar: f"abs({a} - {b}) <= 0.05 * {bar}.n5"
_STAR_UP = f"q.black AND q.long AND p.short AND {_GDN('p', 'q')} AND c.white AND c.close > q.close + 0.3 * q.body"
_STAR_DN = f"q.white AND q.long AND p.short AND {_GUP('p', 'q')} AND c.black AND c.close < q.close - 0.3 * q.body"
_CROWS = "q.black AND p.black AND c.black AND p.open < q.open AND p.open > q.close AND c.open < p.open AND c.open > p.close AND c.close < p.close AND p.close < q.close AND q.nol AND p.nol AND c.nol"
_KICK_UP, _KICK_DN = f"p.maru AND p.black AND c.maru AND c.white AND {_GUP('c', 'p')}", f"p.maru AND p.white AND c.maru AND c.black AND {_GDN('c', 'p')}"
_HAMMER, _INVERTED = "c.short AND c.lo > 2 * c.body AND c.nou", "c.short AND c.up > 2 * c.body AND c.nol"
_UP3 = "q.white AND p.white AND c.white AND c.close > p.close AND p.close > q.close"
NO = "false"
#: name: (rising, falling), over the bars s, r, q, p and c.
CANDLES = {
    "doji": ("c.doji", NO),
    "dragonfly_doji": ("c.doji AND c.nou AND NOT c.nol", NO),
    "gravestone_doji": ("c.doji AND c.nol AND NOT c.nou", NO),
    "long_legged_doji": ("c.doji AND (c.up > c.body OR c.lo > c.body) AND c.rng > c.mr", NO),
    "rickshaw_man": ("c.doji AND c.up > c.body AND c.lo > c.body AND abs(c.mid - (c.high + c.low) / 2) <= 0.1 * c.rng", NO),
    "takuri": ("c.doji AND c.nou AND c.lo > 2 * c.mb", NO),
    "long_line": ("c.white AND c.long AND c.up < c.body / 2 AND c.lo < c.body / 2", "c.black AND c.long AND c.up < c.body / 2 AND c.lo < c.body / 2"),
    "short_line": ("c.white AND c.short AND c.up < c.rng / 4 AND c.lo < c.rng / 4", "c.black AND c.short AND c.up < c.rng / 4 AND c.lo < c.rng / 4"),
    "marubozu": ("c.maru AND c.white", "c.maru AND c.black"),
    "closing_marubozu": ("c.long AND c.white AND c.nou", "c.long AND c.black AND c.nol"),
    "belt_hold": ("c.long AND c.white AND c.nol", "c.long AND c.black AND c.nou"),
    "spinning_top": ("c.white AND c.short AND c.up > c.body AND c.lo > c.body", "c.black AND c.short AND c.up > c.body AND c.lo > c.body"),
    "high_wave": ("c.white AND c.short AND c.up > 2 * c.body AND c.lo > 2 * c.body", "c.black AND c.short AND c.up > 2 * c.body AND c.lo > 2 * c.body"),
    "hammer": (f"{_HAMMER} AND c.bot <= p.low + 0.2 * p.n5", NO),
    "hanging_man": (NO, f"{_HAMMER} AND c.bot >= p.high - 0.2 * p.n5"),
    "inverted_hammer": (f"{_INVERTED} AND {_GDN('c', 'p')}", NO),
    "shooting_star": (NO, f"{_INVERTED} AND {_GUP('c', 'p')}"),
    "engulfing": ("c.white AND p.black AND c.close >= p.open AND c.open <= p.close AND c.body > p.body", "c.black AND p.white AND c.open >= p.close AND c.close <= p.open AND c.body > p.body"),
    "harami": (f"p.long AND p.black AND c.short AND {_IN('c', 'p')}", f"p.long AND p.white AND c.short AND {_IN('c', 'p')}"),
    "harami_cross": (f"p.long AND p.black AND c.doji AND {_IN('c', 'p')}", f"p.long AND p.white AND c.doji AND {_IN('c', 'p')}"),
    "homing_pigeon": (f"p.long AND p.black AND c.short AND c.black AND {_IN('c', 'p')}", NO),
    "doji_star": (f"p.long AND p.black AND c.doji AND {_GDN('c', 'p')}", f"p.long AND p.white AND c.doji AND {_GUP('c', 'p')}"),
    "piercing": ("p.black AND p.long AND c.white AND c.long AND c.open < p.low AND c.close > p.mid AND c.close < p.open", NO),
    "dark_cloud": (NO, "p.white AND p.long AND c.black AND c.open > p.high AND c.close < p.mid AND c.close > p.open"),
    "counterattack": (f"p.black AND p.long AND c.white AND c.long AND {_NEAR('c.close', 'p.close', 'p')}", f"p.white AND p.long AND c.black AND c.long AND {_NEAR('c.close', 'p.close', 'p')}"),
    "separating_lines": (f"p.black AND c.white AND c.long AND c.nol AND {_NEAR('c.open', 'p.open', 'p')}", f"p.white AND c.black AND c.long AND c.nou AND {_NEAR('c.open', 'p.open', 'p')}"),
    "matching_low": (f"p.black AND c.black AND {_NEAR('c.close', 'p.close', 'p')}", NO),
    "in_neck": (NO, "p.black AND p.long AND c.white AND c.open < p.low AND c.close >= p.close AND c.close <= p.close + 0.05 * p.n5"),
    "on_neck": (NO, f"p.black AND p.long AND c.white AND c.open < p.low AND {_NEAR('c.close', 'p.low', 'p')}"),
    "thrusting": (NO, "p.black AND p.long AND c.white AND c.open < p.low AND c.close > p.close + 0.05 * p.n5 AND c.close <= p.mid"),
    "kicking": (_KICK_UP, _KICK_DN),
    "kicking_by_length": (f"({_KICK_UP} OR {_KICK_DN}) AND CASE WHEN c.body > p.body THEN c.white ELSE p.white END", f"({_KICK_UP} OR {_KICK_DN}) AND CASE WHEN c.body > p.body THEN c.black ELSE p.black END"),
    "two_crows": (NO, f"q.white AND q.long AND p.black AND {_GUP('p', 'q')} AND c.black AND c.open < p.open AND c.open > p.close AND c.close > q.open AND c.close < q.close"),
    "upside_gap_two_crows": (NO, f"q.white AND q.long AND p.black AND p.short AND {_GUP('p', 'q')} AND c.black AND c.open > p.open AND c.close < p.close AND c.close > q.close"),
    "three_inside": (f"q.long AND q.black AND p.short AND {_IN('p', 'q')} AND c.white AND c.close > q.open", f"q.long AND q.white AND p.short AND {_IN('p', 'q')} AND c.black AND c.close < q.open"),
    "three_outside": ("p.white AND q.black AND p.close > q.open AND p.open < q.close AND c.close > p.close", "p.black AND q.white AND p.open > q.close AND p.close < q.open AND c.close < p.close"),
    "three_white_soldiers": (f"{_UP3} AND c.nou AND p.nou AND q.nou AND p.open > q.open AND p.open <= q.close + 0.2 * q.n5 AND c.open > p.open AND c.open <= p.close + 0.2 * p.n5", NO),
    "three_black_crows": (NO, f"r.white AND {_CROWS} AND q.close < r.high"),
    "identical_three_crows": (NO, f"{_CROWS} AND {_NEAR('p.open', 'q.close', 'q')} AND {_NEAR('c.open', 'p.close', 'p')}"),
    "advance_block": (NO, f"{_UP3} AND q.long AND p.open > q.open AND c.open > p.open AND c.body < p.body AND p.body < q.body AND c.up > c.body"),
    "stalled_pattern": (NO, f"{_UP3} AND q.long AND p.long AND p.nou AND c.short AND c.open >= p.close - c.body - 0.2 * p.n5"),
    "three_stars_in_south": ("q.black AND p.black AND c.black AND q.long AND q.lo > q.body AND p.body < q.body AND p.open > q.close AND p.low >= q.low AND c.short AND c.nol AND c.nou AND c.low > p.low AND c.high < p.high", NO),
    "morning_star": (_STAR_UP, NO),
    "evening_star": (NO, _STAR_DN),
    "morning_doji_star": (f"{_STAR_UP} AND p.doji", NO),
    "evening_doji_star": (NO, f"{_STAR_DN} AND p.doji"),
    "abandoned_baby": (f"{_STAR_UP} AND p.doji AND p.high < q.low AND c.low > p.high", f"{_STAR_DN} AND p.doji AND p.low > q.high AND c.high < p.low"),
    "tristar": (f"q.doji AND p.doji AND c.doji AND {_GDN('p', 'q')} AND c.bot > p.bot", f"q.doji AND p.doji AND c.doji AND {_GUP('p', 'q')} AND c.top < p.top"),
    "stick_sandwich": (f"q.black AND p.white AND c.black AND p.low > q.close AND {_NEAR('c.close', 'q.close', 'q')}", NO),
    "unique_three_river": ("q.black AND q.long AND p.black AND p.close > q.close AND p.open <= q.open AND p.low < q.low AND c.white AND c.short AND c.open > p.low", NO),
    "gap_side_by_side_white": (f"{_GUP('p', 'q')} AND {_GUP('c', 'q')} AND p.white AND c.white AND {_NEAR('c.open', 'p.open', 'p')}", f"{_GDN('p', 'q')} AND {_GDN('c', 'q')} AND p.white AND c.white AND {_NEAR('c.open', 'p.open', 'p')}"),
    "tasuki_gap": (f"{_GUP('p', 'q')} AND p.white AND c.black AND c.open < p.close AND c.open > p.open AND c.close < p.open AND c.close > q.top", f"{_GDN('p', 'q')} AND p.black AND c.white AND c.open < p.open AND c.open > p.close AND c.close > p.open AND c.close < q.bot"),
    "gap_three_methods": (f"q.white AND p.white AND c.black AND {_GUP('p', 'q')} AND c.open < p.close AND c.open > p.open AND c.close < q.close AND c.close > q.open", f"q.black AND p.black AND c.white AND {_GDN('p', 'q')} AND c.open > p.close AND c.open < p.open AND c.close > q.close AND c.close < q.open"),
    "three_line_strike": ("r.white AND q.white AND p.white AND p.close > q.close AND q.close > r.close AND c.black AND c.open > p.close AND c.close < r.open", "r.black AND q.black AND p.black AND p.close < q.close AND q.close < r.close AND c.white AND c.open < p.close AND c.close > r.open"),
    "conceal_baby_swallow": (f"r.maru AND r.black AND q.maru AND q.black AND p.black AND {_GDN('p', 'q')} AND p.up > p.body AND p.high > q.close AND c.black AND c.high > p.high AND c.low < p.low", NO),
    "hikkake": ("p.high < q.high AND p.low > q.low AND c.high < p.high AND c.low < p.low", "p.high < q.high AND p.low > q.low AND c.high > p.high AND c.low > p.low"),
    "hikkake_modified": ("q.high < r.high AND q.low > r.low AND p.high < q.high AND p.low > q.low AND p.close <= p.low + 0.2 * p.n5 AND c.high < p.high AND c.low < p.low", "q.high < r.high AND q.low > r.low AND p.high < q.high AND p.low > q.low AND p.close >= p.high - 0.2 * p.n5 AND c.high > p.high AND c.low > p.low"),
    "ladder_bottom": ("s.black AND r.black AND q.black AND r.open < s.open AND q.open < r.open AND r.close < s.close AND q.close < r.close AND p.black AND NOT p.nou AND c.white AND c.open > p.open AND c.close > p.high", NO),
    "breakaway": (f"s.black AND s.long AND r.black AND {_GDN('r', 's')} AND q.high < r.high AND q.low < r.low AND p.black AND c.white AND c.close > r.open AND c.close < s.close", f"s.white AND s.long AND r.white AND {_GUP('r', 's')} AND q.high > r.high AND q.low > r.low AND p.white AND c.black AND c.close < r.open AND c.close > s.close"),
    "rise_fall_three_methods": ("s.white AND s.long AND r.black AND r.short AND q.short AND p.short AND c.white AND c.long AND r.bot > s.open AND p.bot > s.open AND r.top < s.high AND p.top < s.high AND c.close > s.close", "s.black AND s.long AND r.white AND r.short AND q.short AND p.short AND c.black AND c.long AND r.top < s.open AND p.top < s.open AND r.bot > s.low AND p.bot > s.low AND c.close < s.close"),
    "mat_hold": (f"s.white AND s.long AND r.black AND {_GUP('r', 's')} AND q.short AND p.short AND q.bot < s.close AND p.bot < s.close AND q.bot > s.close - 0.5 * s.body AND p.bot > s.close - 0.5 * s.body AND c.white AND c.close > greatest(r.high, q.high, p.high)", NO),
}
SQL["candles"] = f"{CANDLE} SELECT c.code, c.d, " + ", ".join(f"CASE WHEN {a} THEN 100 WHEN {b} THEN -100 ELSE 0 END AS {n}" for n, (a, b) in CANDLES.items()) + " FROM x c " + " ".join(f"LEFT JOIN x {y} ON {y}.code = c.code AND {y}.k = c.k - {i + 1}" for i, y in enumerate("pqrs"))

# ---- paths and features -------------------------------------------------------------------------

#: Bricks that a price completes are counted from the last brick's level; a row may give several.
SQL["renko"] = f"""{ROWS}, {walk('b', 'r', {'level': ('r.close', 'w.level + 20000.0 * trunc((r.close - w.level) / 20000.0)'), 'before': ('r.close', 'w.level')})}, n AS (SELECT b.code, b.k, r.d, before, CAST(sign(level - before) AS BIGINT) AS way, CAST(round(abs(level - before) / 20000) AS BIGINT) AS n FROM b JOIN r USING (code, k) WHERE level <> before)
SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY k, i) - 1 AS brick, round(before + way * 20000 * i, 4) AS price, way FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM n)"""
_F = "(SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) AS i FROM f)"
SQL["strokes"] = f"""WITH {BARS}, c AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS hh, min(low) OVER w AS ll FROM bars WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (SELECT code, d, CASE WHEN high = hh THEN 1 ELSE -1 END AS side, CASE WHEN high = hh THEN high ELSE -low END AS reach FROM c WHERE n = 5 AND (high = hh) <> (low = ll)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY code, side ORDER BY d) AS gap FROM {_F}),
h AS (SELECT code, side, gap, min(d) AS begin, arg_max(d, (reach, d)) AS d, max(reach) AS reach FROM g GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY begin) AS k FROM h)
SELECT a.code, a.k - 1 AS stroke, b.d AS "from", a.d AS "to", a.side AS direction, b.side * b.reach AS start, a.side * a.reach AS "end" FROM o a JOIN o b ON a.code = b.code AND a.k = b.k + 1"""
_N = 32
SQL["spectrum"] = f"""{ROWS}, v AS (SELECT code, k, d, coalesce(close / {prev('close')} - 1, 0) AS x FROM r), m AS (SELECT code, k, d, list(x) OVER ({PER} ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW) AS l FROM v),
u AS (SELECT code, k, d, unnest(l) - list_avg(l) AS x, generate_subscripts(l, 1) - 1 AS t FROM m WHERE len(l) = {_N}), f AS (SELECT code, k, d, b, power(sum(x * cos(2 * pi() * b * t / {_N})), 2) + power(sum(x * sin(2 * pi() * b * t / {_N})), 2) AS p FROM u, (SELECT unnest(generate_series(1, {_N // 2})) AS b) GROUP BY 1, 2, 3, 4),
s AS (SELECT code, k, sum(p) AS total, sum(p) FILTER (b > 10) AS high, arg_max(b, p) AS peak FROM f GROUP BY 1, 2), e AS (SELECT code, k, -sum(greatest(p / total, 1e-12) * ln(greatest(p / total, 1e-12))) / ln({_N // 2}.0) AS h FROM f JOIN s USING (code, k) GROUP BY 1, 2)
SELECT m.code, m.d, round(coalesce(high / nullif(total, 0), 0), 4) AS fft_high, coalesce(round(peak / {_N // 2}.0, 4), 0) AS fft_peak, coalesce(round(h, 4), 0) AS fft_entropy FROM m LEFT JOIN s USING (code, k) LEFT JOIN e USING (code, k)"""
