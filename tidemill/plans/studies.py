"""Queries that need more than windows: word paths, strokes and pivots, recursions in blocks, tear sheets, alignments, grids."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import rows
from ..operators import chan, crosses, joins as J, peaks, sheets, words
from ..sources import blocks, kept, tables as D
from ..sources.ask import ask
from ..streaming import streams
from .more import _events, _ran
from .oracles import BARS, PER as KEY, ROWS, low_passed, num, ta_mean, turned, walk, wilder
from .queries import FACTOR, PER, factor_rows, query, rounded

WORD = "[a-z]{1,8}"


def _dictionary(spark, sf):
    """Words of part names and types and of the documents, with their counts."""
    part, docs = D.table(spark, sf, "part"), D.table(spark, sf, "documents")
    texts = part.select(F.col("p_name").alias("text")).union(part.select(F.lower("p_type"))).union(docs.select("text"))
    return words.word_counts(texts, "text", f"^{WORD}$")


def _runs(spark, sf):
    part = D.table(spark, sf, "part")
    return part.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", ""), F.lower("p_type"), F.col("p_size").cast("string")).alias("text"))


_WORDS = f"""n AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) WHERE regexp_full_match(word, '{WORD}') GROUP BY 1),
d AS (SELECT word, CAST(round(ln(n / (SELECT sum(n) FROM n)) * 1000000) AS BIGINT) AS weight FROM n), u AS (SELECT CAST(round(ln(1 / sum(n)) * 1000000) AS BIGINT) AS unknown FROM n),
t AS (SELECT p_partkey, replace(p_name, ' ', '') || lower(p_type) || p_size AS text FROM part), p AS (SELECT *, unnest(generate_series(1, length(text))) AS i FROM t),
e AS (SELECT p_partkey, i, l, word, weight FROM (SELECT *, unnest(generate_series(1, 8)) AS l FROM p) JOIN d ON d.word = substr(text, i, l) AND i + l - 1 <= length(text))"""
#: Single Latin characters in a row are one token: shown as <x>, joined where two meet.
_JOINED = "array_to_string(list_filter(string_split(replace(replace(replace(array_to_string(list_transform({x}, lambda w: CASE WHEN length(w) = 1 THEN '<' || w || '>' ELSE '|' || w || '|' END), ''), '><', ''), '<', '|'), '>', '|'), '|'), lambda w: w <> ''), ' ')"


@query("split_words", f"""WITH RECURSIVE {_WORDS}, g AS (SELECT p.p_partkey, p.i, coalesce(list({{'l': l, 'w': weight}}) FILTER (l IS NOT NULL), [{{'l': 1, 'w': (SELECT unknown FROM u)}}]) AS edges FROM p LEFT JOIN e USING (p_partkey, i) GROUP BY 1, 2),
w AS (SELECT p_partkey, text, length(text) + 1 AS i, [CAST(0 AS BIGINT)] AS s, [CAST([] AS VARCHAR[])] AS paths FROM t
  UNION ALL SELECT p_partkey, text, i, list_append(s, b.s), list_append(paths, list_prepend(substr(text, i, b.l), paths[length(text) + 2 - i - b.l])) FROM (
    SELECT w.p_partkey, w.text, g.i, w.s, w.paths, list_max(list_transform(g.edges, lambda x: {{'s': x.w + w.s[length(w.text) + 2 - g.i - x.l], 'l': x.l}})) AS b FROM w JOIN g ON g.p_partkey = w.p_partkey AND g.i = w.i - 1))
SELECT p_partkey, {_JOINED.format(x="paths[len(paths)]")} AS tokens, s[len(s)] AS score FROM w WHERE i = 1""")
def _(spark, sf):
    return words.segment(_runs(spark, sf), _dictionary(spark, sf)).select("p_partkey", F.array_join("tokens", " ").alias("tokens"), "score")


@query("every_word", f"""WITH {_WORDS}, o AS (SELECT p_partkey, i, l, word FROM e WHERE l > 1), c AS (SELECT p_partkey, i, 1 AS l, substr(text, i, 1) AS word FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.p_partkey = p.p_partkey AND o.i <= p.i AND p.i < o.i + o.l)),
a AS (SELECT p_partkey, list(word ORDER BY i, l) AS words FROM (FROM o UNION ALL FROM c) GROUP BY 1)
SELECT p_partkey, {_JOINED.format(x="words")} AS tokens FROM a""")
def _(spark, sf):
    return words.segment(_runs(spark, sf), _dictionary(spark, sf), every=True).select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


CHAN = ("fractal_type", "fractal_density", *chan.AT_BAR, *chan.AT_END, *chan.POINTS, "trade_point_score")
_STROKES = f"""{BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS i FROM bars),
x AS (SELECT *, n = 5 AND high = hh AS top, n = 5 AND low = ll AS bottom FROM (SELECT *, count(*) OVER w AS n, max(high) OVER w AS hh, min(low) OVER w AS ll FROM b WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))),
f AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY i, kind DESC) AS n FROM (SELECT code, i, 1 AS kind, low AS price FROM x WHERE bottom UNION ALL SELECT code, i, -1, high FROM x WHERE top)),
w AS (SELECT code, n, i, kind, price, 1 AS seq FROM f WHERE n = 1 UNION ALL SELECT code, n, CASE WHEN more OR new THEN fi ELSE i END, CASE WHEN new THEN fk ELSE kind END, CASE WHEN more OR new THEN fp ELSE price END, seq + CASE WHEN new THEN 1 ELSE 0 END FROM (
  SELECT w.code, f.n, w.i, w.kind, w.price, w.seq, f.i AS fi, f.kind AS fk, f.price AS fp, f.kind = w.kind AND (f.price - w.price) * f.kind < 0 AS more, f.kind <> w.kind AND f.i - w.i >= 2 AS new FROM w JOIN f ON f.code = w.code AND f.n = w.n + 1)),
c AS (SELECT code, seq, arg_max(i, n) AS i, arg_max(kind, n) AS kind, arg_max(price, n) AS price FROM w GROUP BY 1, 2),
s AS (SELECT p.code, p.seq AS m, p.i AS start, q.i AS "end", p.kind AS direction, abs(q.price - p.price) / greatest(abs(any_value(b.close) FILTER (b.i = p.i)), 1e-9) AS strength, max(b.high) AS high, min(b.low) AS low,
  any_value(b.close) FILTER (b.i = q.i) AS close_end, any_value(b.high) FILTER (b.i = q.i) AS high_end, any_value(b.low) FILTER (b.i = q.i) AS low_end
  FROM c p JOIN c q ON p.code = q.code AND q.seq = p.seq + 1 JOIN b ON b.code = p.code AND b.i BETWEEN p.i AND q.i GROUP BY p.code, p.seq, p.i, q.i, p.kind, p.price, q.price),
g AS (SELECT z.code, z.m, x.start, z."end", z.direction, (x.strength + y.strength + z.strength) / 3 AS strength, least(x.high, y.high, z.high) AS top, greatest(x.low, y.low, z.low) AS bottom, z.close_end
  FROM s z JOIN s y ON y.code = z.code AND y.m = z.m - 1 JOIN s x ON x.code = z.code AND x.m = z.m - 2),
v AS (SELECT *, (top - bottom) / greatest(close_end, 1e-9) AS width FROM g WHERE top > bottom)"""


@query("chan_projection", f"""WITH RECURSIVE {_STROKES}, l AS (SELECT s.code, s.m, arg_max(v.top, v.m) AS top, arg_max(v.bottom, v.m) AS bottom FROM s JOIN v ON v.code = s.code AND v."end" < s."end" GROUP BY 1, 2),
o AS (SELECT s.*, l.top, l.bottom, (SELECT arg_max(t.strength, t.m) FROM s t JOIN l k USING (code, m) WHERE t.code = s.code AND t.m < s.m AND t.direction = s.direction) AS old FROM s JOIN l USING (code, m)),
q AS (SELECT *, CASE WHEN old > 0 THEN greatest(old - strength, 0) / greatest(old, 1e-9) ELSE 0 END AS div, direction > 0 AND high > top AS b1, direction > 0 AND low_end <= top AND close_end > top AS b2, direction > 0 AND low_end > top AND strength > 0 AS b3,
  direction < 0 AND low < bottom AS s1, direction < 0 AND high_end >= bottom AND close_end < bottom AS s2, direction < 0 AND high_end < bottom AND strength > 0 AS s3 FROM o),
bs AS (SELECT b.code, b.i, arg_max(s.direction, s.m) AS stroke FROM b JOIN s ON s.code = b.code AND b.i BETWEEN s.start AND s."end" GROUP BY 1, 2),
bg AS (SELECT b.code, b.i, arg_max(g.direction, g.m) AS direction, arg_max(g.strength, g.m) AS strength FROM b JOIN g ON g.code = b.code AND b.i BETWEEN g.start AND g."end" GROUP BY 1, 2),
bv AS (SELECT b.code, b.i, arg_max(v.width, v.m) AS width FROM b JOIN v ON v.code = b.code AND b.i BETWEEN v.start AND v."end" GROUP BY 1, 2),
r AS (SELECT x.code, x.d, coalesce(c.kind, 0) AS fractal_type, sum(x.top::INT + x.bottom::INT) OVER (PARTITION BY x.code ORDER BY x.i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS fractal_density, coalesce(bs.stroke, 0) AS stroke_direction, coalesce(bg.direction, 0) AS segment_direction,
  coalesce(bg.strength, 0) AS segment_strength, bv.i IS NOT NULL AS pivot_active, coalesce(bv.width, 0) AS pivot_width, coalesce(q.direction, 0) AS pivot_leg_phase, coalesce(s.direction, 0) AS pivot_leg_direction, coalesce(s.strength, 0) AS pivot_leg_strength,
  coalesce(b1, false) AS buy_point_1, coalesce(b2, false) AS buy_point_2, coalesce(b3, false) AS buy_point_3, coalesce(s1, false) AS sell_point_1, coalesce(s2, false) AS sell_point_2, coalesce(s3, false) AS sell_point_3,
  CASE WHEN b1 THEN div ELSE 0 END AS buy_divergence_score, CASE WHEN s1 THEN div ELSE 0 END AS sell_divergence_score
  FROM x LEFT JOIN c USING (code, i) LEFT JOIN bs USING (code, i) LEFT JOIN bg USING (code, i) LEFT JOIN bv USING (code, i) LEFT JOIN s ON s.code = x.code AND s."end" = x.i LEFT JOIN q ON q.code = x.code AND q."end" = x.i)
SELECT code, d, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in CHAN if c != "trade_point_score")}, round({" + ".join(f"CAST({c} AS DOUBLE) * {p}" for c, p in chan.POINTS.items())}, 6) AS trade_point_score FROM r""")
def _(spark, sf):
    return rounded(chan.projection(D.day_bars(spark, sf)), "code", "d", *CHAN, digits=6)


# ---- tear sheets, grids, alignments -------------------------------------------------------------

PERIODS = (1, 2, 5)


def _clean(spark, sf):
    """Suppliers by month, their mean discount in five quantiles, returns over 1, 2 and 5 months, and the supplier's nation."""
    factors = factor_rows(spark, sf).join(D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("nation")), "code")
    return sheets.clean_factor(sheets.with_horizons(factors, PERIODS), "size", PERIODS, 5, None)


_CLEAN = f"""{FACTOR}, m AS (SELECT f.code, d, size, s_nationkey AS nation, {", ".join(f"lead(close, {p}) OVER ({PER}) / close - 1 AS r{p}" for p in PERIODS)} FROM f JOIN supplier ON s_suppkey = f.code),
z AS (SELECT code, d, size, nation, {", ".join(f"CASE WHEN coalesce(abs(r{p} - avg(r{p}) OVER (PARTITION BY code)) > 20 * stddev_samp(r{p}) OVER (PARTITION BY code), false) THEN NULL ELSE r{p} END AS r{p}" for p in PERIODS)} FROM m),
k AS (SELECT * FROM z WHERE size IS NOT NULL AND {" AND ".join(f"r{p} IS NOT NULL" for p in PERIODS)}), q AS (SELECT d, quantile_cont(size, [0.2, 0.4, 0.6, 0.8]) AS q FROM k GROUP BY 1),
c AS (SELECT k.*, 1 + (size > q[1])::INT + (size > q[2])::INT + (size > q[3])::INT + (size > q[4])::INT AS bin FROM k JOIN q USING (d)),
h AS (SELECT code, d, size, nation, bin, unnest([{", ".join(map(str, PERIODS))}]) AS horizon, unnest([{", ".join(f"r{p}" for p in PERIODS)}]) AS ret FROM c)"""


@query("tear_sheet", f"""WITH {_CLEAN}, e AS (SELECT *, ret - avg(ret) OVER (PARTITION BY d, horizon) AS excess FROM h)
SELECT horizon, bin, nation AS "group", 1 - grouping(bin) AS by_bin, 1 - grouping(nation) AS by_group, count(*) AS n, round(avg(ret), 4) AS ret, round(stddev_samp(ret) / sqrt(count(*)), 4) AS error, round(avg(excess), 4) AS excess, round(max(ret), 4) AS best, round(min(ret), 4) AS worst
FROM e GROUP BY GROUPING SETS ((horizon, bin, nation), (horizon, bin), (horizon, nation), (horizon))""")
def _(spark, sf):
    return rounded(sheets.tear_sheet(_clean(spark, sf), PERIODS, "nation"))


@query("tear_spreads", f"""WITH {_CLEAN}, m AS (SELECT horizon, d, bin, avg(ret) AS m FROM h GROUP BY 1, 2, 3), s AS (SELECT horizon, d, max(m) FILTER (bin = (SELECT max(bin) FROM c)) - max(m) FILTER (bin = (SELECT min(bin) FROM c)) AS s FROM m GROUP BY 1, 2)
SELECT horizon, count(s) AS n, round(avg(s), 4) AS spread, round(stddev_samp(s), 4) AS sd, round(avg(s) / nullif(stddev_samp(s), 0) * sqrt(count(s)), 4) AS t FROM s WHERE s IS NOT NULL GROUP BY 1""".replace("m AS (SELECT horizon", "dm AS (SELECT horizon").replace("AS s FROM m GROUP", "AS s FROM dm GROUP"))
def _(spark, sf):
    return rounded(sheets.spreads(_clean(spark, sf), PERIODS))


@query("tear_information", f"""WITH {_CLEAN}, r AS (SELECT *, rank() OVER (PARTITION BY d, horizon ORDER BY size) + (count(*) OVER (PARTITION BY d, horizon, size) - 1) / 2 AS a, rank() OVER (PARTITION BY d, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY d, horizon, ret) - 1) / 2 AS b FROM h),
i AS (SELECT horizon, d, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM r GROUP BY 1, 2)
SELECT horizon, count(ic) AS n, round(round(avg(ic), 9), 4) AS mean, round(round(stddev_samp(ic), 9), 4) AS sd, round(round(avg(ic) / stddev_samp(ic), 9), 4) AS ir, round(round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 9), 4) AS t, round(round(avg((ic > 1e-12)::INT), 9), 4) AS positive FROM i WHERE ic IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rounded(rounded(sheets.information(_clean(spark, sf), "size", PERIODS), digits=9))  # means of few ranks lie on rounding edges


@query("tear_turnover", f"""WITH {_CLEAN}, n AS (SELECT code, bin, dense_rank() OVER (ORDER BY d) AS i, rank() OVER (PARTITION BY d ORDER BY size) + (count(*) OVER (PARTITION BY d, size) - 1) / 2 AS r FROM c),
j AS (SELECT n.*, p AS horizon, o.bin AS b, o.r AS q FROM (SELECT *, unnest([{", ".join(map(str, PERIODS))}]) AS p FROM n) n LEFT JOIN n o ON o.code = n.code AND o.i = n.i - p WHERE n.i > p),
s AS (SELECT horizon, bin, i, avg(CASE WHEN bin = b THEN 0.0 ELSE 1.0 END) AS new FROM j GROUP BY 1, 2, 3), t AS (SELECT horizon, avg(c) AS stay FROM (SELECT horizon, i, CASE WHEN stddev_pop(r) FILTER (q IS NOT NULL) > 0 AND stddev_pop(q) > 0 THEN corr(r, q) END AS c FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT horizon, bin, count(*) AS days, round(avg(new), 4) AS turnover, round(any_value(stay), 4) AS stay FROM s JOIN t USING (horizon) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(sheets.turnover(_clean(spark, sf), PERIODS, "size"))


#: 1 000 rules: twenty fast means with fifty slow ones each.
GRID = [(f, s) for f in range(1, 21) for s in range(25, 125, 2)]
_GRID = f"""{BARS}, b AS (SELECT code, row_number() OVER w AS i, sum(CAST(round(close / 0.01) AS BIGINT)) OVER w AS p, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY code ORDER BY d)),
n AS (SELECT unnest(list_distinct([{", ".join(str(x) for x in sorted({n for pair in GRID for n in pair}))}])) AS n), v AS (SELECT b.code, b.i, n, b.p - coalesce(o.p, 0) AS s FROM b JOIN n ON b.i >= n LEFT JOIN b o ON o.code = b.code AND o.i = b.i - n),
a AS (SELECT x.code, x.i, x.n AS fast, y.n AS slow, x.s * y.n > y.s * x.n AS above FROM v x JOIN v y ON x.code = y.code AND x.i = y.i AND x.n <= 20 AND y.n >= 25),
g AS (SELECT a.code, fast, slow, above AND NOT coalesce(lag(above) OVER (PARTITION BY a.code, fast, slow ORDER BY a.i), false) AS opened, CASE WHEN above THEN ret ELSE 0 END AS got FROM a JOIN b ON b.code = a.code AND b.i = a.i + 1 WHERE ret IS NOT NULL),
o AS (SELECT code, fast, slow, count(*) AS n, avg(got) AS mean, stddev_samp(got) AS sd, exp(sum(ln(1 + got))) - 1 AS total, sum(opened::INT)::BIGINT AS trades, avg(got) / nullif(stddev_samp(got), 0) * sqrt(252) AS sharpe FROM g GROUP BY 1, 2, 3)"""


@query("scenario_grid", f"WITH {_GRID} SELECT code, fast, slow, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(total, 4) AS total, trades, round(sharpe, 4) AS sharpe FROM o")
def _(spark, sf):
    return rounded(sheets.crossing_grid(D.day_bars(spark, sf), GRID))


@query("scenario_importance", f"""WITH {_GRID}, l AS (SELECT round(sharpe, 6) AS sharpe, fast, slow, code, unnest(['fast', 'slow']) AS parameter, unnest([fast, slow]) AS value FROM o WHERE sharpe IS NOT NULL AND code = '1-URGENT')
SELECT parameter, best, round(stddev_pop(m), 4) AS importance FROM (SELECT parameter, value, avg(sharpe) AS m FROM l GROUP BY 1, 2) JOIN (SELECT parameter, CAST(arg_max(value, (sharpe, fast, slow)) AS VARCHAR) AS best FROM l GROUP BY 1) USING (parameter) GROUP BY 1, 2""")
def _(spark, sf):
    scored = sheets.crossing_grid(D.day_bars(spark, sf).where("code = '1-URGENT'"), GRID)
    return rounded(sheets.importance(scored.withColumn("sharpe", F.round("sharpe", 6)), ["fast", "slow"]))


_SIDES = """g AS (SELECT DISTINCT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, max((l_quantity, l_partkey)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def _sides(spark, sf):
    l = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("volume"), F.col("l_partkey").alias("part"), "l_returnflag")
    l = D.dealt(l, "code")
    return l.where("l_returnflag <> 'R'").select("code", "d").distinct(), l.where("l_returnflag = 'R'")


for _name, _pick in {
    "backward": "b.d", "forward": "a.d", "nearest": "CASE WHEN b.d IS NULL OR a.d - g.d <= g.d - b.d THEN a.d ELSE b.d END", "exact": "CASE WHEN b.d = g.d THEN b.d END",
}.items():
    _far = 45 if _name != "backward" else 100_000
    query(f"reindex_{_name}", f"""WITH {_SIDES}, m AS (SELECT g.code, g.d, {_pick} AS at FROM g ASOF LEFT JOIN r b ON g.code = b.code AND g.d >= b.d ASOF LEFT JOIN r a ON g.code = a.code AND g.d <= a.d)
SELECT m.code, m.d, r.v[1] AS volume, r.v[2] AS part, r.d AS matched FROM m LEFT JOIN r ON r.code = m.code AND r.d = m.at AND abs(m.d - m.at) <= {_far}""")(
        lambda spark, sf, direction=_name, far=_far: J.reindexed(*_sides(spark, sf), ["volume", "part"], direction, far if direction != "backward" else None)
    )


# ---- cross signals ------------------------------------------------------------------------------

def _crossed(a: str, b: str) -> str:
    """1 where a was below b at the row before and is not now."""
    return f"coalesce(CAST(lag(coalesce({a} < {b}, false)) OVER ({KEY}) AND NOT coalesce({a} < {b}, false) AS INT), 0)"


def _since(flag: str) -> str:
    return f"k - coalesce(max(CASE WHEN {flag} = 1 THEN k END) OVER ({KEY} ROWS UNBOUNDED PRECEDING), 0)"


_COMPOSITE = f"""{ROWS}, m AS (SELECT code, k, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS up, abs(x) AS move FROM (SELECT code, k, close - lag(close) OVER ({KEY}) AS x FROM r)), {wilder('gains', 'm', 'up', 12)}, {wilder('moves', 'm', 'move', 12)},
t AS (SELECT *, list((high + low + close) / 3) OVER ({KEY} ROWS 13 PRECEDING) AS l, CASE WHEN k >= 9 THEN coalesce((close - min(low) OVER ({KEY} ROWS 8 PRECEDING)) / nullif(max(high) OVER ({KEY} ROWS 8 PRECEDING) - min(low) OVER ({KEY} ROWS 8 PRECEDING), 0) * 100, 0) END AS f FROM r),
u AS (SELECT *, CASE WHEN k >= 11 THEN avg(f) OVER ({KEY} ROWS 2 PRECEDING) END AS kk, CASE WHEN k >= 14 THEN coalesce(((high + low + close) / 3 - list_avg(l)) / nullif(0.015 * list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))), 0), 0) END AS cci FROM t),
v AS (SELECT *, CASE WHEN k >= 13 THEN avg(kk) OVER ({KEY} ROWS 2 PRECEDING) END AS dd FROM u),
x AS (SELECT v.code, v.k, v.d, v.cci, CASE WHEN dd IS NOT NULL THEN 3 * kk - 2 * dd END AS j, CASE WHEN moves.y > 0 THEN 100 * gains.y / moves.y WHEN moves.y = 0 THEN 0 END AS rsi FROM v JOIN gains USING (code, k) JOIN moves USING (code, k)),
y AS (SELECT *, cci + (rsi - 50) * 4 + (j - 50) * 4 AS mf, (rsi - 50) * 4 AS base, j + (j - lag(j) OVER ({KEY})) AS jp FROM x)"""


@query("max_factor_cross", f"""{_COMPOSITE}, a AS (SELECT *, mf - lag(mf) OVER ({KEY}) AS delta FROM y), b AS (SELECT *, mf + delta AS ahead FROM a),
c AS (SELECT *, greatest({", ".join(_crossed("ahead", f"(base + {x})") for x in (-133, 0, 133))}) AS up, greatest({", ".join(_crossed(f"(base + {x})", "ahead") for x in (-133, 0, 133))}) AS down FROM b)
SELECT code, d, round(mf, 4) AS maxfactor, round(delta, 4) AS maxfactor_delta, round(base, 4) AS regression_baseline, CASE WHEN down = 1 THEN -1 WHEN up = 1 THEN 1 END AS maxfactor_cross, {_since("up")} AS maxfactor_jx, {_since("down")} AS maxfactor_sx FROM c""")
def _(spark, sf):
    return rounded(crosses.max_factor(D.day_bars(spark, sf)), "code", "d", "maxfactor", "maxfactor_delta", "regression_baseline", "maxfactor_cross", "maxfactor_jx", "maxfactor_sx")


@query("dual_cross", f"""{_COMPOSITE}, s AS (SELECT *, coalesce((cci > base)::INT, 0) AS a, coalesce((j > rsi)::INT, 0) AS b, coalesce((jp > rsi)::INT, 0) AS c, coalesce((base > cci)::INT, 0) AS e, coalesce((rsi > j)::INT, 0) AS f, coalesce((rsi > jp)::INT, 0) AS g FROM y),
w AS (SELECT code, k, d, (k > 13 AND a * (a + b + c) > 1)::INT AS up, (k > 13 AND e * (e + f + g) > 1)::INT AS down FROM s)
SELECT code, d, CASE WHEN down = 1 THEN -1 WHEN up = 1 THEN 1 END AS dual_cross, {_since("(1 - up)")} AS dual_jx, {_since("(1 - down)")} AS dual_sx FROM w""")
def _(spark, sf):
    return crosses.dual(D.day_bars(spark, sf)).select("code", "d", "dual_cross", "dual_jx", "dual_sx")


@query("mean_cross", f"""{ROWS}, a AS (SELECT *, CASE WHEN k >= 5 THEN avg(close) OVER ({KEY} ROWS 4 PRECEDING) END AS f, CASE WHEN k >= 30 THEN avg(close) OVER ({KEY} ROWS 29 PRECEDING) END AS s FROM r), c AS (SELECT *, {_crossed("f", "s")} AS up, {_crossed("s", "f")} AS down FROM a)
SELECT code, d, CASE WHEN down = 1 THEN -1 WHEN up = 1 THEN 1 END AS ma_cross, {_since("up")} AS ma_jx, {_since("down")} AS ma_sx FROM c""")
def _(spark, sf):
    return crosses.mean_crosses(D.day_bars(spark, sf)).select("code", "d", "ma_cross", "ma_jx", "ma_sx")


@query("band_cross", f"""{ROWS}, a AS (SELECT *, CASE WHEN k >= 20 THEN avg(close) OVER w END AS mid, CASE WHEN k >= 20 THEN stddev_pop(close) OVER w END AS s, CASE WHEN k >= 2 THEN avg(low) OVER v END AS l2, CASE WHEN k >= 2 THEN avg(high) OVER v END AS h2 FROM r WINDOW w AS ({KEY} ROWS 19 PRECEDING), v AS ({KEY} ROWS 1 PRECEDING)),
b AS (SELECT *, mid + 2 * s AS ub, mid - 2 * s AS lb, least(open, close, CASE WHEN open < mid THEN low ELSE l2 END) AS lo, greatest(open, close, CASE WHEN open > mid THEN high ELSE h2 END) AS hi, 4 * s / mid AS width FROM a),
c AS (SELECT *, {_crossed("lo", "lb")} AS up, {_crossed("ub", "hi")} AS down, width - lag(width) OVER ({KEY}) AS delta, CASE WHEN k >= 39 THEN avg(width) OVER ({KEY} ROWS 19 PRECEDING) END AS wide FROM b)
SELECT code, d, round(lo, 4) AS min_peak, round(hi, 4) AS max_peak, CASE WHEN down = 1 THEN -1 WHEN up = 1 THEN 1 END AS boll_cross, {_since("up")} AS boll_jx, {_since("down")} AS boll_sx, round(ub, 4) AS boll_ub, round(mid, 4) AS boll_ma, round(lb, 4) AS boll_lb, round(width, 4) AS boll_width, round(delta, 4) AS boll_delta, round(wide, 4) AS bbw_ma20 FROM c""")
def _(spark, sf):
    return rounded(crosses.band_crosses(D.day_bars(spark, sf)), "code", "d", "min_peak", "max_peak", "boll_cross", "boll_jx", "boll_sx", "boll_ub", "boll_ma", "boll_lb", "boll_width", "boll_delta", "bbw_ma20")


# ---- turning points -----------------------------------------------------------------------------

_LINE = "p AS (SELECT code, k, close AS v FROM r)"
_AHEAD = {x: f"w.{x} + {num(2 / (n + 1))} * (r.close - w.{x})" for x, n in (("fast", 12), ("slow", 26))}
_MACD = f"""{ROWS}, {_LINE}, a AS (SELECT code, k, close, avg(close) OVER ({KEY} ROWS 11 PRECEDING) AS m12, avg(close) OVER ({KEY} ROWS 25 PRECEDING) AS m26 FROM r),
{walk("e", "a", {x: (f"r.{m}", f"CASE WHEN r.k <= 26 THEN r.{m} ELSE {_AHEAD[x]} END") for x, m in (("fast", "m12"), ("slow", "m26"))})}, f AS (SELECT code, k, CASE WHEN k >= 26 THEN fast - slow END AS x FROM e), {ta_mean("s", "f", "x", 9)},
m AS (SELECT *, hist - lag(hist) OVER ({KEY}) AS delta FROM (SELECT code, k, CASE WHEN s.y IS NOT NULL THEN x END AS dif, s.y AS dea, 2 * (x - s.y) AS hist FROM f JOIN s USING (code, k))),
h AS (SELECT code, k - 33 AS k, dea AS v FROM m WHERE dea IS NOT NULL), {low_passed("hs", "h")}, {turned("ht", "h", "hs", "h")},
g AS (SELECT m.*, turn, greatest({_crossed("dif", "dea")}, coalesce(turn, 0)) AS up, CASE WHEN turn = -1 THEN 1 ELSE 0 END AS down FROM m LEFT JOIN (SELECT code, k + 33 AS k, turn FROM ht) t USING (code, k)),
n AS (SELECT *, {_since("up")} AS jx, {_since("down")} AS sx FROM g)"""
_SHOWN = "round(dif, 4) AS dif, round(dea, 4) AS dea, round(hist, 4) AS macd, round(delta, 4) AS delta, n.turn AS macd_cross, n.jx AS macd_jx, n.sx AS macd_sx"


@query("macd_cross", f"{_MACD} SELECT code, d, {_SHOWN} FROM n JOIN r USING (code, k)")
def _(spark, sf):
    return rounded(peaks.macd_crosses(D.day_bars(spark, sf)), "code", "d", "dif", "dea", "macd", "delta", "macd_cross", "macd_jx", "macd_sx")


@query("price_trend", f"""{_MACD}, {low_passed("ps", "p")}, {turned("pt", "p", "ps", "p")},
i AS (SELECT *, max(k) OVER (PARTITION BY code) AS n, avg(v) OVER ({KEY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean, (2 * lead(v, 2) OVER ({KEY}) + lead(v) OVER ({KEY}) - lag(v) OVER ({KEY}) - 2 * lag(v, 2) OVER ({KEY})) / 10 AS b FROM p),
j AS (SELECT code, k, round(CASE WHEN k = 1 THEN lead(mean, 2) OVER ({KEY}) - 2 * lead(b, 2) OVER ({KEY}) WHEN k = 2 THEN lead(mean) OVER ({KEY}) - lead(b) OVER ({KEY}) WHEN k = n THEN lag(mean, 2) OVER ({KEY}) + 2 * lag(b, 2) OVER ({KEY}) WHEN k = n - 1 THEN lag(mean) OVER ({KEY}) + lag(b) OVER ({KEY}) ELSE mean END, 9) AS v FROM i WHERE n >= 5),
{turned("et", "j", "j", "p")}, o AS (SELECT n.*, pt.turn AS pp, CASE WHEN jx < sx THEN et.turn END AS ee FROM n LEFT JOIN pt ON pt.code = n.code AND pt.k = n.k LEFT JOIN et ON et.code = n.code AND et.k = n.k),
q AS (SELECT *, coalesce((pp = 1)::INT, 0) | coalesce((ee = 1)::INT, 0) AS lows, coalesce((pp = -1)::INT, 0) | coalesce((ee = -1)::INT, 0) AS highs FROM o)
SELECT code, d, {_SHOWN.replace("n.", "q.")}, coalesce(ee, pp) * (k - 1) AS price_cross, {_since("lows")} AS price_jx, {_since("highs")} AS price_sx FROM q JOIN r USING (code, k)""")
def _(spark, sf):
    return rounded(peaks.price_trend(D.day_bars(spark, sf)), "code", "d", "dif", "dea", "macd", "delta", "macd_cross", "macd_jx", "macd_sx", "price_cross", "price_jx", "price_sx")


@query("mean_turns", f"""{ROWS}, h AS (SELECT code, k - 29 AS k, m AS v FROM (SELECT code, k, avg(close) OVER ({KEY} ROWS 29 PRECEDING) AS m FROM r) WHERE k >= 30), {low_passed("hs", "h")}, {turned("ht", "h", "hs", "h")},
g AS (SELECT code, k, d, coalesce((turn = 1)::INT, 0) AS up, coalesce((turn = -1)::INT, 0) AS down FROM r LEFT JOIN (SELECT code, k + 29 AS k, turn FROM ht) t USING (code, k))
SELECT code, d, {_since("up")} AS turn_jx, {_since("down")} AS turn_sx FROM g""")
def _(spark, sf):
    return peaks.mean_turns(D.day_bars(spark, sf)).select("code", "d", "turn_jx", "turn_sx")


# ---- row functions, SQL, streams ----------------------------------------------------------------


@query("move_runs", f"""{ROWS}, m AS (SELECT code, k, d, close, lag(d) OVER ({KEY}) AS before, lag(close) OVER ({KEY}) AS old, CAST(sign(close - lag(close) OVER ({KEY})) AS INT) AS way FROM r),
n AS (SELECT *, sum((way IS DISTINCT FROM w)::INT) OVER ({KEY} ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(way) OVER ({KEY}) AS w FROM m WHERE way IS NOT NULL))
SELECT code, min(before) AS "from", max(d) AS "to", any_value(way) AS way, CAST(count(*) AS INT) AS rows, round(arg_max(close, k) - arg_min(old, k), 4) AS change FROM n GROUP BY code, i""")
def _(spark, sf):
    return rounded(rows.walked(D.day_bars(spark, sf), rows.MoveRuns, rows.MoveRuns.SCHEMA))


@query("asked", f"""WITH {BARS} SELECT code, CAST(year(d) AS INT) AS year, count(*) AS n, round(avg(close), 4) AS mean, max(high) AS top FROM bars WHERE d >= DATE '1996-07-01' AND code <> '5-LOW' GROUP BY 1, 2 HAVING count(*) > 20""")
def _(spark, sf):
    sql = """SELECT code, year(d) AS year, count(*) AS n, round(avg(IDENTIFIER(:mean)), 4) AS mean, max(IDENTIFIER(:top)) AS top
      FROM {bars} WHERE d >= :since AND code <> :without GROUP BY 1, 2 HAVING count(*) > :least"""
    return ask(spark, sql, {"bars": D.day_bars(spark, sf)}, {"mean": "close", "top": "high"}, since=datetime.date(1996, 7, 1), without="5-LOW", least=20)


@query("block_files", "SELECT p_brand AS block, CAST(p_size AS INT) AS kind, CAST(p_partkey AS VARCHAR) AS code FROM part")
def _(spark, sf):
    part = D.table(spark, sf, "part").select(F.substring("p_brand", 7, 9).alias("block"), F.col("p_size").cast("int").alias("kind"), F.col("p_partkey").cast("string").alias("code"))
    path = kept.shared_path(spark, "blocks")
    blocks.write_blocks(part, path)
    return blocks.read_blocks(spark, path).select(F.concat(F.lit("Brand#"), "block").alias("block"), "kind", "code")


@query("stream_sections", """WITH e AS (SELECT event_type AS code, time_bucket(INTERVAL 1 HOUR, ts) AS start, ts, event_id, value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), l AS (SELECT start, code, arg_max(value, (ts, event_id)) AS price FROM e GROUP BY 1, 2),
s AS (SELECT start, count(*) AS n, count(*) >= (SELECT count(DISTINCT code) FROM e) AS complete FROM l GROUP BY 1) SELECT start, code, price, n, complete FROM l JOIN s USING (start) WHERE complete OR start + INTERVAL 1 HOUR < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    kinds = D.table(spark, sf, "events").where("value is not null").select("event_type").distinct().count()
    return _ran(spark, streams.sections(_events(spark, sf), kinds, 3600), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "code", "price", "n", "complete")
