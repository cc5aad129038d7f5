"""Recursive series as a segmented scan: y = keep * y' + add, over blocks of time that run side by side.

A code's rows are cut into blocks.  Within a block the recursion is a running
sum of weighted terms; a block as a whole is one affine map of the value that
enters it.  The maps, a row a block, are composed along each code, and each
block adds what enters it.  So the rows of one code are many tasks' work, all
of it built-in expressions, and nothing but block rows meets in one place.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most; fewer where weights would leave the range of doubles.
ROWS = 512
#: Decades that the weights of one block may span.
DECADES = 150


class Decay(NamedTuple):
    """y = keep^step * y' + add, in SQL; ``step`` is true or false a row, ``add`` null counts as 0.

    y starts from 0 or, if there is ``seed``, from the seed of a code's first
    row that has one, and is null before that row.
    """

    keep: float
    add: str
    step: str = "true"
    seed: str | None = None


def value(x: str) -> str:
    """A number, or null where there is none or it is NaN."""
    return f"nullif(double(`{x}`), double('NaN'))"


def decayed(df: DataFrame, series: dict[str, Decay], code: str = "code", ts: str = "d", period: str = "year", rows: int = ROWS, shown: bool = False) -> DataFrame:
    """``df`` with a column for each of the series; times within a code differ.

    Blocks are calendar periods (``period``: a unit of date_trunc), cut further
    at ``rows`` rows.  With ``shown``, a seeded series shows its seed in the row
    before the one that seeds it, too, and is null where ``seed`` is.  A null
    code is a code; rows without a time have nulls.
    """
    least = min((s.keep for s in series.values()), default=1.0)
    if least <= 0:
        raise ValueError("a series that keeps nothing needs no scan")
    rows = max(1, min(rows, int(DECADES / -math.log10(least)) if least < 1 else rows))
    names, kept, time = list(series), df.columns, dict(df.dtypes)[ts]
    steps = list(dict.fromkeys(s.step for s in series.values() if s.keep != 1))
    seeds = list(dict.fromkeys(s.seed for s in series.values() if s.seed))
    power = lambda s, sign="": "1D" if s.keep == 1 else f"pow({s.keep!r}D, {sign}__e{steps.index(s.step)})"
    block = f"PARTITION BY `{code}`, __b, __s ORDER BY `{ts}`"
    run = f"OVER ({block} ROWS UNBOUNDED PRECEDING)"
    cut = df.selectExpr("*", f"timestamp(date_trunc('{period}', `{ts}`)) AS __b").selectExpr("*", f"floor((row_number() OVER (PARTITION BY `{code}`, __b ORDER BY `{ts}`) - 1) / {rows}) AS __s")
    local = cut.selectExpr("*", *(f"sum(int({e})) {run} AS __e{k}" if e != "true" else f"bigint(row_number() OVER ({block})) AS __e{k}" for k, e in enumerate(steps)), *([f"lead(`{ts}`) OVER ({block}) AS __next"] if shown else []))
    local = local.selectExpr("*", *(f"{power(s)} * sum(coalesce(double({s.add}), 0D) * {power(s, '-')}) {run} AS __l{k}" for k, s in enumerate(series.values())))

    # one row a block: where it begins, its affine maps, its first seeds
    maps = ", ".join([*(f"__e{k}" for k in range(len(steps))), *(f"__l{k}" for k in range(len(names)))])
    ends = local.where(F.col(ts).isNotNull()).groupBy(code, "__b", "__s").agg(
        F.expr(f"min(`{ts}`) AS __from"), F.expr(f"max_by(struct({maps}), `{ts}`) AS __z"), *(F.expr(f"min(CASE WHEN ({g}) IS NOT NULL THEN named_struct('at', `{ts}`, 'x', double({g})) END) AS __g{k}") for k, g in enumerate(seeds))
    )
    seed = lambda s: f"__g{seeds.index(s.seed)}"
    enters = {k: f"coalesce(a.c{k}, r.{seed(s)}.x)" if s.seed else f"a.c{k}" for k, s in enumerate(series.values())}
    kinds = "".join(f", c{k}: double" for k in enters)
    start = f"named_struct('out', cast(array() AS array<struct<b: timestamp, s: bigint, `from`: {time}{kinds}>>)" + "".join(f", 'c{k}', {'cast(null AS double)' if s.seed else '0D'}" for k, s in enumerate(series.values())) + "".join(f", '__g{k}', cast(null AS struct<at: {time}, x: double>)" for k in range(len(seeds))) + ")"
    here = "named_struct('b', r.__b, 's', r.__s, 'from', r.__from" + "".join(f", 'c{k}', {c}" for k, c in enters.items()) + ")"
    leaves = "".join(f", 'c{k}', r.__z.__l{k} + {enters[k]} * {power(s).replace('__e', 'r.__z.__e')}" for k, s in enumerate(series.values()))
    fold = f"named_struct('out', concat(a.out, array({here})){leaves}" + "".join(f", '__g{k}', coalesce(a.__g{k}, r.__g{k})" for k in range(len(seeds))) + ")"
    listed = ", ".join(["__b", "__s", "__from", "__z", *(f"__g{k}" for k in range(len(seeds)))])
    folded = ends.groupBy(code).agg(F.expr(f"aggregate(array_sort(collect_list(struct({listed}))), {start}, (a, r) -> {fold}) AS f"))
    out = "transform(f.out, (o, i) -> struct(o, try_element_at(f.out, int(i + 2)).`from` AS after))"
    carried = folded.selectExpr(f"`{code}` AS __code", *(f"f.__g{k}" for k in range(len(seeds))), f"inline({out})")
    carried = carried.selectExpr("__code", *(f"__g{k}" for k in range(len(seeds))), "o.b AS __b0", "o.s AS __s0", "after AS __after", *(f"o.c{k} AS __c{k}" for k in enters))
    made = []
    for k, (n, s) in enumerate(series.items()):
        y = f"__l{k} + {power(s)} * __c{k}"
        if s.seed:
            y = f"CASE WHEN `{ts}` >= {seed(s)}.at THEN {y} END"
            y = f"CASE WHEN coalesce(__next, __after) = {seed(s)}.at THEN {seed(s)}.x WHEN ({s.seed}) IS NOT NULL THEN {y} END" if shown else y
        made.append(f"{y} AS `{n}`")
    joined = local.join(carried, F.expr(f"`{code}` <=> __code AND __b = __b0 AND __s = __s0"), "left")
    return joined.selectExpr(*(f"`{c}`" for c in kept if c not in names), *made)


def emas(df: DataFrame, wanted: dict[str, tuple[str, int]], code: str = "code", ts: str = "d", **how) -> DataFrame:
    """Columns name: (x, n): means with weights (1 - 2/(n+1))^age in rows; null until n - 1 values were seen.

    Null rows have no weight of their own, but age the values before them.
    """
    series, of = {}, []
    for name, (x, n) in wanted.items():
        there = f"int({value(x)} IS NOT NULL)"
        if n > 1:
            keep = 1 - 2 / (n + 1)
            series |= {f"__n_{name}": Decay(keep, value(x)), f"__d_{name}": Decay(keep, there), f"__c_{x}": Decay(1.0, there)}
            of.append(f"CASE WHEN round(`__c_{x}`) >= {n - 1} THEN `__n_{name}` / nullif(`__d_{name}`, 0D) END AS `{name}`")
        else:
            of.append(f"{value(x)} AS `{name}`")
    scanned = decayed(df, series, code, ts, **how) if series else df
    return scanned.selectExpr(*(f"`{c}`" for c in df.columns if c not in wanted), *of)


def smas(df: DataFrame, wanted: dict[str, tuple[str, int, int]], code: str = "code", ts: str = "d", begun: str | None = None, **how) -> DataFrame:
    """Columns name: (x, n, m): y = (m x + (n - m) y') / n, null on null rows.

    A code's first row is ignored; the first value after it is the seed, and the
    row before that shows the seed too.  ``begun`` names a column that has the
    time of the code's first row (see ``beginnings``); it is found if not given.
    """
    known, series, of = df if begun else beginnings(df, "__t", code, ts), {}, []
    for name, (x, n, m) in wanted.items():
        good = f"({value(x)} IS NOT NULL AND `{ts}` > `{begun or '__t'}`)"
        seed = f"CASE WHEN {good} THEN {value(x)} END"
        if n > m:  # from y' = x the recursion gives x, so the seed is where it starts
            series[f"__y_{name}"] = Decay((n - m) / n, f"{seed} * {m / n!r}D", good, seed)
            of.append(f"`__y_{name}` AS `{name}`")
        else:  # nothing is kept: the scan only finds where the seed is
            series[f"__y_{name}"] = Decay(1.0, "0", good, seed)
            of.append(f"CASE WHEN {good} THEN {value(x)} ELSE `__y_{name}` END AS `{name}`")
    return decayed(known, series, code, ts, shown=True, **how).selectExpr(*(f"`{c}`" for c in df.columns if c not in wanted), *of)


def beginnings(df: DataFrame, name: str, code: str = "code", ts: str = "d") -> DataFrame:
    """``df`` with the time of each code's first row."""
    first = df.groupBy(code).agg(F.min(ts).alias(name)).withColumnRenamed(code, "__code")
    return df.join(first, df[code].eqNullSafe(first["__code"])).drop("__code")


def begun_means(df: DataFrame, wanted: dict[str, tuple[str, int, int]], code: str = "code", ts: str = "d", **how) -> DataFrame:
    """Columns name: (x, n, at): at a code's value number ``at`` the mean of the last n rows, then y' + 2/(n + 1) (x - y'); null before, kept on null rows."""
    over = f"OVER (PARTITION BY `{code}` ORDER BY `{ts}` ROWS"
    seen = list(dict.fromkeys(x for x, _, _ in wanted.values()))
    first = df.selectExpr("*", *(f"count({value(x)}) {over} UNBOUNDED PRECEDING) AS `__n_{x}`" for x in seen), *(f"avg({value(x)}) {over} {n - 1} PRECEDING) AS `__a_{name}`" for name, (x, n, _) in wanted.items()))
    series = {}
    for name, (x, n, at) in wanted.items():
        there, seed = f"({value(x)} IS NOT NULL AND `__n_{x}` >= {at})", f"CASE WHEN {value(x)} IS NOT NULL AND `__n_{x}` = {at} THEN `__a_{name}` END"
        series[name] = Decay(1 - 2 / (n + 1), f"{2 / (n + 1)!r}D * coalesce({seed}, CASE WHEN {there} THEN {value(x)} END)", there, seed)
    return decayed(first, series, code, ts, **how).drop(*(f"__n_{x}" for x in seen), *(f"__a_{name}" for name in wanted))
