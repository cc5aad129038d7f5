"""Runs, crossings and event distances over a code's ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions.series import CROSS, PCT, last_n, ordered


def run_length(df: DataFrame, x: str, name: str = "run", code: str = "code", ts: str = "d") -> DataFrame:
    """Length of the run of 1s that ends at each row; 0 on a 0."""
    w = ordered(code, ts)
    s = df.withColumn("__i", F.sum(F.when(F.col(x) == 1, 0).otherwise(1)).over(last_n(w, 0)))
    inner = Window.partitionBy(code, "__i").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn(name, F.when(F.col(x) == 1, F.sum(F.when(F.col(x) == 1, 1).otherwise(0)).over(inner)).otherwise(0)).drop("__i")


def since_last(df: DataFrame, x: str, name: str = "since", code: str = "code", ts: str = "d") -> DataFrame:
    """Rows since the last 1 (0 on it); before any, rows so far."""
    w = ordered(code, ts)
    s = df.withColumn("__p", F.row_number().over(w))
    return s.withColumn(name, F.col("__p") - F.coalesce(F.max(F.when(F.col(x) == 1, F.col("__p"))).over(last_n(w, 0)), F.lit(0))).drop("__p")


def spaced(df: DataFrame, cond, n: int, name: str = "kept", code: str = "code", ts: str = "d") -> DataFrame:
    """True rows that lie n rows or more after the previous true row; the first counts."""
    w = ordered(code, ts)
    s = df.withColumns({"__p": F.row_number().over(w), "__c": F.coalesce(cond, F.lit(False))})
    before = F.max(F.when(F.col("__c"), F.col("__p"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn(name, F.col("__c") & (before.isNull() | (F.col("__p") - before >= n))).drop("__p", "__c")


def last_rows(df: DataFrame, cond, first: int, last: int, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, holds): whether the condition holds on each of the rows ``first`` to ``last`` from the end (1 is the last)."""
    k = F.row_number().over(Window.partitionBy(code).orderBy(F.desc(ts)))
    band = df.withColumn("__k", k).where(F.col("__k").between(min(first, last), max(first, last)))
    return band.groupBy(code).agg(F.bool_and(F.coalesce(cond, F.lit(False))).alias("holds"))


def bars_since(df: DataFrame, cond, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, since, since_not): rows from the last true (not true) row to the end; null if there is none."""
    s = df.withColumns({"__p": F.row_number().over(ordered(code, ts)), "__c": F.coalesce(cond, F.lit(False))})
    return s.groupBy(code).agg((F.max("__p") - F.max(F.when(F.col("__c"), F.col("__p")))).alias("since"), (F.max("__p") - F.max(F.when(~F.col("__c"), F.col("__p")))).alias("since_not"))


def momentum(df: DataFrame, x: str = "close", n: int = 24, rf: float = 0.02, code: str = "code", ts: str = "d") -> DataFrame:
    return df.withColumn("momentum", PCT(x, n, ordered(code, ts)) - rf)


def crosses(df: DataFrame, fast: str, slow: str, code: str = "code", ts: str = "d") -> DataFrame:
    """Golden and dead crosses and the rows since each."""
    w = ordered(code, ts)
    s = df.withColumns({"golden": F.coalesce(CROSS(fast, slow, w), F.lit(0)), "dead": F.coalesce(CROSS(slow, fast, w), F.lit(0))})
    return since_last(since_last(s, "golden", "since_golden", code, ts), "dead", "since_dead", code, ts)


def longest_sequences(df: DataFrame, x: str = "close", code: str = "code", ts: str = "d") -> DataFrame:
    """(code, rising, falling, hurst): lengths of the longest monotone subsequences and the R/S exponent."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = f.sort_values(ts)[x].to_numpy(float)
        return pd.DataFrame({code: [f[code].iloc[0]], "rising": [len(R.longest_run(v))], "falling": [len(R.longest_run(v, True))], "hurst": [R.hurst(v)]})

    return df.select(code, ts, x).groupBy(code).applyInPandas(run, f"{code} {dict(df.dtypes)[code]}, rising long, falling long, hurst double")


def renko_bricks(df: DataFrame, size: float, percent: bool = False, x: str = "close", code: str = "code", ts: str = "d") -> DataFrame:
    """(code, d, brick, price, way): bricks of a fixed or relative size; a row can give none or several."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ts).reset_index(drop=True)
        made = R.renko(f[x], size, percent)
        return pd.DataFrame({code: [f[code].iloc[0]] * len(made), ts: [f[ts][i] for i, _, _ in made], "brick": list(range(len(made))), "price": [p for _, p, _ in made], "way": [d for _, _, d in made]})

    kinds = dict(df.dtypes)
    return df.select(code, ts, x).groupBy(code).applyInPandas(run, f"{code} {kinds[code]}, {ts} {kinds[ts]}, brick long, price double, way long")


def peaks(df: DataFrame, x: str = "close", smooth: int = 2, distance: int = 5, code: str = "code", ts: str = "d") -> DataFrame:
    """Columns peak and trough: extremes of the centred mean within ``distance`` rows either side."""
    w = ordered(code, ts)
    s = df.withColumn("__m", F.avg(x).over(w.rowsBetween(-smooth, smooth)))
    around = w.rowsBetween(-distance, distance)
    full = F.count("__m").over(around) == 2 * distance + 1
    return s.withColumns({"peak": (full & (F.col("__m") == F.max("__m").over(around))).cast("int"), "trough": (full & (F.col("__m") == F.min("__m").over(around))).cast("int")}).drop("__m")
