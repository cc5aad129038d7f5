"""Fetching: one pushed-down scan for each kind of table that feeds keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(rows: DataFrame, codes=None, start=None, end=None, columns=None, code: str = "code", ts: str = "d", only_last: bool = False) -> DataFrame:
    """Rows of some codes (one, a list, or all) in a closed range of days or times, projected to ``columns``.

    Filters are plain comparisons, so they reach a Parquet or JDBC scan.
    ``only_last`` keeps each code's rows at its latest time in the range.
    """
    if codes is not None:
        rows = rows.where(F.col(code).isin([codes] if isinstance(codes, (str, int)) else list(codes)))
    kind = dict(rows.dtypes).get(ts)
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        rows = rows.where(F.col(ts) <= F.lit(end).cast(kind))
    if only_last:
        last = rows.groupBy(code).agg(F.max(ts).alias("__last")).withColumnRenamed(code, "__code")
        rows = rows.join(last, (F.col(code) == F.col("__code")) & (F.col(ts) == F.col("__last"))).drop("__last", "__code")
    return rows.select(*columns) if columns else rows


def listings(bars: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, first, last, n): what is listed, since when, until when; the list of any kind of instrument."""
    return bars.groupBy(code).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def terminated(bars: DataFrame, before, code: str = "code", ts: str = "d") -> DataFrame:
    """Listings whose last row lies before a day."""
    return listings(bars, code, ts).where(F.col("last") < F.lit(before).cast(dict(bars.dtypes)[ts]))


def names(info: DataFrame, codes, code: str = "code", name: str = "name") -> DataFrame:
    """(code, name) of some codes."""
    return fetch(info, codes, columns=[code, name], code=code)


def weights(members: DataFrame, amount: str, index: str = "index", code: str = "code") -> DataFrame:
    """(index, code, weight): an index's or fund's components by their share of an amount."""
    per = members.groupBy(index, code).agg(F.sum(amount).alias("__a"))
    whole = per.groupBy(index).agg(F.sum("__a").alias("__t"))
    return per.join(whole, index).select(index, code, (F.col("__a") / F.nullif(F.col("__t"), F.lit(0.0))).alias("weight"))


def reports(lines: DataFrame, amount: str, code: str = "code", ts: str = "d") -> DataFrame:
    """(code, period, total, n): one report a code and quarter, dated by the quarter's last day."""
    period = F.last_day(F.add_months(F.trunc(ts, "quarter"), 2))
    return lines.groupBy(code, period.alias("period")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def yields(dividends: DataFrame, prices: DataFrame, code: str = "code", ts: str = "d") -> DataFrame:
    """dividends (code, d, dividend) with the price in force and their ratio."""
    from ..operators.joins import as_of

    return as_of(dividends, prices, ["close"], code, ts).withColumn("yield", F.col("dividend") / F.nullif(F.col("close"), F.lit(0.0)))
