"""Row functions: one code's rows, in order, through an object that may give more or fewer rows.

The general extension point.  Spark deals rows out by key and sorts them; a
table function gets them one after another, so a code's history is never held,
and what it gives streams on.  Usable from DataFrames and from SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


class Walk(Protocol):
    """State of one key: rows in, rows out, and what is left at the end."""

    def row(self, row) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def table_function(make: Callable[[], Walk], schema: str):
    """A Python table function that gives each key's rows to a ``Walk`` of its own."""

    class Handler:
        def __init__(self):
            self.walk = make()

        def eval(self, row):
            yield from self.walk.row(row)

        def terminate(self):
            yield from self.walk.end()

    return udtf(Handler, returnType=schema)


def walked(df: DataFrame, make: Callable[[], Walk], schema: str, by: str = "code", order: str | list[str] = "d") -> DataFrame:
    """What the walks of ``df``'s keys give.  Rows of a null key are one key; equal times come in any order; no rows give none."""
    return table_function(make, schema)(df.asTable().partitionBy(by).orderBy(*([order] if isinstance(order, str) else order)))


def register(spark: SparkSession, name: str, make: Callable[[], Walk], schema: str) -> None:
    """For SQL: SELECT * FROM name(TABLE(t) PARTITION BY code ORDER BY d)."""
    spark.udtf.register(name, table_function(make, schema))


class MoveRuns:
    """Runs of rising, falling or level values: (code, from, to, way, rows, change), a row when a run ends.

    A run begins with the value it moves away from; a code's first row begins
    its first run.  Rows without a value are passed over.
    """

    SCHEMA = "code string, `from` date, `to` date, way int, rows int, change double"

    def __init__(self, code: str = "code", ts: str = "d", x: str = "close"):
        self.names, self.last, self.run = (code, ts, x), None, None

    def row(self, row):
        code, at, x = (row[c] for c in self.names)
        if x is None:
            return
        if self.last is not None:
            way = (x > self.last[1]) - (x < self.last[1])
            if self.run and self.run[3] == way:
                self.run[2], self.run[4], self.run[6] = at, self.run[4] + 1, x
            else:
                yield from self.end()
                self.run = [code, self.last[0], at, way, 1, self.last[1], x]
        self.last = (at, x)

    def end(self):
        if self.run:
            code, begin, to, way, rows, first, x = self.run
            yield code, begin, to, way, rows, float(x) - float(first)
