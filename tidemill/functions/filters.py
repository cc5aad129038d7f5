"""Recursive linear filters over blocks of rows that run side by side.

Rows are cut into blocks of one length.  What a block gives from rest is a
product of its values with a fixed matrix; what it owes to the rows before it
is a product with the state in which it is entered.  The states, one row a
block, are passed along each code in turn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 512


def low_pass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth coefficients (b, a) by the bilinear transform; ``cutoff`` is a share of the highest frequency."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    gain = (warped**order / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)), np.poly((4 + poles) / (4 - poles)).real


def settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State that a constant input of 1 leads to (filters that pass constants unchanged)."""
    return np.cumsum((b - a)[:0:-1])[::-1]


class Steps:
    """Matrices of ``rows`` steps of y = z0 + b0 x, z' = A z + B x."""

    def __init__(self, b: np.ndarray, a: np.ndarray, rows: int = ROWS):
        n = len(a) - 1
        self.turn = np.eye(n, k=1)
        self.turn[:, 0] -= a[1:]
        powers = [np.eye(n)]
        for _ in range(rows):
            powers.append(self.turn @ powers[-1])
        self.powers = np.array(powers)
        feed = b[1:] - a[1:] * b[0]
        self.owed = self.powers[:rows, 0, :]
        self.fed = self.powers[:rows] @ feed
        self.rest = np.concatenate([[b[0]], self.owed[: rows - 1] @ feed])

    def output(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.convolve(x, self.rest)[: len(x)] + self.owed[: len(x)] @ state

    def leaving(self, x: np.ndarray) -> np.ndarray:
        """State after a block that is entered at rest."""
        return self.fed[: len(x)][::-1].T @ x


def one_way(df: DataFrame, b: np.ndarray, a: np.ndarray, rows: int = ROWS) -> DataFrame:
    """(code, k, v) filtered along k, which counts a code's rows from 0; entered as if the first value had stood for ever."""
    steps, begin = Steps(b, a, rows), settled(b, a)

    @F.pandas_udf("array<double>")
    def leaving(x: pd.Series) -> pd.Series:
        return x.map(lambda v: steps.leaving(np.asarray(v)))

    @F.pandas_udf("array<array<double>>")
    def entered(blocks: pd.Series) -> pd.Series:
        def states(found):
            state, out = begin * found[0]["first"], []
            for one in found:
                out.append(state)
                state = steps.powers[one["n"]] @ state + np.asarray(one["leaving"])
            return out

        return blocks.map(states)

    @F.pandas_udf("array<double>")
    def output(x: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([steps.output(np.asarray(v), np.asarray(s)) for v, s in zip(x, state)], dtype=object)

    g = F.floor(F.col("k") / rows)
    blocks = df.groupBy("code", g.alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).select("code", "g", F.col("x.v").alias("x"))
    ends = blocks.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("g", F.size("x").alias("n"), F.col("x")[0].alias("first"), leaving("x").alias("leaving")))).alias("blocks"))
    states = ends.select(F.col("code").alias("__code"), F.posexplode(entered("blocks")).alias("__g", "state"))
    met = blocks.join(states, F.col("code").eqNullSafe(F.col("__code")) & (F.col("g") == F.col("__g")))
    return met.select("code", "g", F.posexplode(output("x", "state")).alias("i", "v")).select("code", (F.col("g") * rows + F.col("i")).alias("k"), "v")


def zero_phase(df: DataFrame, b: np.ndarray, a: np.ndarray, rows: int = ROWS, cut=lambda df: df) -> DataFrame:
    """(code, k, v) filtered forwards and backwards, with both ends continued by their point reflection.

    ``k`` counts a code's rows from 0 and no v is null.  Codes with no more rows
    than a reflection takes (three times the coefficients) are left out.  ``cut``
    may end the lineage of what both ways read twice.
    """
    pad = 3 * len(a)
    ends = df.groupBy(F.col("code").alias("__code")).agg(F.count("*").alias("n"), F.min_by("v", "k").alias("first"), F.max_by("v", "k").alias("last")).where(F.col("n") > pad)
    known = df.join(ends, F.col("code").eqNullSafe(F.col("__code"))).drop("__code")
    k, n = F.col("k"), F.col("n")
    before = F.when(k.between(1, pad), F.struct((pad - k).alias("k"), (2 * F.col("first") - F.col("v")).alias("v")))
    after = F.when(k.between(n - 1 - pad, n - 2), F.struct((2 * (n - 1) - k + pad).alias("k"), (2 * F.col("last") - F.col("v")).alias("v")))
    longer = known.select("code", F.inline(F.array_compact(F.array(before, F.struct((k + pad).alias("k"), F.col("v")), after))))

    def turned(filtered):
        met = filtered.join(ends.select("__code", "n"), F.col("code").eqNullSafe(F.col("__code")))
        return met.select("code", (F.col("n") + 2 * pad - 1 - F.col("k")).alias("k"), "v")

    there = cut(turned(one_way(cut(longer), b, a, rows)))
    back = turned(one_way(there, b, a, rows))
    met = back.join(ends.select("__code", "n"), F.col("code").eqNullSafe(F.col("__code"))).where((k >= pad) & (k < n + pad))
    return met.select("code", (k - pad).alias("k"), "v")
