"""Composite cross signals: where two lines cross, which way, and how long ago.

``*_cross`` is 1 where the fast line comes up through the slow one, -1 where it
goes down through it (which wins if both happen), else null; ``*_jx`` and
``*_sx`` count the rows since the last of either, from the first row if none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import C, H, L, O, W, ratio, stage
from ..functions.scan import Decay, decayed
from ..functions.series import AVEDEV, CROSS, CROSS_STATUS, DIFF, HHV, LLV, MA, STDP
from .signals import run_length, since_last


def wilder_rsi(df: DataFrame, n: int = 12, x: str = "close", name: str = "rsi", code: str = "code", ts: str = "d") -> DataFrame:
    """Index of smoothed gains over smoothed moves; 0 without moves, null for a code's first n rows.

    The mean of the first n moves starts the smoothing: they weigh 1/n each and
    do not age until all have come.
    """
    s = stage(df, __m=DIFF(x, 1, W()), __pos=F.row_number().over(W()))
    late = f"__pos > {n + 1}"
    s = decayed(s, {"__gain": Decay((n - 1) / n, f"greatest(__m, 0D) / {n}", late), "__move": Decay((n - 1) / n, f"abs(__m) / {n}", late)}, code, ts)
    value = F.when(F.col("__move") > 0, 100 * F.col("__gain") / F.col("__move")).otherwise(0.0)
    return stage(s, **{name: F.when(F.col("__pos") > n, value)}).drop("__m", "__pos", "__gain", "__move")


def channel_index(df: DataFrame, n: int = 14, name: str = "cci") -> DataFrame:
    """Distance of the typical price from its mean in mean deviations / 0.015; 0 without deviation."""
    s = stage(df, __t=(H() + L() + C()) / 3)
    spread = AVEDEV("__t", n, W())
    return stage(s, __d=spread, __o=F.col("__t") - MA("__t", n, W())).withColumn(name, F.when(F.col("__d") == 0, 0.0).otherwise(F.col("__o") / (0.015 * F.col("__d")))).drop("__t", "__d", "__o")


def stochastic(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    """slow_k, slow_d and slow_j = 3 k - 2 d with plain means; all null until d is there."""
    low, high = LLV("low", n, W()), HHV("high", n, W())
    s = stage(df, __f=F.when(high == low, 0.0).otherwise((C() - low) / (high - low) * 100))
    s = stage(stage(s, __k=MA("__f", m1, W())), slow_d=MA("__k", m2, W()))
    s = stage(s, slow_k=F.when(F.col("slow_d").isNotNull(), F.col("__k")))
    return stage(s, slow_j=3 * F.col("slow_k") - 2 * F.col("slow_d")).drop("__f", "__k")


def _counted(df: DataFrame, name: str, up, down) -> DataFrame:
    """The three columns of a signal from its up and down flags."""
    s = stage(df, __u=F.coalesce(up, F.lit(0)), __v=F.coalesce(down, F.lit(0)))
    s = stage(s, **{f"{name}_cross": F.when(F.col("__v") == 1, -1).when(F.col("__u") == 1, 1)})
    return since_last(since_last(s, "__u", f"{name}_jx"), "__v", f"{name}_sx").drop("__u", "__v")


def _any(*flags):
    return F.greatest(*(F.coalesce(f, F.lit(0)) for f in flags))


def max_factor(df: DataFrame, band: float = 133.0) -> DataFrame:
    """maxfactor (channel index and four times relative strength and stochastic J, centred), its change, the strength as baseline, and their crosses.

    The factor one step ahead (value and change) is held against the baseline
    and against lines ``band`` below and above it.
    """
    s = stochastic(channel_index(wilder_rsi(df)))
    s = stage(s, regression_baseline=(F.col("rsi") - 50) * 4)
    s = stage(s, maxfactor=F.col("cci") + F.col("regression_baseline") + (F.col("slow_j") - 50) * 4)
    s = stage(s, maxfactor_delta=DIFF("maxfactor", 1, W()))
    s = stage(s, __a=F.col("maxfactor") + F.col("maxfactor_delta"), **{f"__b{k}": F.col("regression_baseline") + k * band - band for k in range(3)})
    up, down = _any(*(CROSS("__a", f"__b{k}", W()) for k in range(3))), _any(*(CROSS(f"__b{k}", "__a", W()) for k in range(3)))
    return _counted(s, "maxfactor", up, down).drop("__a", "__b0", "__b1", "__b2")


def dual(df: DataFrame, warm: int = 13) -> DataFrame:
    """dual_cross where the channel index and the stochastic J are both above (1) or below (-1) relative strength, and the rows that has held; nothing in the first ``warm`` rows."""
    s = stage(stochastic(channel_index(wilder_rsi(df))), __pos=F.row_number().over(W()))
    s = stage(s, __r=(F.col("rsi") - 50) * 4, __j=F.col("slow_j") + DIFF("slow_j", 1, W()))
    both = lambda a, *others: F.when(F.col("__pos") > warm, (a * (a + sum(others[1:], others[0])) > 1).cast("int")).otherwise(0)
    s = stage(
        s, __u=both(CROSS_STATUS("cci", "__r"), CROSS_STATUS("slow_j", "rsi"), CROSS_STATUS("__j", "rsi")), __v=both(CROSS_STATUS("__r", "cci"), CROSS_STATUS("rsi", "slow_j"), CROSS_STATUS("rsi", "__j")),
        dual_cross=F.lit(None).cast("int"),
    )
    s = stage(s, dual_cross=F.when(F.col("__v") == 1, -1).when(F.col("__u") == 1, 1))
    return run_length(run_length(s, "__u", "dual_jx"), "__v", "dual_sx").drop("__pos", "__r", "__j", "__u", "__v")


def mean_crosses(df: DataFrame, fast: int = 5, slow: int = 30) -> DataFrame:
    """ma_cross of two moving means."""
    s = stage(df, __f=MA("close", fast, W()), __s=MA("close", slow, W()))
    return _counted(s, "ma", CROSS("__f", "__s", W()), CROSS("__s", "__f", W())).drop("__f", "__s")


def band_crosses(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """boll_cross of a bar's low end with the lower band and its high end with the upper one, with both ends, the bands, their relative width, its change and mean.

    On the side away from the open's side of the middle a bar's spike counts
    only with the mean of two bars.
    """
    s = stage(df, boll_ma=MA("close", n, W()), __s=STDP("close", n, W()), __l2=MA("low", 2, W()), __h2=MA("high", 2, W()))
    s = stage(s, boll_ub=F.col("boll_ma") + width * F.col("__s"), boll_lb=F.col("boll_ma") - width * F.col("__s"))
    low = F.when(O() < F.col("boll_ma"), L()).otherwise(F.col("__l2"))
    high = F.when(O() > F.col("boll_ma"), H()).otherwise(F.col("__h2"))
    s = stage(s, min_peak=F.least(O(), C(), low), max_peak=F.greatest(O(), C(), high), boll_width=ratio(F.col("boll_ub") - F.col("boll_lb"), F.col("boll_ma")))
    s = stage(s, boll_delta=DIFF("boll_width", 1, W()), bbw_ma20=MA("boll_width", 20, W()))
    return _counted(s, "boll", CROSS("min_peak", "boll_lb", W()), CROSS("boll_ub", "max_peak", W())).drop("__s", "__l2", "__h2")
