"""A feature frame over bars: returns, ranges, fractals, volatility and published alpha formulas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions.indicators import C, H, L, O, V, W, ratio, stage
from ..functions.series import DIFF, PCT, corr, last_n, pct_rank, rolling, zscore


def base_features(bars: DataFrame, fractal: int = 2) -> DataFrame:
    s = stage(bars, return_1=PCT("close", 1, W()), return_5=PCT("close", 5, W()), return_10=PCT("close", 10, W()), range_ratio=ratio(H() - L(), C()), adv20=rolling(F.avg, "volume", 20, W(), 5), __lv=F.ln(F.greatest(V(), F.lit(1.0))), gap_open=ratio(O(), F.lag("close").over(W())) - 1, gap_high=ratio(H(), F.lag("close").over(W())) - 1)
    around = W().rowsBetween(-fractal, fractal)
    full = F.count("close").over(around) == 2 * fractal + 1
    s = stage(s, volume_z=zscore("__lv", 20, W()), volatility=rolling(F.stddev_samp, "return_1", 20, W(), 5), top=(full & (H() == F.max("high").over(around))).cast("int"), bottom=(full & (L() == F.min("low").over(around))).cast("int"))
    s = stage(s, __ad=F.abs(DIFF("close", 1, W())))
    s = stage(s, chan_bias=F.sum(F.col("bottom") - F.col("top")).over(last_n(W(), 10)), vol_rank_20=pct_rank("volatility", 60, W()), __d3=F.sum("__ad").over(last_n(W(), 3)))
    return stage(s, stroke_strength=zscore("__d3", 20, W())).drop("__lv", "__d3", "__ad")


def alphas(bars: DataFrame) -> DataFrame:
    """Published formulaic alphas on one code's own history; needs return_1 and adv20."""
    body, span = C() - O(), H() - L()
    s = stage(bars, vwap=ratio(F.sum((H() + L() + C()) / 3 * V()).over(last_n(W(), 20)), F.sum("volume").over(last_n(W(), 20))))
    s = stage(s, __g=F.col("vwap") - C(), __vm=O() - F.avg("vwap").over(last_n(W(), 10)), __cv=F.abs(C() - F.col("vwap")), __dv=DIFF("volume", 3, W()), __vr=pct_rank("volume", 20, W()), __p25=-F.col("return_1") * F.col("adv20") * F.col("vwap") * (H() - C()), __p7=F.greatest(H() - O(), C() - L()), __p20=body / (span + 1e-3) + span / (span + 1e-3))
    s = stage(s, __mx=F.max("__g").over(last_n(W(), 3)), __mn=F.min("__g").over(last_n(W(), 3)), __co=corr("open", "__vr", last_n(W(), 10)), __p7r=F.col("__p7") * F.col("__vr"))
    v = F.col("vwap")
    s = stage(
        s, alpha_04=-pct_rank("__co", 20, W()), alpha_05=pct_rank("__vm", 20, W()) * (1 - pct_rank("__cv", 20, W())) * 2 - 1, alpha_07=zscore("__p7r", 20, W()), alpha_11=(pct_rank("__mx", 20, W()) + pct_rank("__mn", 20, W())) * pct_rank("__dv", 20, W()) - 1,
        alpha_12=F.when(body >= 0, 1).otherwise(-1) * F.ln(F.nullif(ratio(V(), F.col("adv20")), F.lit(0.0))), alpha_20=zscore("__p20", 20, W()), alpha_25=zscore("__p25", 20, W()),
        alpha_28=F.coalesce(100 * (C() - F.min("low").over(last_n(W(), 9))) / F.nullif(F.max("high").over(last_n(W(), 9)) - F.min("low").over(last_n(W(), 9)), F.lit(0.0)), F.lit(50.0)), alpha_41=ratio(F.sqrt(H() * L()) - v, C()), alpha_42=ratio(v - C(), F.abs(v + C())),
        alpha_51=span / (F.avg("close").over(last_n(W(), 10)) + 1e-3) * 100, alpha_54=body * ratio(V(), F.col("adv20")), alpha_60=body * F.sqrt(ratio(V(), F.col("adv20"))), alpha_101=body / (span + 1e-3),
    )
    return s.drop("__g", "__vm", "__cv", "__dv", "__vr", "__p25", "__p7", "__p20", "__mx", "__mn", "__co", "__p7r")


def session_features(bars: DataFrame, ts: str = "ts", first: int = 4) -> DataFrame:
    """Intraday: gap to the day's running VWAP, break of the opening range, momentum since the open."""
    b = bars.withColumn("__day", F.to_date(ts))
    day = Window.partitionBy("code", "__day")
    run = day.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = b.withColumns({"__k": F.row_number().over(day.orderBy(ts)), "__r": F.coalesce(F.col("close") / F.nullif(F.lag("close").over(day.orderBy(ts)), F.lit(0.0)) - 1, F.lit(0.0))})
    top, bottom = F.max(F.when(F.col("__k") <= first, F.col("high"))).over(day), F.min(F.when(F.col("__k") <= first, F.col("low"))).over(day)
    vwap = F.sum(typical * F.col("volume")).over(run) / F.nullif(F.sum("volume").over(run), F.lit(0.0))
    broke = F.when(F.col("__k") <= first, 0).when(F.col("close") > top, 1).when(F.col("close") < bottom, -1).otherwise(0)
    return b.withColumns({"vwap_gap": F.col("close") / vwap - 1, "range_break": broke, "session_momentum": F.sum("__r").over(run)}).drop("__day", "__k", "__r")


def spectrum(bars: DataFrame, x: str = "return_1", window: int = 32) -> DataFrame:
    """Share of the upper two fifths of the spectrum of the last ``window`` values, its peak as a share of the bins, and its entropy.

    The mean is taken out and the constant bin left out; null values are 0, and
    rows with fewer values before them have 0 in all three.
    """

    def run(f):
        v = np.nan_to_num(f[x].to_numpy(float))
        out = np.zeros((3, len(v)))
        if len(v) >= window:
            views = np.lib.stride_tricks.sliding_window_view(v, window)
            p = np.abs(np.fft.rfft(views - views.mean(axis=1, keepdims=True), axis=1))[:, 1:] ** 2
            total, bins = p.sum(axis=1, keepdims=True), p.shape[1]
            q = p / np.where(total > 0, total, 1)
            out[0, window - 1 :] = q[:, max(1, -(-bins * 3 // 5)) :].sum(axis=1)
            out[1, window - 1 :] = (p.argmax(axis=1) + 1) / bins
            share = np.maximum(q, 1e-12)
            out[2, window - 1 :] = -(share * np.log(share)).sum(axis=1) / np.log(bins)
        return {"fft_high": out[0], "fft_peak": out[1], "fft_entropy": out[2]}

    return R.per_code(bars, run, {"fft_high": "double", "fft_peak": "double", "fft_entropy": "double"})


def strokes(bars: DataFrame, fractal: int = 2) -> DataFrame:
    """(code, stroke, from, to, direction, start, end): strokes between alternating fractals; of a run of like ones the most extreme counts."""
    f = base_features(bars, fractal).where("top + bottom = 1").select("code", "d", F.when(F.col("top") == 1, 1).otherwise(-1).alias("side"), F.when(F.col("top") == 1, H()).otherwise(-L()).alias("reach"))
    s = stage(f, __n=F.when(F.lag("side").over(W()) == F.col("side"), 0).otherwise(1))
    s = stage(s, __i=F.sum("__n").over(last_n(W(), 0)))
    ends = s.groupBy("code", "__i").agg(F.first("side").alias("side"), F.max_by("d", F.struct("reach", "d")).alias("d"), F.max("reach").alias("reach"))
    w = Window.partitionBy("code").orderBy("__i")
    price = F.col("side") * F.col("reach")
    return ends.select("code", (F.col("__i") - 1).alias("stroke"), F.lag("d").over(w).alias("from"), F.col("d").alias("to"), F.col("side").alias("direction"), F.lag(price).over(w).alias("start"), price.alias("end")).where("start is not null")


def feature_frame(bars: DataFrame) -> DataFrame:
    return spectrum(alphas(base_features(bars)))
