"""Technical indicators over bars (code, d, open, high, low, close, volume).

Each takes bars and adds columns.  Those that are sliding windows are columns;
weighted means are scans over blocks of time (``scan``); other recursions are
walked per code (``recursive``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recursive as R
from .scan import beginnings, emas, smas
from .series import AVEDEV, DIFF, HHV, LLV, MA, MAX, REF, STD, STDP, SUM, WMA, bars_since, corr, last_n, ordered, regression

def W():
    return ordered()


def C():
    return F.col("close")


def H():
    return F.col("high")


def L():
    return F.col("low")


def O():  # noqa: E743
    return F.col("open")


def V():
    return F.col("volume")


def ratio(a, b):
    return a / F.nullif(b, F.lit(0.0))


def stage(df: DataFrame, **columns) -> DataFrame:
    return df.withColumns(columns)


def ma(df, *periods, x="close", prefix="ma"):
    return stage(df, **{f"{prefix}{n}": MA(x, n, W()) for n in periods})


def ema(df, *periods, x="close", prefix="ema"):
    return emas(df, {f"{prefix}{n}": (x, n) for n in periods})


def sma(df, n, m=1, x="close", name="sma"):
    return smas(df, {name: (x, n, m)})


def macd(df, short=12, long=26, mid=9):
    s = emas(df, {"__fast": ("close", short), "__slow": ("close", long)})
    s = emas(stage(s, dif=F.col("__fast") - F.col("__slow")), {"dea": ("dif", mid)})
    return stage(s, macd=2 * (F.col("dif") - F.col("dea"))).drop("__fast", "__slow")


def boll(df, n=20, p=2):
    s = stage(df, boll=MA("close", n, W()), __s=STD("close", n, W()))
    return stage(s, ub=F.col("boll") + p * F.col("__s"), lb=F.col("boll") - p * F.col("__s")).drop("__s")


def bbi(df, *periods):
    periods = periods or (3, 6, 12, 24)
    return stage(df, bbi=sum((MA("close", n, W()) for n in periods), F.lit(0.0)) / len(periods))


def dma(df, m1=10, m2=50, m3=10):
    return stage(stage(df, ddd=MA("close", m1, W()) - MA("close", m2, W())), ama=MA("ddd", m3, W()))


def mtm(df, n=12, m=6):
    return stage(stage(df, mtm=DIFF("close", n, W())), mtmma=MA("mtm", m, W()))


def roc(df, n=12, m=6):
    return stage(stage(df, roc=ratio(100 * DIFF("close", n, W()), REF("close", n, W()))), rocma=MA("roc", m, W()))


def bias(df, *periods):
    return stage(df, **{f"bias{n}": ratio((C() - MA("close", n, W())) * 100, MA("close", n, W())) for n in periods})


def cci(df, n=14):
    s = stage(df, typ=(H() + L() + C()) / 3)
    return stage(s, cci=(F.col("typ") - MA("typ", n, W())) / (0.015 * AVEDEV("typ", n, W()) + 1e-8))


def wr(df, *periods):
    return stage(df, **{f"wr{n}": ratio(100 * (HHV("high", n, W()) - C()), HHV("high", n, W()) - LLV("low", n, W())) for n in periods})


def true_range(df, name="tr"):
    before = REF("close", 1, W())
    return stage(df, **{name: MAX(MAX(H() - L(), F.abs(before - H())), F.abs(before - L()))})


def atr(df, n=14):
    return stage(true_range(df), atr=MA("tr", n, W()))


def dmi(df, m1=14, m2=6):
    s = stage(true_range(df), __hd=DIFF("high", 1, W()), __ld=REF("low", 1, W()) - L())
    up = F.when((F.col("__hd") > 0) & (F.col("__hd") > F.col("__ld")), F.col("__hd")).otherwise(0.0)
    down = F.when((F.col("__ld") > 0) & (F.col("__ld") > F.col("__hd")), F.col("__ld")).otherwise(0.0)
    s = stage(s, __u=up, __d=down)
    total = SUM("tr", m1, W())
    s = stage(s, di1=ratio(SUM("__u", m1, W()) * 100, total), di2=ratio(SUM("__d", m1, W()) * 100, total))
    s = stage(s, __dx=ratio(F.abs(F.col("di2") - F.col("di1")), F.col("di1") + F.col("di2")) * 100)
    s = stage(s, adx=MA("__dx", m2, W()))
    return stage(s, adxr=(F.col("adx") + REF("adx", m2, W())) / 2).drop("__hd", "__ld", "__u", "__d", "__dx", "tr")


def vr(df, n=26):
    s = stage(df, __up=F.when(C() > REF("close", 1, W()), V()).otherwise(0.0), __not=F.when(C() <= REF("close", 1, W()), V()).otherwise(0.0))
    return stage(s, vr=ratio(SUM("__up", n, W()), SUM("__not", n, W())) * 100).drop("__up", "__not")


def arbr(df, n=26):
    before = REF("close", 1, W())
    s = stage(df, __ho=H() - O(), __ol=O() - L(), __hc=MAX(F.lit(0.0), H() - before), __cl=MAX(F.lit(0.0), before - L()))
    return stage(s, ar=ratio(SUM("__ho", n, W()), SUM("__ol", n, W())) * 100, br=ratio(SUM("__hc", n, W()), SUM("__cl", n, W())) * 100).drop("__ho", "__ol", "__hc", "__cl")


def cr(df, n=26, m1=5, m2=10, m3=20):
    s = stage(df, __mid=(H() + L() + C()) / 3)
    s = stage(s, __a=MAX(F.lit(0.0), H() - REF("__mid", 1, W())), __b=MAX(F.lit(0.0), REF("__mid", 1, W()) - L()))
    s = stage(s, cr=ratio(SUM("__a", n, W()), SUM("__b", n, W())) * 100)
    s = stage(s, **{f"__m{k}": MA("cr", m, W()) for k, m in enumerate((m1, m2, m3), 1)})
    return stage(s, **{f"crma{k}": REF(f"__m{k}", int(m / 2.5 + 1), W()) for k, m in enumerate((m1, m2, m3), 1)}).drop("__mid", "__a", "__b", "__m1", "__m2", "__m3")


def mfi(df, n=14):
    s = stage(df, __t=(H() + L() + C()) / 3)
    s = stage(s, __p=F.when(F.col("__t") > REF("__t", 1, W()), F.col("__t") * V()).otherwise(0.0), __n=F.when(F.col("__t") < REF("__t", 1, W()), F.col("__t") * V()).otherwise(0.0))
    v1 = ratio(SUM("__p", n, W()), SUM("__n", n, W()))
    return stage(s, mfi=100 - 100 / (1 + v1)).drop("__t", "__p", "__n")


def adtm(df, n=23, m=8):
    before = REF("open", 1, W())
    s = stage(df, __d=F.when(O() <= before, 0.0).otherwise(F.greatest(H() - O(), O() - before)), __b=F.when(O() >= before, 0.0).otherwise(F.greatest(O() - L(), O() - before)))
    s = stage(s, __s=SUM("__d", n, W()), __t=SUM("__b", n, W()))
    a, b = F.col("__s"), F.col("__t")
    s = stage(s, adtm=F.when(a > b, ratio(a - b, a)).when(a == b, 0.0).otherwise(ratio(a - b, b)))
    return stage(s, maadtm=MA("adtm", m, W())).drop("__d", "__b", "__s", "__t")


def cho(df, n1=10, n2=20, m=6):
    s = stage(df, __v=F.coalesce(ratio(V() * (2 * C() - H() - L()), H() + L()), F.lit(0.0)))
    s = stage(s, mid=F.sum("__v").over(last_n(W(), 0)))
    s = stage(s, cho=MA("mid", n1, W()) - MA("mid", n2, W()))
    return stage(s, macho=MA("cho", m, W())).drop("__v", "mid")


def obv(df):
    move = F.when(C() > REF("close", 1, W()), V()).when(C() < REF("close", 1, W()), -V()).otherwise(0.0)
    return stage(stage(df, __m=move), obv=F.sum("__m").over(last_n(W(), 0)) / 10_000).drop("__m")


def pvt(df, n=51, m=6):
    s = stage(df, __m=F.coalesce(V() * DIFF("close", 1, W()) / F.nullif(REF("close", 1, W()), F.lit(0.0)), F.lit(0.0)))
    s = stage(s, pvt=F.sum("__m").over(last_n(W(), 0)), vpt=SUM("__m", n, W()))
    return stage(s, mavpt=MA("vpt", m, W())).drop("__m")


def asi(df, m1=26, m2=10):
    lc, lo, ll = REF("close", 1, W()), REF("open", 1, W()), REF("low", 1, W())
    aa, bb, cc, dd = F.abs(H() - lc), F.abs(L() - lc), F.abs(H() - ll), F.abs(lc - lo)
    r = F.when((aa > bb) & (aa > cc), aa + bb / 2 + dd / 4).when((bb > cc) & (bb > aa), bb + aa / 2 + dd / 4).otherwise(cc + dd / 4)
    x = C() - lc + (C() - O()) / 2 + lc - lo
    s = stage(df, __si=ratio(16 * x, r) * F.greatest(aa, bb))
    s = stage(s, asi=SUM("__si", m1, W()))
    return stage(s, asit=MA("asi", m2, W())).drop("__si")


def mike(df, n=12):
    typ, hh, ll = (H() + L() + C()) / 3, HHV("high", n, W()), LLV("low", n, W())
    return stage(df, wr_=typ + typ - ll, mr=typ + hh - ll, sr=2 * hh - ll, ws=typ - (hh - typ), ms=typ - (hh - ll), ss=2 * ll - hh)


def vstd(df, n=10):
    return stage(df, vstd=STD("volume", n, W()))


def kdj(df, n=9, m1=3, m2=3):
    s = stage(beginnings(df, "__t"), __r=ratio((C() - LLV("low", n, W())) * 100, HHV("high", n, W()) - LLV("low", n, W())))
    s = stage(s, rsv=F.last("__r", ignorenulls=True).over(last_n(W(), 0))).drop("__r")
    s = smas(smas(s, {"k": ("rsv", m1, 1)}, begun="__t"), {"kd": ("k", m2, 1)}, begun="__t")
    return stage(s, j=3 * F.col("k") - 2 * F.col("kd")).drop("__t")


def skdj(df, n=9, m=3):
    s = stage(df, __r=ratio((C() - LLV("low", n, W())) * 100, HHV("high", n, W()) - LLV("low", n, W())))
    s = emas(emas(s, {"__j": ("__r", m)}), {"__k": ("__j", m)})
    return stage(s, sk=F.col("__k"), sd=MA("__k", m, W())).drop("__r", "__j", "__k")


def rsi(df, *periods, x="close"):
    s = stage(df, __m=DIFF(x, 1, W()))
    s = stage(s, __u=F.greatest("__m", F.lit(0.0)), __v=F.abs("__m"))
    s = smas(s, {f"__{c}{n}": (f"__{c}", n, 1) for n in periods for c in "uv"})
    return stage(s, **{f"rsi{n}": ratio(F.col(f"__u{n}"), F.col(f"__v{n}")) * 100 for n in periods}).drop("__m", "__u", "__v", *(f"__{c}{n}" for n in periods for c in "uv"))


def pbx(df, *periods):
    periods = periods or (3, 5, 8, 13, 18, 24)
    spans = sorted({n * k for n in periods for k in (1, 2, 4)})
    s = emas(df, {f"__x{n}": ("close", n) for n in spans})
    return stage(s, **{f"pbx{n}": (F.col(f"__x{n}") + F.col(f"__x{2 * n}") + F.col(f"__x{4 * n}")) / 3 for n in periods}).drop(*(f"__x{n}" for n in spans))


def osc(df, n=20, m=6):
    s = stage(df, osc=(C() - MA("close", n, W())) * 100)
    return emas(s, {"maosc": ("osc", m)})


def ddi(df, n=13, n1=26, m=1, m1=5):
    hl, before = H() + L(), REF("high", 1, W()) + REF("low", 1, W())
    move = F.greatest(F.abs(DIFF("high", 1, W())), F.abs(DIFF("low", 1, W())))
    s = stage(df, __z=F.when(hl <= before, 0.0).otherwise(move), __f=F.when(hl >= before, 0.0).otherwise(move))
    a, b = SUM("__z", n, W()), SUM("__f", n, W())
    s = stage(s, ddi=ratio(a, a + b) - ratio(b, a + b)).drop("__z", "__f")
    s = smas(s, {"addi": ("ddi", n1, m)})
    return stage(s, ad=MA("addi", m1, W()))


# ---- published forms of the usual C library -----------------------------------------------------


def bbands(df, n=5, up=2, down=2):
    mid, s = MA("close", n, W()), STDP("close", n, W())
    return stage(df, upper=mid + up * s, middle=mid, lower=mid - down * s)


def stoch(df, k=5, slow=3, d=3):
    s = stage(df, fastk=ratio((C() - LLV("low", k, W())) * 100, HHV("high", k, W()) - LLV("low", k, W())))
    return stage(stage(s, slowk=MA("fastk", slow, W())), slowd=MA("slowk", d, W()))


def aroon(df, n=14):
    s = stage(df, __p=F.row_number().over(W()))
    w = last_n(W(), n + 1)
    high, low = F.max(F.struct(H(), F.col("__p"))).over(w)["__p"], F.min(F.struct(L(), -F.col("__p"))).over(w)["col2"]
    full = F.count("close").over(w) > n
    s = stage(s, aroonup=F.when(full, 100 * (n - (F.col("__p") - high)) / n), aroondown=F.when(full, 100 * (n - (F.col("__p") + low)) / n))
    return stage(s, aroonosc=F.col("aroonup") - F.col("aroondown")).drop("__p")


def linear(df, n=14, x="close"):
    s = stage(df, __p=F.row_number().over(W()))
    slope, level, end = regression(x, n, W(), "__p")
    return stage(s, linearreg=end, slope=slope, intercept=level, angle=F.degrees(F.atan(slope))).drop("__p")


def correlation(df, n=5, a="high", b="low"):
    full = F.count("close").over(last_n(W(), n)) >= n
    return stage(df, correl=F.when(full, corr(a, b, last_n(W(), n))))


def beta(df, n=5, a="high", b="low"):
    s = stage(df, __a=ratio(DIFF(a, 1, W()), REF(a, 1, W())), __b=ratio(DIFF(b, 1, W()), REF(b, 1, W())))
    full = F.count("__a").over(last_n(W(), n)) >= n
    return stage(s, beta=F.when(full, F.regr_slope("__b", "__a").over(last_n(W(), n)))).drop("__a", "__b")


def ad_line(df):
    flow = F.coalesce(ratio((C() - L()) - (H() - C()), H() - L()), F.lit(0.0)) * V()
    return stage(stage(df, __f=flow), ad=F.sum("__f").over(last_n(W(), 0))).drop("__f")


def price_transforms(df):
    return stage(df, avgprice=(O() + H() + L() + C()) / 4, bop=F.coalesce(ratio(C() - O(), H() - L()), F.lit(0.0)))


def hull(df, n=9, x="close"):
    s = stage(df, __d=2 * WMA(x, n // 2, W()) - WMA(x, n, W()))
    k = int(n**0.5)
    return stage(s, hma=F.when(F.count("__d").over(last_n(W(), k)) >= k, WMA("__d", k, W()))).drop("__d")


def recursive_set(df, n=14):
    """adx, dx, atr (Wilder), rsi, cmo, kama, dema, sar, adosc and super-trend in one walk per code."""

    def run(f: pd.DataFrame):
        h, l, c, v = (f[x].to_numpy(float) for x in ("high", "low", "close", "volume"))
        before = np.append(np.nan, c[:-1])
        tr = np.where(np.isnan(before), np.nan, np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before))))
        up, down = np.append(np.nan, np.diff(h)), np.append(np.nan, -np.diff(l))
        plus, minus = np.where((up > down) & (up > 0), up, np.where(np.isnan(up), np.nan, 0)), np.where((down > up) & (down > 0), down, np.where(np.isnan(up), np.nan, 0))
        with np.errstate(all="ignore"):
            a = R.wilder(tr, n)
            p, m = 100 * R.wilder(plus, n) / a, 100 * R.wilder(minus, n) / a
            dx = 100 * np.abs(p - m) / (p + m)
            d = np.append(np.nan, np.diff(c))
            gain, loss = R.wilder(np.where(np.isnan(d), np.nan, np.fmax(d, 0)), n), R.wilder(np.where(np.isnan(d), np.nan, np.fmax(-d, 0)), n)
            flow = np.cumsum(np.where(h > l, ((c - l) - (h - c)) / np.where(h > l, h - l, 1), 0.0) * v)
            one = R.ta_ema(c, n)
            line, side = R.super_trend(h, l, c)
            return {
                "atr_w": a, "dx": dx, "adx_w": R.wilder(dx, n), "rsi_w": 100 * gain / (gain + loss), "cmo": 100 * (gain - loss) / (gain + loss), "kama": R.kama(c, n),
                "dema": 2 * one - R.ta_ema(one, n), "sar": R.sar(h, l), "adosc": R.ta_ema(flow, 3) - R.ta_ema(flow, 10), "trend_line": line, "trend": side,
            }

    names = ("atr_w", "dx", "adx_w", "rsi_w", "cmo", "kama", "dema", "sar", "adosc", "trend_line", "trend")
    return R.per_code(df, run, {k: "double" for k in names})


def peaks_since(df, x="close", k=2):
    """Rows since the last centred maximum of 2k + 1 rows."""
    w = W().rowsBetween(-k, k)
    s = stage(df, __p=F.row_number().over(W()), __peak=(F.col(x) == F.max(x).over(w)) & (F.count(x).over(w) == 2 * k + 1))
    return stage(s, since_peak=bars_since(F.col("__peak"), W(), "__p")).drop("__p", "__peak")


def hilbert_set(df, x="close"):
    """ht_period, ht_inphase, ht_quadrature, mama, fama (from row 32), ht_phase, ht_sine, ht_lead, ht_trendline, ht_mode (from row 63)."""

    def run(f: pd.DataFrame):
        early, late = R.hilbert(f[x], 12), R.hilbert(f[x], 37)
        shown = lambda v, first: np.where(np.arange(len(v)) >= first, v, np.nan)
        phase = shown(late["phase"], 63)
        return {
            **{k: shown(early[v], 32) for k, v in (("ht_period", "period"), ("ht_inphase", "inphase"), ("ht_quadrature", "quadrature"), ("mama", "mama"), ("fama", "fama"))},
            "ht_phase": phase, "ht_sine": np.sin(np.radians(phase)), "ht_lead": np.sin(np.radians(phase + 45)), "ht_trendline": shown(late["trendline"], 63), "ht_mode": shown(late["mode"], 63),
        }

    names = ("ht_period", "ht_inphase", "ht_quadrature", "mama", "fama", "ht_phase", "ht_sine", "ht_lead", "ht_trendline", "ht_mode")
    return R.per_code(df, run, {k: "double" for k in names})


def macd_of_means(df, fast=12, slow=26, signal=9, x="close"):
    """(difference, signal, rest) of plain means."""
    s = stage(df, macdext=MA(x, fast, W()) - MA(x, slow, W()))
    s = stage(s, macdext_signal=MA("macdext", signal, W()))
    return stage(s, macdext_hist=F.col("macdext") - F.col("macdext_signal"))


def recursive_more(df, n=14):
    """adxr, macd_fix, macd_fix_signal, sarext, and the recursive parts of stop_ma and stop_atr, of 10 rows."""
    s = recursive_set(df, n)

    def run(f: pd.DataFrame):
        h, l, c = (f[k].to_numpy(float) for k in ("high", "low", "close"))
        before = np.append(np.nan, c[:-1])
        tr = np.where(np.isnan(before), np.nan, np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before))))
        adx = f["adx_w"].to_numpy(float)
        dif, signal = R.macd_fixed(c)
        return {"adxr": (adx + np.append(np.full(n - 1, np.nan), adx[: -(n - 1)])) / 2 if len(adx) >= n else np.full(len(adx), np.nan), "macd_fix": dif, "macd_fix_signal": signal, "sarext": R.sar_way(h, l), "stop_ma": R.ta_ema((f["open"].to_numpy(float) + h + l + c) / 4, 10), "stop_atr": R.wilder(tr, 10)}

    return R.per_code(s, run, {k: "double" for k in ("adxr", "macd_fix", "macd_fix_signal", "sarext", "stop_ma", "stop_atr")})


def stoch_rsi(df, k=5, d=3, x="rsi_w"):
    """Fast stochastic of an index, and its mean."""
    s = stage(df, stochrsi_k=ratio((F.col(x) - LLV(x, k, W())) * 100, HHV(x, k, W()) - LLV(x, k, W())))
    return stage(s, stochrsi_d=MA("stochrsi_k", d, W()))


def atr_stops(df):
    """stop_way and stop_line: the side last crossed of stop_ma +- stop_atr, and the line on the other side; needs both columns."""
    top, bottom = F.col("stop_ma") + F.col("stop_atr"), F.col("stop_ma") - F.col("stop_atr")
    s = stage(df, __u=C() < top, __d=bottom < C())
    crossed = F.when(F.lag("__d").over(W()) & ~F.col("__d"), -1.0).when(F.lag("__u").over(W()) & ~F.col("__u"), 1.0)
    s = stage(s, __x=crossed)
    s = stage(s, stop_way=F.last("__x", ignorenulls=True).over(last_n(W(), 0)))
    return stage(s, stop_line=F.col("stop_ma") - F.col("stop_way") * F.col("stop_atr")).drop("__u", "__d", "__x")


def volume_hull(df, n=5):
    """vhma: hull mean of the volume-weighted mean price, and its direction (-2, 0, 2) against one and two rows before."""
    s = R.per_code(stage(df, __cv=C() * V()), lambda f: {"__s": R.ta_ema(f["__cv"], n) / R.ta_ema(f["volume"], n)}, {"__s": "double"})
    s = hull(s, n, "__s").withColumnRenamed("hma", "vhma")
    up = lambda k: F.when(F.col("vhma") > F.lag("vhma", k).over(W()), 1).otherwise(-1)
    return stage(s, vhma_way=up(1) + up(2)).drop("__cv", "__s")


def adx_of_means(df, n=14, smooth=14, limit=18):
    """adx_hull and its trend (-1, 0, 1), with hull means for Wilder's; rows before n + 2 count 0."""
    s = stage(df, __p=F.row_number().over(W()), __up=ratio(DIFF("high", 1, W()), REF("high", 1, W())), __dn=-ratio(DIFF("low", 1, W()), REF("low", 1, W())))
    s = stage(true_range(s, "__tr"), __a=F.when((F.col("__up") > F.col("__dn")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0), __b=F.when((F.col("__dn") > F.col("__up")) & (F.col("__dn") > 0), F.col("__dn")).otherwise(0.0))
    for x, to in (("__tr", "__t"), ("__a", "__h"), ("__b", "__l")):
        s = hull(s, n, x).withColumnRenamed("hma", to)
    part = lambda c: F.when(F.col("__p") > n + 2, F.coalesce(ratio(100 * F.col(c), F.col("__t")), F.lit(0.0))).otherwise(0.0)
    s = stage(s, __plus=part("__h"), __minus=part("__l"))
    total = F.col("__plus") + F.col("__minus")
    s = hull(stage(s, __x=F.abs(F.col("__plus") - F.col("__minus")) / F.when(total == 0, 1.0).otherwise(total)), smooth, "__x")
    s = stage(s, adx_hull=F.when(F.col("__p") > smooth + 2, 100 * F.col("hma")).otherwise(0.0))
    way = F.when((F.col("adx_hull") > limit) & (F.col("__plus") > F.col("__minus")), 1).when((F.col("adx_hull") > limit) & (F.col("__plus") < F.col("__minus")), -1).otherwise(0)
    return stage(s, adx_way=way).drop("__p", "__up", "__dn", "__tr", "__a", "__b", "__t", "__h", "__l", "__plus", "__minus", "__x", "hma")
