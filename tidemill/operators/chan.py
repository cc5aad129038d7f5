"""Strokes, segments, pivots and trade points over the fractals of bars.

Which fractals count depends on the last one that did, so a code's fractals are
read as a sorted stream that holds one of them; all that follows are windows
over strokes, which are few, and one fill along a code's bars.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the trade points and of divergence in the score.
POINTS = {"buy_point_1": 0.35, "buy_point_2": 0.55, "buy_point_3": 0.65, "sell_point_1": -0.35, "sell_point_2": -0.55, "sell_point_3": -0.65, "buy_divergence_score": 0.45, "sell_divergence_score": -0.45}
AT_BAR = ("stroke_direction", "segment_direction", "segment_strength", "pivot_active", "pivot_width")
AT_END = ("pivot_leg_phase", "pivot_leg_direction", "pivot_leg_strength")


def fractals(bars: DataFrame, width: int = 5, code: str = "code", ts: str = "d") -> DataFrame:
    """``bars`` with i (position in the code), top and bottom: 1 where a bar has the extreme of the centred ``width`` bars."""
    w = Window.partitionBy(code).orderBy(ts)
    around = w.rowsBetween(-(width // 2), width - 1 - width // 2)
    full = F.count(F.lit(1)).over(around) == width
    return bars.withColumns({
        "i": F.row_number().over(w) - 1,
        "top": F.coalesce(full & (F.col("high") == F.max("high").over(around)), F.lit(False)).cast("double"),
        "bottom": F.coalesce(full & (F.col("low") == F.min("low").over(around)), F.lit(False)).cast("double"),
    })


def confirmed(marked: DataFrame, least_gap: int, code: str = "code") -> DataFrame:
    """(code, i, kind, price): fractals that count; kind 1 is a bottom, -1 a top.

    Of like fractals in a row the most extreme counts, the first of equal ones;
    one of the other kind counts from ``least_gap`` bars after the last that
    did.  A bar that is both is a bottom first.
    """
    two = F.array(F.when(F.col("bottom") > 0, F.struct(F.lit(1).alias("kind"), F.col("low").alias("price"))), F.when(F.col("top") > 0, F.struct(F.lit(-1).alias("kind"), F.col("high").alias("price"))))
    rows = marked.select(F.col(code).alias("code"), "i", F.posexplode(two).alias("nth", "f")).where("f is not null").select("code", "i", "nth", "f.kind", "f.price")
    kind = dict(rows.dtypes)["code"]

    def run(frames):
        last, done = None, False  # one fractal of one code
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                now = (row.code, row.i, row.kind, row.price)
                if last is None or now[0] != last[0]:
                    out += [last] if last else []
                    last = now
                elif now[2] == last[2]:
                    if (now[3] - last[3]) * now[2] < 0:
                        last = now
                elif now[1] - last[1] >= least_gap:
                    out.append(last)
                    last = now
            if out:
                yield pd.DataFrame(out, columns=["code", "i", "kind", "price"])
        if last:
            yield pd.DataFrame([last], columns=["code", "i", "kind", "price"])

    return rows.repartition("code").sortWithinPartitions("code", "i", "nth").drop("nth").mapInPandas(run, f"code {kind}, i int, kind int, price double").withColumnRenamed("code", code)


def strokes(marked: DataFrame, counted: DataFrame, code: str = "code") -> DataFrame:
    """(code, m, start, end, direction, high, low, strength, close_end, high_end, low_end) between fractals that count."""
    w = Window.partitionBy(code).orderBy("i")
    ends = counted.withColumns({"m": F.row_number().over(w) - 1, "end": F.lead("i").over(w), "to": F.lead("price").over(w)})
    raw = ends.where("end is not null").select(code, "m", F.col("i").alias("start"), "end", F.col("kind").alias("direction"), F.abs(F.col("to") - F.col("price")).alias("move"))
    bar = lambda at, names: marked.select(code, F.col("i").alias(at), *(F.col(c).cast("double").alias(f"{c}_{at}") for c in names))
    tagged = _filled(marked.select(code, "i", "high", "low"), raw.select(code, F.col("start").alias("i"), F.struct("m", "end").alias("s")), code)
    span = tagged.where(F.col("i") < F.col("s.end")).groupBy(code, F.col("s.m").alias("m")).agg(F.max("high").cast("double").alias("h"), F.min("low").cast("double").alias("l"))
    s = raw.join(span, [code, "m"]).join(bar("start", ["close"]), [code, "start"]).join(bar("end", ["close", "high", "low"]), [code, "end"])
    return s.select(
        code, "m", "start", "end", "direction", F.greatest("h", "high_end").alias("high"), F.least("l", "low_end").alias("low"),
        (F.col("move") / F.greatest(F.abs("close_start"), F.lit(1e-9))).alias("strength"), "close_end", "high_end", "low_end",
    )


def _filled(bars: DataFrame, at: DataFrame, code: str) -> DataFrame:
    """``bars`` with s of the last row of ``at`` (code, i, s) at or before each bar."""
    so_far = Window.partitionBy(code).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(at, [code, "i"], "left").withColumn("s", F.last("s", ignorenulls=True).over(so_far))


def structure(legs: DataFrame, code: str = "code") -> DataFrame:
    """Strokes with the segment and pivot that end with each, the last pivot before it, divergence and trade points.

    A segment is three strokes in a row; a pivot is three that overlap.
    """
    w = Window.partitionBy(code).orderBy("m")
    three = w.rowsBetween(-2, 0)
    whole = F.count(F.lit(1)).over(three) == 3
    top, bottom = F.min("high").over(three), F.max("low").over(three)
    s = legs.withColumns({
        "segment": F.when(whole, F.struct("direction", (F.sum("strength").over(three) / 3).alias("strength"))),
        "pivot": F.when(whole & (top > bottom), F.struct(top.alias("high"), bottom.alias("low"), ((top - bottom) / F.greatest("close_end", F.lit(1e-9))).alias("width"))),
    })
    s = s.withColumn("before", F.last("pivot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    there = F.col("before").isNotNull()
    old = F.when(F.lag(there, 2).over(w), F.lag("strength", 2).over(w))  # the last leg of this direction that had a pivot before it
    s = s.withColumn("divergence", F.when(old > 0, F.greatest(old - F.col("strength"), F.lit(0.0)) / F.greatest(old, F.lit(1e-9))).otherwise(0.0))
    up, high, low = F.col("direction") > 0, F.col("before.high"), F.col("before.low")
    flag = lambda c: F.when(there & c, 1.0).otherwise(0.0)
    first = {"buy_point_1": flag(up & (F.col("high") > high)), "sell_point_1": flag(~up & (F.col("low") < low))}
    return s.withColumns(first | {
        "buy_point_2": flag(up & (F.col("low_end") <= high) & (F.col("close_end") > high)), "buy_point_3": flag(up & (F.col("low_end") > high) & (F.col("strength") > 0)),
        "sell_point_2": flag(~up & (F.col("high_end") >= low) & (F.col("close_end") < low)), "sell_point_3": flag(~up & (F.col("high_end") < low) & (F.col("strength") > 0)),
        "pivot_leg_phase": F.when(there, F.col("direction").cast("double")).otherwise(0.0), "pivot_leg_direction": F.col("direction").cast("double"), "pivot_leg_strength": F.col("strength"),
    }).withColumns({f"{side}_divergence_score": F.col("divergence") * F.col(f"{side}_point_1") for side in ("buy", "sell")})


def projection(bars: DataFrame, width: int = 5, code: str = "code", ts: str = "d") -> DataFrame:
    """``bars`` with fractal_type, fractal_density, strokes, segments, pivots, legs, trade points and trade_point_score.

    A bar belongs to the stroke that starts last at or before it; the segment
    and pivot shown are the latest that cover the bar, whether or not they were
    complete by then.  What a leg brings stands on the bar where it ends.  Codes
    with fewer than two counted fractals, and bars without a code, have zeros in
    all but density.  No rows: no rows.
    """
    marked = fractals(bars, width, code, ts)
    counted = confirmed(marked, max(2, width // 2), code)
    s = structure(strokes(marked, counted, code), code)
    w = Window.partitionBy(code).orderBy("m")
    ahead = lambda c, *steps: F.coalesce(*(F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k else F.col(c) for k in steps))
    spans = s.select(code, F.col("start").alias("i"), F.struct(
        "start", "end", "direction", ahead("segment", 2, 1, 0).alias("segment"), ahead("pivot", 2, 1, 0).alias("pivot"), ahead("pivot", 2, 1, 0, -1).alias("at_start"),
    ).alias("s"))
    ends = s.select(code, F.col("end").alias("i"), *POINTS, *AT_END)
    kinds = counted.select(code, "i", F.col("kind").cast("double").alias("fractal_type"))
    out = _filled(marked, spans, code).join(ends, [code, "i"], "left").join(kinds, [code, "i"], "left")
    inside = F.col("i") <= F.col("s.end")
    pivot = F.when(F.col("i") == F.col("s.start"), F.col("s.at_start")).otherwise(F.col("s.pivot"))
    zero: dict[str, Column] = {
        "fractal_type": F.col("fractal_type"), "stroke_direction": F.when(inside, F.col("s.direction").cast("double")), "segment_direction": F.when(inside, F.col("s.segment.direction").cast("double")),
        "segment_strength": F.when(inside, F.col("s.segment.strength")), "pivot_active": F.when(inside & pivot.isNotNull(), 1.0), "pivot_width": F.when(inside, pivot["width"]),
        **{c: F.col(c) for c in (*AT_END, *POINTS)},
    }
    density = F.sum(F.col("top") + F.col("bottom")).over(Window.partitionBy(code).orderBy("i").rowsBetween(1 - 2 * width, 0))
    score = sum((F.coalesce(c, F.lit(0.0)) * F.lit(POINTS[n]) for n, c in zero.items() if n in POINTS), F.lit(0.0))
    return out.select(*bars.columns, *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in zero.items()), density.alias("fractal_density"), score.alias("trade_point_score"))
