import datetime
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import rows
from tidemill.operators import chan, crosses, joins, sheets
from tidemill.sources.ask import ask
from tidemill.streaming import streams

DAY = datetime.date(2020, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_reindex_directions_ties_and_tolerance(spark):
    grid = spark.createDataFrame([("a", day(k), k) for k in (0, 5, 10, 12, 40)] + [(None, day(5), 1), ("b", day(5), 2)], "code string, d date, n int")
    other = spark.createDataFrame([("a", day(3), 3.0), ("a", day(10), 10.0), ("a", day(10), 9.0), ("a", day(14), None), ("c", day(5), 1.0)], "code string, d date, v double")
    got = {way: {(r.code, r.n): (r.v, r.matched) for r in joins.reindexed(grid, other, ["v"], way).collect()} for way in ("exact", "backward", "forward", "nearest")}
    assert all(len(g) == 7 for g in got.values())
    pick = lambda way: [got[way]["a", k][0] for k in (0, 5, 10, 12, 40)]
    assert pick("exact") == [None, None, 10.0, None, None] and pick("backward") == [None, 3.0, 10.0, 10.0, None] and pick("forward") == [3.0, 10.0, 10.0, None, None]
    assert got["nearest"]["a", 12] == (None, day(14)) and pick("nearest")[:3] == [3.0, 3.0, 10.0]  # of equally near ones the later
    assert got["nearest"][None, 1] == (None, None) == got["backward"]["b", 2]
    near = {r.n: r.matched for r in joins.reindexed(grid.where("code = 'a'"), other, ["v"], "nearest", 2).collect()}
    assert near == {0: None, 5: day(3), 10: day(10), 12: day(14), 40: None}
    times = lambda df: df.withColumn("d", F.col("d").cast("timestamp"))
    assert {r.n: r.v for r in joins.reindexed(times(grid.where("code = 'a'")), times(other), ["v"], "forward", 3 * 86_400).collect()} == {0: 3.0, 5: None, 10: 10.0, 12: None, 40: None}
    with pytest.raises(ValueError):
        joins.reindexed(grid, other, ["v"], "sideways")


def test_clean_factor_refuses_large_losses_and_far_returns_go(spark):
    data = [(c, day(k), float(k % 3), 100.0 + k + (1e9 if (c, k) == ("a", 30) else 0)) for c in "abcdef" for k in range(60)]
    df = sheets.with_horizons(spark.createDataFrame(data, "code string, d date, factor double, close double"), (1, 5), z=5.0)
    assert df.where("code = 'a' and ret_1 is null").count() == 2 and df.where("code = 'b' and ret_1 is null").count() == 1
    with pytest.raises(ValueError):
        sheets.clean_factor(df, periods=(1, 5), max_loss=0.01)
    clean = sheets.clean_factor(df, periods=(1, 5), quantiles=3, max_loss=0.35)
    sheet = sheets.tear_sheet(clean, (1, 5))
    assert sheet.where("by_bin = 0 and by_group = 0").agg(F.sum("n")).first()[0] == 2 * clean.count()
    assert sheets.tear_sheet(clean.limit(0), (1, 5)).collect() == []


def test_grid_equals_plain_loops(spark):
    rng = np.random.default_rng(1)
    price = {c: np.round(100 + rng.normal(0, 1, 80).cumsum(), 2) for c in "ab"}
    df = spark.createDataFrame([(c, day(k), float(x)) for c in price for k, x in enumerate(price[c])], "code string, d date, close double")
    sets = [(1, 4), (3, 9), (9, 3), (5, 5), (2, 200)]
    got = {(r.code, r.fast, r.slow): r for r in sheets.crossing_grid(df, sets).collect()}
    for c, x in price.items():
        for f, s in sets:
            tick = np.round(x * 100).astype(int)
            mean = lambda n, i: tick[i - n + 1 : i + 1].sum() / n if i >= n - 1 else None  # noqa: B023, E731
            kept, opened, held_before = [], 0, False
            for i in range(1, len(x)):
                a, b = mean(f, i - 1), mean(s, i - 1)
                if a is None or b is None:
                    continue
                held = a > b
                kept.append((x[i] / x[i - 1] - 1) * held)
                opened, held_before = opened + (held and not held_before), held
            if not kept:
                assert (c, f, s) not in got
                continue
            r = got[c, f, s]
            assert r.n == len(kept) and r.trades == opened and np.isclose(r["mean"], np.mean(kept)) and np.isclose(r.total, np.prod(1 + np.array(kept)) - 1)
    with pytest.raises(ValueError):
        sheets.crossing_grid(df, [(0, 3)])


def test_row_functions_in_sql_and_frames(spark):
    data = [("a", day(k), x) for k, x in enumerate([1.0, 2.0, 3.0, 3.0, None, 2.0])] + [("b", day(0), 5.0), (None, day(0), 1.0), (None, day(1), 0.0)]
    df = spark.createDataFrame(data, "code string, d date, close double")
    want = [(None, day(0), day(1), -1, 1, -1.0), ("a", day(0), day(2), 1, 2, 2.0), ("a", day(2), day(3), 0, 1, 0.0), ("a", day(3), day(5), -1, 1, -1.0)]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, rows.walked(df, rows.MoveRuns, rows.MoveRuns.SCHEMA).collect()), key=key) == want
    df.createOrReplaceTempView("bars_of_test")
    rows.register(spark, "move_runs_of_test", rows.MoveRuns, rows.MoveRuns.SCHEMA)
    found = spark.sql("SELECT * FROM move_runs_of_test(TABLE(bars_of_test) PARTITION BY code ORDER BY d)").collect()
    assert sorted(map(tuple, found), key=key) == want
    assert rows.walked(df.limit(0), rows.MoveRuns, rows.MoveRuns.SCHEMA).collect() == []


def test_asking_checks_names_and_only_reads(spark):
    df = spark.createDataFrame([("a", 1), ("b; DROP TABLE x", 2)], "code string, n int")
    got = ask(spark, "SELECT IDENTIFIER(:c) AS c FROM {t} WHERE code = :code", {"t": df}, {"c": "n"}, code="b; DROP TABLE x").collect()
    assert [r.c for r in got] == [2]
    assert ask(spark, "SELECT * FROM {t} WHERE code = :code", {"t": df}, code="' OR '1' = '1").collect() == []
    for columns in ({"c": "n FROM {t}; --"}, {"c": "missing"}, {"c": "n)"}, {"c": ""}):
        with pytest.raises(ValueError):
            ask(spark, "SELECT IDENTIFIER(:c) FROM {t}", {"t": df}, columns)
    for sql in ("DROP TABLE IF EXISTS {t}", "CREATE TABLE z AS SELECT * FROM {t}", "INSERT INTO z SELECT * FROM {t}", "WITH a AS (SELECT * FROM {t}) INSERT INTO z SELECT * FROM a", "SET a = b", "SELECT * FROM {unknown}"):
        with pytest.raises(ValueError):
            ask(spark, sql, {"t": df})
    with pytest.raises(Exception, match="(?i)parse|syntax"):
        ask(spark, "SELECT 1; SELECT 2", {"t": df})


def test_projection_of_short_and_flat_codes(spark):
    bars = [("flat", day(k), 1.0, 1.0, 1.0) for k in range(20)] + [("one", day(0), 1.0, 2.0, 1.0)] + [("up", day(k), float(k), k + 1.0, k - 1.0) for k in range(20)]
    out = chan.projection(spark.createDataFrame(bars, "code string, d date, close double, high double, low double"))
    assert out.count() == 41 and out.where("code <> 'flat' and (stroke_direction <> 0 or trade_point_score <> 0 or fractal_type <> 0)").count() == 0
    assert crosses.mean_crosses(spark.createDataFrame([], "code string, d date, close double")).collect() == []


def test_sections_wait_for_late_codes_or_the_watermark(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [
        [(1, at(0, 5), "x", 1.0), (2, at(0, 9), "y", 2.0), (3, at(0, 50), "x", 3.0)],  # hour 0: z is late
        [(4, at(1, 5), "x", 4.0), (5, at(1, 6), "y", 5.0)],  # hour 1: z never comes
        [(6, at(0, 30), "z", 6.0), (7, at(1, 1), None, 1.0)],  # late, within the watermark
        [(8, at(0, 59), "x", 9.0)],  # after hour 0 went out: changes nothing
        [(9, at(6, 0), "x", 7.0), (10, at(6, 1), "y", 8.0), (11, at(6, 2), "z", 9.0)],
    ]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(i, t, 0, c, v, None) for i, t, c, v in batch], streams.EVENTS).coalesce(1).write.parquet(f"{path}/events/{k}")
        import os

        for name in os.listdir(f"{path}/events/{k}"):
            if name.endswith(".parquet"):
                os.rename(f"{path}/events/{k}/{name}", f"{path}/events/{k}.parquet")
                os.utime(f"{path}/events/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    out = streams.sections(streams.event_stream(spark, f"{path}/events/*.parquet"), 3, 3600, "2 hours")
    got = streams.collect_available(out, "sections", f"{path}/state").collect()
    by = {}
    for r in got:
        by.setdefault(r.start.hour, []).append((r.code, r.price, r.n, r.complete))
    assert sorted(by[0]) == [("x", 3.0, 3, True), ("y", 2.0, 3, True), ("z", 6.0, 3, True)]
    assert sorted(by[1]) == [("x", 4.0, 2, False), ("y", 5.0, 2, False)]
    assert len(by[6]) == 3 and len(got) == 8
