import tempfile

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """The events as a few files, in order of time."""
    path = tempfile.mkdtemp(prefix="spark-") + "/events"
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    return path


def available(stream, name, mode):
    return streams.collect_available(stream, name, tempfile.mkdtemp(prefix="spark-"), mode)


def test_micro_bars_equal_the_batch(spark, folder):
    bars = streams.micro_bars(streams.event_stream(spark, folder, 10), 3600)
    got = available(bars, "bars", "complete").collect()
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    order = F.struct("ts", "event_id")
    want = (
        events.groupBy("event_type", F.window("ts", "3600 seconds").alias("w"))
        .agg(F.min_by("value", order), F.max("value"), F.min("value"), F.max_by("value", order), F.count("*"))
        .select("event_type", "w.start", *(F.col(c) for c in ("min_by(value, struct(ts, event_id))", "max(value)", "min(value)", "max_by(value, struct(ts, event_id))", "count(1)")))
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_counts_and_last_prices(spark, folder):
    counts = available(streams.tick_counts(streams.event_stream(spark, folder), 86_400, "60 days"), "counts", "complete")
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    last = available(streams.latest_price(streams.event_stream(spark, folder)), "last", "complete").collect()
    want = {r.event_type: r.v for r in events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v")).collect()}
    assert {r.code: r.price for r in last} == want


def test_routing_by_key(spark, folder):
    routed = streams.by_key(streams.event_stream(spark, folder), "event_type", "^(view|click)$")
    got = available(routed.select("event_type"), "routed", "append")
    assert {r.event_type for r in got.distinct().collect()} == {"view", "click"}


def test_batches_are_written_once(spark, folder):
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    check = tempfile.mkdtemp(prefix="spark-")
    for _ in range(2):  # the second run finds nothing new
        streams.write_batches(streams.event_stream(spark, folder, 1), out, check, ["user_id"], "event_id").awaitTermination()
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    got = {r.user_id: (r.event_id, r.value) for r in streams.read_batches(spark, out, ["user_id"], "event_id").collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e"), F.max_by("value", "event_id").alias("v"))
    assert got == {r.user_id: (r.e, r.v) for r in events.collect()}


def test_account_state_over_batches(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    times = sorted(r.ts for r in events.select("ts").collect())
    path, a, b = tempfile.mkdtemp(prefix="spark-") + "/events", times[len(times) // 3], times[2 * len(times) // 3]
    for part in (F.col("ts") < F.lit(a), (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)), F.col("ts") >= F.lit(b)):
        events.where(part).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    try:
        got = streams.available_rows(streams.account_state(streams.event_stream(spark, path)), "update")
        assert got.select("batch").distinct().count() == 3
        last = {r.user_id: r.r for r in got.groupBy("user_id").agg(F.max_by(F.struct("cash", "units"), "batch").alias("r")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        cash, units = want.get(r.user_id, (0.0, 0))
        want[r.user_id] = (cash - r.value, units + 1) if r.event_type == "purchase" else (cash + r.value * units, 0) if r.event_type == "error" else (cash, units)
    assert {k: (round(v.cash, 6), v.units) for k, v in last.items()} == {k: (round(c, 6), u) for k, (c, u) in want.items()}
