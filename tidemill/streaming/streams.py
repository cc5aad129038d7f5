"""Structured Streaming: micro-bars, counts, latest prices and account state with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; ts is a timestamp, as watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def by_key(stream: DataFrame, column: str, pattern: str) -> DataFrame:
    """Routing by a key's value (exact text) or pattern (regular expression)."""
    return stream.where(F.col(column).rlike(pattern))


def micro_bars(stream: DataFrame, seconds: int, late: str = "1 hour", slide: int | None = None) -> DataFrame:
    """(code, start, open, high, low, close, n) per tumbling (or sliding) window; later rows than ``late`` are dropped."""
    window = F.window("ts", f"{seconds} seconds", f"{slide} seconds" if slide else None)
    order = F.struct("ts", "event_id")
    bars = stream.withWatermark("ts", late).groupBy(window.alias("w"), F.col("event_type").alias("code"))
    return bars.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")).select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_price(stream: DataFrame) -> DataFrame:
    """(code, price, ts): update-mode latest price of each code."""
    return stream.groupBy(F.col("event_type").alias("code")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def tick_counts(stream: DataFrame, seconds: int = 30, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.col("event_type").alias("code")).agg(F.count("*").alias("n")).select("code", F.col("w.start").alias("start"), "n")


class Account(StatefulProcessor):
    """Cash and position of each user: a purchase buys one unit at its value, an error sells all at its value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "cash double, units long")

    def handleInputRows(self, key, rows, timers) -> Iterator:
        import pandas as pd

        cash, units = self.state.get() if self.state.exists() else (0.0, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind, value in zip(frame.event_type, frame.value):
            if kind == "purchase":
                cash, units = cash - value, units + 1
            elif kind == "error":
                cash, units = cash + value * units, 0
        self.state.update((cash, units))
        yield pd.DataFrame({"user_id": [key[0]], "cash": [cash], "units": [units]})

    def close(self) -> None:
        pass


def account_state(stream: DataFrame) -> DataFrame:
    """(user_id, cash, units) after each batch; state lives in the state store, keyed by user.

    Needs the RocksDB state store provider.
    """
    return stream.groupBy("user_id").transformWithStateInPandas(Account(), outputStructType="user_id long, cash double, units long", outputMode="Update", timeMode="None")


def sections(stream: DataFrame, expected: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(start, code, price, n, complete): the last prices of all codes for each span of time, given out together and once.

    A span goes out as soon as ``expected`` codes have a price in it, or when the
    watermark has passed its end with the codes that came (``complete`` false).
    What comes for a span after it went out changes nothing.  State: one row a
    span, until the watermark passes it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = ["start", "code", "price", "n", "complete"]

    def given(start, held, complete):
        codes = sorted(held)
        return pd.DataFrame({"start": [start] * len(codes), "code": codes, "price": [held[c][2] for c in codes], "n": [len(codes)] * len(codes), "complete": [complete] * len(codes)}, columns=names)

    def run(key, frames, state):
        seen, done = ({}, False) if not state.exists else (dict(zip(state.get[0], zip(*state.get[1:4]))), state.get[4])
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield given(key[0], seen, False)
            return
        for frame in frames:
            for code, ts, number, price in zip(frame.code, frame.ts, frame.event_id, frame.price):
                at = (pd.Timestamp(ts).value, int(number))
                if code not in seen or at > seen[code][:2]:
                    seen[code] = (*at, float(price))
        ready = not done and len(seen) >= expected
        codes = sorted(seen)
        state.update((codes, [seen[c][0] for c in codes], [seen[c][1] for c in codes], [seen[c][2] for c in codes], done or ready))
        end = pd.Timestamp(key[0]).value // 1_000_000 + seconds * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if ready:
            yield given(key[0], seen, True)

    rows = stream.withWatermark("ts", late).where("value is not null and event_type is not null")
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    rows = rows.select(start.alias("start"), F.col("event_type").alias("code"), "ts", "event_id", F.col("value").alias("price"))
    held = "codes array<string>, times array<long>, numbers array<long>, prices array<double>, done boolean"
    return rows.groupBy("start").applyInPandasWithState(run, "start timestamp, code string, price double, n long, complete boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


def collect_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over what is there now and return the table of results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str):
    """Upsert a stream into a Parquet table, exactly once: a batch replaces its own folder with its last row of each key.

    ``read_batches`` gives the table's rows: the last of each key over all batches.
    """
    from ..operators.bars import latest

    def save(batch: DataFrame, number: int) -> None:
        latest(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    """The table that ``write_batches`` keeps: of each key the row with the largest ``seq``, of equal ones the later batch's."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "batch")).alias("r"))
    return best.select(*keys, "r.*")


def available_rows(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over what is there now, batch by batch, and read the results from the session's checkpoint folder.

    In complete mode each batch replaces the table; in update and append mode
    batches add to it, with their numbers in column ``batch``.
    """
    import uuid

    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("spark.checkpoint.dir must be set")
    path = f"{base}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")
