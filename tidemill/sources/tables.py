"""Reading bar and tick tables, and the shapes that the given tables stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which feeds deliver the same field.
ALIASES = {"vol": "volume", "trade": "volume", "money": "amount", "datetime": "ts", "date": "d"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a part of ``dealt`` tables.
PART_ROWS = 1 << 19


def dealt(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by columns into parts of some PART_ROWS rows, so a task holds no more of a larger table.

    ``rows`` are counted if not given; of a projection of Parquet files that reads their footers alone.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *by)


def normalised(df: DataFrame) -> DataFrame:
    """Column aliases resolved, NaN and sentinel values (over 1e300) null, full-row duplicates gone."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(F.isnan(name) | (F.abs(name) > 1e300), None).otherwise(F.col(name)))
    return df.distinct()


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing required columns: {', '.join(lacking)}")
    return df


def scan_bars(bars: DataFrame, codes=None, start=None, end=None, least_volume: float | None = None, columns=None, key=("code", "d")) -> DataFrame:
    """Pushed-down scan: codes, closed date range, volume above a bound, projection, one row a key.

    Of rows that repeat a key the greatest by their other columns, in order, is kept.
    """
    code, ts = key
    if codes is not None:
        bars = bars.where(F.col(code).isin([codes] if isinstance(codes, str) else list(codes)))
    if start is not None:
        bars = bars.where(F.col(ts) >= F.lit(start).cast(dict(bars.dtypes)[ts]))
    if end is not None:
        bars = bars.where(F.col(ts) <= F.lit(end).cast(dict(bars.dtypes)[ts]))
    if least_volume is not None:
        bars = bars.where(F.col("volume") > least_volume)
    rest = [c for c in bars.columns if c not in key and (columns is None or c in columns)]
    if rest:
        bars = bars.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__r")).select(*key, "__r.*")
    else:
        bars = bars.select(*key).distinct()
    return bars.select(*columns) if columns is not None else bars


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Delimited OHLCV with a header: datetime[, symbol], open, high, low, close, volume."""
    df = require(spark.read.option("header", True).csv(path), "datetime", "open", "high", "low", "close", "volume")
    symbol = F.col("symbol") if "symbol" in df.columns else F.lit("")
    return df.select(symbol.alias("code"), F.to_timestamp("datetime").alias("ts"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("double").alias("volume")).distinct()


def read_jdbc(spark: SparkSession, url: str, query: str, by: str | None = None, lower=None, upper=None, parts: int = 1, **options) -> DataFrame:
    """A relational store; Spark pushes filters and projections into the query.

    With ``by``, a number or time column, the range from ``lower`` to ``upper``
    is read by ``parts`` tasks at once, and rows outside it by the outer ones.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if by is not None:
        reader = reader.options(partitionColumn=by, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Text whose ``#name`` lines open a section: (section, line) for the lines below, per file."""
    from pyspark.sql import Window

    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    order = Window.partitionBy("file").orderBy("at")
    tagged = lines.withColumn("section", F.last(F.when(F.col("value").startswith("#"), F.substring("value", 2, 1000)), ignorenulls=True).over(order))
    return tagged.where(~F.col("value").startswith("#")).select("section", F.col("value").alias("line"))


# ---- shapes over the given tables ---------------------------------------------------------------


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, open, high, low, close, volume, amount): long day bars from orders, code = priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.sum("o_custkey").cast("double").alias("volume"), F.sum("o_totalprice").alias("amount"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, ts, tick_id, price, vol): ticks from events, code = event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.lit(1.0).alias("vol"))


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, ts, open .. amount): hourly bars of ticks."""
    from ..operators.resample import bars_from_ticks

    return bars_from_ticks(ticks(spark, sf_dir), 60)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, seq, price, volume, amount, side): trades from lineitem, code = supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("side"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, code): sectors and their members, from parts and suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("code")).distinct()


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, idx): trade days and their positions, from the days on which orders exist."""
    from ..functions.dates import number_days

    return number_days(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")))
