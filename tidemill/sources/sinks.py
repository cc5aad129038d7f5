"""Writing tables: append above a high-water mark, upsert with last write wins, replace, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, by: str, ts: str) -> int:
    """Append rows later than what the table holds for their key; returns how many."""
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(path).groupBy(by).agg(F.max(ts).alias("__mark"))
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows.write.parquet(path)
        return spark.read.parquet(path).count()
    fresh = rows.join(held, by, "left").where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def upsert(rows: DataFrame, path: str, keys: list[str], version: int) -> DataFrame:
    """Add a version of rows; reading gives the last version of each key (a replacing table)."""
    rows.withColumn("__version", F.lit(version)).write.mode("append").parquet(path)
    return read_latest(rows.sparkSession, path, keys)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    all_ = spark.read.parquet(path)
    columns = [c for c in all_.columns if c not in keys and c != "__version"]
    best = all_.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__version").alias("r")) if columns else all_.select(*keys).distinct()
    return best.select(*keys, "r.*") if columns else best


def replace_jdbc(rows: DataFrame, url: str, name: str, **options) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON record a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
