"""What the text operators share: reading, lineage cuts, Arrow row helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The files outlive executors.  Spark's cleaner removes them once nothing
    refers to them if spark.cleaner.referenceTracking.cleanCheckpoints is set;
    otherwise they stay until the folder is emptied.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode, where it may be unset, one of our own.

    Raises on a cluster without one: a folder of one machine is none there.
    """
    context, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if given is None and not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return given or context.getCheckpointDir()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are gone; it acts when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def crc_mod(column: str, n: int):
    """crc32 of a value's text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


#: Texts whose 64-bit hashes may be equal by chance before a run is refused.
MOST_CLASHES = 10_000


def text_key(hashed: DataFrame):
    """A 64-bit key by the columns h1 and h2 (see ``with_hashes``): h1, or h2 where texts of one h1 differ in h2."""
    clash = hashed.groupBy("h1").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).where("a != b").select("h1").limit(MOST_CLASHES + 1).collect()
    if len(clash) > MOST_CLASHES:
        raise ValueError("too many texts with equal hashes")
    return F.when(F.col("h1").isin([r.h1 for r in clash]), F.col("h2")).otherwise(F.col("h1")) if clash else F.col("h1")


def with_hashes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with two different 64-bit hashes of the text, h1 and h2."""
    return df.withColumns({"h1": F.xxhash64(text_col), "h2": F.xxhash64(F.lit(1), F.col(text_col))})


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def per_row(df: DataFrame, names: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Arrow map: ``rows(*python_values)`` yields the result tuples of one input row.

    Strings arrive as UTF-8 bytes.  Output is cut into batches by size, so that
    no batch grows with the number of rows that one text gives.
    """
    spark = df.sparkSession
    out = pa_schema(spark, schema)

    def run(batches):
        held, weight = [], 0
        for batch in batches:
            columns = [as_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                for made in rows(*values):
                    held.append(made)
                    weight += 64 + sum(len(x) for x in made if isinstance(x, (bytes, str)))
                    if weight > 8_000_000:
                        yield to_batch(held, out)
                        held, weight = [], 0
        if held:
            yield to_batch(held, out)

    return df.select(*names).mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = []
    for values, field in zip(columns, schema):
        if pa.types.is_string(field.type):
            raw = [v.encode("utf-8") if isinstance(v, str) else v for v in values]
            arrays.append(pa.array(raw, pa.binary()).cast(pa.string()))
        else:
            arrays.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string, found on the driver (tasks only receive it)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
