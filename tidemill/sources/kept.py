"""Ends of lineages, in the folder that the machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Make sure of a checkpoint folder: the session's own or, in local mode where none is set, a new one."""
    context, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if given is None and not f"{context.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    shared_folder(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder, from where a lost executor's work is read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
