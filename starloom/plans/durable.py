"""Cutting lineage and checking sizes before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="starloom-checkpoint-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows, written to the checkpoint folder, so that a lost executor costs no recomputation of the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table under the checkpoint folder and read back column by column.

    For what several passes read: unlike a checkpoint it is compressed, and each pass reads only its columns.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the side has at most max_rows rows; a larger side is left to the planner's shuffle joins."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores where its files give fewer tasks than that, for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
