"""Structured Streaming: file sources that end when everything available is read, late data, and resumable batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.plans.durable import shared_folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a sink or a stream's state below the shared checkpoint folder, on whatever file system that is."""
    return shared_folder(spark, name)


def file_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    """Stream of the Parquet files of a folder that match a pattern, with the schema of an example."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_available(stream: DataFrame, sink: str, state: str, mode: str = "append") -> None:
    """Write everything that is there to a Parquet sink and stop; a further run goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def windowed_sums(stream: DataFrame, at: str, value: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts and sums per time window and keys; rows later than the watermark are dropped once a window is closed."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    sums = timed.groupBy(F.window("_at", window).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("_w.start").alias("window_start"), *keys, "n", "total")


def first_arrivals(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark before (repeated deliveries are dropped)."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def append_new(stream: DataFrame, sink: str, state: str, key: str) -> None:
    """Rows whose key no earlier batch has stored: each batch is held against the sink, so nothing is kept in a state store.

    Repeated keys may come any time later.  A batch that is run again replaces its own part; null keys are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if number > 0:
            stored = batch.sparkSession.read.parquet(sink).filter(F.col("batch") < number).select(key)
            fresh = fresh.join(stored, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def upsert_totals(stream: DataFrame, sink: str, state: str, keys: list[str], merge: Callable[[DataFrame], DataFrame]) -> None:
    """Per-batch partial results appended with their batch number; a batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def merged_totals(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Sums of the partial results of all batches."""
    parts = spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").drop("batch")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
