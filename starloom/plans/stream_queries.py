"""Streaming queries: each reads its table as a stream of files to the end and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.plans.registry import Registry
from starloom.sources.tables import table
from starloom.streaming import events as E

registry = Registry()
query = registry.query


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream: a single file, or all files of its folder."""
    like = table(spark, sf_dir, name)
    if any(f"/{name}.parquet/" in path for path in like.inputFiles()):
        return E.file_stream(spark, f"{sf_dir}/{name}.parquet", "*.parquet", like)
    return E.file_stream(spark, sf_dir, f"{name}.parquet", like)


@query("micro_batch_totals", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def micro_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals kept as partial results per micro-batch and merged on reading."""
    sink, state = E.scratch_folder(spark, "totals"), E.scratch_folder(spark, "totals-state")
    keys = ["user_id", "event_type"]
    E.upsert_totals(
        _stream(spark, sf_dir, "events"), sink, state, keys, lambda b: b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )
    return E.merged_totals(spark, sink, keys).select(*keys, "n", F.round("total", 4).alias("total"))


@query("windowed_stream", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', any_value(ts)) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'")
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour sums of the windows that a watermark of one day has closed."""
    sink, state = E.scratch_folder(spark, "windows"), E.scratch_folder(spark, "windows-state")
    sums = E.windowed_sums(_stream(spark, sf_dir, "events"), "ts", "value", ["event_type"], "6 hours", "1 day")
    E.run_available(sums, sink, state)
    out = spark.read.schema(sums.schema).parquet(sink)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_distinct_loads", "SELECT count(DISTINCT pid) AS n_particles FROM particles")
def stream_distinct_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles after dropping repeated loads, however late they come: each batch is held against what is stored."""
    sink, state = E.scratch_folder(spark, "loads"), E.scratch_folder(spark, "loads-state")
    E.append_new(_stream(spark, sf_dir, "particles").select("pid", "loaded_at"), sink, state, "pid")
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n_particles"))
