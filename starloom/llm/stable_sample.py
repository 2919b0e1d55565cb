"""A reproducible sample that keeps its members as data grows, by epoch-rate selection.

Each record's first-seen epoch is persisted in a ledger together with the rate that was in force then; both are frozen.  The
ledger is a Parquet table of batches, one folder per arrival batch, that is only ever added to: a batch holds the keys that
no earlier batch has, so later rows with an earlier time, and rates that change, touch no entry.  A record is selected if a counter-based random number of its identifier, a pure function of
(seed, identifier, counter), lies under its own frozen rate.  Nothing depends on partitioning, order or other records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = 120_000  # months of the years 0 to 9999: the calendar bounds the list of rates


def counter_random(key: Column, seed: int, counter: int = 0) -> Column:
    """Uniform number in [0, 1) with 52 bits, a pure function of seed, counter and key; null for a null key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{counter}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def month_number(seen_at: Column) -> Column:
    """Months since year 0, the epoch of a point in time."""
    return (F.year(seen_at) * 12 + F.month(seen_at) - 1).cast("int")


def new_entries(records: DataFrame, ledger: DataFrame | None, key: str, seen_at: str, rates: DataFrame) -> DataFrame:
    """Ledger entries (key, epoch, rate) for the keys that the ledger doesn't have yet.

    rates (epoch, rate) may have gaps: an epoch takes the rate of the latest listed epoch not after it, before the first
    one the first; of two rates of one epoch the higher one holds.  Rows with a null key or time are left out.  A key's
    rows count once, at their earliest time.
    """
    seen = records.filter(F.col(key).isNotNull() & F.col(seen_at).isNotNull())
    first = seen.groupBy(key).agg(month_number(F.min(seen_at)).alias("epoch"))
    if ledger is not None:
        first = first.join(ledger.select(key), key, "left_anti")
    months = rates.filter((F.col("epoch") >= 0) & (F.col("epoch") < MONTHS)).groupBy("epoch").agg(F.max("rate").alias("rate"))
    steps = F.broadcast(months.agg(F.sort_array(F.collect_list(F.struct("epoch", "rate"))).alias("__sl_steps")))  # one row of MONTHS steps at most
    valid = F.filter("__sl_steps", lambda s: s["epoch"] <= F.col("epoch"))
    rate = F.coalesce(F.try_element_at(valid, F.lit(-1))["rate"], F.try_element_at(F.col("__sl_steps"), F.lit(1))["rate"])
    return first.join(steps, F.lit(True)).select(key, "epoch", rate.alias("rate"))


def extend_ledger(ledger: DataFrame | None, records: DataFrame, key: str, seen_at: str, rates: DataFrame) -> DataFrame:
    """The ledger with the new keys added; entries it has already are never changed."""
    fresh = new_entries(records, ledger, key, seen_at, rates)
    return fresh if ledger is None else ledger.select(key, "epoch", "rate").unionByName(fresh)


def read_ledger(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """(key, epoch, rate, batch) of the batches stored under a folder, or of those before a number; None for no folder yet."""
    try:
        ledger = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return ledger if before is None else ledger.filter(F.col("batch") < before)


def append_batch(folder: str, batch: int, records: DataFrame, key: str, seen_at: str, rates: DataFrame) -> DataFrame:
    """Store the keys of an arrival batch that no earlier batch has, and return the ledger.

    Batches are numbered in order of arrival.  Writing a batch again with the same records gives the same entries, so a job
    that failed half-way can be repeated.
    """
    spark = records.sparkSession
    fresh = new_entries(records, read_ledger(spark, folder, batch), key, seen_at, rates)
    fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return read_ledger(spark, folder)


def selected(ledger: DataFrame, key: str, seed: int) -> DataFrame:
    """Ledger entries whose random number lies under their own rate."""
    return ledger.withColumn("u", counter_random(F.col(key), seed)).filter(F.col("u") < F.col("rate"))
