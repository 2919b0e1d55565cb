"""Relational spine: asset inventories with fallback keys and reasons, manifests, stratified picks, ranges and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.running import linear_quantiles
from starloom.plans.durable import bounded_broadcast

SPANS = 100_000  # chunks of a file list that are broadcast


def fallback_join(left: DataFrame, right: DataFrame, fine: Sequence[str], coarse: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left rows with the values of the right row of their fine key, else the smallest value among the rows of their coarse key.

    Both lookups are grouped to one row per key first, so a key that occurs often on the left meets one row.
    """
    by_fine = right.dropna(subset=list(fine)).groupBy(*fine).agg(*(F.min(v).alias(f"_fine_{v}") for v in values))
    by_coarse = right.groupBy(*coarse).agg(*(F.min(v).alias(f"_coarse_{v}") for v in values))
    joined = left.join(by_fine, list(fine), "left").join(by_coarse, list(coarse), "left")
    found = {v: F.coalesce(f"_fine_{v}", f"_coarse_{v}") for v in values}
    return joined.select(*[F.col(c) for c in left.columns], *(c.alias(v) for v, c in found.items()))


def exclusion_reasons(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, in the given order; an unknown check (null) fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda r: r.isNotNull())


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """(reason, n): how often each reason occurs; rows without reasons add nothing."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str, counted: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ordinal per key, with repeat_count, the number of rows of the counted columns (default: keys)."""
    counted = list(counted or keys)
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(ordinal)).alias("_row")).select("_row.*")
    counts = df.groupBy(*counted).agg(F.count(F.lit(1)).alias("repeat_count"))
    return kept.join(counts, counted)


def mode_smallest(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): the most frequent value, the smallest of equals; nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b")))
    return counts.groupBy(*keys).agg(best.alias(name))


def ranked_limit(df: DataFrame, order: Sequence[Column], limit: int, name: str = "selection_rank") -> DataFrame:
    """The first limit rows of an order with their rank from 1; the limit is taken per partition before the last step."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))  # limit rows at most


def stratified_pick(df: DataFrame, strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each stratum in the given order."""
    return df.groupBy(*strata).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def chunk_ranges(chunks: DataFrame, requests: DataFrame, length: str, chunk: str, start: str, count: str) -> DataFrame:
    """Parts of requested global row ranges that lie in each chunk: (request columns, chunk, local_start, n, global_start).

    chunks: (chunk, length) in order of chunk, a list of files of which up to SPANS are broadcast (counted first); requests
    are half-open ranges [start, start + count).
    """
    before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    spans = chunks.select(F.col(chunk).alias("chunk"), F.coalesce(F.sum(length).over(before), F.lit(0)).alias("_from"), F.col(length).alias("_len"))
    first, last = F.greatest(F.col(start), F.col("_from")), F.least(F.col(start) + F.col(count), F.col("_from") + F.col("_len"))
    joined = requests.join(bounded_broadcast(spans, SPANS), (F.col("_from") < F.col(start) + F.col(count)) & (F.col("_from") + F.col("_len") > F.col(start)))
    return joined.select(*[F.col(c) for c in requests.columns], "chunk", (first - F.col("_from")).alias("local_start"), (last - first).alias("n"), first.alias("global_start"))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without a finished result (resumable batches)."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def terciles(df: DataFrame, value: str, low: float, high: float, bin_of: Column) -> DataFrame:
    """size_bin 0, 1 or 2 by two percentiles of value over all rows, which are counted over bins."""
    cuts = linear_quantiles(df, [], value, [low, high], bin_of)
    binned = F.when(F.col(value) <= F.col("q")[0], 0).when(F.col(value) <= F.col("q")[1], 1).otherwise(2)
    return df.join(F.broadcast(cuts), F.lit(True)).select(*[F.col(c) for c in df.columns], binned.alias("size_bin"))  # one row
