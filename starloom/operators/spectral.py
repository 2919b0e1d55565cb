"""Spectra in long form: (keys, wave, flux).  Waves are made distinct per key by averaging before anything ordered is done.

Spectra of one key may be long and unequal; ordered steps work inside segments of the wave axis with a margin taken from
the neighbouring segment, so no task holds a whole spectrum of unbounded length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, keys: Sequence[str], wave: str, segment: float, values: Sequence[str]) -> DataFrame:
    """Add prev_<c> and next_<c> for wave and values: the neighbouring points of the same key, null at the ends.

    Windows run over segments of the axis; the first and last point of each segment are joined to the segments beside
    them, which is one row per key and segment.
    """
    cols = [wave, *values]
    rows = df.withColumn("_seg", F.floor(F.col(wave) / segment))
    inside = Window.partitionBy(*keys, "_seg").orderBy(wave)
    local = rows.withColumns({f"_p_{c}": F.lag(c).over(inside) for c in cols} | {f"_n_{c}": F.lead(c).over(inside) for c in cols})
    ends = rows.groupBy(*keys, "_seg").agg(
        F.min_by(F.struct(*cols), F.col(wave)).alias("_first"), F.max_by(F.struct(*cols), F.col(wave)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_seg")
    beside = ends.select(*keys, "_seg", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    joined = local.join(beside, [*keys, "_seg"])
    added = {f"prev_{c}": F.coalesce(f"_p_{c}", F.col(f"_before.{c}")) for c in cols} | {
        f"next_{c}": F.coalesce(f"_n_{c}", F.col(f"_after.{c}")) for c in cols
    }
    return joined.select(*[F.col(c) for c in df.columns], *(v.alias(k) for k, v in added.items()))


def gradient(df: DataFrame, keys: Sequence[str], wave: str, segment: float) -> DataFrame:
    """Add step: half the distance between the neighbours, the single distance at the ends, null for a lone point."""
    near = with_neighbours(df, keys, wave, segment, [])
    before, after = F.col(wave) - F.col(f"prev_{wave}"), F.col(f"next_{wave}") - F.col(wave)
    step = F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2).otherwise(F.coalesce(before, after))
    return near.select(*[F.col(c) for c in df.columns], step.alias("step"))


def trapezoid(df: DataFrame, keys: Sequence[str], wave: str, value: str, segment: float) -> DataFrame:
    """(keys, integral): trapezoid rule over each key's points; 0 for a lone point."""
    near = with_neighbours(df, keys, wave, segment, [value])
    area = (F.col(f"next_{wave}") - F.col(wave)) * (F.col(f"next_{value}") + F.col(value)) / 2
    return near.groupBy(*keys).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("integral"))


def resample_linear(df: DataFrame, keys: Sequence[str], wave: str, value: str, start: float, step: float, count: int, segment: float) -> DataFrame:
    """(keys, k, wave, value) on a regular axis of count points: linear inside the key's range, no row outside it."""
    near = with_neighbours(df, keys, wave, segment, [value]).filter(F.col(f"next_{wave}").isNotNull())
    lo, hi = F.col(wave), F.col(f"next_{wave}")
    first = F.greatest(F.ceil((lo - start) / step), F.lit(0)).cast("int")
    last = F.least(F.ceil((hi - start) / step) - 1, F.lit(count - 1)).cast("int")
    spread = near.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))
    at = F.lit(start) + F.col("k") * step
    found = F.col(value) + (F.col(f"next_{value}") - F.col(value)) * (at - lo) / (hi - lo)
    return spread.select(*keys, "k", at.alias("at"), found.alias("resampled"))


def simpson(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, step: float, legacy: bool = False) -> DataFrame:
    """(keys, integral) over an odd number of equally spaced points, numbered from 0, by Simpson's rule.

    legacy repeats a known fault for comparison with old products: the even sum counts the last odd point each time.
    """
    k = F.col(ordinal)
    last = df.groupBy(*keys).agg(F.max(ordinal).alias("_last"))
    joined = df.join(last, list(keys))
    ends, odd = (k == 0) | (k == F.col("_last")), k % 2 == 1
    even_sum = F.sum(F.when(~ends & ~odd, F.col(value)))
    if legacy:
        even_sum = F.count_if(~ends & ~odd) * F.max(F.when(k == F.col("_last") - 1, F.col(value)))
    total = F.sum(F.when(ends, F.col(value)).otherwise(0.0)) + 4 * F.sum(F.when(odd & ~ends, F.col(value)).otherwise(0.0)) + 2 * F.coalesce(even_sum, F.lit(0.0))
    return joined.groupBy(*keys).agg((total * step / 3).alias("integral"))


def simpson_closed(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, step: float, legacy: bool = False) -> DataFrame:
    """(keys, integral) over all points, numbered from 0: Simpson's rule to the last even one, a trapezoid over an interval
    left over.  A missing point counts as 0; legacy as in simpson."""
    k = F.col(ordinal)
    last = df.groupBy(*keys).agg(F.max(ordinal).alias("_z")).withColumn("_e", F.col("_z") - F.col("_z") % 2)
    joined = df.join(last, list(keys))
    inner = (k > 0) & (k < F.col("_e"))
    even_sum = F.sum(F.when(inner & (k % 2 == 0), F.col(value)).otherwise(0.0))
    if legacy:
        even_sum = F.count_if(inner & (k % 2 == 0)) * F.coalesce(F.max(F.when(k == F.col("_e") - 1, F.col(value))), F.lit(0.0))
    ends = F.sum(F.when((F.col("_e") > 0) & ((k == 0) | (k == F.col("_e"))), F.col(value)).otherwise(0.0))
    odd = F.sum(F.when(inner & (k % 2 == 1), F.col(value)).otherwise(0.0))
    rest = F.sum(F.when((F.col("_z") > F.col("_e")) & (k >= F.col("_e")), F.col(value)).otherwise(0.0))
    return joined.groupBy(*keys).agg(((ends + 4 * odd + 2 * even_sum) * step / 3 + rest * step / 2).alias("integral"))


def good_pixels(wave: Column, lines: Sequence[float], width: float) -> Column:
    """Whether a wave keeps more than width away from every line."""
    good = F.lit(True)
    for line in lines:
        good = good & (F.abs(wave - line) > width)
    return good


def log_bins(low: float, high: float, count: int) -> tuple[float, float]:
    """(log of the lower end, width in log) of equal bins in log wave."""
    return math.log(low), (math.log(high) - math.log(low)) / count


def log_rebin(df: DataFrame, keys: Sequence[str], wave: str, value: str, low: float, high: float, count: int) -> DataFrame:
    """(keys, bin, flux): mean value of the points in each of count bins of equal width in log wave; empty bins have no row."""
    start, width = log_bins(low, high, count)
    at = F.floor((F.ln(F.col(wave)) - start) / width).cast("int")
    placed = df.filter((F.col(wave) >= low) & (F.col(wave) < high)).withColumn("bin", F.least(at, F.lit(count - 1)))
    return placed.groupBy(*keys, "bin").agg(F.avg(value).alias("flux"))


def window_snr(df: DataFrame, keys: Sequence[str], value: str, inside: Column) -> DataFrame:
    """(keys, snr): median value over the median absolute deviation inside a window; null where the deviation is 0."""
    rows = df.filter(inside).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    middle = rows.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5, _n)").alias("_m"))
    spread = rows.join(middle, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("_m"))).groupBy(*keys).agg(
        F.first("_m").alias("_m"), F.expr("percentile(_d, 0.5, _n)").alias("_s")
    )
    return spread.select(*keys, F.try_divide("_m", F.nullif("_s", F.lit(0.0))).alias("snr"))


def fill_bands(df: DataFrame, keys: Sequence[str], band: str, value: str) -> DataFrame:
    """A key's missing bands filled from the nearest lower band that has a value, else the nearest higher one."""
    up = Window.partitionBy(*keys).orderBy(band).rowsBetween(Window.unboundedPreceding, 0)  # bands of one key: a fixed few
    down = Window.partitionBy(*keys).orderBy(band).rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last(value, True).over(up), F.first(value, True).over(down))
    return df.withColumn("filled", filled)
