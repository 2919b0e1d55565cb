"""Running totals, ranks and weighted quantiles of groups of any size.

A group is cut into bins along its order.  Sums of whole bins run over the bins, the rest runs inside one bin, so no task
ever holds a whole group: a galaxy with a tenth of all particles is spread over as many tasks as it has bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], bin_of: Column) -> DataFrame:
    """Add a running sum, the row included, for each name in sums, over the order columns within the keys.

    bin_of must not fall along the order.  Null values add nothing; ties in the order are taken one after the other.
    """
    names = list(sums)
    binned = df.withColumns({f"_v_{n}": F.coalesce(sums[n], F.lit(0.0)) for n in names}).withColumn("_bin", bin_of)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "_bin").agg(*(F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names))
    carried = totals.select(*keys, "_bin", *(F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0.0)).alias(f"_c_{n}") for n in names))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = binned.join(carried, [*keys, "_bin"])
    return summed.select(*[F.col(c) for c in df.columns], *((F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in names))


def ranks(df: DataFrame, keys: Sequence[str], value: str, bin_of: Column, name: str = "avg_rank") -> DataFrame:
    """Add the average rank (ties share the mean of their places) of value within the keys; null values get null."""
    counts = df.filter(F.col(value).isNotNull()).withColumn("_bin", bin_of).groupBy(*keys, "_bin", value).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_sums(counts, keys, [value], {"_upto": F.col("_n").cast("double")}, F.col("_bin"))
    placed = summed.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(placed, [*keys, value], "left") if keys else df.join(placed, value, "left")


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, bins: Column) -> DataFrame:
    """(keys, quantile): the first value at which the running weight reaches q of the total; a step function.

    Weights at or under zero and null values are left out; a group without weight has no row.
    """
    rows = df.filter((F.col(weight) > 0) & F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"), F.col(weight).alias("_w"), bins.alias("_bin"))
    per_value = rows.groupBy(*keys, "_bin", "_x").agg(F.sum("_w").alias("_w"))
    totals = per_value.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = totals.withColumns({"_upto": F.sum("_bw").over(upto), "_all": F.sum("_bw").over(group)})
    hit = reached.filter((F.col("_upto") >= q * F.col("_all")) & (F.col("_upto") - F.col("_bw") < q * F.col("_all")))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    near = per_value.join(hit, [*keys, "_bin"]).withColumn("_run", F.col("_upto") - F.col("_bw") + F.sum("_w").over(inside))
    return near.filter(F.col("_run") >= q * F.col("_all")).groupBy(*keys).agg(F.min("_x").alias("quantile"))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], bin_of: Column, weight: Column | None = None) -> DataFrame:
    """(keys, q array): linear percentiles of value per key, exact, with no group in one task.

    Rows are counted per distinct value and per bin; only the bins that hold a wanted place are looked into.  bin_of must
    not fall as value rises.  weight: an integer number of times that a row counts, default 1.  Nulls are left out; a key
    without values has no row.
    """
    times = F.sum(weight) if weight is not None else F.count(F.lit(1))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_bin", bin_of)
    counts = rows.groupBy(*keys, "_bin", F.col(value).alias("_x")).agg(times.alias("_n")).filter("_n > 0")
    group = Window.partitionBy(*(keys or [F.lit(0)]))  # bins only
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn")).withColumns({"_upto": F.sum("_bn").over(upto), "_all": F.sum("_bn").over(group)})
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(points))))
    at = (F.col("_all") - 1) * F.col("_p.q")
    places = F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))
    needed = (
        bins.withColumn("_p", wanted)
        .withColumn("_h", at)
        .withColumn("_place", places)
        .filter((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_bn")))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    few = counts.join(needed.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").withColumn("_run", F.sum("_n").over(inside))
    hits = few.join(needed, [*keys, "_bin"]).withColumn("_to", F.col("_upto") - F.col("_bn") + F.col("_run"))
    hits = hits.filter((F.col("_place") < F.col("_to")) & (F.col("_place") >= F.col("_to") - F.col("_n")))
    ends = hits.groupBy(*keys, F.col("_p.k").alias("_k")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first("_h").alias("_h"))
    found = F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo"))
    return ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", found.alias("v")))), lambda s: s["v"]).alias("q"))
