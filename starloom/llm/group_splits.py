"""Train, validation and test splits that keep all records of one object together, by largest-differencing balance.

Objects are connected components of the links between entities.  Their record counts are the weights.  Components
lighter than 1/BUNDLES of all records are bundled by a hash of their id, heavier ones (at most BUNDLES of them) stand
alone; this bounds the list of weights at 2 x BUNDLES numbers whatever the data size.  Over that list, largest
differencing repeatedly combines the two partial solutions of most extreme difference, heaviest bins with lightest, into
BINS nearly equal bins, and whole bins then go to the split that is furthest behind its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUNDLES = 4096
BINS = 100


def largest_differencing(weights: list[int], bins: int) -> list[int]:
    """Bin number of each weight: the two partial solutions with the largest spread are combined, extremes meeting.

    A partial solution is a list of (sum, members) in descending order; the heaviest bin of one is put together with the
    lightest of the other.  Ties are broken by position, so the result is deterministic.
    """
    if not weights:
        return []
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    # pack the sorted weights in rows of `bins`, each row a first partial solution
    heap = []
    for row in range(0, len(order), bins):
        members = order[row : row + bins]
        sums = [(weights[i], [i]) for i in members] + [(0, [])] * (bins - len(members))
        heap.append((sums[-1][0] - sums[0][0], row, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: (-s[0], s[1][:1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], at, merged))
    found = [0] * len(weights)
    for number, (_, members) in enumerate(heap[0][2]):
        for i in members:
            found[i] = number
    return found


def bins_to_splits(sums: list[int], shares: Mapping[str, float]) -> list[str]:
    """Split of each bin: heaviest first, to the split that is furthest behind its share of the total."""
    total, given, found = sum(sums), dict.fromkeys(shares, 0.0), [""] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        split = max(shares, key=lambda s: shares[s] * total - given[s])
        given[split] += sums[i]
        found[i] = split
    return found


def group_splits(records: DataFrame, group: str, shares: Mapping[str, float]) -> DataFrame:
    """The records with their split; a group's records always share one.  Records with a null group get a null split."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    sizes = records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__sl_weight"))
    total = sizes.agg(F.sum("__sl_weight")).first()[0] or 0
    light = F.pmod(F.xxhash64(F.col(group)), F.lit(BUNDLES))
    alone = F.col("__sl_weight") * BUNDLES > F.lit(total)
    named = sizes.select(group, "__sl_weight", F.when(alone, F.col(group)).alias("__sl_alone"), F.when(~alone, light).alias("__sl_light"))
    bundles = named.groupBy("__sl_alone", "__sl_light").agg(F.sum("__sl_weight").alias("__sl_weight"))
    listed = sorted(bundles.collect(), key=lambda r: (r["__sl_alone"] or "", r["__sl_light"] if r["__sl_light"] is not None else -1))  # <= 2 x BUNDLES
    weights = [r["__sl_weight"] for r in listed]
    at = largest_differencing(weights, BINS)
    sums = [0] * BINS
    for weight, number in zip(weights, at, strict=True):
        sums[number] += weight
    split_of = bins_to_splits(sums, shares)
    spark = records.sparkSession
    heavy_rows = [(r["__sl_alone"], split_of[n]) for r, n in zip(listed, at, strict=True) if r["__sl_alone"] is not None]
    heavy = spark.createDataFrame(heavy_rows, f"`{group}` string, __sl_heavy_split string")
    light_rows = [(r["__sl_light"], split_of[n]) for r, n in zip(listed, at, strict=True) if r["__sl_light"] is not None]
    rest = spark.createDataFrame(light_rows, "__sl_light bigint, __sl_light_split string")
    placed = records.join(F.broadcast(heavy), group, "left").withColumn("__sl_light", light).join(F.broadcast(rest), "__sl_light", "left")
    split = F.when(F.col(group).isNotNull(), F.coalesce("__sl_heavy_split", "__sl_light_split"))
    return placed.select(*[F.col(c) for c in records.columns], split.alias("split"))
