"""Sample matching target category proportions, by top-down quotas over a category tree and permuted ranks at its leaves.

Quotas come down from the sample size, from each node of the tree to its children, by their shares and never under the
minimums of their leaves; the children of a node always add up to its quota.  What a leaf cannot fill is passed
first to its siblings (all tree columns equal), then to cousins (fewer equal), at last to the whole tree, always in
proportion to what is left there.  A leaf draws its records by the rank of a pseudo-random permutation of their keys, so
the draw depends on the keys alone.  Ranks are counted over hash ranges of a leaf, never over a whole leaf in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.durable import bounded_broadcast, durable

RANGE_BITS = 12  # ranks are counted over 4096 hash ranges of a category
TURN_BITS = 60
MAX_CATEGORIES = 100_000  # categories are configuration; beyond this many they are joined by shuffle
WIDE = "decimal(38,0)"


def permuted(key: Column, seed: int) -> Column:
    """A fixed pseudo-random 60-bit number of a key; the same in every run, partitioning and SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15), 16, 10).cast("bigint")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by the order columns; combined before the shuffle, so a hot key costs no task more."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__sl_row")).select("__sl_row.*")


def place(rows: DataFrame, categories: DataFrame, equal: Sequence[str], value: str, low: str, high: str) -> DataFrame:
    """Rows with the category they fall in: equal columns agree and low <= value < high; unplaced rows are left out.

    A null in an equal column or in the value places nowhere.
    """
    named = bounded_broadcast(categories.select(F.struct(*categories.columns).alias("__sl_category")), MAX_CATEGORIES)
    on = (F.col(value) >= F.col(f"__sl_category.{low}")) & (F.col(value) < F.col(f"__sl_category.{high}"))
    for column in equal:
        on = on & (F.col(column) == F.col(f"__sl_category.{column}"))
    return rows.join(named, on).select(*[F.col(c) for c in rows.columns], F.col("__sl_category.target_id").alias("target_id"))


def tree_quotas(leaves: DataFrame, leaf: str, tree: Sequence[str], share: str, least: str, size: DataFrame) -> DataFrame:
    """(leaf, quota): whole numbers that come down a category tree from the sample size (size: one row with n).

    The root has the sample size, or the sum of the minimums where that is larger.  A node gives each child the minimums
    of its leaves and shares the rest in proportion to what the child's part by share has over them; parts are cut to whole
    numbers along the order of the children, so they add up.  Where no minimum binds, a child gets its share.
    """
    path = [*tree, leaf]
    nodes = leaves.agg(F.coalesce(F.sum(least), F.lit(0)).alias("_m")).join(F.broadcast(size), F.lit(True))  # one row each
    nodes = nodes.select(F.greatest(F.round("n"), F.col("_m")).cast("double").alias("_quota"))
    for depth in range(1, len(path) + 1):
        above, own = path[: depth - 1], path[depth - 1]
        children = leaves.groupBy(*path[:depth]).agg(F.sum(share).alias("_s"), F.sum(least).cast("double").alias("_m"))
        parents = nodes.select("_quota", *(F.col(c).alias(f"_up_{c}") for c in above))
        on = F.lit(True)
        for c in above:
            on = on & F.col(c).eqNullSafe(F.col(f"_up_{c}"))
        level = Window.partitionBy(*(above or [F.lit(0)]))  # one row per child of a node
        upto = level.orderBy(own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = F.coalesce(F.try_divide(F.col("_quota") * F.col("_s"), F.sum("_s").over(level)), F.lit(0.0))
        over = children.join(parents, on).withColumn("_over", F.greatest(part - F.col("_m"), F.lit(0.0)))
        over = over.withColumns({"_all": F.sum("_over").over(level), "_to": F.sum("_over").over(upto), "_rest": F.col("_quota") - F.sum("_m").over(level)})
        cut = lambda upper: F.floor(F.round(F.coalesce(F.try_divide(F.col("_rest") * upper, F.nullif("_all", F.lit(0.0))), F.lit(0.0)), 6))
        nodes = over.select(*path[:depth], (F.col("_m") + cut(F.col("_to")) - cut(F.col("_to") - F.col("_over"))).alias("_quota"))
    return nodes.select(leaf, F.col("_quota").cast("bigint").alias("quota"))


def pass_quota(leaves: DataFrame, leaf: str, tree: Sequence[str]) -> DataFrame:
    """Add allocated, received and shortfall to leaves with quota and available (one row per category).

    received counts what was passed on to a leaf from others; shortfall is what no leaf of the whole tree could take of
    this leaf's quota, own_gap what the leaf itself could not fill.
    """
    df = leaves.withColumns(
        {
            "allocated": F.least("quota", "available").cast(WIDE),
            "unmet": F.greatest(F.col("quota") - F.col("available"), F.lit(0)).cast(WIDE),
            "spare": F.greatest(F.col("available") - F.col("quota"), F.lit(0)).cast(WIDE),
            "received": F.lit(0).cast(WIDE),
        }
    ).withColumn("own_gap", F.col("unmet"))
    for depth in range(len(tree), -1, -1):
        level = Window.partitionBy(*([F.col(c) for c in tree[:depth]] or [F.lit(0)]))
        upto = level.orderBy(leaf).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns(
            {
                "_unmet": F.sum("unmet").over(level),
                "_spare": F.sum("spare").over(level),
                "_unmet_to": F.sum("unmet").over(upto),
                "_spare_to": F.sum("spare").over(upto),
            }
        ).withColumn("_give", F.least("_unmet", "_spare"))

        def part(of: str, give: str = "_give") -> Column:
            upper = F.floor(F.try_divide(F.col(give) * F.col(f"_{of}_to"), F.col(f"_{of}")))
            lower = F.floor(F.try_divide(F.col(give) * (F.col(f"_{of}_to") - F.col(of)), F.col(f"_{of}")))
            return F.coalesce(upper - lower, F.lit(0)).cast(WIDE)

        df = df.withColumns({"_in": part("spare"), "_out": part("unmet")})
        df = df.withColumns(
            {
                "allocated": (F.col("allocated") + F.col("_in")).cast(WIDE),
                "received": (F.col("received") + F.col("_in")).cast(WIDE),
                "spare": (F.col("spare") - F.col("_in")).cast(WIDE),
                "unmet": (F.col("unmet") - F.col("_out")).cast(WIDE),
            }
        ).select(*leaves.columns, "allocated", "unmet", "spare", "received", "own_gap")
    counts = {c: F.col(c).cast("bigint") for c in ("allocated", "received", "own_gap")}
    return df.withColumns(counts).withColumn("shortfall", F.col("unmet").cast("bigint")).drop("unmet", "spare")


def quota_report(placed: DataFrame, n_all: DataFrame, categories: DataFrame, tree: Sequence[str], fraction: float) -> DataFrame:
    """One row per category: needed, quota, available, allocated, received, own_gap, shortfall, is_met and both shares.

    placed has one row per record (target_id); n_all is one row with n, the records counted in the sample size, the
    unplaced ones included.  needed and is_met look at a category by itself; quota comes down the tree.  wanted_share is the
    target, achieved_share the part of the allocated records.  An empty table gives zero quotas but for min_rows.
    """
    counts = placed.groupBy("target_id").agg(F.count(F.lit(1)).alias("available"))
    needed = F.greatest(F.col("min_rows").cast("double"), F.round(F.col("target_share") * F.col("n") * fraction, 9))
    quotas = tree_quotas(categories, "target_id", tree, "target_share", "min_rows", n_all.select((F.col("n") * fraction).alias("n")))
    leaves = (
        categories.join(F.broadcast(n_all), F.lit(True))  # one row
        .join(counts, "target_id", "left")
        .join(quotas, "target_id")
        .withColumns({"available": F.coalesce("available", F.lit(0)).cast("bigint"), "needed": needed})
        .select(*categories.columns, "needed", "quota", "available")
    )
    report = pass_quota(leaves, "target_id", tree).withColumn("is_met", F.col("available") >= F.col("needed"))
    achieved = F.try_divide(F.col("allocated"), F.sum("allocated").over(Window.partitionBy(F.lit(0))))  # one row per category
    return report.withColumns({"wanted_share": F.col("target_share"), "achieved_share": achieved})


def draw(placed: DataFrame, report: DataFrame, key: str, seed: int) -> DataFrame:
    """(target_id, key, draw_rank) of the drawn records: dense ranks of the permuted keys up to a category's allocation.

    Only the hash range in which a category's allocation ends is cut; ranges before it are taken whole.
    """
    report = durable(report.select("target_id", "allocated"))
    rows = placed.select("target_id", key, permuted(F.col(key), seed).alias("__sl_turn")).withColumn(
        "__sl_range", F.shiftright("__sl_turn", TURN_BITS - RANGE_BITS)
    )
    counts = rows.groupBy("target_id", "__sl_range").agg(F.count_distinct(key).alias("__sl_n"))
    before = Window.partitionBy("target_id").orderBy("__sl_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    limits = (
        counts.withColumn("__sl_before", F.coalesce(F.sum("__sl_n").over(before), F.lit(0)))
        .join(bounded_broadcast(report, MAX_CATEGORIES), "target_id")
        .filter(F.col("__sl_before") < F.col("allocated"))
        .select("target_id", "__sl_range", "__sl_before", "allocated")
    )
    inside = Window.partitionBy("target_id", "__sl_range").orderBy("__sl_turn", key)
    ranked = rows.join(limits, ["target_id", "__sl_range"]).withColumn("draw_rank", F.col("__sl_before") + F.dense_rank().over(inside))
    return ranked.filter(F.col("draw_rank") <= F.col("allocated")).select("target_id", key, "draw_rank")
