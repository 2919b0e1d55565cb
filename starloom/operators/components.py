"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.durable import durable


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang a node's neighbours (larger ones, or smaller ones and itself) on the smallest node among them and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, source: str, target: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a link; component is the smallest node in its order.

    Each round is a few shuffles of the shrinking link list, cut by a checkpoint; the number of rounds grows with the
    logarithm of the longest path.  Null ends are ignored, a node linked only to itself is its own component, repeated
    links change nothing, and no links give no rows.
    """
    clean = links.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null").distinct()
    clean = durable(clean)
    nodes = clean.select("a").union(clean.select(F.col("b"))).distinct()
    stars, seen = clean.filter("a <> b"), None
    for _ in range(max_rounds):
        stars = durable(_star(_star(stars, large=True), large=False))
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(stars.select("a", F.col("b").alias("component")), "a", "left").select(
        F.col("a").alias("node"), F.coalesce("component", "a").alias("component")
    )
