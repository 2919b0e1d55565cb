"""Iterative and model-like operators on grouped sums: mixtures, role permutation, node assignment, sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.durable import stored

MODELS = 100_000  # keys whose models (one row each) are broadcast

def midpoint_nodes(rows: DataFrame, nodes: DataFrame, x: str, node: str, max_nodes: int = 10_000) -> DataFrame:
    """Rows with their nearest node on a line: node k takes (middle to the one before, middle to the one after].

    nodes is a library of checked size; each row scans one sorted array.
    """
    nodes = nodes.select(node).distinct()
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    listed = nodes.agg(F.array_sort(F.collect_set(node)).alias("_n"))
    middles = F.transform(F.sequence(F.lit(1), F.size("_n") - 1), lambda k: (F.element_at("_n", k) + F.element_at("_n", k + 1)) / 2)
    edges = listed.select("_n", F.when(F.size("_n") > 1, middles).otherwise(F.array().cast("array<double>")).alias("_m"))
    at = F.size(F.filter("_m", lambda m: F.col(x) > m)) + 1
    joined = rows.join(F.broadcast(edges), F.lit(True))  # one row
    return joined.select(*[F.col(c) for c in rows.columns], F.when(F.col(x).isNotNull(), F.get("_n", at - 1)).alias(node))


def standardised(values: dict[str, Column], mean: dict[str, Column], spread: dict[str, Column]) -> dict[str, Column]:
    return {k: (v - mean[k]) / F.greatest(spread[k], F.lit(1e-9)) for k, v in values.items()}


def best_roles(components: DataFrame, keys: Sequence[str], number: str, scores: dict[str, Column]) -> DataFrame:
    """(keys, one column per role): the assignment of three components to three roles with the greatest total score.

    components has one row per key and number 0, 1, 2; of equal totals the first permutation wins.
    """
    roles = list(scores)
    rows = components.select(*keys, F.col(number).alias("_k"), *(v.alias(f"_s_{r}") for r, v in scores.items()))
    tables = rows.groupBy(*keys).agg(
        *(F.max(F.when(F.col("_k") == k, F.col(f"_s_{r}"))).alias(f"_{r}_{k}") for r in roles for k in range(3))
    )
    options = [
        F.struct(sum((F.col(f"_{r}_{k}") for r, k in zip(roles[1:], p[1:], strict=True)), F.col(f"_{roles[0]}_{p[0]}")).alias("total"), F.lit(-n).alias("first"), F.array(*map(F.lit, p)).alias("p"))
        for n, p in enumerate(permutations(range(3)))
    ]
    best = tables.select(*keys, F.array_max(F.array(*options)).alias("_b"))
    return best.select(*keys, *(F.col("_b.p")[n].alias(r) for n, r in enumerate(roles)))


def mixture_step(df: DataFrame, keys: Sequence[str], x: str, model: DataFrame, k: int) -> DataFrame:
    """One expectation-maximisation round of a 1D Gaussian mixture per key: only sums leave the rows.

    model: one row per key with arrays weight, mean, variance.  Result: the new model and loglik of the old one.
    """
    parts = range(k)
    gap = [f"(`{x}` - mean[{i}])" for i in parts]
    densities = [f"weight[{i}] * exp(-{gap[i]} * {gap[i]} / (2 * variance[{i}])) / sqrt({2 * math.pi!r} * variance[{i}]) as _d{i}" for i in parts]
    scored = df.join(model, list(keys)).selectExpr(*(f"`{c}`" for c in (*keys, x)), *densities)
    scored = scored.selectExpr("*", f"greatest({' + '.join(f'_d{i}' for i in parts)}, 1e-300D) as _t")
    sums = ["count(1) as _n", "sum(ln(_t)) as loglik"]
    for i in parts:
        sums += [f"sum(_d{i} / _t) as _r{i}", f"sum(_d{i} / _t * `{x}`) as _x{i}", f"sum(_d{i} / _t * `{x}` * `{x}`) as _q{i}"]
    totals = scored.groupBy(*keys).agg(*map(F.expr, sums))
    r = [f"greatest(_r{i}, 1e-12D)" for i in parts]
    mean = [f"(_x{i} / {r[i]})" for i in parts]
    return totals.selectExpr(
        *(f"`{c}`" for c in keys),
        f"array({', '.join(f'{r[i]} / _n' for i in parts)}) as weight",
        f"array({', '.join(mean)}) as mean",
        f"array({', '.join(f'greatest(_q{i} / {r[i]} - {mean[i]} * {mean[i]}, 1e-6D)' for i in parts)}) as variance",
        "loglik",
    )


def fit_mixture(df: DataFrame, keys: Sequence[str], x: str, k: int = 3, rounds: int = 8) -> DataFrame:
    """Model after some rounds from evenly spread means between the smallest and largest value; (keys, weight, mean, variance, loglik).

    The two columns that every round reads are stored once.  Up to MODELS keys their models are broadcast, so that the rows
    are not shuffled; more keys are joined by shuffle.
    """
    df = stored(df.select(*keys, x))
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.greatest(F.var_pop(x), F.lit(1e-6)).alias("_v"))
    model = ends.select(
        *keys,
        F.array(*[F.lit(1.0 / k)] * k).alias("weight"),
        F.array(*(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i + 0.5) / k for i in range(k))).alias("mean"),
        F.array(*[F.col("_v")] * k).alias("variance"),
    )
    few = ends.count() <= MODELS
    for _ in range(rounds):
        before = model.select(*keys, "weight", "mean", "variance")
        model = mixture_step(df, keys, x, F.broadcast(before) if few else before, k)
    return model


def sweep_best(df: DataFrame, keys: Sequence[str], options: Sequence[float], cost: dict[float, Column]) -> DataFrame:
    """(keys, option, cost): the option of least summed cost per key, the smaller option of equals; one pass over the rows."""
    sums = df.groupBy(*keys).agg(F.array(*(F.struct(F.sum(cost[o]).alias("cost"), F.lit(o).alias("option")) for o in options)).alias("_o"))
    best = F.array_min("_o")
    return sums.select(*keys, best["option"].alias("option"), best["cost"].alias("cost"))


def ordinal_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], bin_of: Column, name: str) -> DataFrame:
    """Add the rank from 1 by the order columns (a total order), over bins first and inside one bin second."""
    binned = df.withColumn("_b", bin_of)
    counts = binned.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    joined = binned.join(carried, [*keys, "_b"])
    return joined.withColumn(name, (F.col("_c") + F.row_number().over(inside)).cast("bigint")).select(*[F.col(c) for c in df.columns], name)


def softened(grid: DataFrame, keys: Sequence[str], sigma: float, bins: int, classes: Sequence[str], blend: float) -> DataFrame:
    """Class shares blended with their Gaussian mean over the filled neighbours, renormalised; only filled cells stay.

    The mean is a blur of shares over a blur of filled cells, so borders and holes don't pull shares down.
    """
    from starloom.operators.grids import blur

    filled = grid.select(*keys, "iy", "ix", *classes, F.lit(1.0).alias("_f"))
    soft = blur(filled, keys, sigma, bins, ["_f", *classes]).select(*keys, "iy", "ix", "_f", *(F.col(c).alias(f"_s_{c}") for c in classes))
    joined = grid.join(soft, [*keys, "iy", "ix"])
    mixed = {c: (1 - blend) * F.col(c) + blend * F.col(f"_s_{c}") / F.col("_f") for c in classes}
    total = sum(list(mixed.values())[1:], mixed[classes[0]])
    return joined.select(*keys, "iy", "ix", *((v / total).alias(c) for c, v in mixed.items()))
