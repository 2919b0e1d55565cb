"""Particle features and statistics per galaxy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import sigmoid
from starloom.operators.running import running_sums

GRAVITY = 4.30091e-6


def angular_momentum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lx, ly, lz, mass): sum of m (r x v); sums are combined before the shuffle, so heavy galaxies cost nothing extra."""
    m = F.col("mass")
    return df.groupBy(*keys).agg(
        F.sum(m * (F.col("y") * F.col("vz") - F.col("z") * F.col("vy"))).alias("lx"),
        F.sum(m * (F.col("z") * F.col("vx") - F.col("x") * F.col("vz"))).alias("ly"),
        F.sum(m * (F.col("x") * F.col("vy") - F.col("y") * F.col("vx"))).alias("lz"),
        F.sum(m).alias("mass"),
    )


def rotate_face_on(df: DataFrame, momentum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions and velocities turned so that the galaxy's angular momentum points along +z.

    Rodrigues rotation written out in columns; no momentum leaves a galaxy as it is, an opposite one flips y and z.
    """
    norm = F.sqrt(F.col("lx") ** 2 + F.col("ly") ** 2 + F.col("lz") ** 2)
    axes = momentum.select(*keys, *(F.when(norm > 0, F.col(c) / norm).otherwise(d).alias(f"_{c}") for c, d in (("lx", 0.0), ("ly", 0.0), ("lz", 1.0))))
    a, b, c = F.col("_lx"), F.col("_ly"), F.col("_lz")
    k = F.when(c > -1 + 1e-12, 1 / (1 + c))
    rows = ((1 - a * a * k, -a * b * k, -a), (-a * b * k, 1 - b * b * k, -b), (a, b, c))
    flip = ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))

    def turned(names: tuple[str, str, str]) -> dict[str, Column]:
        return {
            names[i]: sum((F.coalesce(rows[i][j], F.lit(flip[i][j])) * F.col(names[j]) for j in range(3)), F.lit(0.0)) for i in range(3)
        }

    joined = df.join(axes, list(keys))
    return joined.withColumns(turned(("x", "y", "z")) | turned(("vx", "vy", "vz"))).select(*df.columns)


def weighted_covariance(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z"), weight: str = "mass") -> DataFrame:
    """Weighted covariance of the axes from sums of products; null without weight."""
    w = F.col(weight)
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums = df.groupBy(*keys).agg(
        F.sum(w).alias("_w"),
        *(F.sum(w * F.col(a)).alias(f"_s{a}") for a in axes),
        *(F.sum(w * F.col(a) * F.col(b)).alias(f"_p{a}{b}") for a, b in pairs),
    )
    total = F.nullif("_w", F.lit(0.0))
    return sums.select(
        *keys, *((F.try_divide(f"_p{a}{b}", total) - F.try_divide(f"_s{a}", total) * F.try_divide(f"_s{b}", total)).alias(f"c{a}{b}") for a, b in pairs)
    )


def circularity_proxy() -> Column:
    """Angular momentum about z over radius and speed, in [-1, 1]; 0 at the centre or at rest."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    v = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    jz = F.col("x") * F.col("vy") - F.col("y") * F.col("vx")
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(jz, F.nullif(r * v, F.lit(0.0))))), F.lit(0.0))


def class_of_circularity(eps: Column) -> Column:
    """disk from 0.7 on, bulge above -0.3 and under 0.3, halo otherwise."""
    return F.when(eps >= 0.7, "disk").when(F.abs(eps) < 0.3, "bulge").otherwise("halo")


def score_classes(radius: Column, height: Column, eps: Column) -> dict[str, Column]:
    """Normalised bulge, disk and halo scores from radius and height in effective radii and circularity."""
    disk = sigmoid(5 * (eps - 0.25)) * F.exp(-height / 0.75)
    bulge = F.exp(-radius / 0.60) * F.exp(-F.abs(eps) / 0.7)
    halo = (1 - disk) * (1 - F.exp(-radius / 0.9) + 0.35 * F.least(F.greatest(height, F.lit(0.0)), F.lit(3.0)))
    floored = {k: F.greatest(v, F.lit(1e-8)) for k, v in (("bulge", bulge), ("disk", disk), ("halo", halo))}
    total = floored["bulge"] + floored["disk"] + floored["halo"]
    return {k: v / total for k, v in floored.items()}


def spherical_potential(df: DataFrame, keys: Sequence[str], order: Sequence[str], bin_width: float = 1.0) -> DataFrame:
    """Add phi: potential of the mass inside the radius and of the shells outside, by two running sums over radius."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    rows = df.withColumn("r", r).withColumn("_inv", F.col("mass") / F.greatest(F.col("r"), F.lit(1e-6)))
    summed = running_sums(rows, keys, ["r", *order], {"_inside": F.col("mass"), "_near": F.col("_inv")}, F.floor(F.col("r") / bin_width))
    outer = df.withColumn("_i", F.col("mass") / F.greatest(r, F.lit(1e-6))).groupBy(*keys).agg(F.sum("_i").alias("_outer"))
    phi = -GRAVITY * (F.col("_inside") / F.greatest(F.col("r"), F.lit(1e-3)) + F.col("_outer") - F.col("_near"))
    return summed.join(outer, list(keys)).withColumn("phi", phi).select(*df.columns, "r", "phi")


def circular_moment(df: DataFrame, keys: Sequence[str], order: int = 2) -> DataFrame:
    """(keys, n, strength, angle): mass-weighted azimuthal moment |sum m e^(i order phi)| / sum m and its angle."""
    phi = F.atan2("y", "x")
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mass").alias("_m"),
        F.sum(F.col("mass") * F.cos(order * phi)).alias("_c"),
        F.sum(F.col("mass") * F.sin(order * phi)).alias("_s"),
    )
    strength = F.try_divide(F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2), F.nullif("_m", F.lit(0.0)))
    return sums.select(*keys, "n", strength.alias("strength"), (F.atan2("_s", "_c") / order).alias("angle"))


def energy_envelope(df: DataFrame, keys: Sequence[str], energy: str, value: str, low: float, width: float, bins: int) -> DataFrame:
    """(keys, bin, envelope): largest |value| per energy bin, running maximum over the bins (at most bins rows per key)."""
    from pyspark.sql import Window

    at = F.least(F.greatest(F.floor((F.col(energy) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    tops = df.groupBy(*keys, at.alias("bin")).agg(F.max(F.abs(F.col(value))).alias("_top"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return tops.select(*keys, "bin", F.max("_top").over(upto).alias("envelope"))


def proportional_fit(df: DataFrame, keys: Sequence[str], raw: Sequence[str], targets: Sequence[float], weight: str, rounds: int) -> DataFrame:
    """(keys, s_<class>): scales of iterative proportional fitting of class probabilities to target shares.

    Each round is one grouped aggregation of the rows; rows are floored at 1e-8, shares at 1e-8.  Scales start at 1.
    """
    names = [f"s_{c}" for c in raw]
    scales = df.select(*keys).distinct().select(*keys, *(F.lit(1.0).alias(n) for n in names))
    for _ in range(rounds):
        scaled = df.join(scales, list(keys))
        parts = [F.greatest(F.col(c), F.lit(1e-8)) * F.col(n) for c, n in zip(raw, names, strict=True)]
        total = sum(parts[1:], parts[0])
        shares = scaled.groupBy(*keys, *names).agg(
            F.sum(weight).alias("_w"), *(F.sum(F.col(weight) * p / total).alias(f"_{c}") for c, p in zip(raw, parts, strict=True))
        )
        new = [
            (F.col(n) * t / F.greatest(F.col(f"_{c}") / F.col("_w"), F.lit(1e-8))).alias(n)
            for c, n, t in zip(raw, names, targets, strict=True)
        ]
        scales = shares.select(*keys, *new)
    return scales


def relative_angle(angle: Column, reference: Column, fold: float = math.pi) -> Column:
    """angle - reference in [-fold/2, fold/2)."""
    return F.pmod(angle - reference + fold / 2, F.lit(fold)) - fold / 2
