"""Validation of labels and maps: prediction sets, calibration slopes, run comparisons, detectors, spectra of one rest frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.grids import connected_cells, neighbours

SPEED_OF_LIGHT = 299792.458

# Optical branch of the mean extinction law of Cardelli, Clayton and Mathis (1989), coefficients of x - 1.82 in rising powers.
EXTINCTION_A = [1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.7753, 0.32999]
EXTINCTION_B = [0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.3026, -2.09002]


# Ultraviolet branch (offset, slope, height, place and width of the bump), its curvature beyond 5.9 per micron
# and the far-ultraviolet branch in powers of x - 8, from the same law.
EXTINCTION_UV = {"a": (1.752, -0.316, -0.104, 4.67, 0.341), "b": (-3.090, 1.825, 1.206, 4.62, 0.263)}
EXTINCTION_CURVE = {"a": (-0.04473, -0.009779), "b": (0.2130, 0.1207)}
EXTINCTION_FAR = {"a": [-1.073, -0.628, 0.137, -0.070], "b": [13.670, 4.257, -0.420, 0.374]}


def _horner(c: Sequence[float], y: Column) -> Column:
    total = F.lit(c[-1])
    for value in reversed(c[:-1]):
        total = total * y + value
    return total


def extinction(wave_micron: Column, a_v: Column, r_v: float = 3.1) -> Column:
    """Extinction in magnitudes at a wavelength, by the mean law of Cardelli, Clayton and Mathis (1989).

    Infrared power law from 0.3 to 1.1 per micron, optical polynomial up to 3.3, ultraviolet up to 8 and far ultraviolet
    beyond.  Under 0.3 per micron no law is given and the result is null; negative values become 0.
    """
    x = 1 / wave_micron
    power = F.pow(x, F.lit(1.61))
    over = F.greatest(x - 5.9, F.lit(0.0))

    def ultraviolet(part: str) -> Column:
        offset, slope, height, place, width = EXTINCTION_UV[part]
        square, cube = EXTINCTION_CURVE[part]
        return offset + slope * x + height / ((x - place) ** 2 + width) + square * over**2 + cube * over**3

    def law(infrared: Column, optical: Sequence[float], part: str) -> Column:
        return (
            F.when(x < 0.3, None).when(x < 1.1, infrared).when(x <= 3.3, _horner(optical, x - 1.82)).when(x <= 8, ultraviolet(part)).otherwise(_horner(EXTINCTION_FAR[part], x - 8))
        )

    ratio = law(0.574 * power, EXTINCTION_A, "a") + law(-0.527 * power, EXTINCTION_B, "b") / r_v
    return F.when(ratio.isNotNull() & a_v.isNotNull(), F.greatest(F.lit(0.0), ratio * a_v))


def rest_wave(wave: Column, velocity: Column) -> Column:
    """Wavelength at rest of an observed one, first order in velocity over the speed of light."""
    return wave / (1 + velocity / SPEED_OF_LIGHT)


def sigma_from_inverse_variance(ivar: Column) -> Column:
    """Standard deviation; null where the inverse variance is not positive."""
    return F.when(ivar > 0, 1 / F.sqrt(ivar))


def ab_magnitude(nanomaggies: Column, floor: float = 1e-30) -> Column:
    return 22.5 - 2.5 * F.log10(F.greatest(nanomaggies, F.lit(floor)))


def prediction_sets(df: DataFrame, classes: Sequence[str], threshold: Column) -> DataFrame:
    """Add set_size and top: the classes whose share is at least 1 - threshold, the largest one always among them."""
    shares = F.array(*classes)
    top = F.array_position(shares, F.array_max(shares))
    names = F.array(*map(F.lit, classes))
    inside = F.filter(F.zip_with(shares, names, lambda p, n: F.struct(p.alias("p"), n.alias("n"))), lambda s: s["p"] >= 1 - threshold)
    members = F.array_union(F.transform(inside, lambda s: s["n"]), F.array(F.get(names, top - 1)))
    return df.withColumn("set_members", members).withColumns({"set_size": F.size("set_members"), "top": F.get(names, top - 1)})


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept, r2) of least squares from sums; null slope where x is constant."""
    sums = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"), F.var_pop(y).alias("_u")
    )
    slope = F.try_divide("_c", F.nullif("_v", F.lit(0.0)))
    r2 = F.try_divide(F.col("_c") ** 2, F.nullif(F.col("_v") * F.col("_u"), F.lit(0.0)))
    return sums.select(*keys, "n", slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"), r2.alias("r2"))


def label_transitions(before: DataFrame, after: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(old, new, n, share): how labels of the same cells changed between two runs; cells in one run only are left out."""
    joined = before.select(*keys, F.col(label).alias("old")).join(after.select(*keys, F.col(label).alias("new")), list(keys))
    counts = joined.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total), F.lit(True)).select("old", "new", "n", (F.col("n") / F.col("_t")).alias("share"))  # one row


def run_agreement(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(n, pearson, rmse, bias) of a value in the same cells of two runs."""
    from starloom.operators.statistics import guarded_corr

    joined = before.select(*keys, F.col(value).alias("_a")).join(after.select(*keys, F.col(value).alias("_b")), list(keys))
    gap = F.col("_b") - F.col("_a")
    return joined.agg(F.count(F.lit(1)).alias("n"), guarded_corr("_a", "_b").alias("pearson"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"))


def next_runs(df: DataFrame, run: str, keys: Sequence[str], value: str) -> DataFrame:
    """(run, next, keys, old, new) of the cells that two runs have, one after the other by number, both named in the data."""
    runs = df.select(run).distinct().withColumn("_r", F.col(run).try_cast("bigint")).filter("_r is not null")
    follow = runs.withColumn("next", F.lead(run).over(Window.orderBy("_r", run))).filter("next is not null").drop("_r")  # one row per run
    before = df.select(run, *keys, F.col(value).alias("old")).join(follow, run)
    return before.join(df.select(F.col(run).alias("next"), *keys, F.col(value).alias("new")), ["next", *keys]).select(run, "next", *keys, "old", "new")


def role_inversion(df: DataFrame, keys: Sequence[str], radius: Column, inner: Column, outer: Column, factor: float = 0.9) -> DataFrame:
    """(keys, r_inner, r_outer, inverted): whether the outer role's mean radius lies under factor times the inner role's."""
    sums = df.groupBy(*keys).agg(
        F.try_divide(F.sum(radius * outer), F.nullif(F.sum(outer), F.lit(0.0))).alias("r_outer"),
        F.try_divide(F.sum(radius * inner), F.nullif(F.sum(inner), F.lit(0.0))).alias("r_inner"),
    )
    return sums.select(*keys, "r_inner", "r_outer", (F.col("r_outer") < factor * F.col("r_inner")).alias("inverted"))


def second_peaks(maxima: DataFrame, keys: Sequence[str], share: float, apart: float) -> DataFrame:
    """(keys, n_peaks, n_second): peaks with at least share of the highest and at least apart cells from it."""
    best = maxima.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks"), F.max_by(F.struct("value", "iy", "ix"), F.struct("value", (-F.col("iy")).alias("a"), (-F.col("ix")).alias("b"))).alias("_p"))
    joined = maxima.join(best, list(keys))
    away = F.sqrt((F.col("iy") - F.col("_p.iy")) ** 2 + (F.col("ix") - F.col("_p.ix")) ** 2) >= apart
    return joined.groupBy(*keys, "n_peaks").agg(F.count_if(away & (F.col("value") >= share * F.col("_p.value"))).alias("n_second"))


def islands_kept(cells: DataFrame, keys: Sequence[str], least: int, largest_only: bool = False, keep_small: bool = False, bins: int | None = None) -> DataFrame:
    """Cells of islands of at least least cells; largest_only keeps the greatest (the first of equals) and, with keep_small,
    keeps it even if it is under the limit."""
    named = connected_cells(cells, keys, bins)
    sizes = named.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("_n"))
    if largest_only:
        top = sizes.groupBy(*keys).agg(F.min_by(F.struct("island", "_n"), F.struct((-F.col("_n")).alias("a"), F.col("island").alias("b"))).alias("_t"))
        sizes = top.select(*keys, "_t.*")
    kept = sizes if keep_small else sizes.filter(F.col("_n") >= least)
    return named.join(kept, [*keys, "island"]).select(*keys, "iy", "ix", F.col("_n").alias("island_size"))


def rotate_bilinear(grid: DataFrame, keys: Sequence[str], bins: int, degrees: float, value: str = "value") -> DataFrame:
    """Grid turned about its centre by bilinear interpolation; cells outside count as 0, cells that get nothing have no row.

    Each source cell is sent to the targets whose turned place falls within one cell of it, so it is one grouped sum.
    """
    middle = (bins - 1) / 2
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    y, x = F.col("iy") - middle, F.col("ix") - middle
    cy, cx = F.floor(c * y + s * x + middle).cast("int"), F.floor(-s * y + c * x + middle).cast("int")
    steps = F.array(*(F.struct((cy + a).alias("ty"), (cx + b).alias("tx")) for a in range(-1, 3) for b in range(-1, 3)))
    sent = grid.select(*keys, "iy", "ix", value, F.explode(steps).alias("_t"))
    ty, tx = F.col("_t.ty") - middle, F.col("_t.tx") - middle
    sy, sx = c * ty - s * tx + middle, s * ty + c * tx + middle
    weight = F.greatest(F.lit(0.0), 1 - F.abs(sy - F.col("iy"))) * F.greatest(F.lit(0.0), 1 - F.abs(sx - F.col("ix")))
    moved = sent.withColumn("_w", weight).filter(f"_w > 0 and _t.ty >= 0 and _t.ty < {bins} and _t.tx >= 0 and _t.tx < {bins}")
    return moved.groupBy(*keys, F.col("_t.ty").alias("iy"), F.col("_t.tx").alias("ix")).agg(F.sum(F.col(value) * F.col("_w")).alias(value))


def edge_strength(grid: DataFrame, keys: Sequence[str], classes: Sequence[str], tau: float) -> DataFrame:
    """(keys, iy, ix, edge): exp(-g / tau) of the summed backward differences of class shares; a missing neighbour adds nothing."""
    parts = []
    for c in classes:
        before = neighbours(grid.select(*keys, "iy", "ix", F.col(c).alias("value")), keys, 1, corners=False)
        before = before.filter("(dy = -1 and dx = 0) or (dy = 0 and dx = -1)")
        joined = grid.select(*keys, "iy", "ix", F.col(c).alias("_v")).join(before, [*keys, "iy", "ix"], "left")
        parts.append(joined.groupBy(*keys, "iy", "ix").agg(F.coalesce(F.sum(F.abs(F.col("_v") - F.col("other"))), F.lit(0.0)).alias("_g")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys, "iy", "ix").agg(F.exp(-F.sum("_g") / tau).alias("edge"))


def kinematic_checks(
    cells: DataFrame, keys: Sequence[str], dominant: float = 0.5, least: int = 5, vsigma_ratio: float = 1.1, sigma_ratio: float = 1.1, tolerance: float = 0.15, skew: float = 0.1
) -> DataFrame:
    """Four kinematic tests of a class map and how many of those that apply are passed.

    cells: keys, v, sigma, h3 and the shares bulge, disk and bar.  Medians and rank sums are taken inside a map, which is a
    small grid.  rotation: median |v - median v| / sigma of disk cells over that of bulge cells; dispersion: median sigma of
    bulge over disk cells; bar_sigma: that of bar cells between disk and bulge within a tolerance; h3_signature: rank
    correlation of h3 and v in bar cells, at most -skew.  A test with fewer than least cells on a side is N/A.
    coherence is null where no test applies.
    """
    valid = cells.filter("v is not null and sigma >= 1")
    centre = valid.groupBy(*keys).agg(F.percentile("v", 0.5).alias("_c"))
    rows = valid.join(centre, list(keys)).withColumn("_vs", F.abs(F.col("v") - F.col("_c")) / (F.col("sigma") + 1e-6))
    of = lambda c, value: F.when(F.col(c) > dominant, F.col(value))
    w = Window.partitionBy(*keys)
    bar_rank = lambda c: F.when(F.col("bar") > dominant, F.rank().over(w.orderBy(of("bar", c).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, of("bar", c))) - 1) / 2)
    ranked = rows.withColumns({"_rv": bar_rank("v"), "_rh": bar_rank("h3")})
    middle = lambda c, value: F.percentile(of(c, value), 0.5)
    sums = ranked.groupBy(*keys).agg(
        *(F.count(of(c, "v")).alias(f"n_{c}") for c in ("bulge", "disk", "bar")),
        middle("disk", "_vs").alias("_vd"), middle("bulge", "_vs").alias("_vb"),
        *(middle(c, "sigma").alias(f"_s_{c}") for c in ("bulge", "disk", "bar")),
        F.try_divide(F.covar_pop("_rv", "_rh"), F.nullif(F.stddev_pop(F.when(F.col("_rh").isNotNull(), F.col("_rv"))) * F.stddev_pop(F.when(F.col("_rv").isNotNull(), F.col("_rh"))), F.lit(0.0))).alias("rho"),
    )
    both = (F.col("n_disk") >= least) & (F.col("n_bulge") >= least)
    three = both & (F.col("n_bar") >= least)
    status = lambda applies, passed: F.when(~applies, "N/A").when(passed, "PASS").otherwise("FAIL")
    between = (F.col("_s_bar") >= F.col("_s_disk") * (1 - tolerance)) & (F.col("_s_bar") <= F.col("_s_bulge") * (1 + tolerance))
    tests = {
        "rotation": status(both, F.col("_vd") / (F.col("_vb") + 1e-6) >= vsigma_ratio),
        "dispersion": status(both, F.col("_s_bulge") / (F.col("_s_disk") + 1e-6) >= sigma_ratio),
        "bar_sigma": status(three, between),
        "h3_signature": status(F.col("n_bar") >= least, F.coalesce("rho", F.lit(0.0)) <= -skew),
    }
    found = sums.select(*keys, *(v.alias(k) for k, v in tests.items()))
    listed = F.array(*tests)
    applied, passed = F.size(F.filter(listed, lambda t: t != "N/A")), F.size(F.filter(listed, lambda t: t == "PASS"))
    return found.withColumns({"n_applicable": applied, "n_passed": passed}).withColumn("coherence", F.try_divide("n_passed", "n_applicable"))
