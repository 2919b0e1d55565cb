"""Labels of particles and cells: look-ups, priors, ladders, legacy rules, responsibilities, central and substructure weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.heavy_keys import skew_join


def unique_lookup(rows: DataFrame, catalogue: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(rows' distinct keys, n_rows, status, value): the one usable value of a key in a catalogue.

    status: none without a row, several with different values, invalid if the value is null, NaN or not positive, else ok.
    The value is null unless the status is ok.  A key's rows are combined before the shuffle.
    """
    found = catalogue.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_filled")
    )
    joined = rows.select(*keys).distinct().join(found, list(keys), "left")
    usable = F.col("_low").isNotNull() & ~F.isnan("_high") & (F.col("_low") > 0)
    status = (
        F.when(F.col("n_rows").isNull(), "none").when(F.col("_low") < F.col("_high"), "several").when(~F.coalesce(usable, F.lit(False)), "invalid").otherwise("ok")
    )
    named = joined.withColumn("status", status)
    return named.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "status", F.when(F.col("status") == "ok", F.col("_low")).alias(value))


def priors(parts: Sequence[Column], names: Sequence[str], confidence: float) -> list[Column]:
    """Columns of class priors that add up to 1 and their confidence: uniform with confidence 0 where nothing is positive.

    Null, NaN and negative parts count as 0.
    """
    clean = [F.when(F.isnan(p) | (p < 0) | p.isNull(), 0.0).otherwise(p) for p in parts]
    total = sum(clean[1:], clean[0])
    shares = [F.when(total > 0, c / total).otherwise(1 / len(clean)).alias(n) for c, n in zip(clean, names, strict=True)]
    return [*shares, F.when(total > 0, confidence).otherwise(0.0).alias("confidence")]


def responsibilities(x: Column, components: Sequence[tuple[float, float, float]]) -> list[Column]:
    """Share of each Gaussian component (weight, mean, variance) in the density at x."""
    density = [w * F.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for w, m, v in components]
    total = F.greatest(sum(density[1:], density[0]), F.lit(1e-300))
    return [d / total for d in density]


def legacy_roles(means: DataFrame, keys: Sequence[str], number: str, spin: str, energy: str, radius: str, tie: float = 0.05) -> DataFrame:
    """(keys, bulge, disk, halo): the component that spins most is the disk; of the others the lower energy is the bulge.

    Energies closer than tie are decided by the smaller radius; of equals the lower number comes first.  Three rows a key.
    """
    entry = F.struct(F.col(number).alias("k"), F.col(spin).alias("s"), F.col(energy).alias("e"), F.col(radius).alias("r"))
    rows = means.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_c"))  # three rows
    most = F.array_max(F.transform("_c", lambda c: F.struct(c["s"].alias("s"), (-c["k"]).alias("k"))))
    split = rows.withColumn("disk", -most["k"]).withColumn("_rest", F.filter("_c", lambda c: c["k"] != F.col("disk")))
    a, b = F.get("_rest", F.lit(0)), F.get("_rest", F.lit(1))
    far = F.abs(a["e"] - b["e"]) >= tie
    first = F.when(far, a["e"] < b["e"]).otherwise(a["r"] <= b["r"])
    return split.select(*keys, F.when(first, a["k"]).otherwise(b["k"]).alias("bulge"), "disk", F.when(first, b["k"]).otherwise(a["k"]).alias("halo"))


def ladder_classes(df: DataFrame, keys: Sequence[str], value: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add class: the last rule that holds; rows without a rule take the class whose mean value in their key is nearest.

    Of equally near classes the one of the earlier rule is taken; a key without any ruled row keeps null.
    """
    ruled = F.lit(None).cast("string")
    for name, holds in rules:
        ruled = F.when(holds, name).otherwise(ruled)
    rows = df.withColumn("_ruled", ruled)
    means = rows.groupBy(*keys).agg(*(F.avg(F.when(F.col("_ruled") == n, F.col(value))).alias(f"_m{k}") for k, (n, _) in enumerate(rules)))
    gaps = [F.struct(F.round(F.abs(F.col(value) - F.col(f"_m{k}")), 9).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, _) in enumerate(rules)]
    filled = F.array_compact(F.array(*(F.when(F.col(f"_m{k}").isNotNull(), g) for k, g in enumerate(gaps))))
    joined = rows.join(means, list(keys))
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_ruled", F.array_min(filled)["n"]).alias("class"))


def central_weight(iy: Column, ix: Column, bins: int, scale: float) -> Column:
    """Gaussian weight of a cell by its distance from the middle of the grid, in cells."""
    middle = (bins - 1) / 2
    return F.exp(-0.5 * ((iy - middle) ** 2 + (ix - middle) ** 2) / scale**2)


def bar_weight(phi: Column, radius: Column, angle: Column, bar_radius: Column, soft: Column) -> Column:
    """Weight of a place in a bar: cosine of twice the angle from the bar, cut at 0, fading beyond the bar's radius."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.cos(2 * (phi - angle)))) / (1 + F.exp((radius - bar_radius) / soft))


def token_index(files: DataFrame, path: str, pattern: str, suffix_rank: Column) -> DataFrame:
    """(token, path): for each id that file paths name, the best file by rank of its kind, length of its name and path."""
    named = files.select(path, F.explode(F.array_distinct(F.regexp_extract_all(path, F.lit(pattern), F.lit(0)))).alias("token"))
    name = F.element_at(F.split(path, "/"), -1)
    return named.groupBy("token").agg(F.min_by(path, F.struct(suffix_rank.alias("a"), F.length(name).alias("b"), F.col(path).alias("c"))).alias(path))


def match_tokens(rows: DataFrame, key: str, tokens: Column, index: DataFrame, path: str) -> DataFrame:
    """(key, token, path): the file of the longest of a row's id tokens that the index has, the first in text order of equals."""
    each = rows.select(key, F.explode(F.array_distinct(F.array_compact(tokens))).alias("token"))
    found = skew_join(each, index, "token")
    best = F.max_by(F.struct("token", path), F.struct(F.length("token").alias("a"), F.col("token").alias("b")))
    return found.groupBy(key).agg(best.alias("_b")).select(key, "_b.token", f"_b.{path}")


def affine_resample(grid: DataFrame, keys: Sequence[str], bins: int, scale: float, shift: float, flip: bool, value: str = "value") -> DataFrame:
    """Grid read at (scale * iy + shift, scale * ix + shift), the second one counted from the far end if flip, bilinearly.

    Cells outside the source and missing ones count as 0; targets that meet no source cell have no row.  Each source cell
    is sent to the targets whose place falls within one cell of it.
    """
    cells = F.sequence(F.lit(0), F.lit(bins - 1))
    at = lambda t: t * scale + shift
    over = lambda t: (bins - 1) - at(t) if flip else at(t)
    ys = F.filter(cells, lambda t: F.abs(at(t) - F.col("iy")) < 1)
    xs = F.filter(cells, lambda t: F.abs(over(t) - F.col("ix")) < 1)
    sent = grid.withColumn("_ty", F.explode(ys)).withColumn("_tx", F.explode(xs))
    weight = (1 - F.abs(at(F.col("_ty")) - F.col("iy"))) * (1 - F.abs(over(F.col("_tx")) - F.col("ix")))
    return sent.groupBy(*keys, F.col("_ty").alias("iy"), F.col("_tx").alias("ix")).agg(F.sum(F.col(value) * weight).alias(value))


def line_spread(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, width: Column, reach: int) -> DataFrame:
    """(keys, ordinal, spread): each point as the mean of the points up to reach places around it, weighted by a Gaussian.

    width: standard deviation in places at the point itself.  Every point is sent to its neighbours, one equi-join.
    """
    near = df.select(*keys, F.col(ordinal).alias("_at"), value, F.explode(F.sequence(F.col(ordinal) - reach, F.col(ordinal) + reach)).alias(ordinal))
    own = df.select(*keys, ordinal, width.alias("_w"))
    weight = F.exp(-((F.col("_at") - F.col(ordinal)) ** 2) / (2 * F.col("_w") ** 2))
    joined = near.join(own, [*keys, ordinal])
    return joined.groupBy(*keys, ordinal).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("spread"))


def crop_boxes(cells: DataFrame, keys: Sequence[str], bins: int, pad: int) -> DataFrame:
    """(keys, y0, y1, x0, x1): bounding box of the cells with a margin, kept inside the grid; ends are exclusive."""
    low = lambda c: F.greatest(F.min(c) - pad, F.lit(0))
    high = lambda c: F.least(F.max(c) + 1 + pad, F.lit(bins))
    return cells.groupBy(*keys).agg(low("iy").alias("y0"), high("iy").alias("y1"), low("ix").alias("x0"), high("ix").alias("x1"))


def drawn_views(units: DataFrame, galaxy: Sequence[str], view: str, epoch: int, count: int, seed: int) -> DataFrame:
    """(galaxy, view) of count views of each galaxy for an epoch, by a hash of seed, epoch, galaxy and view; the same in every run."""
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(g).cast("string") for g in galaxy), F.col(view).cast("string")))
    distinct = units.select(*galaxy, view).distinct().withColumn("_turn", turn)
    ranked = Window.partitionBy(*galaxy).orderBy("_turn")  # views of one galaxy: a fixed few
    return distinct.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= count).select(*galaxy, view)
