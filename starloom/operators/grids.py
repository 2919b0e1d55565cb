"""2D grids in long form: one row per filled cell (keys, iy, ix, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAP_CELLS = 65_536  # cells of a map that is handled as one array

def bin_closed(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number with the last bin closed on the right; null outside."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return F.when((value >= low) & (value < high), at).when(value == high, F.lit(bins - 1))


def bin_open(value: Column, step: float, bins: int) -> Column:
    """Cell of a coordinate on a centred grid of bins cells of size step; null outside."""
    at = F.floor(value / step + bins / 2).cast("int")
    return F.when((at >= 0) & (at < bins), at)


def surface_density(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str, radius: float, bins: int) -> DataFrame:
    """(keys, iy, ix, density): weight per area of each cell of the square around the centre; empty or zero cells have no row."""
    cell = (2 * radius / bins) ** 2
    placed = df.select(*keys, bin_closed(F.col(x), -radius, radius, bins).alias("ix"), bin_closed(F.col(y), -radius, radius, bins).alias("iy"), weight)
    sums = placed.filter("ix is not null and iy is not null").groupBy(*keys, "iy", "ix").agg(F.sum(weight).alias("_w"))
    return sums.filter("_w > 0").select(*keys, "iy", "ix", (F.col("_w") / cell).alias("density"))


def mean_map(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, weight: str, radius: float, bins: int) -> DataFrame:
    """(keys, iy, ix, mean): weighted mean of value per cell; cells without weight have no row."""
    placed = df.select(
        *keys, bin_closed(F.col(x), -radius, radius, bins).alias("ix"), bin_closed(F.col(y), -radius, radius, bins).alias("iy"), value, weight
    )
    sums = placed.filter("ix is not null and iy is not null").groupBy(*keys, "iy", "ix").agg(
        F.sum(F.col(value) * F.col(weight)).alias("_v"), F.sum(weight).alias("_w")
    )
    return sums.filter("_w > 0").select(*keys, "iy", "ix", (F.col("_v") / F.col("_w")).alias("mean"))


def radial_profile(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str, radius: float, bins: int, value: str | None = None) -> DataFrame:
    """(keys, ring, profile): weight per ring area, or the weighted mean of value in the ring."""
    ring = bin_closed(F.sqrt(F.col(x) ** 2 + F.col(y) ** 2), 0.0, radius, bins)
    placed = df.withColumn("ring", ring).filter("ring is not null")
    w = F.sum(weight)
    if value:
        result = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(w, F.lit(0.0)))
        return placed.groupBy(*keys, "ring").agg(result.alias("profile"))
    step = radius / bins
    area = math.pi * step * step * (2 * F.col("ring") + 1)
    return placed.groupBy(*keys, "ring").agg(w.alias("_w")).select(*keys, "ring", (F.col("_w") / area).alias("profile"))


def deposit_nearest(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str, step: float, bins: int) -> DataFrame:
    """(keys, iy, ix, value): each row's weight in the cell that holds it; rows outside the grid are left out."""
    placed = df.select(*keys, bin_open(F.col(x), step, bins).alias("ix"), bin_open(F.col(y), step, bins).alias("iy"), weight)
    return placed.filter("ix is not null and iy is not null").groupBy(*keys, "iy", "ix").agg(F.sum(weight).alias("value"))


def deposit_cic(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str, step: float, bins: int) -> DataFrame:
    """(keys, iy, ix, value): cloud-in-cell deposit, each row's weight shared bilinearly by four cells; parts outside are lost."""
    u, v = F.col(x) / step + bins / 2 - 0.5, F.col(y) / step + bins / 2 - 0.5
    rows = df.select(*keys, weight, F.floor(u).cast("int").alias("_iu"), F.floor(v).cast("int").alias("_iv"), (u - F.floor(u)).alias("_fu"), (v - F.floor(v)).alias("_fv"))
    corners = [
        F.struct(
            (F.col("_iv") + b).cast("int").alias("iy"),
            (F.col("_iu") + a).cast("int").alias("ix"),
            (F.col(weight) * (F.col("_fu") if a else 1 - F.col("_fu")) * (F.col("_fv") if b else 1 - F.col("_fv"))).alias("value"),
        )
        for a in (0, 1)
        for b in (0, 1)
    ]
    cells = rows.select(*keys, F.explode(F.array(*corners)).alias("_c")).select(*keys, "_c.*")
    inside = cells.filter(f"ix >= 0 and ix < {bins} and iy >= 0 and iy < {bins}")
    return inside.groupBy(*keys, "iy", "ix").agg(F.sum("value").alias("value"))


def gather(df: DataFrame, grid: DataFrame, keys: Sequence[str], x: str, y: str, step: float, bins: int) -> DataFrame:
    """Rows with the grid value of their cell, 0 outside or where the cell is empty."""
    placed = df.withColumns({"ix": bin_open(F.col(x), step, bins), "iy": bin_open(F.col(y), step, bins)})
    joined = placed.join(grid.select(*keys, "iy", "ix", F.col("value").alias("gathered")), [*keys, "iy", "ix"], "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("gathered", F.lit(0.0)).alias("gathered"))


def kernel_1d(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights from -radius to radius."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _spread(grid: DataFrame, keys: Sequence[str], along: str, kernel: list[float], bins: int, values: Sequence[str], nearest: bool) -> DataFrame:
    reach = len(kernel) // 2
    other = "ix" if along == "iy" else "iy"
    if nearest:  # a target outside the grid never occurs; a source cell at the edge also stands for all cells beyond it
        edge = [
            F.struct(
                F.lit(t).alias("_to"),
                F.expr(
                    "aggregate(filter(sequence(0, {n}), k -> greatest(0, least({last}, {t} + k - {r})) = {a}), 0D, (s, k) -> s + element_at(array({w}), k + 1))".format(
                        n=len(kernel) - 1, last=bins - 1, t=t, r=reach, a=along, w=", ".join(f"{w!r}D" for w in kernel)
                    )
                ).alias("_w"),
            )
            for t in range(bins)
        ]
        parts = F.filter(F.array(*edge), lambda p: p["_w"] > 0)
    else:
        steps = [F.struct((F.col(along) + k - reach).cast("int").alias("_to"), F.lit(w).alias("_w")) for k, w in enumerate(kernel)]
        parts = F.filter(F.array(*steps), lambda p: (p["_to"] >= 0) & (p["_to"] < bins))
    moved = grid.select(*keys, other, F.explode(parts).alias("_p"), *values)
    return moved.groupBy(*keys, other, F.col("_p._to").alias(along)).agg(*(F.sum(F.col(v) * F.col("_p._w")).alias(v) for v in values))


def blur(grid: DataFrame, keys: Sequence[str], sigma: float, bins: int, values: Sequence[str] = ("value",), nearest: bool = False) -> DataFrame:
    """Separable Gaussian blur of the cell values, columns first, rows second; each pass is one map-side combined sum.

    Empty cells count as 0.  Outside the grid is 0, or with nearest the edge cell repeated.
    """
    kernel = kernel_1d(sigma)
    once = _spread(grid, keys, "ix", kernel, bins, values, nearest)
    return _spread(once, keys, "iy", kernel, bins, values, nearest).select(*keys, "iy", "ix", *values)


def blur_renormalised(grid: DataFrame, keys: Sequence[str], sigma: float, bins: int, classes: Sequence[str], weight: str) -> DataFrame:
    """Blur class shares times weight, over blurred weight, and renormalise so that the shares of a cell add up to 1."""
    weighted = grid.select(*keys, "iy", "ix", weight, *((F.col(c) * F.col(weight)).alias(c) for c in classes))
    soft = blur(weighted, keys, sigma, bins, [weight, *classes])
    ratios = soft.select(*keys, "iy", "ix", *((F.col(c) / (F.col(weight) + 1e-8)).alias(c) for c in classes))
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return ratios.withColumn("_t", total).filter("_t > 0").select(*keys, "iy", "ix", *((F.col(c) / F.col("_t")).alias(c) for c in classes))


def ring_residual(grid: DataFrame, keys: Sequence[str], bins: int, rings: int) -> DataFrame:
    """(keys, iy, ix, ring, residual): cell value over the mean of its ring around the centre, minus 1; null where the mean is 0."""
    middle = (bins - 1) / 2
    distance = F.sqrt((F.col("iy") - middle) ** 2 + (F.col("ix") - middle) ** 2)
    ringed = grid.withColumn("ring", F.least(F.floor(distance / (bins / 2 / rings)), F.lit(rings - 1)).cast("int"))
    means = ringed.groupBy(*keys, "ring").agg(F.avg("value").alias("_mean"))
    residual = F.try_divide("value", F.nullif("_mean", F.lit(0.0))) - 1
    return ringed.join(means, [*keys, "ring"]).select(*keys, "iy", "ix", "ring", residual.alias("residual"))


def neighbours(grid: DataFrame, keys: Sequence[str], reach: int, corners: bool = True) -> DataFrame:
    """Each cell's values sent to the cells around it: (keys, iy, ix, dy, dx, other)."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if corners or abs(a) + abs(b) <= reach]
    moves = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))
    sent = grid.select(*keys, "iy", "ix", F.explode(moves).alias("_m"), F.col("value").alias("other"))
    return sent.select(*keys, (F.col("iy") - F.col("_m.dy")).alias("iy"), (F.col("ix") - F.col("_m.dx")).alias("ix"), "_m.dy", "_m.dx", "other")


def local_maxima(grid: DataFrame, keys: Sequence[str], reach: int = 2) -> DataFrame:
    """Cells whose value is positive and not under any value within reach rows and columns."""
    tops = neighbours(grid, keys, reach).groupBy(*keys, "iy", "ix").agg(F.max("other").alias("_top"))
    return grid.join(tops, [*keys, "iy", "ix"]).filter("value > 0 and value >= _top").select(*keys, "iy", "ix", "value")


def dilate(cells: DataFrame, keys: Sequence[str], bins: int, reach: int = 1) -> DataFrame:
    """Cells (keys, iy, ix) grown by reach in both directions, inside the grid."""
    grown = neighbours(cells.withColumn("value", F.lit(1)), keys, reach).select(*keys, "iy", "ix").distinct()
    return grown.filter(f"iy >= 0 and iy < {bins} and ix >= 0 and ix < {bins}")


def erode(cells: DataFrame, keys: Sequence[str], bins: int, reach: int = 1) -> DataFrame:
    """Cells all of whose neighbours within reach are set; beyond the grid nothing is set."""
    side = 2 * reach + 1
    full = neighbours(cells.withColumn("value", F.lit(1)), keys, reach).groupBy(*keys, "iy", "ix").agg(F.count(F.lit(1)).alias("_n"))
    return full.filter(f"_n = {side * side} and iy >= 0 and iy < {bins} and ix >= 0 and ix < {bins}").select(*keys, "iy", "ix")


def boundary(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled cells with a 4-neighbour of another label."""
    around = neighbours(labels.withColumnRenamed("label", "value"), keys, 1, corners=False)
    joined = labels.join(around, [*keys, "iy", "ix"])
    return joined.filter("label <> other").select(*keys, "iy", "ix", "label").distinct()


def dihedral(grid: DataFrame, bins: int, quarter_turns: int, mirror: bool) -> DataFrame:
    """Square grid mirrored left to right (optionally), then turned counter-clockwise by quarter turns."""
    iy, ix = F.col("iy"), F.col("ix")
    if mirror:
        ix = F.lit(bins - 1) - ix
    for _ in range(quarter_turns % 4):
        iy, ix = F.lit(bins - 1) - ix, iy
    return grid.withColumns({"iy": iy.cast("int"), "ix": ix.cast("int")})


def center_pad(grid: DataFrame, bins: int, target: int) -> DataFrame:
    """Cells of a grid of bins cells a side moved to the middle of one of target cells; cells beyond it are left out."""
    shift = (target - bins) // 2
    moved = grid.withColumns({"iy": F.col("iy") + shift, "ix": F.col("ix") + shift})
    return moved.filter(f"iy >= 0 and iy < {target} and ix >= 0 and ix < {target}")


def azimuth_contrast(grid: DataFrame, keys: Sequence[str], bins: int, sectors: int) -> DataFrame:
    """(keys, n_cells, mean, spread): population deviation of the sector means of value around the centre."""
    middle = (bins - 1) / 2
    angle = F.atan2(F.col("iy") - middle, F.col("ix") - middle)
    sector = F.least(F.floor((angle + math.pi) / (2 * math.pi / sectors)), F.lit(sectors - 1)).cast("int")
    means = grid.withColumn("sector", sector).groupBy(*keys, "sector").agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return means.groupBy(*keys).agg(F.sum("_n").alias("n_cells"), F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("spread"))


def azimuthal_extent(cells: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, extent): degrees that the cells around the centre span: 360 less the widest gap between neighbouring angles."""
    middle = (bins - 1) / 2
    degrees = F.degrees(F.atan2(F.col("iy") - middle, F.col("ix") - middle))
    angles = cells.select(*keys, F.round(degrees, 6).alias("_a")).distinct()
    w = Window.partitionBy(*keys).orderBy("_a")  # cells of one map
    gaps = angles.select(*keys, "_a", (F.lead("_a").over(w) - F.col("_a")).alias("_g"))
    ends = gaps.groupBy(*keys).agg(F.max("_g").alias("_widest"), (360 - (F.max("_a") - F.min("_a"))).alias("_wrap"))
    return ends.select(*keys, F.greatest(F.lit(0.0), 360 - F.greatest(F.coalesce("_widest", F.lit(0.0)), F.col("_wrap"))).alias("extent"))


def _cell_name(keys: Sequence[str], of: str = "") -> Column:
    return F.concat_ws("|", *(F.col(of + k).cast("string") for k in keys), F.lpad(F.col(of + "iy"), 5, "0"), F.lpad(F.col(of + "ix"), 5, "0"))


_ROW = 1 << 32


def _island_labels(maps: pd.Series) -> pd.Series:
    """For each cell number of a map, in order, the smallest number of its 4-connected island (flood fill of one small map)."""
    found = []
    for cells in maps:
        label: dict[int, int] = {}
        inside = set(cells.tolist())
        for start in sorted(inside):
            stack = [] if start in label else [start]
            while stack:
                cell = stack.pop()
                if cell in inside and cell not in label:
                    label[cell] = start
                    stack += (cell - 1, cell + 1, cell - _ROW, cell + _ROW)
        found.append([label[c] for c in cells.tolist()])
    return pd.Series(found)


def connected_cells(cells: DataFrame, keys: Sequence[str], bins: int | None = None) -> DataFrame:
    """(keys, iy, ix, island): 4-connected islands of cells, named by their first cell.

    Where the grid has bins cells a side and at most MAP_CELLS in all, a map is one short array and is labelled inside its
    group.  Maps of unknown or larger size are labelled by star contraction of the links between cells.
    """
    if bins is not None and bins * bins <= MAP_CELLS:
        number = F.col("iy").cast("bigint") * _ROW + F.col("ix")
        maps = cells.groupBy(*keys).agg(F.collect_set(number).alias("_cells"))  # at most MAP_CELLS numbers
        labels = F.pandas_udf(_island_labels, "array<bigint>")("_cells").alias("_labels")
        each = maps.select(*keys, "_cells", labels).select(*keys, F.explode(F.arrays_zip("_cells", "_labels")).alias("_c"))
        row = lambda c: F.floor((F.col(c) + _ROW // 2) / F.lit(float(_ROW))).cast("int")
        at = lambda c: [row(c).alias("iy"), (F.col(c) - row(c).cast("bigint") * _ROW).cast("int").alias("ix")]
        first = F.struct(*keys, *at("_c._labels"))
        named = each.select(*keys, *at("_c._cells"), first.alias("_first"))
        return named.select(*keys, "iy", "ix", _cell_name(keys, "_first.").alias("island"))
    return _contracted_cells(cells, keys)


def _contracted_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    from starloom.operators.components import connected_components

    named = cells.select(*keys, "iy", "ix", _cell_name(keys).alias("_cell"))
    right = named.select("_cell", *keys, "iy", (F.col("ix") + 1).alias("ix"))
    below = named.select("_cell", *keys, (F.col("iy") + 1).alias("iy"), "ix")
    links = right.unionByName(below).withColumn("_other", _cell_name(keys)).select("_cell", "_other")
    real = links.join(named.select(F.col("_cell").alias("_other")), "_other")
    islands = connected_components(real, "_cell", "_other")
    joined = named.join(islands.withColumnRenamed("node", "_cell"), "_cell", "left")
    return joined.select(*keys, "iy", "ix", F.coalesce("component", "_cell").alias("island"))


def grid_frame(spark: SparkSession, bins: int) -> DataFrame:
    """All cells of a square grid."""
    return spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("iy"), (F.col("id") % bins).cast("int").alias("ix"))
