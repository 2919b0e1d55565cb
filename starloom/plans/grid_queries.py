"""Queries over gridded particles: deposits, blurs, labels, islands and map statistics.

Grids are BINS x BINS cells of STEP kpc around the centre; maps of single galaxies come from star particles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.operators import grids as G
from starloom.operators import particles as P
from starloom.operators import statistics as T
from starloom.plans.particle_queries import CLASS_SQL, EPS_SQL
from starloom.plans.registry import Registry
from starloom.plans.views import STARS_SQL, stars

registry = Registry()
query = registry.query
STEP, BINS, SIGMA = 1.0, 16, 1.0
KEY = ["galaxy_id"]
CLASSES = ["bulge", "disk", "halo"]


def _cell(c: str) -> str:
    return f"floor({c} / {STEP} + {BINS / 2})::INTEGER"


GRID_SQL = f"WITH {STARS_SQL}, g AS (SELECT galaxy_id, {_cell('y')} AS iy, {_cell('x')} AS ix, sum(mass) AS value FROM s WHERE {_cell('x')} BETWEEN 0 AND {BINS - 1} AND {_cell('y')} BETWEEN 0 AND {BINS - 1} GROUP BY ALL)"


def star_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.deposit_nearest(stars(spark, sf_dir), KEY, "x", "y", "mass", STEP, BINS)


@query("nearest_deposit", GRID_SQL + " SELECT * FROM g")
def nearest_deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_grid(spark, sf_dir)


def _corner(a: int, b: int) -> str:
    wx, wy = ("fu" if a else "(1 - fu)"), ("fv" if b else "(1 - fv)")
    return f"SELECT galaxy_id, iv + {b} AS iy, iu + {a} AS ix, mass * {wx} * {wy} AS w FROM q"


CIC_SQL = (
    f"WITH {STARS_SQL}, r AS (SELECT galaxy_id, mass, x / {STEP} + {BINS / 2 - 0.5} AS u, y / {STEP} + {BINS / 2 - 0.5} AS v FROM s), "
    "q AS (SELECT galaxy_id, mass, floor(u)::INTEGER AS iu, floor(v)::INTEGER AS iv, u - floor(u) AS fu, v - floor(v) AS fv FROM r), "
    "c AS (" + " UNION ALL ".join(_corner(a, b) for a in (0, 1) for b in (0, 1)) + "), "
    f"k AS (SELECT galaxy_id, iy, ix, sum(w) AS value FROM c WHERE iy BETWEEN 0 AND {BINS - 1} AND ix BETWEEN 0 AND {BINS - 1} GROUP BY ALL)"
)


@query("cic_deposit", CIC_SQL + " SELECT galaxy_id, iy, ix, round(value, 4) AS value FROM k")
def cic_deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.deposit_cic(stars(spark, sf_dir), KEY, "x", "y", "mass", STEP, BINS).withColumn("value", F.round("value", 4))


@query(
    "grid_gather",
    GRID_SQL + f" SELECT s.pid, s.galaxy_id, coalesce(g.value, 0.0) AS gathered FROM s LEFT JOIN g ON g.galaxy_id = s.galaxy_id AND g.iy = {_cell('s.y')} AND g.ix = {_cell('s.x')}",
)
def grid_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each star with the mass of its cell."""
    return G.gather(stars(spark, sf_dir), star_grid(spark, sf_dir), KEY, "x", "y", STEP, BINS).select("pid", "galaxy_id", "gathered")


def _blur_sql(source: str, keys: str, values: list[str], sigma: float, name: str) -> str:
    kernel = G.kernel_1d(sigma)
    reach = len(kernel) // 2
    table = "(VALUES " + ", ".join(f"({k - reach}, {w!r}::DOUBLE)" for k, w in enumerate(kernel)) + ") AS w(d, f)"
    sums = ", ".join(f"sum({v} * f) AS {v}" for v in values)
    return (
        f"{name}_x AS (SELECT {keys}, iy, ix + d AS ix, {sums} FROM {source}, {table} WHERE ix + d BETWEEN 0 AND {BINS - 1} GROUP BY {keys}, iy, ix + d), "
        f"{name} AS (SELECT {keys}, iy + d AS iy, ix, {sums} FROM {name}_x, {table} WHERE iy + d BETWEEN 0 AND {BINS - 1} GROUP BY {keys}, iy + d, ix)"
    )


STACK_SQL = GRID_SQL + ", t AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, iy, ix, sum(value) AS value FROM g GROUP BY ALL)"


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star grids summed over the galaxies of a snapshot."""
    grid = star_grid(spark, sf_dir).withColumn("snap", F.regexp_extract("galaxy_id", r"-(\d+)-", 1))
    return grid.groupBy("snap", "iy", "ix").agg(F.sum("value").alias("value"))


@query("gaussian_blur", STACK_SQL + ", " + _blur_sql("t", "snap", ["value"], SIGMA, "b") + " SELECT snap, iy, ix, round(value / 1e6, 6) AS value FROM b")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blur(stacked(spark, sf_dir), ["snap"], SIGMA, BINS).withColumn("value", F.round(F.col("value") / 1e6, 6))


SHARES_SQL = (
    f"WITH {STARS_SQL}, k AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, {_cell('y')} AS iy, {_cell('x')} AS ix, mass, {CLASS_SQL} AS class "
    f"FROM (SELECT *, round({EPS_SQL}, 6) AS eps FROM s)), "
    "h AS (SELECT snap, iy, ix, count(*) AS n, sum(mass) AS w, sum(mass * mass) AS w2, "
    + ", ".join(f"coalesce(sum(mass) FILTER (class = '{c}'), 0) / sum(mass) AS {c}" for c in CLASSES)
    + f" FROM k WHERE iy BETWEEN 0 AND {BINS - 1} AND ix BETWEEN 0 AND {BINS - 1} GROUP BY 1, 2, 3 HAVING sum(mass) > 0)"
)


def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass share of each class per cell of a snapshot's stack, with row count n, weight w and sum of squared weights w2."""
    kind = P.class_of_circularity(F.round(P.circularity_proxy(), 6))
    rows = stars(spark, sf_dir).select(
        F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"), G.bin_open(F.col("y"), STEP, BINS).alias("iy"), G.bin_open(F.col("x"), STEP, BINS).alias("ix"), "mass", kind.alias("class")
    )
    sums = rows.filter("iy is not null and ix is not null").groupBy("snap", "iy", "ix").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mass").alias("w"),
        F.sum(F.col("mass") ** 2).alias("w2"),
        *(F.coalesce(F.sum(F.when(F.col("class") == c, F.col("mass"))), F.lit(0.0)).alias(c) for c in CLASSES),
    )
    return sums.filter("w > 0").withColumns({c: F.col(c) / F.col("w") for c in CLASSES})


@query("class_projection", SHARES_SQL + " SELECT snap, iy, ix, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in CLASSES) + " FROM h")
def class_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", "n", *(F.round(c, 6).alias(c) for c in CLASSES))


@query("kish_neff", SHARES_SQL + " SELECT snap, iy, ix, round(w * w / w2, 5) AS n_eff FROM h")
def kish_neff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", F.round(F.col("w") ** 2 / F.col("w2"), 5).alias("n_eff"))


_ENT = "-(" + " + ".join(f"CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END" for c in CLASSES) + f") / {math.log(3)!r}"


@query("cell_entropy", SHARES_SQL + f" SELECT snap, iy, ix, round({_ENT}, 6) + 0.0 AS entropy FROM h")
def cell_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised entropy of the class shares of each cell."""
    value = F.round(S.entropy(F.array(*CLASSES), 3), 6) + 0.0
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", value.alias("entropy"))


_PMAX = "greatest(" + ", ".join(CLASSES) + ")"


@query("validity_code", SHARES_SQL + f" SELECT snap, iy, ix, CASE WHEN w * w / w2 >= 30 AND round({_ENT}, 6) <= 0.75 AND round({_PMAX}, 6) >= 0.5 THEN 1 ELSE 2 END AS code FROM h")
def validity_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for cells with enough particles and a clear class, 2 for other cells with signal."""
    sure = (
        (F.col("w") ** 2 / F.col("w2") >= 30) & (F.round(S.entropy(F.array(*CLASSES), 3), 6) <= 0.75) & (F.round(F.greatest(*CLASSES), 6) >= 0.5)
    )
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", F.when(sure, 1).otherwise(2).alias("code"))


_SECOND = "list_sort([round(bulge, 6), round(disk, 6), round(halo, 6)], 'DESC')"
HARD_SQL = SHARES_SQL + (
    ", l AS (SELECT snap, iy, ix, CASE WHEN round(bulge, 6) >= round(disk, 6) AND round(bulge, 6) >= round(halo, 6) THEN 'bulge' WHEN round(disk, 6) >= round(halo, 6) THEN 'disk' ELSE 'halo' END AS top, "
    f"{_SECOND}[1] AS p1, {_SECOND}[2] AS p2 FROM h), m AS (SELECT snap, iy, ix, CASE WHEN p1 >= 0.55 AND p1 - p2 >= 0.15 THEN top ELSE 'unsure' END AS label FROM l)"
)


def hard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First largest class of each cell where its share and margin suffice, else unsure."""
    shares = F.array(*(F.round(c, 6) for c in CLASSES))
    order = F.sort_array(shares, asc=False)
    clear = (order[0] >= 0.55) & (order[0] - order[1] >= 0.15)
    label = F.when(clear, F.get(F.array(*map(F.lit, CLASSES)), S.first_argmax(shares))).otherwise("unsure")
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", label.alias("label"))


@query("harden_labels", HARD_SQL + " SELECT * FROM m")
def harden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_labels(spark, sf_dir)


@query("hard_label_counts", HARD_SQL + " SELECT snap, label, count(*) AS n_cells FROM m GROUP BY 1, 2")
def hard_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_labels(spark, sf_dir).groupBy("snap", "label").agg(F.count(F.lit(1)).alias("n_cells"))


@query("boundary_map", HARD_SQL + " SELECT DISTINCT a.snap, a.iy, a.ix, a.label FROM m a JOIN m b ON a.snap = b.snap AND abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1 WHERE a.label <> b.label")
def boundary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.boundary(hard_labels(spark, sf_dir), ["snap"])


@query(
    "psf_renormalize",
    SHARES_SQL + ", wt AS (SELECT snap, iy, ix, w, " + ", ".join(f"{c} * w AS {c}" for c in CLASSES) + " FROM h), " + _blur_sql("wt", "snap", ["w", *CLASSES], SIGMA, "b")
    + ", r AS (SELECT snap, iy, ix, " + ", ".join(f"{c} / (w + 1e-8) AS {c}" for c in CLASSES) + " FROM b) SELECT snap, iy, ix, "
    + ", ".join(f"round({c} / (bulge + disk + halo), 6) AS {c}" for c in CLASSES) + " FROM r WHERE bulge + disk + halo > 0",
)
def psf_renormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = G.blur_renormalised(class_shares(spark, sf_dir), ["snap"], SIGMA, BINS, CLASSES, "w")
    return soft.select("snap", "iy", "ix", *(F.round(c, 6).alias(c) for c in CLASSES))


_MID = (BINS - 1) / 2
_DIST = f"sqrt(pow(iy - {_MID}, 2) + pow(ix - {_MID}, 2))"


@query(
    "ring_residual",
    STACK_SQL + f", r AS (SELECT *, least(floor({_DIST} / 1.0), 7)::INTEGER AS ring FROM t) SELECT snap, iy, ix, ring, round(value / nullif(avg(value) OVER (PARTITION BY snap, ring), 0) - 1, 6) AS residual FROM r",
)
def ring_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ring_residual(stacked(spark, sf_dir), ["snap"], BINS, 8).withColumn("residual", F.round("residual", 6))


@query("local_maxima", STACK_SQL + " SELECT a.snap, a.iy, a.ix, any_value(a.value) AS value FROM t a JOIN t b ON a.snap = b.snap AND abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2 GROUP BY 1, 2, 3 HAVING any_value(a.value) > 0 AND any_value(a.value) >= max(b.value)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_maxima(stacked(spark, sf_dir), ["snap"])


SET_SQL = GRID_SQL + ", d AS (SELECT galaxy_id, iy, ix FROM g WHERE value > 60000)"


def signal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_grid(spark, sf_dir).filter("value > 60000").select("galaxy_id", "iy", "ix")


_NINE = "(VALUES (-1), (0), (1)) AS p(dy), (VALUES (-1), (0), (1)) AS q(dx)"


@query(
    "closing_3x3",
    SET_SQL
    + f", grown AS (SELECT DISTINCT galaxy_id, iy + dy AS iy, ix + dx AS ix FROM d, {_NINE} WHERE iy + dy BETWEEN 0 AND {BINS - 1} AND ix + dx BETWEEN 0 AND {BINS - 1}) "
    f"SELECT galaxy_id, iy + dy AS iy, ix + dx AS ix FROM grown, {_NINE} WHERE iy + dy BETWEEN 0 AND {BINS - 1} AND ix + dx BETWEEN 0 AND {BINS - 1} GROUP BY 1, 2, 3 HAVING count(*) = 9",
)
def closing_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal cells grown and shrunk by one cell."""
    return G.erode(G.dilate(signal_cells(spark, sf_dir), KEY, BINS), KEY, BINS)


@query(
    "connected_components",
    "WITH RECURSIVE " + SET_SQL[5:]
    + ", near AS (SELECT a.galaxy_id, a.iy * 100 + a.ix AS a, b.iy * 100 + b.ix AS b FROM d a JOIN d b ON a.galaxy_id = b.galaxy_id AND abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1), "
    "reach(galaxy_id, a, b) AS (SELECT galaxy_id, iy * 100 + ix, iy * 100 + ix FROM d UNION SELECT r.galaxy_id, r.a, n.b FROM reach r JOIN near n ON r.galaxy_id = n.galaxy_id AND r.b = n.a), "
    "i AS (SELECT galaxy_id, a, min(b) AS island FROM reach GROUP BY 1, 2) SELECT galaxy_id, island, count(*) AS n_cells FROM i GROUP BY 1, 2",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of signal cells per galaxy, named by their first cell, with their size."""
    islands = G.connected_cells(signal_cells(spark, sf_dir), KEY, BINS)
    first = F.split("island", r"\|")
    name = F.try_element_at(first, F.lit(2)).cast("int") * 100 + F.try_element_at(first, F.lit(3)).cast("int")
    return islands.groupBy("galaxy_id", name.alias("island")).agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "azimuthal_extent",
    SET_SQL
    + f", a AS (SELECT DISTINCT galaxy_id, round(degrees(atan2(iy - {_MID}, ix - {_MID})), 6) AS a FROM d), g2 AS (SELECT galaxy_id, a, lead(a) OVER (PARTITION BY galaxy_id ORDER BY a) - a AS gap FROM a) "
    "SELECT galaxy_id, round(greatest(0.0, 360 - greatest(coalesce(max(gap), 0.0), 360 - (max(a) - min(a)))), 6) AS extent FROM g2 GROUP BY 1",
)
def azimuthal_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.azimuthal_extent(signal_cells(spark, sf_dir), KEY, BINS).withColumn("extent", F.round("extent", 6))


@query("azimuth_contrast", STACK_SQL + f", u AS (SELECT snap, least(floor((atan2(iy - {_MID}, ix - {_MID}) + pi()) / {2 * math.pi / 16!r}), 15)::INTEGER AS sector, avg(value) AS m, count(*) AS n FROM t WHERE NOT (abs(iy - {_MID}) = abs(ix - {_MID})) AND iy <> ix GROUP BY 1, 2) SELECT snap, sum(n)::BIGINT AS n_cells, round(avg(m), 3) AS mean, round(stddev_pop(m), 3) AS spread FROM u GROUP BY 1")
def azimuth_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of sector means; cells on a diagonal, which is a sector border, are left out."""
    off = F.abs(F.col("iy") - _MID) != F.abs(F.col("ix") - _MID)
    found = G.azimuth_contrast(stacked(spark, sf_dir).filter(off), ["snap"], BINS, 16)
    return found.select("snap", "n_cells", F.round("mean", 3).alias("mean"), F.round("spread", 3).alias("spread"))


@query("d4_transform", STACK_SQL + f" SELECT snap, ({BINS - 1} - ({BINS - 1} - ix))::INTEGER AS iy, iy AS ix, value FROM t")
def d4_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack mirrored and turned by a quarter."""
    return G.dihedral(stacked(spark, sf_dir), BINS, 1, True).select("snap", "iy", "ix", "value")


_TURNS = [(q, m) for q in range(4) for m in (False, True)]


def _turn_sql(q: int, m: bool) -> tuple[str, str]:
    iy, ix = "iy", f"({BINS - 1} - ix)" if m else "ix"
    for _ in range(q):
        iy, ix = f"({BINS - 1} - {ix})", iy
    return iy, ix


@query(
    "d4_alignment",
    STACK_SQL
    + ", r AS (SELECT iy, ix, value FROM t WHERE snap = '90'), a AS ("
    + " UNION ALL ".join(f"SELECT {q} AS turns, {str(m).lower()} AS mirrored, snap, {_turn_sql(q, m)[0]} AS iy, {_turn_sql(q, m)[1]} AS ix, value FROM t WHERE snap <> '90'" for q, m in _TURNS)
    + ") SELECT snap, turns, mirrored, round(CASE WHEN count(*) > 1 AND var_pop(a.value) > 0 AND var_pop(r.value) > 0 THEN covar_pop(a.value, r.value) / (sqrt(var_pop(a.value)) * sqrt(var_pop(r.value))) ELSE 0.0 END, 5) AS ncc "
    "FROM a JOIN r USING (iy, ix) GROUP BY 1, 2, 3",
)
def d4_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each snapshot's stack with that of snapshot 90 in the eight mirrorings and turns."""
    grid = stacked(spark, sf_dir)
    reference = grid.filter("snap = '90'").select("iy", "ix", F.col("value").alias("ref"))
    turned = [G.dihedral(grid.filter("snap <> '90'"), BINS, q, m).withColumns({"turns": F.lit(q), "mirrored": F.lit(m)}) for q, m in _TURNS]
    every = turned[0]
    for one in turned[1:]:
        every = every.unionByName(one)
    return every.join(reference, ["iy", "ix"]).groupBy("snap", "turns", "mirrored").agg(F.round(T.guarded_corr("value", "ref"), 5).alias("ncc"))


@query("center_pad", GRID_SQL + " SELECT galaxy_id, iy + 8 AS iy, ix + 8 AS ix, value FROM g")
def center_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.center_pad(star_grid(spark, sf_dir), BINS, 32)


@query("js_divergence", SHARES_SQL + ", q AS (SELECT a.snap, a.iy, a.ix, a.bulge AS b1, a.disk AS d1, a.halo AS h1, b.bulge AS b2, b.disk AS d2, b.halo AS h2 FROM h a JOIN h b USING (iy, ix) WHERE b.snap = '90' AND a.snap <> '90') SELECT snap, iy, ix, round("
       + " + ".join(f"CASE WHEN {p} > 0 THEN 0.5 * {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN 0.5 * {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END" for p, q in (("b1", "b2"), ("d1", "d2"), ("h1", "h2")))
       + ", 5) + 0.0 AS js FROM q")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of class shares between each snapshot's cells and those of snapshot 90."""
    shares = class_shares(spark, sf_dir)
    reference = shares.filter("snap = '90'").select("iy", "ix", F.array(*CLASSES).alias("q"))
    mine = shares.filter("snap <> '90'").select("snap", "iy", "ix", F.array(*CLASSES).alias("p"))
    return mine.join(reference, ["iy", "ix"]).select("snap", "iy", "ix", (F.round(S.js_divergence(F.col("p"), F.col("q")), 5) + 0.0).alias("js"))


@query("iou_pairwise", GRID_SQL + ", o AS (SELECT iy, ix, regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, sum(value) AS value FROM g GROUP BY ALL), f AS (SELECT p.snap AS a, q.snap AS b FROM (SELECT DISTINCT snap FROM o) p, (SELECT DISTINCT snap FROM o) q WHERE p.snap < q.snap), "
       "c AS (SELECT DISTINCT iy, ix FROM o) SELECT f.a, f.b, round(sum(least(coalesce(x.value, 0), coalesce(y.value, 0))) / sum(greatest(coalesce(x.value, 0), coalesce(y.value, 0))), 6) AS iou FROM f, c LEFT JOIN o x ON x.snap = f.a AND x.iy = c.iy AND x.ix = c.ix LEFT JOIN o y ON y.snap = f.b AND y.iy = c.iy AND y.ix = c.ix GROUP BY 1, 2")
def iou_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft overlap of the stacks of each two snapshots."""
    grid = stacked(spark, sf_dir).withColumn("all", F.lit(1))
    return T.soft_iou(grid, "all", "snap", ["iy", "ix"], "value").select("a", "b", F.round("iou", 6).alias("iou"))


@query("mirror_weights", STACK_SQL + f" SELECT a.snap, a.iy, a.ix, round(least(a.value, coalesce(b.value, 0)) / a.value, 6) AS kept FROM t a LEFT JOIN t b ON a.snap = b.snap AND b.iy = {BINS - 1} - a.iy AND b.ix = {BINS - 1} - a.ix WHERE a.value > 0")
def mirror_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of each cell's mass that its mirror cell through the centre also has."""
    grid = stacked(spark, sf_dir)
    other = G.dihedral(grid, BINS, 2, False).withColumnRenamed("value", "other")
    joined = grid.filter("value > 0").join(other, ["snap", "iy", "ix"], "left")
    return joined.select("snap", "iy", "ix", F.round(F.least(F.col("value"), F.coalesce("other", F.lit(0.0))) / F.col("value"), 6).alias("kept"))
