"""Queries of the validation operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import grids as G
from starloom.operators import particles as P
from starloom.operators import validation as V
from starloom.plans.grid_queries import BINS, CLASSES, GRID_SQL, HARD_SQL, KEY, SET_SQL, SHARES_SQL, STACK_SQL, STEP, class_shares, hard_labels, signal_cells, stacked, star_grid
from starloom.plans.particle_queries import EPS_SQL
from starloom.operators.statistics import guarded_corr
from starloom.plans.registry import Registry
from starloom.plans.views import SPECTRA_SQL, STARS_SQL, spectra, stars

registry = Registry()
query = registry.query


def _poly(c: list[float]) -> str:
    text = repr(c[-1])
    for value in reversed(c[:-1]):
        text = f"({text} * y + {value!r})"
    return text


def _extinction_sql(wave: str) -> str:
    """The law written out for DuckDB: magnitudes per event at a wavelength in micron."""
    uv = {c: f"{o} + {s} * x + {h} / (pow(x - {p}, 2) + {w}) + CASE WHEN x > 5.9 THEN {q} * pow(x - 5.9, 2) + {k} * pow(x - 5.9, 3) ELSE 0 END" for c, (o, s, h, p, w), (q, k) in ((c, V.EXTINCTION_UV[c], V.EXTINCTION_CURVE[c]) for c in "ab")}
    far = {c: " + ".join(f"{v} * pow(x - 8, {n})" for n, v in enumerate(V.EXTINCTION_FAR[c])) for c in "ab"}
    branches = [
        ("x < 1.1", "0.574 * pow(x, 1.61)", "-0.527 * pow(x, 1.61)"),
        ("x <= 3.3", _poly(V.EXTINCTION_A), _poly(V.EXTINCTION_B)),
        ("x <= 8", uv["a"], uv["b"]),
        ("x > 8", far["a"], far["b"]),
    ]
    cases = " ".join(f"WHEN {when} THEN ({a}) + ({b}) / 3.1" for when, a, b in branches)
    return (
        f"WITH {SPECTRA_SQL}, w AS (SELECT event_id, 1 / ({wave}) AS x, 1 / ({wave}) - 1.82 AS y, flux / 500 AS av FROM e), r AS (SELECT event_id, av, CASE WHEN x >= 0.3 THEN CASE {cases} END END AS ratio FROM w) "
        "SELECT event_id, round(CASE WHEN ratio * av IS NOT NULL THEN greatest(0.0, ratio * av) END, 6) AS mag FROM r"
    )


@query("extinction_curve", _extinction_sql("0.25::DOUBLE + (event_id % 300) / 100.0"))
def extinction_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extinction of each event at a wavelength given by its id, from the near ultraviolet to the infrared."""
    wave = 0.25 + (F.col("event_id") % 300) / 100.0
    return spectra(spark, sf_dir).select("event_id", F.round(V.extinction(wave, F.col("flux") / 500), 6).alias("mag"))


@query("extinction_ultraviolet", _extinction_sql("0.0917::DOUBLE + (event_id % 400) / 1000.0"))
def extinction_ultraviolet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extinction of each event at a wavelength given by its id, from the far ultraviolet to the optical."""
    wave = 0.0917 + (F.col("event_id") % 400) / 1000.0
    return spectra(spark, sf_dir).select("event_id", F.round(V.extinction(wave, F.col("flux") / 500), 6).alias("mag"))


@query("rest_frame", f"WITH {SPECTRA_SQL} SELECT event_id, round((4000.0 + wave / 1000) / (1 + (flux - 250) / 299792.458), 5) AS rest, round(22.5 - 2.5 * log10(greatest(flux, 1e-30)), 5) AS mag, round(1 / sqrt(flux), 6) AS sigma FROM e WHERE flux > 0")
def rest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).filter("flux > 0")
    return rows.select(
        "event_id",
        F.round(V.rest_wave(4000.0 + F.col("wave") / 1000, F.col("flux") - 250), 5).alias("rest"),
        F.round(V.ab_magnitude(F.col("flux")), 5).alias("mag"),
        F.round(V.sigma_from_inverse_variance(F.col("flux")), 6).alias("sigma"),
    )


_R = ", ".join(f"round({c}, 6) AS {c}" for c in CLASSES)


def rounded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", "w", *(F.round(c, 6).alias(c) for c in CLASSES))


@query(
    "prediction_sets",
    SHARES_SQL + f", q AS (SELECT snap, {_R} FROM h), n AS (SELECT snap, greatest((bulge >= 0.3)::INTEGER + (disk >= 0.3)::INTEGER + (halo >= 0.3)::INTEGER, 1) AS size FROM q) SELECT snap, count(*) AS n_cells, round(avg(size), 6) AS mean_size FROM n GROUP BY 1",
)
def prediction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of classes in the prediction sets of a snapshot's cells."""
    sets = V.prediction_sets(rounded_shares(spark, sf_dir), CLASSES, F.lit(0.7))
    return sets.groupBy("snap").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("set_size"), 6).alias("mean_size"))


@query("concentration_line", SHARES_SQL + ", q AS (SELECT snap, ln(w) AS x, " + "greatest(bulge, disk, halo) AS y FROM h) SELECT snap, count(*) AS n, round(covar_pop(x, y) / nullif(var_pop(x), 0), 5) AS slope, round(pow(covar_pop(x, y), 2) / nullif(var_pop(x) * var_pop(y), 0), 5) AS r2 FROM q GROUP BY 1")
def concentration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line of the largest share over the logarithm of the cell's mass."""
    rows = class_shares(spark, sf_dir).select("snap", F.ln("w").alias("x"), F.greatest(*CLASSES).alias("y"))
    return V.line_fit(rows, ["snap"], "x", "y").select("snap", "n", F.round("slope", 5).alias("slope"), F.round("r2", 5).alias("r2"))


_NEXT = ", r AS (SELECT snap, lead(snap) OVER (ORDER BY TRY_CAST(snap AS BIGINT), snap) AS next FROM (SELECT DISTINCT snap FROM {0} WHERE TRY_CAST(snap AS BIGINT) IS NOT NULL)), j AS (SELECT a.snap, r.next, a.{1} AS a, b.{1} AS b FROM {0} a JOIN r ON a.snap = r.snap JOIN {0} b ON b.snap = r.next AND a.iy = b.iy AND a.ix = b.ix)"


_LABEL_TRANSITIONS_SQL = HARD_SQL + _NEXT.format("m", "label") + " SELECT snap, next, a AS old, b AS new, count(*) AS n, round(count(*) / any_value(t), 6) AS share FROM (SELECT *, count(*) OVER (PARTITION BY snap) AS t FROM j) GROUP BY 1, 2, 3, 4"


@query("label_transitions", _LABEL_TRANSITIONS_SQL)
@query("label_transitions_all", _LABEL_TRANSITIONS_SQL)
def label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label changes of the cells from each snapshot to the next."""
    counts = V.next_runs(hard_labels(spark, sf_dir), "snap", ["iy", "ix"], "label").groupBy("snap", "next", "old", "new").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("snap").agg(F.sum("n").alias("t"))
    return counts.join(totals, "snap").select("snap", "next", "old", "new", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


_RUN_AGREEMENT_SQL = SHARES_SQL + _NEXT.format("h", "disk") + " SELECT snap, next, count(*) AS n, round(CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) ELSE 0 END, 5) AS pearson, round(sqrt(avg(pow(b - a, 2))), 6) AS rmse, round(avg(b - a), 6) AS bias FROM j GROUP BY 1, 2"


@query("run_agreement", _RUN_AGREEMENT_SQL)
@query("run_agreement_all", _RUN_AGREEMENT_SQL)
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the disk shares of each snapshot with the next."""
    gap = F.col("new") - F.col("old")
    found = V.next_runs(class_shares(spark, sf_dir), "snap", ["iy", "ix"], "disk").groupBy("snap", "next").agg(
        F.count(F.lit(1)).alias("n"), guarded_corr("old", "new").alias("pearson"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias")
    )
    return found.select("snap", "next", "n", F.round("pearson", 5).alias("pearson"), F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"))


@query(
    "role_inversion",
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, sqrt(x * x + y * y) AS r, mass, abs({EPS_SQL}) < 0.3 AS is_bulge, {EPS_SQL} >= 0.7 AS is_disk FROM s), "
    "g AS (SELECT galaxy_id, sum(r * mass) FILTER (is_bulge) / nullif(sum(mass) FILTER (is_bulge), 0) AS b, sum(r * mass) FILTER (is_disk) / nullif(sum(mass) FILTER (is_disk), 0) AS d FROM f GROUP BY 1) "
    "SELECT galaxy_id, round(b, 5) AS r_bulge, round(d, 5) AS r_disk, d < 0.9 * b AS inverted FROM g",
)
def role_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galaxies whose disk stars lie further in than their bulge stars."""
    eps, m = P.circularity_proxy(), F.col("mass")
    zero = F.lit(0.0)
    found = V.role_inversion(
        stars(spark, sf_dir), ["galaxy_id"], F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), F.when(F.abs(eps) < 0.3, m).otherwise(zero), F.when(eps >= 0.7, m).otherwise(zero)
    )
    return found.select("galaxy_id", F.round("r_inner", 5).alias("r_bulge"), F.round("r_outer", 5).alias("r_disk"), "inverted")


@query(
    "second_peaks",
    STACK_SQL
    + ", mx AS (SELECT a.snap, a.iy, a.ix, any_value(a.value) AS value FROM t a JOIN t b ON a.snap = b.snap AND abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2 GROUP BY 1, 2, 3 HAVING any_value(a.value) > 0 AND any_value(a.value) >= max(b.value)), "
    "pk AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY snap ORDER BY value DESC, iy, ix) = 1) "
    "SELECT mx.snap, count(*) AS n_peaks, count(*) FILTER (sqrt(pow(mx.iy - pk.iy, 2) + pow(mx.ix - pk.ix, 2)) >= 3 AND mx.value >= 0.02 * pk.value) AS n_second FROM mx JOIN pk USING (snap) GROUP BY 1",
)
def second_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright peaks of a snapshot's stack away from the highest one."""
    return V.second_peaks(G.local_maxima(stacked(spark, sf_dir), ["snap"]), ["snap"], 0.02, 3.0)


_ISLANDS = (
    "WITH RECURSIVE " + SET_SQL[5:]
    + ", near AS (SELECT a.galaxy_id, a.iy * 100 + a.ix AS a, b.iy * 100 + b.ix AS b FROM d a JOIN d b ON a.galaxy_id = b.galaxy_id AND abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1), "
    "reach(galaxy_id, a, b) AS (SELECT galaxy_id, iy * 100 + ix, iy * 100 + ix FROM d UNION SELECT r.galaxy_id, r.a, n.b FROM reach r JOIN near n ON r.galaxy_id = n.galaxy_id AND r.b = n.a), "
    "i AS (SELECT galaxy_id, a, min(b) AS island FROM reach GROUP BY 1, 2), z AS (SELECT galaxy_id, island, count(*) AS n FROM i GROUP BY 1, 2) "
)


@query("islands_kept", _ISLANDS + "SELECT i.galaxy_id, (a // 100)::INTEGER AS iy, (a % 100)::INTEGER AS ix, n AS island_size FROM i JOIN z USING (galaxy_id, island) WHERE n >= 3")
def islands_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal cells without islands of under three cells."""
    return V.islands_kept(signal_cells(spark, sf_dir), KEY, 3, bins=BINS)


@query("largest_island", _ISLANDS + ", l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY n DESC, island) = 1) SELECT i.galaxy_id, (a // 100)::INTEGER AS iy, (a % 100)::INTEGER AS ix, n AS island_size FROM i JOIN l USING (galaxy_id, island)")
def largest_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the largest island of each galaxy, however small."""
    return V.islands_kept(signal_cells(spark, sf_dir), KEY, 0, largest_only=True, keep_small=True, bins=BINS)


_C, _S, _M = math.cos(math.radians(30.0)), math.sin(math.radians(30.0)), (BINS - 1) / 2


@query(
    "rotate_bilinear",
    STACK_SQL
    + f", k AS (SELECT ty, tx, {_C!r} * (ty - {_M}) - {_S!r} * (tx - {_M}) + {_M} AS sy, {_S!r} * (ty - {_M}) + {_C!r} * (tx - {_M}) + {_M} AS sx FROM (SELECT unnest(range({BINS})) AS ty), (SELECT unnest(range({BINS})) AS tx)) "
    "SELECT snap, ty::INTEGER AS iy, tx::INTEGER AS ix, round(sum(value * greatest(0.0, 1 - abs(sy - iy)) * greatest(0.0, 1 - abs(sx - ix))) / 1e6, 8) AS value FROM t JOIN k ON abs(sy - iy) < 1 AND abs(sx - ix) < 1 GROUP BY 1, 2, 3",
)
def rotate_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack turned by 30 degrees."""
    turned = V.rotate_bilinear(stacked(spark, sf_dir), ["snap"], BINS, 30.0)
    return turned.withColumn("value", F.round(F.col("value") / 1e6, 8))


@query(
    "edge_strength",
    SHARES_SQL + ", g AS (SELECT a.snap, a.iy, a.ix, " + " + ".join(f"coalesce(abs(a.{c} - b.{c}), 0) + coalesce(abs(a.{c} - l.{c}), 0)" for c in CLASSES)
    + " AS g FROM h a LEFT JOIN h b ON a.snap = b.snap AND b.iy = a.iy - 1 AND b.ix = a.ix LEFT JOIN h l ON a.snap = l.snap AND l.iy = a.iy AND l.ix = a.ix - 1) SELECT snap, iy, ix, round(exp(-g / 0.5), 6) AS edge FROM g",
)
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edge_strength(class_shares(spark, sf_dir), ["snap"], CLASSES, 0.5).withColumn("edge", F.round("edge", 6))


@query("center_reference", GRID_SQL + f", q AS (SELECT *, sqrt(pow(iy - {_M}, 2) + pow(ix - {_M}, 2)) AS r FROM g) SELECT galaxy_id, count(*) FILTER (r <= 3) AS n_center, round(sum(value) FILTER (r <= 3) / sum(value), 6) AS center_share FROM q GROUP BY 1 HAVING count(*) FILTER (r <= 3) > 0")
def center_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells near the centre of a galaxy and their share of its mass."""
    near = F.sqrt((F.col("iy") - _M) ** 2 + (F.col("ix") - _M) ** 2) <= 3
    sums = star_grid(spark, sf_dir).groupBy("galaxy_id").agg(
        F.count_if(near).alias("n_center"), F.round(F.sum(F.when(near, F.col("value"))) / F.sum("value"), 6).alias("center_share")
    )
    return sums.filter("n_center > 0")


@query(
    "inner_shape",
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, x, y, z, mass FROM s WHERE sqrt(x * x + y * y + z * z) < 4) SELECT galaxy_id, count(*) AS n, round(sqrt(sum(mass * z * z) / nullif(sum(mass * (x * x + y * y)) / 2, 0)), 5) AS flattening FROM f GROUP BY 1 HAVING sum(mass * (x * x + y * y)) > 0",
)
def inner_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness over width of the inner stars, from second moments."""
    inner = stars(spark, sf_dir).filter(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) < 4)
    m = F.col("mass")
    sums = inner.groupBy("galaxy_id").agg(F.count(F.lit(1)).alias("n"), F.sum(m * F.col("z") ** 2).alias("_z"), F.sum(m * (F.col("x") ** 2 + F.col("y") ** 2)).alias("_r"))
    return sums.filter("_r > 0").select("galaxy_id", "n", F.round(F.sqrt(F.col("_z") / (F.col("_r") / 2)), 5).alias("flattening"))



@query(
    "mirror_circularity",
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, least(floor(abs(round({EPS_SQL}, 6)) * 10), 9)::INTEGER AS b, round({EPS_SQL}, 6) >= 0 AS with_spin, mass FROM s), "
    "g AS (SELECT galaxy_id, b, coalesce(sum(mass) FILTER (with_spin), 0) AS p, coalesce(sum(mass) FILTER (NOT with_spin), 0) AS q FROM f GROUP BY 1, 2) SELECT galaxy_id, b AS bin, round(CASE WHEN p > 0 THEN greatest(0.0, 1 - q / p) ELSE 0.0 END, 6) AS excess FROM g",
)
def mirror_circularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess of stars that turn with the disk over those that turn against it, per bin of |circularity|."""
    eps = F.round(P.circularity_proxy(), 6)
    rows = stars(spark, sf_dir).select("galaxy_id", F.least(F.floor(F.abs(eps) * 10), F.lit(9)).cast("int").alias("bin"), (eps >= 0).alias("w"), "mass")
    sums = rows.groupBy("galaxy_id", "bin").agg(*(F.coalesce(F.sum(F.when(c, F.col("mass"))), F.lit(0.0)).alias(n) for n, c in (("p", F.col("w")), ("q", ~F.col("w")))))
    excess = F.when(F.col("p") > 0, F.greatest(F.lit(0.0), 1 - F.col("q") / F.col("p"))).otherwise(0.0)
    return sums.select("galaxy_id", "bin", F.round(excess, 6).alias("excess"))
