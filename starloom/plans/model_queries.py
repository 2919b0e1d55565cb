"""Queries of iterative and model-like operators, and of validation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import models as M
from starloom.operators import particles as P
from starloom.operators import statistics as T
from starloom.plans.grid_queries import BINS, CLASSES, SHARES_SQL, SIGMA, _blur_sql, class_shares
from starloom.plans.particle_queries import EPS_SQL
from starloom.plans.registry import Registry
from starloom.plans.views import SPECTRA_SQL, STARS_SQL, spectra, stars
from starloom.sources.tables import table

registry = Registry()
query = registry.query


@query(
    "midpoint_nodes",
    "WITH n AS (SELECT DISTINCT p_size * 1.0::DOUBLE AS node FROM part), m AS (SELECT node, (lag(node) OVER (ORDER BY node) + node) / 2 AS lo, (lead(node) OVER (ORDER BY node) + node) / 2 AS hi FROM n) "
    "SELECT node, count(*) AS n FROM lineitem JOIN m ON (lo IS NULL OR l_quantity * 0.97 > lo) AND (hi IS NULL OR l_quantity * 0.97 <= hi) GROUP BY 1",
)
def midpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per nearest node of a grid of nodes."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("node"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 0.97).alias("x"))
    return M.midpoint_nodes(rows, nodes, "x", "node").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


_NODES_SQL = (
    "WITH n AS (SELECT DISTINCT p_size * 1.0::DOUBLE AS node FROM part), m AS (SELECT node, (lag(node) OVER (ORDER BY node) + node) / 2 AS lo, (lead(node) OVER (ORDER BY node) + node) / 2 AS hi FROM n) "
    "SELECT a.node AS age, b.node AS met, count(*) AS n, round(sum(l_extendedprice), 2) AS flux FROM lineitem JOIN m a ON (a.lo IS NULL OR l_quantity > a.lo) AND (a.hi IS NULL OR l_quantity <= a.hi) "
    "JOIN m b ON (b.lo IS NULL OR l_discount * 500 > b.lo) AND (b.hi IS NULL OR l_discount * 500 <= b.hi) GROUP BY 1, 2"
)


@query("node_histogram", _NODES_SQL)
@query("node_histogram_all", _NODES_SQL)
def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional histogram over the nearest of all nodes of two axes."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("node"))
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") * 500).alias("d"), "l_extendedprice")
    first = M.midpoint_nodes(rows, nodes, "l_quantity", "node").withColumnRenamed("node", "age")
    both = M.midpoint_nodes(first, nodes, "d", "node").withColumnRenamed("node", "met")
    return both.groupBy("age", "met").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("flux"))


_MEANS = f"WITH {STARS_SQL}, f AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, pid % 3 AS k, sqrt(x * x + y * y) AS r, abs(z) AS h, {EPS_SQL} AS eps, 0.5 * (vx * vx + vy * vy + vz * vz) / 10000 AS e FROM s), "


def component_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean radius, height, circularity and energy of three arbitrary components per snapshot."""
    rows = stars(spark, sf_dir).select(
        F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"),
        (F.col("pid") % 3).alias("k"),
        F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("r"),
        F.abs("z").alias("h"),
        P.circularity_proxy().alias("eps"),
        (0.5 * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2) / 10000).alias("e"),
    )
    return rows.groupBy("snap", "k").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("r", "h", "eps", "e")))


_PERMS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
_ROLES = {"bulge": "-r - e", "disk": "eps + r - h", "halo": "h - eps"}


@query(
    "role_permutation",
    _MEANS
    + "m AS (SELECT snap, k, round(avg(r), 6) AS r, round(avg(h), 6) AS h, round(avg(eps), 6) AS eps, round(avg(e), 6) AS e FROM f GROUP BY 1, 2), o AS ("
    + " UNION ALL ".join(
        f"SELECT snap, {n} AS n, {p[0]} AS bulge, {p[1]} AS disk, {p[2]} AS halo, sum(CASE WHEN k = {p[0]} THEN -r - e END) + sum(CASE WHEN k = {p[1]} THEN eps + r - h END) + sum(CASE WHEN k = {p[2]} THEN h - eps END) AS total FROM m GROUP BY 1"
        for n, p in enumerate(_PERMS)
    )
    + ") SELECT snap, bulge, disk, halo FROM o QUALIFY row_number() OVER (PARTITION BY snap ORDER BY round(total, 6) DESC, n) = 1",
)
def role_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which component plays which role: the best of the six assignments."""
    scores = {r: F.expr(e) for r, e in _ROLES.items()}
    return M.best_roles(component_means(spark, sf_dir), ["snap"], "k", scores)


@query(
    "feature_scaling",
    f"WITH {STARS_SQL}, f AS (SELECT pid, galaxy_id, {EPS_SQL} AS eps, sqrt(x * x + y * y) AS r, abs(z) AS h, 0.5 * (vx * vx + vy * vy + vz * vz) AS e FROM s), t AS (SELECT galaxy_id, max(r) AS r1, max(h) AS h1, max(e) AS e1 FROM f GROUP BY 1) "
    "SELECT pid, galaxy_id, round(eps, 6) AS f_eps, round(coalesce(r / nullif(r1, 0), 0), 6) AS f_r, round(coalesce(h / nullif(h1, 0), 0), 6) AS f_h, round(coalesce(e / nullif(e1, 0), 0), 6) AS f_e FROM f JOIN t USING (galaxy_id)",
)
def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features per star, scaled by the largest of their galaxy; maxima are grouped, not windowed."""
    rows = stars(spark, sf_dir).select(
        "pid",
        "galaxy_id",
        P.circularity_proxy().alias("eps"),
        F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("r"),
        F.abs("z").alias("h"),
        (0.5 * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("e"),
    )
    tops = rows.groupBy("galaxy_id").agg(*(F.max(c).alias(f"{c}1") for c in "rhe"))
    scaled = [F.round(F.coalesce(F.try_divide(F.col(c), F.nullif(f"{c}1", F.lit(0.0))), F.lit(0.0)), 6).alias(f"f_{c}") for c in "rhe"]
    return rows.join(tops, "galaxy_id").select("pid", "galaxy_id", F.round("eps", 6).alias("f_eps"), *scaled)


@query("mixture_fit")
def mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-component mixture of circularity per snapshot after eight rounds (compared with NumPy in the tests)."""
    rows = stars(spark, sf_dir).select(F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"), P.circularity_proxy().alias("x"))
    fitted = M.fit_mixture(rows, ["snap"], "x")
    each = F.posexplode(F.arrays_zip("weight", "mean", "variance")).alias("k", "c")
    return fitted.select("snap", F.round("loglik", 4).alias("loglik"), each).select(
        "snap", "k", *(F.round(F.col(f"c.{c}"), 6).alias(c) for c in ("weight", "mean", "variance")), "loglik"
    )


@query(
    "mixture_moments",
    f"WITH {STARS_SQL}, f AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, {EPS_SQL} AS x FROM s) SELECT snap, 1.0::DOUBLE AS weights, round(avg(x), 6) AS mean, round(avg(x * x), 6) AS square FROM f GROUP BY 1",
)
def mixture_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, mean and mean square of the fitted mixtures: a fit keeps the first two moments of its data."""
    rows = stars(spark, sf_dir).select(F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"), P.circularity_proxy().alias("x"))
    each = M.fit_mixture(rows, ["snap"], "x").select("snap", F.explode(F.arrays_zip("weight", "mean", "variance")).alias("c"))
    w, m, v = F.col("c.weight"), F.col("c.mean"), F.col("c.variance")
    return each.groupBy("snap").agg(F.round(F.sum(w), 6).alias("weights"), F.round(F.sum(w * m), 6).alias("mean"), F.round(F.sum(w * (v + m * m)), 6).alias("square"))


_OPTIONS = [0.1, 0.3, 0.5, 0.7, 0.9]


@query(
    "calibration_sweep",
    f"WITH {STARS_SQL}, f AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, round({EPS_SQL}, 6) AS eps, sqrt(x * x + y * y) < 3 AS inner_part FROM s), "
    "c AS (SELECT snap, o, count(*) FILTER ((eps < o) <> inner_part) AS cost FROM f, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS o) GROUP BY 1, 2) SELECT snap, o AS option, cost FROM c QUALIFY row_number() OVER (PARTITION BY snap ORDER BY cost, o) = 1",
)
def calibration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold on circularity that best tells inner from outer stars, per snapshot."""
    rows = stars(spark, sf_dir).select(
        F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"), F.round(P.circularity_proxy(), 6).alias("eps"), (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) < 3).alias("near")
    )
    cost = {o: ((F.col("eps") < o) != F.col("near")).cast("bigint") for o in _OPTIONS}
    return M.sweep_best(rows, ["snap"], _OPTIONS, cost)


@query("spearman_ordinal", f"WITH {SPECTRA_SQL}, r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY flux, event_id) AS a, row_number() OVER (PARTITION BY kind ORDER BY wave, event_id) AS b FROM e) SELECT kind, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with ties broken by id."""
    rows = spectra(spark, sf_dir).select("kind", "event_id", "flux", "wave")
    first = M.ordinal_rank(rows, ["kind"], ["flux", "event_id"], F.floor("flux"), "a")
    both = M.ordinal_rank(first, ["kind"], ["wave", "event_id"], F.floor(F.col("wave") / 86400), "b")
    return both.groupBy("kind").agg(F.round(T.guarded_corr("a", "b"), 6).alias("rho"))


_BLEND = 0.45


@query(
    "normalized_convolution",
    SHARES_SQL + ", wt AS (SELECT snap, iy, ix, 1.0::DOUBLE AS filled, " + ", ".join(CLASSES) + " FROM h), " + _blur_sql("wt", "snap", ["filled", *CLASSES], SIGMA, "b")
    + ", m AS (SELECT h.snap, h.iy, h.ix, " + ", ".join(f"{1 - _BLEND} * h.{c} + {_BLEND} * b.{c} / b.filled AS {c}" for c in CLASSES) + " FROM h JOIN b USING (snap, iy, ix)) SELECT snap, iy, ix, "
    + ", ".join(f"round({c} / (bulge + disk + halo), 6) AS {c}" for c in CLASSES) + " FROM m",
)
def normalized_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares blended with those of the filled cells around them."""
    soft = M.softened(class_shares(spark, sf_dir), ["snap"], SIGMA, BINS, CLASSES, _BLEND)
    return soft.select("snap", "iy", "ix", *(F.round(c, 6).alias(c) for c in CLASSES))


@query(
    "kinematic_tests",
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, CASE WHEN {EPS_SQL} >= 0.7 THEN 'disk' WHEN abs({EPS_SQL}) < 0.3 THEN 'bulge' ELSE 'rest' END AS class, vz FROM s), "
    "d AS (SELECT galaxy_id, count(*) FILTER (class = 'disk') AS n_disk, count(*) FILTER (class = 'bulge') AS n_bulge, stddev_pop(vz) FILTER (class = 'disk') AS s_disk, stddev_pop(vz) FILTER (class = 'bulge') AS s_bulge FROM f GROUP BY 1) "
    "SELECT galaxy_id, n_disk, n_bulge, CASE WHEN n_disk < 10 OR n_bulge < 10 OR s_disk = 0 THEN 'N/A' WHEN s_bulge / s_disk >= 1.1 THEN 'PASS' ELSE 'FAIL' END AS dispersion_test FROM d",
)
def kinematic_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether bulge stars move faster along the line of sight than disk stars, where there are enough of both."""
    eps = P.circularity_proxy()
    kind = F.when(eps >= 0.7, "disk").when(F.abs(eps) < 0.3, "bulge").otherwise("rest")
    rows = stars(spark, sf_dir).select("galaxy_id", kind.alias("class"), "vz")
    of = lambda c: F.when(F.col("class") == c, F.col("vz"))
    sums = rows.groupBy("galaxy_id").agg(
        *(F.count(of(c)).alias(f"n_{c}") for c in ("disk", "bulge")), *(F.stddev_pop(of(c)).alias(f"s_{c}") for c in ("disk", "bulge"))
    )
    few = (F.col("n_disk") < 10) | (F.col("n_bulge") < 10) | (F.col("s_disk") == 0)
    verdict = F.when(few, "N/A").when(F.try_divide("s_bulge", "s_disk") >= 1.1, "PASS").otherwise("FAIL")
    return sums.select("galaxy_id", "n_disk", "n_bulge", verdict.alias("dispersion_test"))


@query(
    "rescale_to_targets",
    SHARES_SQL + ", tot AS (SELECT snap, sum(w) AS w, " + ", ".join(f"sum(w * {c}) AS s_{c}" for c in CLASSES) + " FROM h GROUP BY 1), "
    "sc AS (SELECT snap, 0.3 * w / greatest(s_bulge, 1e-8) AS k_bulge, 0.5 * w / greatest(s_disk, 1e-8) AS k_disk, 0.2 * w / greatest(s_halo, 1e-8) AS k_halo FROM tot) SELECT snap, iy, ix, "
    + ", ".join(f"round(h.w * {c} * k_{c} / 1e6, 6) AS {c}" for c in CLASSES) + " FROM h JOIN sc USING (snap)",
)
def rescale_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class masses of the cells scaled so that each class has its target share of the snapshot."""
    cells = class_shares(spark, sf_dir)
    targets = dict(zip(CLASSES, (0.3, 0.5, 0.2), strict=True))
    sums = cells.groupBy("snap").agg(F.sum("w").alias("_w"), *(F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in CLASSES))
    joined = cells.join(sums, "snap")
    scaled = {c: F.col("w") * F.col(c) * targets[c] * F.col("_w") / F.greatest(F.col(f"_{c}"), F.lit(1e-8)) for c in CLASSES}
    return joined.select("snap", "iy", "ix", *(F.round(v / 1e6, 6).alias(c) for c, v in scaled.items()))


@query(
    "foreground_sum",
    f"WITH {STARS_SQL}, g AS (SELECT galaxy_id, x, y, z, mass FROM p WHERE component = 'gas') "
    "SELECT s.galaxy_id, s.pid, count(*) AS n, round(sum(g.mass), 2) AS column_mass FROM s JOIN g ON s.galaxy_id = g.galaxy_id AND abs(s.x - g.x) <= 0.25 AND abs(s.y - g.y) <= 0.25 AND g.z > s.z "
    "AND sqrt(pow(s.x - g.x, 2) + pow(s.y - g.y, 2)) <= 0.25 GROUP BY s.galaxy_id, s.pid",
)
def foreground_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gas in front of each star within a radius on the sky: a range join keyed by galaxy and cell.

    The cell is part of the key, so a galaxy with very many particles is spread over its cells.
    """
    from starloom.plans.views import particles

    rows = particles(spark, sf_dir)
    star = rows.filter("component = 'star'").select("galaxy_id", "pid", "x", "y", F.col("z").alias("sz"))
    gas = rows.filter("component = 'gas'").select(F.col("galaxy_id").alias("g"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"), F.col("mass").alias("gm"))
    near = T.range_join(star, gas, "x", "y", "gx", "gy", 0.25, [("galaxy_id", "g")]).filter("gz > sz")
    return near.groupBy("galaxy_id", "pid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gm"), 2).alias("column_mass"))
