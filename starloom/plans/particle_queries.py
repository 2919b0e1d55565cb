"""Queries over particles: maps, profiles, features, class scores and statistics per galaxy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.operators import grids as G
from starloom.operators import particles as P
from starloom.operators import running as R
from starloom.plans.registry import Registry
from starloom.plans.views import PARTICLES_SQL, STARS_SQL, particles, stars

registry = Registry()
query = registry.query
RADIUS, BINS = 8.0, 16


def _bin_sql(c: str, low: float, high: float, n: int) -> str:
    return f"CASE WHEN {c} >= {low} AND {c} < {high} THEN floor(({c} - ({low})) / {(high - low) / n})::INTEGER WHEN {c} = {high} THEN {n - 1} END"


IX, IY = _bin_sql("x", -RADIUS, RADIUS, BINS), _bin_sql("y", -RADIUS, RADIUS, BINS)
CELLS_SQL = f"c AS (SELECT galaxy_id, {IY} AS iy, {IX} AS ix, mass, vz, component FROM p)"


@query(
    "surface_density_map",
    f"WITH {PARTICLES_SQL}, {CELLS_SQL} SELECT component, iy, ix, round(log10(sum(mass) / 1.0), 6) AS log_density FROM c "
    "WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(mass) > 0",
)
def surface_density_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log surface density of the stacked galaxies per component."""
    grid = G.surface_density(particles(spark, sf_dir), ["component"], "x", "y", "mass", RADIUS, BINS)
    return grid.select("component", "iy", "ix", F.round(F.log10("density"), 6).alias("log_density"))


@query(
    "weighted_mean_map",
    f"WITH {PARTICLES_SQL}, {CELLS_SQL} SELECT component, iy, ix, round(sum(mass * vz) / sum(mass), 6) AS mean_vz FROM c "
    "WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(mass) > 0",
)
def weighted_mean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.mean_map(particles(spark, sf_dir), ["component"], "x", "y", "vz", "mass", RADIUS, BINS)
    return grid.select("component", "iy", "ix", F.round("mean", 6).alias("mean_vz"))


RING = _bin_sql("sqrt(x * x + y * y)", 0.0, RADIUS, BINS)


@query(
    "radial_density_profile",
    f"WITH {STARS_SQL} SELECT galaxy_id, ring, round(sum(mass) / (pi() * 0.25 * (2 * ring + 1)), 4) AS density "
    f"FROM (SELECT galaxy_id, {RING} AS ring, mass FROM s) WHERE ring IS NOT NULL GROUP BY 1, 2",
)
def radial_density_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = G.radial_profile(stars(spark, sf_dir), ["galaxy_id"], "x", "y", "mass", RADIUS, BINS)
    return profile.select("galaxy_id", "ring", F.round("profile", 4).alias("density"))


@query(
    "radial_mean_profile",
    f"WITH {STARS_SQL} SELECT galaxy_id, ring, round(sum(mass * vz) / sum(mass), 6) AS mean_vz "
    f"FROM (SELECT galaxy_id, {RING} AS ring, mass, vz FROM s) WHERE ring IS NOT NULL GROUP BY 1, 2 HAVING sum(mass) > 0",
)
def radial_mean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = G.radial_profile(stars(spark, sf_dir), ["galaxy_id"], "x", "y", "mass", RADIUS, BINS, "vz")
    return profile.filter("profile is not null").select("galaxy_id", "ring", F.round("profile", 6).alias("mean_vz"))


@query(
    "display_range",
    f"WITH {PARTICLES_SQL} SELECT component, round(quantile_cont(mass, 0.02), 6) AS low, "
    "round(CASE WHEN quantile_cont(mass, 0.98) > quantile_cont(mass, 0.02) THEN quantile_cont(mass, 0.98) ELSE quantile_cont(mass, 0.02) + 1 END, 6) AS high FROM p GROUP BY 1",
)
def display_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2nd and 98th percentile of mass, widened by one where they coincide."""
    ends = R.linear_quantiles(particles(spark, sf_dir), ["component"], "mass", [0.02, 0.98], F.floor(F.col("mass") / 1000))
    low, top = F.col("q")[0], F.col("q")[1]
    return ends.select("component", F.round(low, 6).alias("low"), F.round(F.when(top > low, top).otherwise(low + 1), 6).alias("high"))


@query(
    "point_intensity",
    f"WITH {PARTICLES_SQL}, t AS (SELECT component, quantile_cont(mass, 0.95) AS top FROM p GROUP BY 1) "
    "SELECT pid, galaxy_id, component, round(least(1.0, greatest(0.0, ln(1 + mass / top) / ln(2.0))), 6) AS intensity FROM p JOIN t USING (component)",
)
def point_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = particles(spark, sf_dir)
    found = R.linear_quantiles(rows, ["component"], "mass", [0.95], F.floor(F.col("mass") / 1000))
    top = found.select("component", F.col("q")[0].alias("top"))
    value = F.log1p(F.col("mass") / F.col("top")) / math.log(2.0)
    joined = rows.join(F.broadcast(top), "component")  # one row per component
    return joined.select("pid", "galaxy_id", "component", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6).alias("intensity"))


@query(
    "unit_conversion",
    f"WITH {PARTICLES_SQL}, u AS (SELECT *, 0.5 + 0.005 * regexp_extract(galaxy_id, '-(\\d+)-', 1)::INTEGER AS a FROM p) "
    "SELECT pid, galaxy_id, round(x * a / 0.6774, 6) AS x_kpc, round(mass / 1e5 * 1e10 / 0.6774 / 1e6, 4) AS mass_msun_e6, round(vx * sqrt(a), 6) AS vx_kms, round(z / a, 6) AS potential FROM u",
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comoving to physical units; the scale factor is a rule on the snapshot number."""
    scale = 0.5 + 0.005 * F.regexp_extract("galaxy_id", r"-(\d+)-", 1).cast("int")
    rows = particles(spark, sf_dir).withColumn("a", scale)
    return rows.select(
        "pid",
        "galaxy_id",
        F.round(S.physical_length(F.col("x"), F.col("a")), 6).alias("x_kpc"),
        F.round(S.physical_mass(F.col("mass") / 1e5) / 1e6, 4).alias("mass_msun_e6"),
        F.round(S.peculiar_velocity(F.col("vx"), F.col("a")), 6).alias("vx_kms"),
        F.round(S.physical_potential(F.col("z"), F.col("a")), 6).alias("potential"),
    )


_TIME = f"{2 / (3 * math.sqrt(1 - S.OMEGA_M)) * S.HUBBLE_TIME_GYR!r} * asinh({math.sqrt((1 - S.OMEGA_M) / S.OMEGA_M)!r} * pow({{}}, 1.5))"


@query(
    "stellar_ages",
    f"WITH {STARS_SQL}, u AS (SELECT pid, galaxy_id, 0.05 + (pid % 800) / 1000.0 AS a FROM s) SELECT pid, galaxy_id, "
    f"round(greatest(0.001, 13.8 * (1 - greatest(0.0001, least(a, 1.0)))), 6) AS linear_gyr, round(greatest(0.001, {_TIME.format('0.95')} - {_TIME.format('a')}), 6) AS age_gyr FROM u",
)
def stellar_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two age conventions of the stars; the formation scale factor is a rule on pid."""
    rows = stars(spark, sf_dir).select("pid", "galaxy_id", (0.05 + (F.col("pid") % 800) / 1000.0).alias("a"))
    return rows.select(
        "pid", "galaxy_id", F.round(S.linear_age_gyr(F.col("a")), 6).alias("linear_gyr"), F.round(S.stellar_age_gyr(F.col("a"), F.lit(0.95)), 6).alias("age_gyr")
    )


_L = "sum(mass * (y * vz - z * vy)) AS lx, sum(mass * (z * vx - x * vz)) AS ly, sum(mass * (x * vy - y * vx)) AS lz"


@query("angular_momentum", f"WITH {STARS_SQL} SELECT galaxy_id, round(lx / m, 5) AS jx, round(ly / m, 5) AS jy, round(lz / m, 5) AS jz FROM (SELECT galaxy_id, {_L}, sum(mass) AS m FROM s GROUP BY 1) WHERE m > 0")
def angular_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = P.angular_momentum(stars(spark, sf_dir), ["galaxy_id"]).filter("mass > 0")
    return total.select("galaxy_id", *(F.round(F.col(f"l{c}") / F.col("mass"), 5).alias(f"j{c}") for c in "xyz"))


@query(
    "face_on_rotation",
    f"WITH {STARS_SQL}, l AS (SELECT galaxy_id, {_L} FROM s GROUP BY 1), n AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS q FROM l), "
    "u AS (SELECT galaxy_id, CASE WHEN q > 0 THEN lx / q ELSE 0 END AS a, CASE WHEN q > 0 THEN ly / q ELSE 0 END AS b, CASE WHEN q > 0 THEN lz / q ELSE 1 END AS c FROM n) "
    "SELECT pid, galaxy_id, round((1 - a * a / (1 + c)) * x - a * b / (1 + c) * y - a * z, 4) AS x, round(-a * b / (1 + c) * x + (1 - b * b / (1 + c)) * y - b * z, 4) AS y, "
    "round(a * x + b * y + c * z, 4) AS z FROM s JOIN u USING (galaxy_id)",
)
def face_on_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stars(spark, sf_dir)
    turned = P.rotate_face_on(rows, P.angular_momentum(rows, ["galaxy_id"]), ["galaxy_id"])
    return turned.select("pid", "galaxy_id", *(F.round(c, 4).alias(c) for c in "xyz"))


@query(
    "weighted_covariance",
    f"WITH {STARS_SQL} SELECT galaxy_id, "
    + ", ".join(
        f"round(sum(mass * {a} * {b}) / sum(mass) - sum(mass * {a}) / sum(mass) * (sum(mass * {b}) / sum(mass)), 5) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")
    )
    + " FROM s GROUP BY 1 HAVING sum(mass) > 0",
)
def weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = P.weighted_covariance(stars(spark, sf_dir), ["galaxy_id"]).filter("cxx is not null")
    return result.select("galaxy_id", *(F.round(f"c{p}", 5).alias(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))


EPS_SQL = "coalesce(greatest(-1.0, least(1.0, (x * vy - y * vx) / nullif(sqrt(x * x + y * y) * sqrt(vx * vx + vy * vy + vz * vz), 0))), 0.0)"


@query("circularity", f"WITH {STARS_SQL} SELECT pid, galaxy_id, round({EPS_SQL}, 6) AS eps FROM s")
def circularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("pid", "galaxy_id", F.round(P.circularity_proxy(), 6).alias("eps"))


CLASS_SQL = "CASE WHEN eps >= 0.7 THEN 'disk' WHEN abs(eps) < 0.3 THEN 'bulge' ELSE 'halo' END"


@query(
    "class_fractions",
    f"WITH {STARS_SQL}, k AS (SELECT galaxy_id, mass, {CLASS_SQL} AS class FROM (SELECT *, round({EPS_SQL}, 6) AS eps FROM s)) "
    "SELECT galaxy_id, class, round(sum(mass) / max(t), 6) AS fraction FROM (SELECT *, sum(mass) OVER (PARTITION BY galaxy_id) AS t FROM k) GROUP BY 1, 2",
)
def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass share of each class in its galaxy; grouped sums only, no window over particles."""
    eps = F.round(P.circularity_proxy(), 6)
    sums = stars(spark, sf_dir).groupBy("galaxy_id", P.class_of_circularity(eps).alias("class")).agg(F.sum("mass").alias("m"))
    totals = sums.groupBy("galaxy_id").agg(F.sum("m").alias("t"))
    return sums.join(totals, "galaxy_id").select("galaxy_id", "class", F.round(F.col("m") / F.col("t"), 6).alias("fraction"))


@query(
    "score_classifier",
    f"WITH {STARS_SQL}, f AS (SELECT pid, galaxy_id, sqrt(x * x + y * y) / 3.0 AS r, abs(z) / 3.0 AS h, {EPS_SQL} AS eps FROM s), "
    "d AS (SELECT *, 1 / (1 + exp(-5 * (eps - 0.25))) * exp(-h / 0.75) AS disk0 FROM f), "
    "t AS (SELECT pid, galaxy_id, greatest(disk0, 1e-8) AS disk, greatest(exp(-r / 0.6) * exp(-abs(eps) / 0.7), 1e-8) AS bulge, "
    "greatest((1 - disk0) * (1 - exp(-r / 0.9) + 0.35 * least(greatest(h, 0.0), 3.0)), 1e-8) AS halo FROM d) "
    "SELECT pid, galaxy_id, round(bulge / (bulge + disk + halo), 6) AS p_bulge, round(disk / (bulge + disk + halo), 6) AS p_disk, round(halo / (bulge + disk + halo), 6) AS p_halo FROM t",
)
def score_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.score_classes(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) / 3.0, F.abs("z") / 3.0, P.circularity_proxy())
    return stars(spark, sf_dir).select("pid", "galaxy_id", *(F.round(v, 6).alias(f"p_{k}") for k, v in scores.items()))


@query(
    "weighted_quantile",
    f"WITH {STARS_SQL}, v AS (SELECT galaxy_id, round(sqrt(x * x + y * y), 6) AS r, sum(mass) AS m FROM s WHERE mass > 0 GROUP BY 1, 2), "
    "w AS (SELECT *, sum(m) OVER (PARTITION BY galaxy_id ORDER BY r) AS run, sum(m) OVER (PARTITION BY galaxy_id) AS t FROM v) "
    "SELECT galaxy_id, min(r) AS r_half FROM w WHERE run >= 0.5 * t GROUP BY 1",
)
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-mass radius: step quantile over radius bins first, inside one bin second."""
    rows = stars(spark, sf_dir).select("galaxy_id", F.round(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), 6).alias("r"), "mass")
    return R.weighted_quantile(rows, ["galaxy_id"], "r", "mass", 0.5, F.floor(F.col("r") * 4)).withColumnRenamed("quantile", "r_half")


@query(
    "azimuthal_moment",
    f"WITH {STARS_SQL}, a AS (SELECT galaxy_id, mass, atan2(y, x) AS phi FROM s WHERE sqrt(x * x + y * y) < 4), "
    "b AS (SELECT galaxy_id, count(*) AS n, sum(mass) AS m, sum(mass * cos(2 * phi)) AS c, sum(mass * sin(2 * phi)) AS d FROM a GROUP BY 1) "
    "SELECT galaxy_id, n, round(sqrt(c * c + d * d) / m, 6) AS a2, round(atan2(d, c) / 2, 6) AS angle, n >= 20 AND sqrt(c * c + d * d) / m >= 0.3 AS is_barred FROM b WHERE m > 0",
)
def azimuthal_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and angle of the m = 2 moment inside a radius, and whether it makes a bar."""
    moment = P.circular_moment(stars(spark, sf_dir).filter(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) < 4), ["galaxy_id"]).filter("strength is not null")
    is_barred = (F.col("n") >= 20) & (F.col("strength") >= 0.3)
    return moment.select("galaxy_id", "n", F.round("strength", 6).alias("a2"), F.round("angle", 6).alias("angle"), is_barred.alias("is_barred"))


@query(
    "bar_transfer",
    f"WITH {STARS_SQL}, f AS (SELECT *, {EPS_SQL} AS eps, sqrt(x * x + y * y) AS r, abs(atan2(y, x)) AS dphi FROM s) SELECT pid, galaxy_id, "
    "r < 4 AND eps > 0.3 AND eps < 0.6 AND abs(z) < 0.5 AND (dphi < 0.785 OR pi() - dphi < 0.785) AS in_bar FROM f",
)
def bar_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars that a bar along x takes over: inside its radius, at middling circularity, thin, close to the axis."""
    eps = P.circularity_proxy()
    off = F.abs(F.atan2("y", "x"))
    near = (off < 0.785) | (math.pi - off < 0.785)
    inside = (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) < 4) & (eps > 0.3) & (eps < 0.6) & (F.abs("z") < 0.5) & near
    return stars(spark, sf_dir).select("pid", "galaxy_id", inside.alias("in_bar"))


_RAW = "SELECT galaxy_id, mass, greatest(exp(-0.5 * pow(sqrt(x * x + y * y) / 1.5, 2)), 1e-8) AS b, 1.0 AS d, greatest(1 / (1 + exp(-(sqrt(x * x + y * y) - 4) / 0.8)), 1e-8) AS o FROM s"


def _ipf_sql(rounds: int) -> str:
    steps, scale = [f"raw AS ({_RAW})", "k0 AS (SELECT DISTINCT galaxy_id, 1.0::DOUBLE AS sb, 1.0::DOUBLE AS sd, 1.0::DOUBLE AS so FROM raw)"], "k0"
    for n in range(1, rounds + 1):
        t = "(b * sb + d * sd + o * so)"
        steps.append(
            f"k{n} AS (SELECT galaxy_id, sb * 0.3 / greatest(sum(mass * b * sb / {t}) / sum(mass), 1e-8) AS sb, sd * 0.5 / greatest(sum(mass * d * sd / {t}) / sum(mass), 1e-8) AS sd, "
            f"so * 0.2 / greatest(sum(mass * o * so / {t}) / sum(mass), 1e-8) AS so FROM raw JOIN {scale} USING (galaxy_id) GROUP BY galaxy_id, sb, sd, so)"
        )
        scale = f"k{n}"
    return f"WITH {STARS_SQL}, " + ", ".join(steps) + f" SELECT galaxy_id, round(sb, 4) AS s_b, round(sd, 4) AS s_d, round(so, 4) AS s_o FROM {scale}"


@query("ipf_scaling", _ipf_sql(3))
def ipf_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of proportional fitting of radial class scores to target shares."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    rows = stars(spark, sf_dir).select("galaxy_id", "mass", F.exp(-0.5 * (r / 1.5) ** 2).alias("b"), F.lit(1.0).alias("d"), S.sigmoid((r - 4) / 0.8).alias("o"))
    fitted = P.proportional_fit(rows, ["galaxy_id"], ["b", "d", "o"], [0.3, 0.5, 0.2], "mass", 3)
    return fitted.select("galaxy_id", *(F.round(f"s_{c}", 4).alias(f"s_{c}") for c in "bdo"))


@query(
    "energy_envelope",
    f"WITH {STARS_SQL}, j AS (SELECT galaxy_id, 0.5 * (vx * vx + vy * vy + vz * vz) AS e, abs(x * vy - y * vx) AS jz FROM s), "
    "b AS (SELECT galaxy_id, least(greatest(floor(e / 2000.0), 0), 31)::INTEGER AS bin, max(jz) AS top FROM j GROUP BY 1, 2) "
    "SELECT galaxy_id, bin, round(max(top) OVER (PARTITION BY galaxy_id ORDER BY bin), 5) AS envelope FROM b",
)
def energy_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest angular momentum up to each energy bin."""
    rows = stars(spark, sf_dir).select(
        "galaxy_id", (0.5 * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("e"), (F.col("x") * F.col("vy") - F.col("y") * F.col("vx")).alias("jz")
    )
    return P.energy_envelope(rows, ["galaxy_id"], "e", "jz", 0.0, 2000.0, 32).select("galaxy_id", "bin", F.round("envelope", 5).alias("envelope"))




@query(
    "spherical_potential",
    f"WITH {STARS_SQL}, r AS (SELECT galaxy_id, pid, mass, sqrt(x * x + y * y + z * z) AS r FROM s), "
    "w AS (SELECT galaxy_id, pid, r, sum(mass) OVER a AS inside, sum(mass / greatest(r, 1e-6)) OVER (PARTITION BY galaxy_id) - sum(mass / greatest(r, 1e-6)) OVER a AS outside FROM r "
    "WINDOW a AS (PARTITION BY galaxy_id ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT galaxy_id, pid, round(max(-4.30091e-6 * (inside / greatest(r, 1e-3) + outside)), 5) AS phi FROM w GROUP BY ALL",
)
def spherical_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential of each star in its galaxy's spherical mass; stars at the same radius see the same potential."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    rows = stars(spark, sf_dir)
    shells = rows.withColumn("r", r).groupBy("galaxy_id", "r").agg(F.sum("mass").alias("mass"))
    inverse = F.col("mass") / F.greatest(F.col("r"), F.lit(1e-6))
    summed = R.running_sums(shells, ["galaxy_id"], ["r"], {"inside": F.col("mass"), "near": inverse}, F.floor("r"))
    outer = shells.groupBy("galaxy_id").agg(F.sum(inverse).alias("outer"))
    phi = -P.GRAVITY * (F.col("inside") / F.greatest(F.col("r"), F.lit(1e-3)) + F.col("outer") - F.col("near"))
    shell_phi = summed.join(outer, "galaxy_id").select("galaxy_id", "r", F.round(phi, 5).alias("phi"))
    return rows.withColumn("r", r).join(shell_phi, ["galaxy_id", "r"]).select("galaxy_id", "pid", "phi").distinct()


@query(
    "average_ranks",
    f"WITH {STARS_SQL} SELECT galaxy_id, pid, mass, round(rank() OVER w + (count(*) OVER (PARTITION BY galaxy_id, mass) - 1) / 2.0, 1) AS avg_rank FROM s WINDOW w AS (PARTITION BY galaxy_id ORDER BY mass)",
)
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank of each star by mass in its galaxy, without sorting a galaxy in one task."""
    rows = stars(spark, sf_dir).select("galaxy_id", "pid", "mass")
    return R.ranks(rows, ["galaxy_id"], "mass", F.floor(F.col("mass") / 5000)).select("galaxy_id", "pid", "mass", F.round("avg_rank", 1).alias("avg_rank"))


@query(
    "sky_projection",
    f"WITH {PARTICLES_SQL} SELECT pid, galaxy_id, round((x - y) / sqrt(2.0), 6) AS u, round((-x - y + 2 * z) / sqrt(6.0), 6) AS v, round((x + y + z) / sqrt(3.0), 6) AS depth FROM p",
)
def sky_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on the sky seen along (1, 1, 1): depth, and two axes across it."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return particles(spark, sf_dir).select(
        "pid",
        "galaxy_id",
        F.round((x - y) / math.sqrt(2.0), 6).alias("u"),
        F.round((-x - y + 2 * z) / math.sqrt(6.0), 6).alias("v"),
        F.round((x + y + z) / math.sqrt(3.0), 6).alias("depth"),
    )


@query(
    "hash_sample",
    f"WITH {PARTICLES_SQL}, h AS (SELECT DISTINCT galaxy_id, pid, (pid * 1103515245 + 12345) % 2147483648 AS turn FROM p) "
    "SELECT galaxy_id, pid FROM h QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY turn, pid) <= 20",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 particles per galaxy by a fixed hash order: the best 20 of each hash range first, the best of those second."""
    from pyspark.sql import Window

    rows = particles(spark, sf_dir).select("galaxy_id", "pid").distinct().withColumn("turn", (F.col("pid") * 1103515245 + 12345) % 2147483648)
    first = Window.partitionBy("galaxy_id", "part").orderBy("turn", "pid")
    few = rows.withColumn("part", F.col("turn") % 64).withColumn("n", F.row_number().over(first)).filter("n <= 20")
    last = Window.partitionBy("galaxy_id").orderBy("turn", "pid")
    return few.withColumn("n", F.row_number().over(last)).filter("n <= 20").select("galaxy_id", "pid")


@query(
    "particle_summary",
    f"WITH {PARTICLES_SQL} SELECT galaxy_id, count(*) FILTER (component = 'star') AS n_star, count(*) FILTER (component = 'gas') AS n_gas, count(*) FILTER (component = 'dm') AS n_dm, "
    "coalesce(sum(mass) FILTER (component = 'star'), 0) AS star_mass, round(max(sqrt(x * x + y * y + z * z)), 6) AS r_max FROM p GROUP BY 1",
)
def particle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda c: F.col("component") == c
    return particles(spark, sf_dir).groupBy("galaxy_id").agg(
        *(F.count_if(is_(c)).alias(f"n_{c}") for c in ("star", "gas", "dm")),
        F.coalesce(F.sum(F.when(is_("star"), F.col("mass"))), F.lit(0.0)).alias("star_mass"),
        F.round(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)), 6).alias("r_max"),
    )
