"""Queries of labels, look-ups and small rules over catalogues, particles and grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.functions.galaxies import galaxy_id
from starloom.operators import grids as G
from starloom.operators import labels as L
from starloom.operators import particles as P
from starloom.operators import validation as V
from starloom.plans.catalog_queries import UNIT, UNITS_SQL, units
from starloom.plans.grid_queries import BINS, CLASSES, GRID_SQL, KEY, SET_SQL, SHARES_SQL, STACK_SQL, STEP, class_shares, signal_cells, stacked, star_grid
from starloom.plans.model_queries import component_means
from starloom.plans.particle_queries import EPS_SQL
from starloom.plans.registry import Registry
from starloom.plans.stats_queries import _all_points
from starloom.plans.views import PARTICLES_SQL, SPECTRA_SQL, STARS_SQL, particles, spectra, stars
from starloom.sources.tables import table

registry = Registry()
query = registry.query
_MID = (BINS - 1) / 2

# --- scalars of catalogue rows


def _views_sql() -> str:
    axes = " ".join(f"WHEN repeat_count <= 3 AND view = {k} THEN [{', '.join('1.0' if j == k else '0.0' for j in range(3))}]" for k in range(3))
    # the ring of five: x = 1 / sqrt 5, angles of 72 degrees from the lowest z, in falling order of y and z
    ring = sorted(((2 / math.sqrt(5) * math.sin(math.radians(72 * k)), -2 / math.sqrt(5) * math.cos(math.radians(72 * k))) for k in range(5)), key=lambda v: (-round(v[0], 9), -round(v[1], 9)))
    others = " ".join(f"WHEN coalesce(repeat_count, 9) > 3 AND view = {k} THEN [{1 / math.sqrt(5)!r}, {y!r}, {z!r}]" for k, (y, z) in enumerate(ring, 1))
    return f"CASE {axes} WHEN coalesce(repeat_count, 9) > 3 AND view = 0 THEN [1.0, 0.0, 0.0] {others} END::DOUBLE[]"


@query("view_vectors", f"WITH v AS (SELECT manifest_id, {_views_sql()} AS d FROM manifest) SELECT manifest_id, round(d[1], 6) AS dx, round(d[2], 6) AS dy, round(d[3], 6) AS dz FROM v")
def view_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction from which each delivered unit is seen."""
    found = table(spark, sf_dir, "manifest").select("manifest_id", S.view_vector(F.col("view"), F.col("repeat_count")).alias("d"))
    return found.select("manifest_id", *(F.round(F.get("d", F.lit(k)), 6).alias(n) for k, n in enumerate(("dx", "dy", "dz"))))


@query(
    "parsed_options",
    "SELECT listing_id, coalesce(lower(trim(CASE WHEN sample_manga = 1 THEN ' Yes' WHEN sample_manga = 2 THEN 'Y ' ELSE views END)) IN ('1', 'true', 'yes', 'y'), false) AS chosen, "
    "CASE WHEN regexp_full_match(trim(views), '[+-]?\\d+') THEN greatest(1, least(trim(views)::HUGEINT, 4)) ELSE 2 END::INTEGER AS view_no, "
    "CASE WHEN n_star_part > 0 THEN least(n_star_part, 50000) ELSE 50000 END::BIGINT AS n_points, regexp_extract(galaxy_id, '(?i)tng50[-_]0*(\\d+)', 1) AS snap FROM wave2_manifest",
)
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, bounded numbers and limits from texts."""
    said = F.when(F.col("sample_manga") == 1, " Yes").when(F.col("sample_manga") == 2, "Y ").otherwise(F.col("views"))
    snap = F.regexp_extract("galaxy_id", r"(?i)tng50[-_]0*(\d+)", 1)
    return table(spark, sf_dir, "wave2_manifest").select(
        "listing_id", S.truth(said).alias("chosen"), S.clamped_int(F.trim("views"), 2, 1, 4).alias("view_no"), S.point_limit(F.col("n_star_part"), 50000).alias("n_points"), snap.alias("snap")
    )


@query(
    "template_tokens",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 1000.0 ELSE p_size / 10.0 END::DOUBLE AS age, ('0.' || lpad((p_partkey % 50)::VARCHAR, 3, '0'))::DOUBLE AS metallicity, "
    "lpad(round_even(p_size / 200.0::DOUBLE * 100, 0)::INTEGER::VARCHAR, 3, '0') AS key FROM part",
)
def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and metallicity out of names such as ssp_500Myr_z0.020, and threshold keys."""
    size = F.col("p_size")
    age = F.when(F.col("p_partkey") % 2 == 0, F.concat(size.cast("string"), F.lit("Myr"))).otherwise(F.concat((size / 10).cast("string"), F.lit("Gyr")))
    digits = F.lpad((F.col("p_partkey") % 50).cast("string"), 3, "0")
    dotted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0."), digits)).otherwise(digits)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ssp_"), age, F.lit("_z"), dotted).alias("name"), size)
    return rows.select("p_partkey", S.age_from_token(F.col("name")).alias("age"), S.metallicity_from_token(F.col("name")).alias("metallicity"), S.threshold_key(F.col("p_size") / 200.0).alias("key"))


@query("json_vectors", f"WITH {PARTICLES_SQL} SELECT pid, round(x, 6) AS x, CASE WHEN pid % 4 < 3 THEN round(y, 6) END AS y, CASE WHEN pid % 4 < 3 THEN round(z, 6) END AS z FROM p WHERE pid % 4 < 3 UNION ALL SELECT pid, NULL, NULL, NULL FROM p WHERE pid % 4 = 3")
def json_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions read back from JSON records that name them in three ways, or lack one number."""
    rows, vector = particles(spark, sf_dir), F.array("x", "y", "z")
    forms = [F.struct(*(F.col(a).alias(f"pos_{a}") for a in "xyz")), F.struct(vector.alias("pos")), F.struct(vector.alias("SubhaloPos")), F.struct(F.col("x").alias("pos_x"))]
    text = F.when(F.col("pid") % 4 == 0, F.to_json(forms[0])).when(F.col("pid") % 4 == 1, F.to_json(forms[1])).when(F.col("pid") % 4 == 2, F.to_json(forms[2])).otherwise(F.to_json(forms[3]))
    found = rows.select("pid", S.json_vector(text, "pos", "SubhaloPos").alias("v"))
    return found.select("pid", *(F.round(F.get("v", F.lit(k)), 6).alias(a) for k, a in enumerate("xyz")))


@query(
    "unique_radius",
    f"WITH {UNITS_SQL}, k AS (SELECT DISTINCT snapshot, subhalo_id FROM u), c AS (SELECT snapshot, subhalo_id, count(*) AS n_rows, min(re_kpc) AS a, max(re_kpc) AS b FROM wave2_manifest GROUP BY 1, 2), "
    "j AS (SELECT snapshot, subhalo_id, coalesce(n_rows, 0) AS n_rows, CASE WHEN n_rows IS NULL THEN 'none' WHEN a < b THEN 'several' WHEN a IS NULL OR isnan(b) OR a <= 0 THEN 'invalid' ELSE 'ok' END AS status, a FROM k LEFT JOIN c USING (snapshot, subhalo_id)) "
    "SELECT snapshot, subhalo_id, n_rows, status, CASE WHEN status = 'ok' THEN a END AS re_kpc FROM j",
)
def unique_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one radius that the listings give for each delivered galaxy, or why there is none."""
    return L.unique_lookup(units(spark, sf_dir), table(spark, sf_dir, "wave2_manifest"), ["snapshot", "subhalo_id"], "re_kpc")


_PARTS_SQL = ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 0 THEN 0.0 ELSE {c} END AS {c[0]}" for c in ("bulge_frac", "disk_frac", "halo_frac"))


@query(
    "class_priors",
    "WITH c AS (SELECT * FROM wave2_strata QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id ORDER BY classified_at DESC NULLS LAST, strata_id DESC) = 1), "
    f"q AS (SELECT snapshot, subhalo_id, {_PARTS_SQL} FROM c), s AS (SELECT snapshot, subhalo_id, CASE WHEN b + d + h > 0 THEN b / (b + d + h) ELSE 1.0 / 3 END AS b, CASE WHEN b + d + h > 0 THEN d / (b + d + h) ELSE 1.0 / 3 END AS d, "
    "CASE WHEN b + d + h > 0 THEN h / (b + d + h) ELSE 1.0 / 3 END AS h, CASE WHEN b + d + h > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM q) "
    "SELECT snapshot, subhalo_id, round(b, 6) AS bulge, round(d, 6) AS disk, round(h, 6) AS halo, confidence, CASE WHEN round(h, 6) > 0.5 THEN 'halo' WHEN round(d, 6) > 0.5 THEN 'disk' WHEN round(b, 6) > 0.5 THEN 'bulge' ELSE 'mixed' END AS family FROM s",
)
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family fractions of each galaxy's latest classification, made to add up to 1, and the family above one half."""
    fracs = ["bulge_frac", "disk_frac", "halo_frac"]
    rows = table(spark, sf_dir, "wave2_strata").groupBy("snapshot", "subhalo_id").agg(
        *(F.max_by(f, F.struct("classified_at", "strata_id")).alias(f) for f in fracs)
    )
    shares = rows.select("snapshot", "subhalo_id", *L.priors([F.col(f) for f in fracs], CLASSES, 0.5))
    shares = shares.withColumns({c: F.round(c, 6) for c in CLASSES})
    family = F.when(F.col("halo") > 0.5, "halo").when(F.col("disk") > 0.5, "disk").when(F.col("bulge") > 0.5, "bulge").otherwise("mixed")
    return shares.withColumn("family", family)


_SCORE = "3.0 * p + 2.0 * least(b, 1) + 2.0 * (least(b, 0.35) + least(d, 0.45)) + 0.4 * least(h * 3, 2.0) + 0.5 * least(log10(greatest(n, 1)) / 3.0, 1.0)"


@query(
    "candidate_scores",
    "WITH q AS (SELECT listing_id, (sample_manga = 1)::INTEGER AS p, re_kpc / 20 AS b, rcov_kpc / 40 AS d, re_kpc / 10 AS h, ifu_design AS n FROM wave2_manifest WHERE re_kpc IS NOT NULL AND rcov_kpc IS NOT NULL AND sample_manga IS NOT NULL AND ifu_design IS NOT NULL) "
    f"SELECT listing_id, round({_SCORE}, 6) AS score FROM q",
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each listing from a flag, capped ratios and a size bonus."""
    rows = table(spark, sf_dir, "wave2_manifest").dropna(subset=["re_kpc", "rcov_kpc", "sample_manga", "ifu_design"])
    parts = rows.select(
        "listing_id", (F.col("sample_manga") == 1).cast("int").alias("p"), (F.col("re_kpc") / 20).alias("b"), (F.col("rcov_kpc") / 40).alias("d"), (F.col("re_kpc") / 10).alias("h"), F.col("ifu_design").alias("n")
    )
    cap = lambda c, top: F.least(c, F.lit(top))
    size = cap(F.log10(F.greatest("n", F.lit(1))) / 3.0, 1.0)
    score = 3.0 * F.col("p") + 2.0 * cap(F.col("b"), 1.0) + 2.0 * (cap(F.col("b"), 0.35) + cap(F.col("d"), 0.45)) + 0.4 * cap(F.col("h") * 3, 2.0) + 0.5 * size
    return parts.select("listing_id", F.round(score, 6).alias("score"))


# --- files and units

_TOKEN = "TNG50-\\d+-\\d+(?:-\\d+)?(?:-\\d+)?"
_KIND = "CASE WHEN regexp_matches(lower(path), '\\.fits$') THEN 0 WHEN regexp_matches(lower(path), '\\.gz$') THEN 1 ELSE 2 END"


@query(
    "image_match",
    f"WITH t AS (SELECT path, unnest(list_distinct(regexp_extract_all(path, '{_TOKEN}'))) AS token, {_KIND} AS a, length(split_part(path, '/', -1)) AS b FROM cube_files), "
    "i AS (SELECT token, path FROM t QUALIFY row_number() OVER (PARTITION BY token ORDER BY a, b, path) = 1), "
    f"r AS (SELECT manifest_id, trim(canonical_id) AS c, snapshot, coalesce(subhalo_id, regexp_extract(canonical_id, '{UNIT}', 2)::BIGINT) AS s, view FROM manifest), "
    "k AS (SELECT DISTINCT manifest_id, unnest([c, 'TNG50-' || snapshot || '-' || s, 'TNG50-' || snapshot || '-' || s || '-' || view]) AS token FROM r) "
    "SELECT manifest_id, token, path FROM k JOIN i USING (token) QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY length(token) DESC, token DESC) = 1",
)
def image_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cube that names the longest of a record's ids: unit, galaxy and view, or galaxy."""
    lower = F.lower("path")
    rank = F.when(lower.endswith(".fits"), 0).when(lower.endswith(".gz"), 1).otherwise(2)
    index = L.token_index(table(spark, sf_dir, "cube_files"), "path", _TOKEN, rank)
    number = F.coalesce("subhalo_id", F.nullif(F.regexp_extract("canonical_id", UNIT, 2), F.lit("")).cast("bigint"))
    galaxy = F.concat(F.lit("TNG50-"), F.col("snapshot").cast("string"), F.lit("-"), number.cast("string"))
    tokens = F.array(F.trim("canonical_id"), galaxy, F.concat(galaxy, F.lit("-"), F.col("view").cast("string")))
    return L.match_tokens(table(spark, sf_dir, "manifest"), "manifest_id", tokens, index, "path")


@query("distinct_in_order", "SELECT cube_path AS path, min(manifest_id) AS first_id FROM manifest WHERE cube_path IS NOT NULL GROUP BY 1")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths with the record that names each first: order-preserving deduplication."""
    rows = table(spark, sf_dir, "manifest").filter("cube_path is not null")
    return rows.groupBy(F.col("cube_path").alias("path")).agg(F.min("manifest_id").alias("first_id"))


@query(
    "label_status",
    f"WITH {UNITS_SQL}, w AS (SELECT DISTINCT snapshot, subhalo_id, view FROM u), c AS (SELECT DISTINCT regexp_extract(path, '{UNIT}', 1)::INTEGER AS snapshot, regexp_extract(path, '{UNIT}', 2)::BIGINT AS subhalo_id, "
    f"regexp_extract(path, '{UNIT}', 3)::INTEGER AS view, 1 AS done FROM cube_files WHERE regexp_matches(path, '{UNIT}')) "
    "SELECT snapshot, count(*) AS n_units, count(done) AS n_done, count(*) - count(done) AS n_missing, count(*) = count(done) AS complete FROM w LEFT JOIN c USING (snapshot, subhalo_id, view) GROUP BY 1",
)
def label_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units of each snapshot have their product, and whether all do."""
    key = ["snapshot", "subhalo_id", "view"]
    part = lambda k, kind: F.regexp_extract("path", UNIT, k).cast(kind)
    files = table(spark, sf_dir, "cube_files").filter(F.col("path").rlike(UNIT))
    done = files.select(part(1, "int").alias("snapshot"), part(2, "bigint").alias("subhalo_id"), part(3, "int").alias("view")).distinct().withColumn("done", F.lit(1))
    joined = units(spark, sf_dir).select(*key).distinct().join(done, key, "left")
    n, ready = F.count(F.lit(1)), F.count("done")
    return joined.groupBy("snapshot").agg(n.alias("n_units"), ready.alias("n_done"), (n - ready).alias("n_missing"), (n == ready).alias("complete"))


@query(
    "epoch_views",
    f"WITH {UNITS_SQL}, d AS (SELECT DISTINCT snapshot, subhalo_id, view FROM u) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id ORDER BY md5('7:3:' || snapshot || ':' || subhalo_id || ':' || view)) <= 2",
)
def epoch_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of each galaxy for one epoch of training, the same in every run."""
    return L.drawn_views(units(spark, sf_dir), ["snapshot", "subhalo_id"], "view", 3, 2, 7)


@query(
    "run_table",
    "SELECT snapshot, " + ", ".join(f"round(avg(re_kpc) FILTER (sample_manga = {k}), 6) AS sample_{k}" for k in (1, 2, 3)) + ", count(*) AS n FROM wave2_manifest GROUP BY 1",
)
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by name, one column per variant; a missing variant is null."""
    rows = table(spark, sf_dir, "wave2_manifest")
    wide = rows.groupBy("snapshot").pivot("sample_manga", [1, 2, 3]).agg(F.round(F.avg("re_kpc"), 6))
    counts = rows.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    return wide.join(counts, "snapshot").select("snapshot", *(F.col(str(k)).alias(f"sample_{k}") for k in (1, 2, 3)), "n")


@query(
    "orientation_report",
    "WITH q AS (SELECT snapshot, sample_manga, re_kpc, (coalesce(re_kpc, 0) + coalesce(rcov_kpc, 0)) / nullif((re_kpc IS NOT NULL)::INTEGER + (rcov_kpc IS NOT NULL)::INTEGER, 0) AS c FROM wave2_manifest) "
    "SELECT snapshot, count(*) AS n, round(count(*) FILTER (sample_manga = 1) / count(*), 6) AS accepted, round(median(re_kpc), 6) AS middle, round(avg(c), 6) AS mean_c FROM q GROUP BY 1",
)
def orientation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance, median and mean over the available columns of a row, per run; medians over counts of distinct values."""
    rows = table(spark, sf_dir, "wave2_manifest")
    have = F.array_compact(F.array("re_kpc", "rcov_kpc"))
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, v: a + v), F.size(have))
    sums = rows.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("sample_manga") == 1) / F.count(F.lit(1)), 6).alias("accepted"), F.round(F.avg(mean), 6).alias("mean_c")
    )
    counts = rows.groupBy("snapshot", "re_kpc").agg(F.count(F.lit(1)).alias("_n"))
    middle = counts.groupBy("snapshot").agg(F.round(F.expr("percentile(re_kpc, 0.5, _n)"), 6).alias("middle"))
    return sums.join(middle, "snapshot").select("snapshot", "n", "accepted", "middle", "mean_c")


@query(
    "method_comparison",
    f"WITH {PARTICLES_SQL}, m AS (SELECT component AS method, count(*) AS n, avg(vz) AS v, stddev_pop(vz) AS s FROM p GROUP BY 1), b AS (SELECT * FROM m WHERE method = 'star') "
    "SELECT m.method, m.n, round(m.v - b.v, 6) AS shift, round(m.s / b.s, 6) AS ratio FROM m, b",
)
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's report beside that of the baseline."""
    reports = particles(spark, sf_dir).groupBy(F.col("component").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.avg("vz").alias("v"), F.stddev_pop("vz").alias("s"))
    base = reports.filter("method = 'star'").select(F.col("v").alias("_v"), F.col("s").alias("_s"))
    joined = reports.join(F.broadcast(base), F.lit(True))  # one row
    return joined.select("method", "n", F.round(F.col("v") - F.col("_v"), 6).alias("shift"), F.round(F.col("s") / F.col("_s"), 6).alias("ratio"))


# --- particles

_BOX = 20.0


@query(
    "periodic_positions",
    f"WITH {PARTICLES_SQL}, t AS (SELECT galaxy_id, least(min(x), min(y), min(z)) + 10 < 2 AND greatest(max(x), max(y), max(z)) + 10 > 18 AS wraps FROM p GROUP BY 1) SELECT pid, "
    + ", ".join(f"round(CASE WHEN wraps THEN CASE WHEN {c} + 20 > 20 THEN {c} ELSE {c} + 20 END - 10 ELSE {c} + 10 END, 6) AS u{c}" for c in "xyz")
    + " FROM p JOIN t USING (galaxy_id)",
)
def periodic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a periodic box, unwrapped for the galaxies that touch both of its faces."""
    rows = particles(spark, sf_dir)
    ends = rows.groupBy("galaxy_id").agg(F.min(F.least("x", "y", "z")).alias("_lo"), F.max(F.greatest("x", "y", "z")).alias("_hi"))
    wraps = (F.col("_lo") + _BOX / 2 < _BOX / 10) & (F.col("_hi") + _BOX / 2 > _BOX * 0.9)
    joined = rows.join(ends, "galaxy_id")
    place = lambda c: F.when(wraps, S.unwrapped(F.col(c) + _BOX / 2, _BOX)).otherwise(F.col(c) + _BOX / 2)
    return joined.select("pid", *(F.round(place(c), 6).alias(f"u{c}") for c in "xyz"))


@query(
    "collapsed_positions",
    "SELECT component, pid % 61 AS fibre, count(*) FILTER (z::VARCHAR <> 'nan') AS n, round(avg(z) FILTER (z::VARCHAR <> 'nan'), 6) AS z FROM particles WHERE pid IS NOT NULL GROUP BY 1, 2",
)
def collapsed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean position per fibre; NaN positions are left out."""
    rows = table(spark, sf_dir, "particles").filter("pid is not null").select("component", (F.col("pid") % 61).alias("fibre"), S.none_if_nan(F.col("z")).alias("z"))
    return rows.groupBy("component", "fibre").agg(F.count("z").alias("n"), F.round(F.avg("z"), 6).alias("z"))


_MIX = [(0.3, -0.1, 0.09), (0.5, 0.6, 0.04), (0.2, 0.1, 0.25)]


def _mix_sql() -> str:
    parts = [f"{w} * exp(-pow(eps - ({m}), 2) / {2 * v!r}) / {math.sqrt(2 * math.pi * v)!r}" for w, m, v in _MIX]
    return f"{', '.join(f'{p} AS q{k}' for k, p in enumerate(parts))}"


@query("mixture_shares", f"WITH {STARS_SQL}, f AS (SELECT pid, {EPS_SQL} AS eps FROM s), d AS (SELECT pid, {_mix_sql()} FROM f) SELECT pid, " + ", ".join(f"round(q{k} / (q0 + q1 + q2), 6) AS p{k}" for k in range(3)) + " FROM d")
def mixture_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the components of a stored mixture in each star."""
    shares = L.responsibilities(F.col("eps"), _MIX)
    rows = stars(spark, sf_dir).select("pid", P.circularity_proxy().alias("eps"))
    return rows.select("pid", *(F.round(s, 6).alias(f"p{k}") for k, s in enumerate(shares)))


@query(
    "legacy_roles",
    f"WITH {STARS_SQL}, f AS (SELECT regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, pid % 3 AS k, sqrt(x * x + y * y) AS r, {EPS_SQL} AS eps, 0.5 * (vx * vx + vy * vy + vz * vz) / 10000 AS e FROM s), "
    "m AS (SELECT snap, k, round(avg(r), 6) AS r, round(avg(eps), 6) AS eps, round(avg(e), 6) AS e FROM f GROUP BY 1, 2), d AS (SELECT snap, arg_max(k, [eps, -k]) AS disk FROM m GROUP BY 1), "
    "o AS (SELECT snap, disk, list(k ORDER BY k) AS ks, list(e ORDER BY k) AS es, list(r ORDER BY k) AS rs FROM m JOIN d USING (snap) WHERE k <> disk GROUP BY 1, 2), "
    "b AS (SELECT *, CASE WHEN abs(es[1] - es[2]) >= 0.05 THEN es[1] < es[2] ELSE rs[1] <= rs[2] END AS first_is FROM o) "
    "SELECT snap, CASE WHEN first_is THEN ks[1] ELSE ks[2] END AS bulge, disk, CASE WHEN first_is THEN ks[2] ELSE ks[1] END AS halo FROM b",
)
def legacy_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of three components by the older rule, for comparison."""
    return L.legacy_roles(component_means(spark, sf_dir), ["snap"], "k", "eps", "e", "r")


_LADDER_SQL = "CASE WHEN eps < -0.6 THEN 'halo' WHEN eps < 0.25 AND r < 3 THEN 'bulge' WHEN eps > 0.75 THEN 'disk' END"


@query(
    "initial_classes",
    f"WITH {STARS_SQL}, f AS (SELECT pid, regexp_extract(galaxy_id, '-(\\d+)-', 1) AS snap, round({EPS_SQL}, 6) AS eps, sqrt(x * x + y * y) AS r FROM s), l AS (SELECT *, {_LADDER_SQL} AS c FROM f), "
    "m AS (SELECT snap, " + ", ".join(f"avg(eps) FILTER (c = '{c}') AS m_{c}" for c in ("disk", "bulge", "halo")) + " FROM l GROUP BY 1), "
    "g AS (SELECT pid, c, coalesce(round(abs(eps - m_disk), 9), 99) AS a, coalesce(round(abs(eps - m_bulge), 9), 99) AS b, coalesce(round(abs(eps - m_halo), 9), 99) AS d FROM l JOIN m USING (snap)) "
    "SELECT pid, coalesce(c, CASE WHEN a <= b AND a <= d THEN 'disk' WHEN b <= d THEN 'bulge' ELSE 'halo' END) AS class FROM g",
)
def initial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First classes of the stars: a ladder of rules, and the nearest class mean for the rest."""
    rows = stars(spark, sf_dir).select(
        "pid", F.regexp_extract("galaxy_id", r"-(\d+)-", 1).alias("snap"), F.round(P.circularity_proxy(), 6).alias("eps"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("r")
    )
    eps = F.col("eps")
    rules = [("disk", eps > 0.75), ("bulge", (eps < 0.25) & (F.col("r") < 3)), ("halo", eps < -0.6)]
    return L.ladder_classes(rows, ["snap"], "eps", rules).select("pid", "class")


@query(
    "stratum_anomalies",
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, sqrt(x * x + y * y) AS r, mass, abs({EPS_SQL}) < 0.3 AS ib, {EPS_SQL} >= 0.7 AS ij FROM s), "
    "g AS (SELECT galaxy_id, sum(r * mass) FILTER (ib) / nullif(sum(mass) FILTER (ib), 0) AS b, sum(r * mass) FILTER (ij) / nullif(sum(mass) FILTER (ij), 0) AS d FROM f GROUP BY 1), "
    "c AS (SELECT 'TNG50-' || snapshot || '-' || subhalo_id AS galaxy_id, stratum FROM wave2_strata QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id ORDER BY classified_at DESC NULLS LAST, strata_id DESC) = 1) "
    "SELECT lower(trim(stratum)) AS stratum, count(*) AS n, count(*) FILTER (round(d, 6) < round(0.9 * b, 6)) AS n_inverted FROM c JOIN g USING (galaxy_id) GROUP BY 1",
)
def stratum_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galaxies with their roles inverted, per stratum of the latest classification."""
    eps, m, r = P.circularity_proxy(), F.col("mass"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    mean = lambda w: F.try_divide(F.sum(F.when(w, r * m)), F.nullif(F.sum(F.when(w, m)), F.lit(0.0)))
    sums = stars(spark, sf_dir).groupBy("galaxy_id").agg(mean(F.abs(eps) < 0.3).alias("b"), mean(eps >= 0.7).alias("d"))
    latest = table(spark, sf_dir, "wave2_strata").groupBy("snapshot", "subhalo_id").agg(F.max_by("stratum", F.struct("classified_at", "strata_id")).alias("stratum"))
    named = latest.select(galaxy_id(None, F.col("snapshot"), F.col("subhalo_id")).alias("galaxy_id"), F.lower(F.trim("stratum")).alias("stratum"))
    inverted = F.round("d", 6) < F.round(0.9 * F.col("b"), 6)
    return named.join(sums, "galaxy_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(inverted).alias("n_inverted"))


_GAS_CELL = f"floor(y / {STEP} + {BINS / 2})::INTEGER AS iy, floor(x / {STEP} + {BINS / 2})::INTEGER AS ix"


@query(
    "gas_boost",
    f"WITH {STARS_SQL}, g AS (SELECT galaxy_id, {_GAS_CELL}, sum(mass) AS v FROM p WHERE component = 'gas' GROUP BY ALL), i AS (SELECT * FROM g WHERE iy BETWEEN 0 AND {BINS - 1} AND ix BETWEEN 0 AND {BINS - 1}), "
    f"t AS (SELECT galaxy_id, max(v) AS top FROM i GROUP BY 1), c AS (SELECT pid, galaxy_id, {_GAS_CELL} FROM s) "
    "SELECT pid, round(coalesce(v, 0) / top, 6) AS boost FROM c JOIN t USING (galaxy_id) LEFT JOIN i USING (galaxy_id, iy, ix)",
)
def gas_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gas of each star's cell over that of its galaxy's richest one; stars of galaxies without gas have no row."""
    gas = G.deposit_nearest(particles(spark, sf_dir, "gas"), KEY, "x", "y", "mass", STEP, BINS)
    tops = gas.groupBy("galaxy_id").agg(F.max("value").alias("_top"))
    cell = lambda c: F.floor(F.col(c) / STEP + BINS / 2).cast("int")
    places = stars(spark, sf_dir).select("pid", "galaxy_id", cell("y").alias("iy"), cell("x").alias("ix"))
    joined = places.join(tops, "galaxy_id").join(gas, ["galaxy_id", "iy", "ix"], "left")
    return joined.select("pid", F.round(F.coalesce("value", F.lit(0.0)) / F.col("_top"), 6).alias("boost"))


@query(
    "substructure_shares",
    f"WITH {GRID_SQL[5:]}, q AS (SELECT *, floor(sqrt(pow(iy - {_MID}, 2) + pow(ix - {_MID}, 2)))::INTEGER AS ring FROM g), a AS (SELECT galaxy_id, ring, avg(value) AS ax FROM q GROUP BY 1, 2), "
    "w AS (SELECT galaxy_id, iy, ix, CASE WHEN value - ax > 0.3 * ax THEN (value - ax) / ax ELSE 0.0 END AS arm FROM q JOIN a USING (galaxy_id, ring)), "
    "b AS (SELECT galaxy_id, atan2(sum(mass * 2 * x * y / nullif(x * x + y * y, 0)), sum(mass * (x * x - y * y) / nullif(x * x + y * y, 0))) / 2 AS angle FROM s WHERE sqrt(x * x + y * y) <= 3 GROUP BY 1), "
    f"r AS (SELECT s.pid, sqrt(x * x + y * y) AS r, greatest(0.0, least(1.0, cos(2 * (atan2(y, x) - angle)))) / (1 + exp((sqrt(x * x + y * y) - 3) / 0.75)) AS bar, CASE WHEN sqrt(x * x + y * y) > 3 THEN coalesce(arm, 0) ELSE 0 END AS arm FROM s JOIN b USING (galaxy_id) "
    f"LEFT JOIN w ON w.galaxy_id = s.galaxy_id AND w.iy = floor(y / {STEP} + {BINS / 2}) AND w.ix = floor(x / {STEP} + {BINS / 2})) "
    "SELECT pid, round(1 / (1 + bar + arm), 6) AS disk, round(bar / (1 + bar + arm), 6) AS bar, round(arm / (1 + bar + arm), 6) AS arms FROM r WHERE bar IS NOT NULL",
)
def substructure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of disk, bar and arms in each star: a bar by its angle and radius, arms where a cell stands out of its ring."""
    x, y, m = F.col("x"), F.col("y"), F.col("mass")
    rows, r = stars(spark, sf_dir), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    grid = star_grid(spark, sf_dir).withColumn("ring", F.floor(F.sqrt((F.col("iy") - _MID) ** 2 + (F.col("ix") - _MID) ** 2)).cast("int"))
    means = grid.groupBy("galaxy_id", "ring").agg(F.avg("value").alias("ax"))
    over = F.col("value") - F.col("ax")
    arms = grid.join(means, ["galaxy_id", "ring"]).select("galaxy_id", "iy", "ix", F.when(over > 0.3 * F.col("ax"), over / F.col("ax")).otherwise(0.0).alias("arm"))
    square = F.nullif(x * x + y * y, F.lit(0.0))
    inner = rows.filter(r <= 3).groupBy("galaxy_id").agg((F.atan2(F.sum(F.try_divide(m * 2 * x * y, square)), F.sum(F.try_divide(m * (x * x - y * y), square))) / 2).alias("angle"))
    cell = lambda c: F.floor(F.col(c) / STEP + BINS / 2).cast("int")
    placed = rows.select("pid", "galaxy_id", "x", "y", cell("y").alias("iy"), cell("x").alias("ix")).join(inner, "galaxy_id").join(arms, ["galaxy_id", "iy", "ix"], "left")
    bar = L.bar_weight(F.atan2(y, x), r, F.col("angle"), F.lit(3.0), F.lit(0.75))
    raw = placed.select("pid", bar.alias("b"), F.when(r > 3, F.coalesce("arm", F.lit(0.0))).otherwise(0.0).alias("a")).filter("b is not null")
    total = 1 + F.col("b") + F.col("a")
    return raw.select("pid", F.round(1 / total, 6).alias("disk"), F.round(F.col("b") / total, 6).alias("bar"), F.round(F.col("a") / total, 6).alias("arms"))


# --- grids


_CELL_SQL = (
    f"WITH {STARS_SQL}, f AS (SELECT galaxy_id, floor(y / 2 + 4)::INTEGER AS iy, floor(x / 2 + 4)::INTEGER AS ix, mass, vz, round({EPS_SQL}, 6) AS eps FROM s), "
    "c AS (SELECT galaxy_id, iy, ix, avg(vz) AS v, stddev_pop(vz) AS sigma, round((avg(pow(vz, 3)) - 3 * avg(vz) * avg(pow(vz, 2)) + 2 * pow(avg(vz), 3)) / nullif(pow(stddev_pop(vz), 3), 0), 6) AS h3, "
    "coalesce(sum(mass) FILTER (abs(eps) < 0.3), 0) / sum(mass) AS bulge, coalesce(sum(mass) FILTER (eps >= 0.7), 0) / sum(mass) AS disk, coalesce(sum(mass) FILTER (eps > -0.7 AND eps <= -0.3), 0) / sum(mass) AS bar "
    "FROM f WHERE iy BETWEEN 0 AND 7 AND ix BETWEEN 0 AND 7 GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND stddev_pop(vz) >= 1 AND sum(mass) > 0)"
)


@query(
    "kinematic_checks",
    _CELL_SQL + ", d AS (SELECT *, median(v) OVER (PARTITION BY galaxy_id) AS mid FROM c), e AS (SELECT *, abs(v - mid) / (sigma + 1e-6) AS vs, "
    "rank() OVER (PARTITION BY galaxy_id, bar > 0.4 ORDER BY v) + (count(*) OVER (PARTITION BY galaxy_id, bar > 0.4, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY galaxy_id, bar > 0.4 ORDER BY h3) + (count(*) OVER (PARTITION BY galaxy_id, bar > 0.4, h3) - 1) / 2.0 AS rh FROM d), "
    "m AS (SELECT galaxy_id, count(*) FILTER (bulge > 0.4) AS nb, count(*) FILTER (disk > 0.4) AS nd, count(*) FILTER (bar > 0.4) AS na, median(vs) FILTER (disk > 0.4) AS vd, median(vs) FILTER (bulge > 0.4) AS vb, "
    "median(sigma) FILTER (bulge > 0.4) AS sb, median(sigma) FILTER (disk > 0.4) AS sd, median(sigma) FILTER (bar > 0.4) AS sa, "
    "coalesce(covar_pop(rv, rh) FILTER (bar > 0.4) / nullif(stddev_pop(rv) FILTER (bar > 0.4) * stddev_pop(rh) FILTER (bar > 0.4), 0), 0) AS rho FROM e GROUP BY 1), "
    "t AS (SELECT galaxy_id, CASE WHEN nb < 3 OR nd < 3 THEN 'N/A' WHEN vd / (vb + 1e-6) >= 1.1 THEN 'PASS' ELSE 'FAIL' END AS rotation, CASE WHEN nb < 3 OR nd < 3 THEN 'N/A' WHEN sb / (sd + 1e-6) >= 1.1 THEN 'PASS' ELSE 'FAIL' END AS dispersion, "
    "CASE WHEN nb < 3 OR nd < 3 OR na < 3 THEN 'N/A' WHEN sa >= sd * 0.85 AND sa <= sb * 1.15 THEN 'PASS' ELSE 'FAIL' END AS bar_sigma, CASE WHEN na < 3 THEN 'N/A' WHEN rho <= -0.1 THEN 'PASS' ELSE 'FAIL' END AS h3_signature FROM m) "
    "SELECT *, len(list_filter([rotation, dispersion, bar_sigma, h3_signature], lambda x: x <> 'N/A'))::INTEGER AS n_applicable, len(list_filter([rotation, dispersion, bar_sigma, h3_signature], lambda x: x = 'PASS'))::INTEGER AS n_passed, "
    "round(n_passed / nullif(n_applicable, 0), 6) AS coherence FROM t",
)
def kinematic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation, dispersion, bar and skewness tests of each galaxy's map of 2 kpc cells, and how many are passed."""
    cell = lambda c: F.floor(F.col(c) / 2 + 4).cast("int")
    rows = stars(spark, sf_dir).select("galaxy_id", cell("y").alias("iy"), cell("x").alias("ix"), "mass", "vz", F.round(P.circularity_proxy(), 6).alias("eps"))
    eps, mean, square, cube = F.col("eps"), F.avg("vz"), F.avg(F.col("vz") ** 2), F.avg(F.col("vz") ** 3)
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("mass"))), F.lit(0.0)) / F.sum("mass")
    maps = rows.filter("iy between 0 and 7 and ix between 0 and 7").groupBy("galaxy_id", "iy", "ix").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mass").alias("m"), mean.alias("v"), F.stddev_pop("vz").alias("sigma"), mean.alias("a"), square.alias("b"), cube.alias("c"),
        share(F.abs(eps) < 0.3).alias("bulge"), share(eps >= 0.7).alias("disk"), share((eps > -0.7) & (eps <= -0.3)).alias("bar"),
    )
    skewness = F.try_divide(F.col("c") - 3 * F.col("a") * F.col("b") + 2 * F.col("a") ** 3, F.nullif(F.col("sigma") ** 3, F.lit(0.0)))
    cells = maps.filter("n >= 3 and sigma >= 1 and m > 0").withColumn("h3", F.round(skewness, 6))
    found = V.kinematic_checks(cells, KEY, dominant=0.4, least=3)
    return found.withColumn("coherence", F.round("coherence", 6))


@query("label_sums", SHARES_SQL + " SELECT snap, count(*) AS n_cells, count(*) FILTER (abs(bulge + disk + halo - 1) > 1e-3) AS n_bad, count(*) FILTER (isnan(bulge + disk + halo)) AS n_nan, count(*) FILTER (abs(bulge + disk + halo - 1) > 1e-3) = 0 AS valid FROM h GROUP BY 1")
def label_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored shares of a snapshot's cells add up to 1 everywhere and hold no NaN."""
    total = F.col("bulge") + F.col("disk") + F.col("halo")
    bad = F.count_if(F.abs(total - 1) > 1e-3)
    return class_shares(spark, sf_dir).groupBy("snap").agg(F.count(F.lit(1)).alias("n_cells"), bad.alias("n_bad"), F.count_if(F.isnan(total)).alias("n_nan"), (bad == 0).alias("valid"))


_WEIGHT_SQL = f"exp(-0.5 * (pow(iy - {_MID}, 2) + pow(ix - {_MID}, 2)) / 9.0)"


@query("central_recalibration", SHARES_SQL + f", q AS (SELECT snap, iy, ix, bulge * (1 + 0.5 * {_WEIGHT_SQL}) AS b, disk * greatest(0.25, least(1.0, 1 - 0.8 * {_WEIGHT_SQL})) AS d, halo AS h FROM h) SELECT snap, iy, ix, round(b / (b + d + h), 6) AS bulge, round(d / (b + d + h), 6) AS disk, round(h / (b + d + h), 6) AS halo FROM q")
def central_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares with the bulge raised and the disk lowered towards the centre."""
    w = L.central_weight(F.col("iy"), F.col("ix"), BINS, 3.0)
    moved = {"bulge": F.col("bulge") * (1 + 0.5 * w), "disk": F.col("disk") * F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1 - 0.8 * w)), "halo": F.col("halo")}
    total = sum(list(moved.values())[1:], moved["bulge"])
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", *(F.round(v / total, 6).alias(c) for c, v in moved.items()))


@query(
    "source_contrast",
    STACK_SQL + ", f AS (SELECT snap, quantile_cont(value, 0.02) AS lo FROM t WHERE value > 0 GROUP BY 1) SELECT snap, iy, ix, round(CASE WHEN value > 0 THEN log10(greatest(value, lo)) ELSE 0 END, 6) AS contrast FROM t JOIN f USING (snap)",
)
def source_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of each cell's value above the second percentile of its map; maps are small grids."""
    cells = stacked(spark, sf_dir)
    floors = cells.filter("value > 0").groupBy("snap").agg(F.expr("percentile(value, 0.02)").alias("lo"))
    contrast = F.when(F.col("value") > 0, F.log10(F.greatest("value", "lo"))).otherwise(0.0)
    return cells.join(floors, "snap").select("snap", "iy", "ix", F.round(contrast, 6).alias("contrast"))


@query("crop_boxes", SET_SQL + f" SELECT galaxy_id, greatest(min(iy) - 2, 0) AS y0, least(max(iy) + 3, {BINS}) AS y1, greatest(min(ix) - 2, 0) AS x0, least(max(ix) + 3, {BINS}) AS x1 FROM d GROUP BY 1")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.crop_boxes(signal_cells(spark, sf_dir), KEY, BINS, 2)


@query("cells_outward", GRID_SQL + f" SELECT galaxy_id, iy, ix, row_number() OVER (PARTITION BY galaxy_id ORDER BY pow(iy - {_MID}, 2) + pow(ix - {_MID}, 2), iy, ix) AS n FROM g")
def cells_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each map in order of distance from the centre; a map has at most BINS x BINS cells."""
    from pyspark.sql import Window

    away = (F.col("iy") - _MID) ** 2 + (F.col("ix") - _MID) ** 2
    return star_grid(spark, sf_dir).select("galaxy_id", "iy", "ix", F.row_number().over(Window.partitionBy("galaxy_id").orderBy(away, "iy", "ix")).alias("n"))


_KEYS = [0.4, 0.55, 0.7]


@query(
    "hard_variants",
    SHARES_SQL + ", q AS (SELECT snap, iy, ix, round(greatest(bulge, disk, halo), 6) AS p, CASE WHEN round(bulge, 6) >= round(disk, 6) AND round(bulge, 6) >= round(halo, 6) THEN 'bulge' WHEN round(disk, 6) >= round(halo, 6) THEN 'disk' ELSE 'halo' END AS top FROM h) SELECT snap, iy, ix, "
    + " || ';' || ".join(f"'{round(k * 100):03d}=' || CASE WHEN p >= {k} THEN top ELSE 'none' END" for k in _KEYS)
    + " AS variants FROM q",
)
def hard_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard label of each cell under several thresholds, by threshold key."""
    shares = F.array(*(F.round(c, 6) for c in CLASSES))
    top = F.get(F.array(*map(F.lit, CLASSES)), S.first_argmax(shares))
    variants = F.map_from_arrays(F.array(*(F.lit(f"{round(k * 100):03d}") for k in _KEYS)), F.array(*(F.when(F.array_max(shares) >= k, top).otherwise("none") for k in _KEYS)))
    text = F.array_join(F.transform(F.map_entries(variants), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return class_shares(spark, sf_dir).select("snap", "iy", "ix", text.alias("variants"))


@query(
    "affine_resample",
    STACK_SQL + f", k AS (SELECT ty, tx, 0.8 * ty + 1.3 AS sy, {BINS - 1} - (0.8 * tx + 1.3) AS sx FROM (SELECT unnest(range({BINS}))::DOUBLE AS ty), (SELECT unnest(range({BINS}))::DOUBLE AS tx)) "
    "SELECT snap, ty::INTEGER AS iy, tx::INTEGER AS ix, round(sum(value * (1 - abs(sy - iy)) * (1 - abs(sx - ix))) / 1e6, 6) AS value FROM t JOIN k ON abs(sy - iy) < 1 AND abs(sx - ix) < 1 GROUP BY 1, 2, 3",
)
def affine_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack read on a finer grid of another origin, mirrored."""
    found = L.affine_resample(stacked(spark, sf_dir), ["snap"], BINS, 0.8, 1.3, flip=True)
    return found.withColumn("value", F.round(F.col("value") / 1e6, 6))


# --- spectra


@query(
    "line_spread",
    f"WITH {SPECTRA_SQL}, h AS (SELECT kind, floor(wave / 21600)::INTEGER AS k, avg(flux) AS flux FROM e GROUP BY 1, 2), j AS (SELECT a.kind, a.k, b.flux, exp(-pow(b.k - a.k, 2) / (2 * pow(1 + a.k / 60.0, 2))) AS w FROM h a JOIN h b ON a.kind = b.kind AND abs(a.k - b.k) <= 8) "
    "SELECT kind, k, round(sum(w * flux) / sum(w), 5) AS flux FROM j GROUP BY 1, 2",
)
def line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum of each kind smeared by a Gaussian that widens with wavelength."""
    found = L.line_spread(_all_points(spark, sf_dir), ["kind"], "k", "flux", 1 + F.col("k") / 60.0, 8)
    return found.select("kind", "k", F.round("spread", 5).alias("flux"))


@query(
    "ring_flux",
    f"WITH {SPECTRA_SQL}, w AS (SELECT kind, 3600 + wave / 400 AS l, flux FROM e) SELECT kind, count(*) AS n, round(avg(flux), 5) AS level, round(3.0 * avg(flux) / (5 / 1.7361) / (1 / (1 + exp(-(6000 - 3900) / 100.0)) / (1 + exp((6000 - 10100) / 100.0)) + 1), 5) AS noise FROM w WHERE l >= 5415 AND l < 6989 AND flux <> 0 GROUP BY 1",
)
def ring_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean flux per kind in a wavelength window, zeros ignored, and the noise that goes with it at 6000."""
    wave = 3600 + F.col("wave") / 400
    rows = spectra(spark, sf_dir).filter((wave >= 5415) & (wave < 6989) & (F.col("flux") != 0))
    levels = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("flux").alias("f"))
    return levels.select("kind", "n", F.round("f", 5).alias("level"), F.round(S.noise_amplitude(F.lit(6000.0), F.col("f")), 5).alias("noise"))


@query(
    "wave_axes",
    f"WITH {SPECTRA_SQL}, h AS (SELECT spaxel, count(*) AS n, min(wave) AS a FROM e GROUP BY 1) SELECT spaxel, n, round(a + (1 - 2) * 0.5, 5) AS first_wave, round(a + (n - 2) * 0.5, 5) AS last_wave, round(((n + 1) / 2.0 - 1) * 0.5, 5) AS mean_offset FROM h",
)
def wave_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear wavelength axis of each spectrum from its header: start at pixel 2, steps of one half."""
    heads = spectra(spark, sf_dir).groupBy("spaxel").agg(F.count(F.lit(1)).alias("n"), F.min("wave").alias("a"))
    axes = heads.select("spaxel", "n", S.wave_axis(F.col("n").cast("int"), F.col("a"), F.lit(0.5), F.lit(2)).alias("axis"))
    mean = F.aggregate("axis", F.lit(0.0), lambda s, v: s + v) / F.size("axis")
    return axes.select("spaxel", "n", F.round(F.element_at("axis", 1), 5).alias("first_wave"), F.round(F.element_at("axis", -1), 5).alias("last_wave"), F.round(mean - F.element_at("axis", 1), 5).alias("mean_offset"))


@query(
    "fit_windows",
    f"WITH {SPECTRA_SQL}, r AS (SELECT spaxel, wave / (1 + (spaxel % 100) / 1000.0) AS w FROM e), i AS (SELECT * FROM r WHERE w >= 400000 AND w <= 1600000) "
    "SELECT spaxel, count(*) AS n, round(min(ln(w)), 6) AS first_log, round((max(ln(w)) - min(ln(w))) / nullif(count(*) - 1, 0), 8) AS step, count(*) >= 5 AS usable FROM i GROUP BY 1",
)
def fit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rest-frame points of each spectrum in a window, the step of their log grid, and whether they are enough."""
    rest = F.col("wave") / (1 + (F.col("spaxel") % 100) / 1000.0)
    rows = spectra(spark, sf_dir).select("spaxel", rest.alias("w")).filter("w >= 400000 and w <= 1600000").withColumn("l", F.ln("w"))
    n, low, high = F.count(F.lit(1)), F.min("l"), F.max("l")
    step = F.try_divide(high - low, F.nullif(n - 1, F.lit(0)))
    return rows.groupBy("spaxel").agg(n.alias("n"), F.round(low, 6).alias("first_log"), F.round(step, 8).alias("step"), (n >= 5).alias("usable"))
