"""Queries over catalogues, manifests and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.functions.galaxies import canonical_id, galaxy_id
from starloom.operators import catalog as C
from starloom.plans.registry import Registry
from starloom.plans.views import PARTICLES_SQL, particles
from starloom.sources.tables import table

registry = Registry()
query = registry.query

UNIT = "(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)"
UNITS_SQL = (
    f"u AS (SELECT manifest_id, snapshot, coalesce(subhalo_id, regexp_extract(canonical_id, '{UNIT}', 2)::BIGINT) AS subhalo_id, view, ifu_design, re_kpc, n_star_part, n_gas_cell, "
    "listed_at, cube_path, rss_path, pipe3d_path FROM manifest)"
)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with their subhalo number always filled."""
    number = F.coalesce("subhalo_id", F.nullif(F.regexp_extract("canonical_id", UNIT, 2), F.lit("")).cast("bigint"))
    return table(spark, sf_dir, "manifest").select(
        "manifest_id", "snapshot", number.alias("subhalo_id"), "view", "ifu_design", "re_kpc", "n_star_part", "n_gas_cell", "listed_at", "cube_path", "rss_path", "pipe3d_path"
    )


@query("canonical_id_parse", f"SELECT manifest_id, regexp_extract(canonical_id, '{UNIT}', 1)::INTEGER AS snap, regexp_extract(canonical_id, '{UNIT}', 3)::INTEGER AS view_no, regexp_extract(canonical_id, '{UNIT}', 4)::INTEGER AS ifu FROM manifest WHERE regexp_matches(canonical_id, '{UNIT}')")
def canonical_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").filter(F.col("canonical_id").rlike(UNIT))
    part = lambda k: F.regexp_extract("canonical_id", UNIT, k).cast("int")
    return rows.select("manifest_id", part(1).alias("snap"), part(3).alias("view_no"), part(4).alias("ifu"))


@query("canonical_id_build", f"WITH {UNITS_SQL} SELECT manifest_id, 'TNG50-' || snapshot || '-' || subhalo_id || '-' || view || '-' || ifu_design AS unit_id FROM u")
def canonical_id_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = canonical_id(F.col("canonical_id"), F.col("snapshot"), F.col("subhalo_id"), F.col("view"), F.col("ifu_design"))
    return table(spark, sf_dir, "manifest").select("manifest_id", built.alias("unit_id"))


@query("cutout_size", "SELECT listing_id, round((n_star_part * 72 + n_gas_cell * 96) / 1e6, 6) AS mb FROM wave2_manifest WHERE n_star_part >= 0 AND n_gas_cell >= 0")
def cutout_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wave2_manifest").filter("n_star_part >= 0 and n_gas_cell >= 0")
    return rows.select("listing_id", F.round(S.cutout_megabytes(F.col("n_star_part"), F.col("n_gas_cell")), 6).alias("mb"))


@query("coverage_radius", "SELECT listing_id, greatest(re_kpc, 1e-6) * CASE WHEN sample_manga = 2 THEN 2.5::DOUBLE ELSE 1.5::DOUBLE END AS rcov FROM wave2_manifest WHERE re_kpc IS NOT NULL")
def coverage_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wave2_manifest").filter("re_kpc is not null")
    return rows.select("listing_id", S.coverage_radius(F.col("re_kpc"), F.col("sample_manga")).alias("rcov"))


@query("plain_names", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS plain, ends_with(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), '0') AS ends_zero FROM part")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = S.plain_name(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", plain.alias("plain"), plain.endswith("0").alias("ends_zero"))


@query("term_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'bridge') AND contains(lower(text), 'lamp')")
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all terms, whatever the case."""
    text = F.lower("text")
    return table(spark, sf_dir, "documents").filter(text.contains("bridge") & text.contains("lamp")).select("doc_id")


def _assets(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    """Stored files keyed by the unit in their name: snapshot, subhalo_id, view and the path."""
    rows = table(spark, sf_dir, name).filter(F.col("path").rlike(UNIT))
    part = lambda k, t: F.regexp_extract("path", UNIT, k).cast(t)
    return rows.select(part(1, "int").alias("snapshot"), part(2, "bigint").alias("subhalo_id"), part(3, "int").alias("view"), F.col("path").alias(column))


def _assets_sql(name: str, column: str) -> str:
    return (
        f"SELECT regexp_extract(path, '{UNIT}', 1)::INTEGER AS snapshot, regexp_extract(path, '{UNIT}', 2)::BIGINT AS subhalo_id, regexp_extract(path, '{UNIT}', 3)::INTEGER AS view, "
        f"path AS {column} FROM {name} WHERE regexp_matches(path, '{UNIT}')"
    )


FALLBACK = {"cube": ("cube_files", False), "maps": ("pipe3d_files", False), "rss": ("rss_files", True)}


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit (latest delivery) with the smallest path of each asset, rss falling back to any view of the galaxy, and reasons."""
    rows = C.last_wins(units(spark, sf_dir), ["snapshot", "subhalo_id", "view"], "manifest_id", ["snapshot", "subhalo_id"])
    key, galaxy = ["snapshot", "subhalo_id", "view"], ["snapshot", "subhalo_id"]
    for name, (files, falls_back) in FALLBACK.items():
        assets = _assets(spark, sf_dir, files, name)
        if falls_back:
            rows = C.fallback_join(rows, assets, key, galaxy, [name])
        else:
            rows = rows.join(assets.groupBy(*key).agg(F.min(name).alias(name)), key, "left")
    checks = {
        "no_cube": F.col("cube").isNotNull(),
        "no_maps": F.col("maps").isNotNull(),
        "no_rss": F.col("rss").isNotNull(),
        "few_stars": F.col("n_star_part") >= 20000,
        "no_radius": F.col("re_kpc") > 0,
    }
    return rows.withColumn("reasons", C.exclusion_reasons(checks))


INVENTORY_SQL = (
    f"WITH {UNITS_SQL}, "
    + ", ".join(f"{n} AS (SELECT snapshot, subhalo_id, view, min({n}) AS {n} FROM ({_assets_sql(f, n)}) GROUP BY 1, 2, 3)" for n, (f, _) in FALLBACK.items())
    + ", g AS (SELECT snapshot, subhalo_id, min(rss) AS rss FROM rss GROUP BY 1, 2), "
    "c AS (SELECT snapshot, subhalo_id, count(*) AS repeat_count FROM u GROUP BY 1, 2), "
    "k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id, view ORDER BY manifest_id DESC) = 1), "
    "i AS (SELECT k.*, repeat_count, cube, maps, coalesce(rss.rss, g.rss) AS rss FROM k JOIN c USING (snapshot, subhalo_id) LEFT JOIN cube USING (snapshot, subhalo_id, view) "
    "LEFT JOIN maps USING (snapshot, subhalo_id, view) LEFT JOIN rss USING (snapshot, subhalo_id, view) LEFT JOIN g USING (snapshot, subhalo_id)), "
    "r AS (SELECT *, list_filter([CASE WHEN cube IS NULL THEN 'no_cube' END, CASE WHEN maps IS NULL THEN 'no_maps' END, CASE WHEN rss IS NULL THEN 'no_rss' END, "
    "CASE WHEN coalesce(n_star_part, -1) < 20000 THEN 'few_stars' END, CASE WHEN coalesce(re_kpc, 0) <= 0 THEN 'no_radius' END], lambda x: x IS NOT NULL) AS reasons FROM i) "
)


@query("asset_inventory", INVENTORY_SQL + "SELECT manifest_id, snapshot, subhalo_id, view, repeat_count, cube, maps, rss, array_to_string(reasons, ';') AS reasons FROM r")
def asset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory(spark, sf_dir)
    return rows.select("manifest_id", "snapshot", "subhalo_id", "view", "repeat_count", "cube", "maps", "rss", F.array_join("reasons", ";").alias("reasons"))


@query("exclusion_reason_counts", INVENTORY_SQL + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1")
def exclusion_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reason_counts(inventory(spark, sf_dir), "reasons")


@query(
    "strict_match_ranked",
    INVENTORY_SQL + "SELECT manifest_id, row_number() OVER (ORDER BY n_star_part DESC, manifest_id) AS selection_rank FROM r WHERE len(reasons) = 0 ORDER BY selection_rank LIMIT 100",
)
def strict_match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 complete units with most stars, ranked."""
    complete = inventory(spark, sf_dir).filter(F.size("reasons") == 0)
    return C.ranked_limit(complete, [F.desc("n_star_part"), F.asc("manifest_id")], 100).select("manifest_id", "selection_rank")


@query(
    "repeat_count",
    f"WITH {UNITS_SQL} SELECT manifest_id, snapshot, subhalo_id, view, repeat_count FROM (SELECT *, count(*) OVER (PARTITION BY snapshot, subhalo_id) AS repeat_count, "
    "row_number() OVER (PARTITION BY snapshot, subhalo_id, view ORDER BY manifest_id DESC) AS n FROM u) WHERE n = 1",
)
def repeat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.last_wins(units(spark, sf_dir), ["snapshot", "subhalo_id", "view"], "manifest_id", ["snapshot", "subhalo_id"])
    return kept.select("manifest_id", "snapshot", "subhalo_id", "view", "repeat_count")


@query(
    "full_outer_manifest",
    f"WITH {UNITS_SQL}, d AS (SELECT snapshot, subhalo_id, count(*) AS n_deliveries FROM u GROUP BY 1, 2), l AS (SELECT snapshot, subhalo_id, count(*) AS n_listings FROM wave2_manifest GROUP BY 1, 2) "
    "SELECT snapshot, subhalo_id, coalesce(n_deliveries, 0) AS n_deliveries, coalesce(n_listings, 0) AS n_listings FROM d FULL JOIN l USING (snapshot, subhalo_id)",
)
def full_outer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries and listings of every galaxy that has either."""
    key = ["snapshot", "subhalo_id"]
    delivered = units(spark, sf_dir).groupBy(*key).agg(F.count(F.lit(1)).alias("n_deliveries"))
    listed = table(spark, sf_dir, "wave2_manifest").groupBy(*key).agg(F.count(F.lit(1)).alias("n_listings"))
    return delivered.join(listed, key, "full").na.fill(0, ["n_deliveries", "n_listings"])


@query(
    "galaxy_manifest",
    "WITH w AS (SELECT 'TNG50-' || snapshot || '-' || subhalo_id AS galaxy_id, * EXCLUDE (galaxy_id) FROM wave2_manifest), "
    "m AS (SELECT galaxy_id, ifu_design, count(*) AS n FROM w WHERE ifu_design IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY n DESC, ifu_design) = 1) "
    "SELECT galaxy_id, count(*) AS n_rows, round(median(re_kpc), 6) AS re_kpc, max(n_star_part) AS n_star_part, any_value(m.ifu_design) AS ifu_design, "
    "array_to_string(list_sort(list_distinct(list(sample_manga))), ';') AS samples FROM w LEFT JOIN m USING (galaxy_id) GROUP BY 1",
)
def galaxy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per galaxy: median radius, most frequent design, largest count, sorted set of samples.

    Medians are taken over counts of distinct values, so a galaxy that is listed very often is combined before the shuffle.
    """
    rows = table(spark, sf_dir, "wave2_manifest").withColumn("galaxy_id", galaxy_id(None, F.col("snapshot"), F.col("subhalo_id")))
    counts = rows.groupBy("galaxy_id", "re_kpc").agg(F.count(F.lit(1)).alias("_n"))
    middle = counts.groupBy("galaxy_id").agg(F.round(F.expr("percentile(re_kpc, 0.5, _n)"), 6).alias("re_kpc"))
    design = C.mode_smallest(rows, ["galaxy_id"], "ifu_design", "ifu_design")
    rest = rows.groupBy("galaxy_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("n_star_part").alias("n_star_part"),
        F.array_join(F.sort_array(F.collect_set("sample_manga")).cast("array<string>"), ";").alias("samples"),
    )
    return rest.join(middle, "galaxy_id").join(design, "galaxy_id", "left").select("galaxy_id", "n_rows", "re_kpc", "n_star_part", "ifu_design", "samples")


@query(
    "snapshot_rollup",
    "SELECT snapshot, sample_manga, count(*) AS n_rows, count(DISTINCT subhalo_id) AS n_galaxies, round(avg(re_kpc), 4) AS mean_re FROM wave2_manifest GROUP BY ROLLUP (snapshot, sample_manga)",
)
def snapshot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level roll-up; galaxies are made distinct in a first grouping, so the roll-up itself expands few rows."""
    rows = table(spark, sf_dir, "wave2_manifest").groupBy("snapshot", "sample_manga", "subhalo_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("re_kpc").alias("s"), F.count("re_kpc").alias("c")
    )
    return rows.rollup("snapshot", "sample_manga").agg(
        F.sum("n").alias("n_rows"), F.count_distinct("subhalo_id").alias("n_galaxies"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 4).alias("mean_re")
    )


@query(
    "stratified_pilot",
    "WITH q AS (SELECT quantile_cont(re_kpc, 0.333) AS a, quantile_cont(re_kpc, 0.666) AS b FROM wave2_manifest WHERE re_kpc IS NOT NULL), "
    "t AS (SELECT w.*, CASE WHEN re_kpc <= a THEN 0 WHEN re_kpc <= b THEN 1 ELSE 2 END AS size_bin FROM wave2_manifest w, q WHERE re_kpc IS NOT NULL) "
    "SELECT sample_manga, ifu_design, size_bin, listing_id FROM t QUALIFY row_number() OVER (PARTITION BY sample_manga, ifu_design, size_bin ORDER BY snapshot, subhalo_id, listing_id) = 1",
)
def stratified_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First listing of each sample, design and size tercile."""
    rows = table(spark, sf_dir, "wave2_manifest").filter("re_kpc is not null").select("listing_id", "snapshot", "subhalo_id", "sample_manga", "ifu_design", "re_kpc")
    binned = C.terciles(rows, "re_kpc", 0.333, 0.666, F.floor(F.col("re_kpc") * 8))
    return C.stratified_pick(binned, ["sample_manga", "ifu_design", "size_bin"], ["snapshot", "subhalo_id", "listing_id"]).select("sample_manga", "ifu_design", "size_bin", "listing_id")


@query(
    "pending_units",
    f"WITH {UNITS_SQL}, a AS ({_assets_sql('cube_files', 'cube')}) SELECT manifest_id FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.snapshot = u.snapshot AND a.subhalo_id = u.subhalo_id AND a.view = u.view)",
)
def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose unit has no cube yet: what a resumed batch has left to do."""
    return C.pending(units(spark, sf_dir), _assets(spark, sf_dir, "cube_files", "cube"), ["snapshot", "subhalo_id", "view"]).select("manifest_id")


@query("worklist_page", "SELECT listing_id, estimated_raw_mb FROM wave2_manifest WHERE estimated_raw_mb::VARCHAR <> 'nan' ORDER BY estimated_raw_mb, listing_id LIMIT 200 OFFSET 50")
def worklist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the work list in order of size."""
    rows = table(spark, sf_dir, "wave2_manifest").filter("estimated_raw_mb is not null and not isnan(estimated_raw_mb)")
    return rows.select("listing_id", "estimated_raw_mb").orderBy("estimated_raw_mb", "listing_id").offset(50).limit(200)


@query(
    "disjoint_check",
    "SELECT count(*) AS n_shared FROM (SELECT DISTINCT snapshot, subhalo_id FROM wave2_manifest WHERE sample_manga = 1 INTERSECT SELECT DISTINCT snapshot, subhalo_id FROM wave2_manifest WHERE sample_manga = 2)",
)
def disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galaxies that two samples share."""
    rows = table(spark, sf_dir, "wave2_manifest")
    part = lambda k: rows.filter(F.col("sample_manga") == k).select("snapshot", "subhalo_id")
    return part(1).intersect(part(2)).agg(F.count(F.lit(1)).alias("n_shared"))


@query(
    "strata_join",
    "SELECT w.listing_id, s.stratum FROM wave2_manifest w JOIN (SELECT * FROM wave2_strata QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id ORDER BY classified_at DESC, strata_id DESC) = 1) s USING (snapshot, subhalo_id)",
)
def strata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the latest classification of their galaxy."""
    rows = table(spark, sf_dir, "wave2_strata").select("snapshot", "subhalo_id", "stratum", "classified_at", "strata_id")
    latest = rows.groupBy("snapshot", "subhalo_id").agg(F.max_by("stratum", F.struct("classified_at", "strata_id")).alias("stratum"))
    return table(spark, sf_dir, "wave2_manifest").join(latest, ["snapshot", "subhalo_id"]).select("listing_id", "stratum")


@query(
    "interval_chunks",
    "WITH c AS (SELECT snapshot AS chunk, count(*) AS len FROM wave2_manifest GROUP BY 1), s AS (SELECT chunk, sum(len) OVER (ORDER BY chunk) - len AS f, len FROM c), "
    "r AS (SELECT o_custkey, min(o_orderkey) % 4000 AS first, count(*) * 37 AS n_wanted FROM orders GROUP BY 1) "
    "SELECT o_custkey, chunk, (greatest(first, f) - f)::BIGINT AS local_start, (least(first + n_wanted, f + len) - greatest(first, f))::BIGINT AS n, greatest(first, f)::BIGINT AS global_start "
    "FROM r JOIN s ON f < first + n_wanted AND f + len > first",
)
def interval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ranges that customers ask for, cut along the chunks of a listing (one per snapshot)."""
    chunks = table(spark, sf_dir, "wave2_manifest").groupBy(F.col("snapshot").alias("chunk")).agg(F.count(F.lit(1)).alias("len"))
    wanted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_orderkey") % 4000).alias("first"), (F.count(F.lit(1)) * 37).alias("n_wanted"))
    return C.chunk_ranges(chunks, wanted, "len", "chunk", "first", "n_wanted").select("o_custkey", "chunk", "local_start", "n", "global_start")


@query(
    "id_match",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'",
)
def id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values brought to rows of another order by id; a missing id gives null."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query(
    "rounded_coordinate_join",
    f"WITH {PARTICLES_SQL}, r AS (SELECT galaxy_id, pid, round(x, 2) AS a, round(y, 2) AS b, component FROM p) "
    "SELECT s.pid AS star, g.pid AS gas FROM r s JOIN r g USING (galaxy_id, a, b) WHERE s.component = 'star' AND g.component = 'gas'",
)
def rounded_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars and gas cells of one galaxy at the same rounded place; the galaxy and the place are the key."""
    of = lambda c, name: particles(spark, sf_dir, c).select("galaxy_id", F.round("x", 2).alias("a"), F.round("y", 2).alias("b"), F.col("pid").alias(name))
    return of("star", "star").join(of("gas", "gas"), ["galaxy_id", "a", "b"]).select("star", "gas")


@query("views_per_listing", "SELECT n_views, count(*) AS n FROM (SELECT len(regexp_extract_all(regexp_replace(coalesce(views, ''), '(?i)=?tng50[-_0-9]+', '', 'g'), '\\d+')) AS n_views FROM wave2_manifest) GROUP BY 1")
def views_per_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings name how many views; entries that name a galaxy or unit are left out."""
    numbers = F.regexp_replace(F.coalesce("views", F.lit("")), r"(?i)=?tng50[-_0-9]+", "")
    count = F.size(F.regexp_extract_all(numbers, F.lit(r"(\d+)"), F.lit(1))).cast("bigint")
    return table(spark, sf_dir, "wave2_manifest").groupBy(count.alias("n_views")).agg(F.count(F.lit(1)).alias("n"))
