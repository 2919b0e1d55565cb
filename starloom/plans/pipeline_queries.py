"""Queries of the general data-pipeline operators: skewed keys (p2) and orphan references (p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.galaxies import galaxy_id, plain_path
from starloom.operators.heavy_keys import SAMPLED, hashes_of_totals, heavy_totals, skew_join, skewed_totals, usable
from starloom.operators.orphans import dated_orphans, orphan_references
from starloom.plans.durable import stored
from starloom.plans.registry import Registry
from starloom.sources.tables import table

registry = Registry()
HEAVY_SHARE = 0.02
AMOUNTS = ["n_star_part", "n_gas_cell", "estimated_raw_mb"]

LISTING_GALAXY = "'TNG50-' || snapshot || '-' || subhalo_id"
PARTICLE_GALAXY = (
    "CASE WHEN regexp_matches(galaxy_id, '(?i)tng50[-_]\\d+[-_]\\d+') THEN 'TNG50-' || "
    "regexp_extract(galaxy_id, '(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)', 1) || '-' || "
    "regexp_extract(galaxy_id, '(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)', 2) END"
)
USABLE = "CASE WHEN {0} >= 0 AND NOT isnan({0}::DOUBLE) THEN {0}::DOUBLE END"


def listing_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """galaxy_id in the plain form and the usable amounts of each listing."""
    rows = table(spark, sf_dir, "wave2_manifest")
    key = galaxy_id(F.col("galaxy_id"), F.col("snapshot"), F.col("subhalo_id"))
    return rows.select(key.alias("galaxy_id"), *(usable(F.col(m)).alias(m) for m in AMOUNTS))


def particle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """galaxy_id in the plain form of each particle row (null without a galaxy), with a count of one."""
    rows = table(spark, sf_dir, "particles")
    return rows.select(galaxy_id(F.col("galaxy_id")).alias("galaxy_id"), F.lit(1.0).alias("particles"))


LISTINGS_SQL = f"SELECT {LISTING_GALAXY} AS galaxy_id, " + ", ".join(f"{USABLE.format(m)} AS {m}" for m in AMOUNTS) + " FROM wave2_manifest"


@registry.query(
    "p2_found",
    f"WITH w AS ({LISTINGS_SQL}), p AS (SELECT {PARTICLE_GALAXY} AS galaxy_id FROM particles), "
    + "long AS ("
    + " UNION ALL ".join(f"SELECT galaxy_id, '{m}' AS measure, sum({m}) AS total, (SELECT sum({m}) FROM w) AS grand FROM w GROUP BY 1" for m in AMOUNTS)
    + " UNION ALL SELECT galaxy_id, 'particles', count(*)::DOUBLE, (SELECT count(*)::DOUBLE FROM p) FROM p GROUP BY 1) "
    f"SELECT galaxy_id, measure FROM long WHERE galaxy_id IS NOT NULL AND grand > 0 AND total >= {HEAVY_SHARE} * grand",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = heavy_totals(listing_amounts(spark, sf_dir), "galaxy_id", AMOUNTS, HEAVY_SHARE)
    counted = heavy_totals(particle_rows(spark, sf_dir), "galaxy_id", ["particles"], HEAVY_SHARE)
    return listed.unionByName(counted).select("galaxy_id", "measure")


@registry.query(
    "p2_totals",
    f"SELECT galaxy_id, count(*) AS n_rows, sum(n_star_part) AS n_star_part, sum(n_gas_cell) AS n_gas_cell, "
    f"round(sum(estimated_raw_mb), 3) AS estimated_raw_mb FROM ({LISTINGS_SQL}) GROUP BY galaxy_id",
)
def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per galaxy over all listings."""
    totals = skewed_totals(listing_amounts(spark, sf_dir), "galaxy_id", AMOUNTS)
    return totals.select("galaxy_id", "n_rows", "n_star_part", "n_gas_cell", F.round("estimated_raw_mb", 3).alias("estimated_raw_mb"))


PARTICLE_MASS = "CASE WHEN mass >= 0 AND NOT isnan(mass) THEN mass END"


@registry.query(
    "p2_mass_shares",
    f"WITH p AS (SELECT {PARTICLE_GALAXY} AS galaxy_id, pid, {PARTICLE_MASS} AS mass FROM particles) "
    "SELECT galaxy_id, pid, round(CASE WHEN t.mass > 0 THEN p.mass / t.mass END, 9) AS mass_share "
    "FROM p JOIN (SELECT galaxy_id, sum(mass) AS mass FROM p GROUP BY 1) t USING (galaxy_id)",
)
def p2_mass_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each particle row in its galaxy's mass: per-key totals joined back to the rows."""
    rows = table(spark, sf_dir, "particles").select(galaxy_id(F.col("galaxy_id")).alias("galaxy_id"), "pid", usable(F.col("mass")).alias("mass"))
    totals = stored(skewed_totals(rows, "galaxy_id", ["mass"]).select("galaxy_id", "n_rows", F.col("mass").alias("total_mass")))
    hot = hashes_of_totals(totals, "galaxy_id", "n_rows", 0.01)  # the counts are exact, so the join needs no sample
    joined = skew_join(rows, totals.drop("n_rows"), "galaxy_id", hot=hot)
    return joined.select("galaxy_id", "pid", F.round(F.try_divide("mass", F.nullif("total_mass", F.lit(0.0))), 9).alias("mass_share"))



def _drawn(rows: DataFrame, part: float) -> DataFrame:
    return rows if part >= 1 else rows.sample(part, seed=1)


REF_FIELDS = {"cube_path": "cube_files", "pipe3d_path": "pipe3d_files", "rss_path": "rss_files"}


def path_references(spark: SparkSession, sf_dir: str, part: float = 1.0) -> DataFrame:
    """(manifest_id, listed_at, ref_field, file) for each of a record's three references; file is null for no reference.

    part under 1 draws rows before their paths are looked at.
    """
    rows = _drawn(table(spark, sf_dir, "manifest"), part).select("manifest_id", "listed_at", *REF_FIELDS)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("path")) for f in REF_FIELDS)))
    return rows.select("manifest_id", "listed_at", each.alias("_r")).select(
        "manifest_id", "listed_at", "_r.ref_field", plain_path(F.col("_r.path")).alias("file")
    )


def stored_files(spark: SparkSession, sf_dir: str, part: float = 1.0) -> DataFrame:
    """(ref_field, file, registered_at, deleted_at) of the three file tables, or of a part of their rows."""
    parts = [
        _drawn(table(spark, sf_dir, name), part).select(
            F.lit(field).alias("ref_field"), plain_path(F.col("path")).alias("file"), "registered_at", "deleted_at"
        )
        for field, name in REF_FIELDS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of the manifest; a reference is the pair (ref_field, file), matched simply: no file, no reference."""
    samples = path_references(spark, sf_dir, SAMPLED), stored_files(spark, sf_dir, SAMPLED)
    return dated_orphans(
        path_references(spark, sf_dir), stored_files(spark, sf_dir), ["ref_field", "file"], "listed_at", "registered_at", "deleted_at", samples=samples
    )


def _path_sql(column: str) -> str:
    """Plain path in DuckDB; four rounds of dir/.. are resolved."""
    text = f"regexp_replace({column}, '^[\\s\\x00]+|[\\s\\x00]+$', '', 'g')"
    text = f"CASE WHEN {text} NOT IN ('', '-', 'nan', 'NaN', 'None', 'none', 'null', 'NULL', 'N/A', 'n/a') THEN {text} END"
    text = f"regexp_replace(replace({text}, '\\', '/'), '^(?i:file):/+', '/')"
    text = f"regexp_replace(regexp_replace({text}, '/{{2,}}', '/', 'g'), '(/\\.)+(/|$)', '\\2', 'g')"
    for _ in range(4):
        text = f"regexp_replace({text}, '/[^/]+/\\.\\.(/|$)', '\\1')"
    return text


ORPHANS_SQL = (
    "WITH r AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT manifest_id, listed_at, '{f}' AS ref_field, {_path_sql(f)} AS file FROM manifest" for f in REF_FIELDS)
    + "), f AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT '{f}' AS ref_field, {_path_sql('path')} AS file, registered_at, deleted_at FROM {t}" for f, t in REF_FIELDS.items())
    + "), j AS (SELECT r.manifest_id, r.ref_field, r.listed_at, count(f.file) AS n, "
    "bool_or(f.registered_at <= r.listed_at AND (f.deleted_at IS NULL OR r.listed_at < f.deleted_at)) AS live, "
    "bool_or(f.registered_at <= r.listed_at) AS before FROM r LEFT JOIN f USING (ref_field, file) "
    "WHERE r.file IS NOT NULL AND r.listed_at IS NOT NULL GROUP BY ALL), "
    "o AS (SELECT manifest_id, ref_field, listed_at, CASE WHEN n = 0 THEN 'missing' WHEN before THEN 'deleted' ELSE 'late' END AS reason "
    "FROM j WHERE n = 0 OR NOT live) "
)


@registry.query("p5_found", ORPHANS_SQL + "SELECT manifest_id, ref_field, reason FROM o")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_paths(spark, sf_dir).select("manifest_id", "ref_field", "reason")


@registry.query(
    "p5_report",
    ORPHANS_SQL
    + "SELECT replace(ref_field, '_path', '_files') AS file_table, strftime(listed_at, '%Y-%m') AS month, reason, count(*) AS n_orphans "
    "FROM o GROUP BY ALL",
)
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per file table, month of listed_at and reason."""
    orphans = orphan_paths(spark, sf_dir)
    return orphans.groupBy(
        F.replace("ref_field", F.lit("_path"), F.lit("_files")).alias("file_table"), F.date_format("listed_at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_orphans"))


UNIT_KEY = ["snapshot", "subhalo_id", "view"]
UNIT_NAME = "(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)"
_UNIT_PARENTS = (
    f"c AS (SELECT DISTINCT regexp_extract(path, '{UNIT_NAME}', 1)::INTEGER AS snapshot, regexp_extract(path, '{UNIT_NAME}', 2)::BIGINT AS subhalo_id, "
    f"regexp_extract(path, '{UNIT_NAME}', 3)::INTEGER AS view FROM cube_files WHERE regexp_matches(path, '{UNIT_NAME}'))"
)
_UNIT_MATCHES = {
    "simple": "subhalo_id IS NOT NULL AND view IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot = m.snapshot AND c.subhalo_id = m.subhalo_id AND c.view = m.view)",
    "partial": "CASE WHEN subhalo_id IS NULL THEN NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot = m.snapshot AND c.view = m.view) "
    "ELSE NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot = m.snapshot AND c.subhalo_id = m.subhalo_id AND c.view = m.view) END",
    "full": "subhalo_id IS NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot = m.snapshot AND c.subhalo_id = m.subhalo_id AND c.view = m.view)",
}


@registry.query(
    "p5_unit_matches",
    f"WITH {_UNIT_PARENTS}, o AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS match, snapshot, subhalo_id IS NULL AS partly_null FROM manifest m WHERE {where}" for name, where in _UNIT_MATCHES.items())
    + ") SELECT match, snapshot, partly_null, count(*) AS n_orphans FROM o GROUP BY ALL",
)
def p5_unit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest records whose unit (snapshot, subhalo_id, view) no stored cube has, under simple, partial and full match.

    subhalo_id is null at times, so records fall into two null masks, each anti-joined on its filled columns.
    """
    records = table(spark, sf_dir, "manifest").select("manifest_id", *UNIT_KEY)
    part = lambda k, kind: F.regexp_extract("path", UNIT_NAME, k).cast(kind)
    stored = table(spark, sf_dir, "cube_files").filter(F.col("path").rlike(UNIT_NAME))
    stored = stored.select(part(1, "int").alias("snapshot"), part(2, "bigint").alias("subhalo_id"), part(3, "int").alias("view"))
    found = [orphan_references(records, stored, UNIT_KEY, match).withColumn("match", F.lit(match)) for match in ("simple", "partial", "full")]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("match", "snapshot", F.col("subhalo_id").isNull().alias("partly_null")).agg(F.count(F.lit(1)).alias("n_orphans"))
