"""Role views over the tables, each with its DuckDB text, so that a query and its oracle read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.galaxies import galaxy_id
from starloom.sources.tables import table

NAMED = "(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)"
# the latest load of each particle, here by the greatest loaded_at of its usable rows; the Spark side ranks the rows
PARTICLES_SQL = (
    f"loads AS MATERIALIZED (SELECT 'TNG50-' || regexp_extract(galaxy_id, '{NAMED}', 1) || '-' || regexp_extract(galaxy_id, '{NAMED}', 2) AS galaxy_id, "
    f"pid, component, x, y, z, vx, vy, vz, mass, loaded_at FROM particles WHERE regexp_matches(galaxy_id, '{NAMED}') AND mass IS NOT NULL AND z::VARCHAR <> 'nan' AND pid IS NOT NULL), "
    "p AS (SELECT l.* EXCLUDE (loaded_at) FROM loads l JOIN (SELECT pid, max(loaded_at) AS last FROM loads GROUP BY pid) m ON l.pid = m.pid AND l.loaded_at IS NOT DISTINCT FROM m.last)"
)


def particles(spark: SparkSession, sf_dir: str, component: str | None = None) -> DataFrame:
    """The latest load of each particle among its rows with a galaxy, a mass and a position; rows without a pid are left out."""
    rows = table(spark, sf_dir, "particles")
    if component:
        rows = rows.filter(F.col("component") == component)
    usable = rows.filter("pid is not null and mass is not null and not isnan(z)").withColumn("galaxy_id", galaxy_id(F.col("galaxy_id")))
    latest = Window.partitionBy("pid").orderBy(F.desc_nulls_last("loaded_at"))
    ranked = usable.filter("galaxy_id is not null").withColumn("_load", F.row_number().over(latest)).filter("_load = 1")
    return ranked.select("galaxy_id", "pid", "component", "x", "y", "z", "vx", "vy", "vz", "mass")


STARS_SQL = PARTICLES_SQL + ", s AS (SELECT * FROM p WHERE component = 'star')"


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(spark, sf_dir, "star")


# spectra: a user is a spaxel, seconds since the start of 2024 the wavelength, value the flux, event_type the class
SPECTRA_SQL = (
    "e AS (SELECT event_id, user_id AS spaxel, event_type AS kind, value AS flux, "
    "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1000000.0 AS wave FROM events WHERE value IS NOT NULL AND NOT isnan(value))"
)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, spaxel, kind, flux, wave of each event."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)
    return table(spark, sf_dir, "events").filter("value is not null and not isnan(value)").select(
        "event_id", F.col("user_id").alias("spaxel"), F.col("event_type").alias("kind"), F.col("value").alias("flux"), (micros / 1e6).alias("wave")
    )
