"""Round trips through text and partitioned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.plans.registry import Registry
from starloom.sources import files as S
from starloom.sources.tables import table
from starloom.streaming.events import scratch_folder

registry = Registry()
query = registry.query

CATALOG = {
    "listing_id": (["listing_id"], "bigint"),
    "subhalo_id": (["subhalo", "subhalo_id"], "bigint"),
    "ifu_design": (["manga_ifu_dsn", "ifu_design"], "int"),
    "n_star_part": (["n_star_part"], "bigint"),
    "estimated_raw_mb": (["estimated_raw_mb"], "double"),
}


@query("csv_catalog", "SELECT listing_id, subhalo_id, ifu_design, n_star_part, CASE WHEN estimated_raw_mb::VARCHAR <> 'nan' THEN estimated_raw_mb END AS estimated_raw_mb FROM wave2_manifest")
def csv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written as CSV and read again under aliased column names."""
    folder = f"{scratch_folder(spark, 'catalog')}/catalog.csv"
    S.write_csv(table(spark, sf_dir, "wave2_manifest").withColumnRenamed("ifu_design", "manga_ifu_dsn"), folder, ["listing_id", "subhalo_id", "manga_ifu_dsn", "n_star_part", "estimated_raw_mb"])
    return S.read_catalog(spark, folder, CATALOG, ["listing_id"])


@query("partitioned_product", "SELECT snapshot, count(*) AS n, max(subhalo_id) AS last_subhalo FROM wave2_strata WHERE snapshot >= 88 GROUP BY 1")
def partitioned_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product written by snapshot; the filter prunes folders."""
    folder = f"{scratch_folder(spark, 'product')}/strata"
    S.write_product(table(spark, sf_dir, "wave2_strata").select("snapshot", "subhalo_id"), folder, ["snapshot"])
    found = spark.read.parquet(folder).filter("snapshot >= 88")
    return found.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.max("subhalo_id").alias("last_subhalo"))


@query("listed_products", "SELECT DISTINCT snapshot, true AS has_files FROM wave2_strata")
def listed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots for which a written product has files, from the listing of its folders alone."""
    folder = f"{scratch_folder(spark, 'listed')}/strata"
    S.write_product(table(spark, sf_dir, "wave2_strata").select("snapshot", "subhalo_id"), folder, ["snapshot"])
    found = S.list_files(spark, folder, "*.parquet").filter("length > 0")
    snapshot = F.regexp_extract("path", r"snapshot=(\d+)", 1).cast("int")
    return found.groupBy(snapshot.alias("snapshot")).agg((F.count(F.lit(1)) > 0).alias("has_files"))


@query("json_report", "SELECT ifu_design, count(*) AS n FROM wave2_manifest GROUP BY 1")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as JSON lines and read with a schema."""
    folder = f"{scratch_folder(spark, 'report')}/report"
    S.write_report(table(spark, sf_dir, "wave2_manifest").groupBy("ifu_design").agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.schema("ifu_design int, n bigint").json(folder)


@query("best_files", "SELECT regexp_extract(path, '([^/\\\\]+)$', 1) AS name, max(n_bytes) AS n_bytes FROM cube_files WHERE n_bytes IS NOT NULL GROUP BY 1")
def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest stored file of each name."""
    rows = table(spark, sf_dir, "cube_files").filter("n_bytes is not null")
    named = rows.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), "n_bytes", "path")
    return S.best_listing(named, ["name"], "n_bytes", "path").select("name", "n_bytes")


@query("wide_union", "SELECT 'cube' AS kind, count(*) AS n, count(deleted_at) AS n_deleted, 0::BIGINT AS n_bench FROM cube_files UNION ALL SELECT 'item', count(*), 0, count(bench) FROM eval_items")
def wide_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns in one."""
    files = table(spark, sf_dir, "cube_files").select(F.lit("cube").alias("kind"), "file_id", "deleted_at")
    items = table(spark, sf_dir, "eval_items").select(F.lit("item").alias("kind"), "item_id", "bench")
    both = S.union_by_name([files, items])
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("n_deleted"), F.count("bench").alias("n_bench"))
