"""Text sources and sinks: catalogues as CSV with aliased columns, typed manifests, JSON reports, partitioned products.

Schemas are always explicit.  A file has no row order in Spark, so an ordinal that matters is a column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def first_filled(df: DataFrame, aliases: Sequence[str], default: object = None) -> Column:
    """The first filled column of those that exist, blanks counting as missing; default where none is."""
    present = [F.nullif(F.trim(F.col(f"`{a}`")), F.lit("")) for a in aliases if a in df.columns]
    return F.coalesce(*present, F.lit(default).cast("string")) if present else F.lit(default).cast("string")


def whole_number(text: Column) -> Column:
    """Integer from text such as 37 or 37.0; null for anything else."""
    return text.try_cast("double").try_cast("bigint")


def read_catalog(spark: SparkSession, path: str, columns: Mapping[str, tuple[Sequence[str], str]], required: Sequence[str] = ()) -> DataFrame:
    """A catalogue by suffix (.csv, .json, .orc, else Parquet) with columns name -> (aliases, type).

    Text that is no number of the wanted type becomes null; rows without a required column are left out.
    """
    suffix = PurePosixPath(path).suffix
    if suffix == ".csv":
        raw = read_text_table(spark, path)
    elif suffix == ".json":
        raw = spark.read.json(path)
    elif suffix == ".orc":
        raw = spark.read.orc(path)
    else:
        raw = spark.read.parquet(path)
    raw = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns))
    picked = []
    for name, (aliases, kind) in columns.items():
        text = first_filled(raw, aliases)
        value = whole_number(text).try_cast(kind) if kind in ("int", "bigint") else text.try_cast(kind)
        picked.append(value.alias(name))
    return raw.select(*picked).dropna(subset=list(required)) if required else raw.select(*picked)


def check_schema(df: DataFrame, required: Mapping[str, str]) -> list[str]:
    """What a table lacks: missing columns and columns of another type, in the given order."""
    kinds = dict(df.dtypes)
    return [f"{c}: missing" if c not in kinds else f"{c}: {kinds[c]}" for c, kind in required.items() if kinds.get(c) != kind]


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV in a fixed column order; null and NaN are empty fields."""
    kinds = {f.name: f.dataType for f in df.schema}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in columns]
    df.select(*clean).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_product(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """A product as Parquet, one folder per value of the partition columns, each written by the tasks that hold its rows."""
    df.repartition(*partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; a column that a table lacks is null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def best_listing(files: DataFrame, keys: Sequence[str], score: str, path: str) -> DataFrame:
    """One file per key: the highest score, then the last path in text order."""
    return files.groupBy(*keys).agg(F.max(F.struct(score, path)).alias("_best")).select(*keys, "_best.*")


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; the contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))
