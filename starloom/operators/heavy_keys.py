"""Per-key results when a few keys hold most records.

Totals: a count-min sketch (two hashed rows of WIDTH cells, filled by map-side partial sums) names a superset of the keys
that hold at least a given share of any measure: the true sum of a key never exceeds its cells, so no heavy key is missed,
and at most 1/share cells per row and measure can be heavy, which bounds what is broadcast whatever the input size.  The
sketch also holds the grand totals.  Rows of heavy keys are marked by a broadcast join and salted, all others go through
an ordinary shuffle by key, and the two results are united; both are read from one exchange.

Joins: heavy keys are told from a sample by a bounded top-k sketch of hashed keys.  Their rows stay where they are and meet
a broadcast of just those keys' right rows, whose number is counted first; beyond the bound both sides are salted instead.

Columns of the input keep their names and values whatever they are called; internal ones start with __sl_.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.durable import durable

WIDTH = 1 << 12
SALTS = 64
SAMPLED = 0.02  # part of the rows that a join looks at to find its heavy keys; a key missed costs time only, never rows
FEW_ROWS = 100_000  # right rows of all heavy keys together that are broadcast; more of them are joined by salted shuffle


def _cell(key: str, row: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(row)), F.lit(WIDTH)).cast("int")


def usable(value: Column) -> Column:
    """The value as double; null, NaN and negative values become null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (number < 0), None).otherwise(number)


def count_min(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Count-min sketch (sketch_row, cell, all_*, sum_*) of 2 x WIDTH rows; all_* include rows with a null key.

    Measures must be non-negative; nulls add nothing.  An empty table has an empty sketch.
    """
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("sketch_row"), _cell(key, r).alias("cell")) for r in (0, 1))))
    spread = df.select(rows.alias("__sl_at"), F.col(key).isNotNull().alias("__sl_keyed"), *measures)
    return durable(
        spread.groupBy("__sl_at.sketch_row", "__sl_at.cell").agg(
            *(F.sum(m).alias(f"all_{m}") for m in measures),
            *(F.sum(F.when(F.col("__sl_keyed"), F.col(m))).alias(f"sum_{m}") for m in measures),
        )
    )


def _grand(sketch: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row with the grand total of each measure; null for no usable value."""
    return sketch.filter("sketch_row = 0").agg(*(F.sum(f"all_{m}").alias(f"__sl_all_{m}") for m in measures))


def heavy_cells(sketch: DataFrame, measures: Sequence[str], share: float) -> DataFrame:
    """Sketch cells (sketch_row, cell) that hold at least share of some measure: at most 1/share per row and measure."""
    heavy = reduce(
        lambda a, b: a | b,
        ((F.col(f"sum_{m}") > 0) & (F.col(f"sum_{m}") >= F.col(f"__sl_all_{m}") * F.lit(share)) for m in measures),
    )
    joined = sketch.join(F.broadcast(_grand(sketch, measures)), F.lit(True))  # one row
    return joined.filter(F.coalesce(heavy, F.lit(False))).select("sketch_row", "cell")


def _totals(df: DataFrame, key: str, measures: Sequence[str], cells: DataFrame) -> DataFrame:
    """(key, n_rows, measures, is_heavy) of all keys: salted for the keys in heavy cells, by ordinary shuffle for the others."""
    first = F.broadcast(cells.filter("sketch_row = 0").select(F.col("cell").alias("__sl_c0"), F.lit(True).alias("__sl_h0")))
    second = F.broadcast(cells.filter("sketch_row = 1").select(F.col("cell").alias("__sl_c1"), F.lit(True).alias("__sl_h1")))
    marked = (
        df.select(F.col(key).alias("__sl_key"), *measures)
        .filter("__sl_key is not null")
        .withColumns({"__sl_c0": _cell("__sl_key", 0), "__sl_c1": _cell("__sl_key", 1)})
        .join(first, "__sl_c0", "left")
        .join(second, "__sl_c1", "left")
        .withColumn("__sl_heavy", F.col("__sl_h0").isNotNull() & F.col("__sl_h1").isNotNull())
    )
    salt = F.when(F.col("__sl_heavy"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1)
    # the flag is an aggregate and no grouping column, so that the filters below stay above the one exchange they share
    parts = marked.groupBy("__sl_key", salt.alias("__sl_salt")).agg(
        F.count(F.lit(1)).alias("__sl_n"), *(F.sum(m).alias(m) for m in measures), F.max("__sl_heavy").alias("__sl_heavy")
    )
    sums = [F.sum("__sl_n").alias("__sl_n"), *(F.sum(m).alias(m) for m in measures)]
    merged = parts.filter("__sl_heavy").groupBy("__sl_key").agg(*sums).withColumn("__sl_heavy", F.lit(True))
    light = parts.filter("not __sl_heavy").select("__sl_key", "__sl_n", *measures, "__sl_heavy")
    united = merged.unionByName(light)
    return united.select(F.col("__sl_key").alias(key), F.col("__sl_n").alias("n_rows"), *measures, F.col("__sl_heavy").alias("is_heavy"))


def skewed_totals(df: DataFrame, key: str, measures: Sequence[str], share: float = 0.01) -> DataFrame:
    """Per-key row counts and sums without a straggling task: heavy keys salted, light keys by ordinary shuffle, united.

    Rows with a null key are left out; nulls in a measure add nothing and a key with nulls only gets null.
    """
    rows = df.select(key, *measures, F.lit(1.0).alias("__sl_one"))
    sketch = count_min(rows, key, ["__sl_one", *measures])
    return _totals(rows, key, measures, heavy_cells(sketch, ["__sl_one", *measures], share))


def heavy_totals(df: DataFrame, key: str, measures: Sequence[str], share: float) -> DataFrame:
    """(key, measure, total, grand_total) of every key that holds at least share of a measure's grand total.

    The totals of all keys, heavy and light, are held against the grand totals of the sketch.  These run over all rows,
    those without a key included; a measure that sums to zero has no heavy key.  Ties at exactly the share count as heavy.
    Repeated rows count as often as they occur.
    """
    sketch = count_min(df, key, measures)
    totals = _totals(df, key, measures, heavy_cells(sketch, measures, share))
    known = totals.join(F.broadcast(_grand(sketch, measures)), F.lit(True))  # one row
    reached = {m: (F.col(f"__sl_all_{m}") > 0) & (F.col(m) >= F.col(f"__sl_all_{m}") * F.lit(share)) for m in measures}
    entry = lambda m: F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("total"), F.col(f"__sl_all_{m}").cast("double").alias("grand_total"))
    entries = F.array_compact(F.array(*(F.when(reached[m], entry(m)) for m in measures)))
    return known.select(key, F.explode(entries).alias("__sl_e")).select(key, "__sl_e.*")


def key_hash(key: str) -> Column:
    """The 64-bit number by which a key is told heavy or light; both sides of a join use it, so a clash loses nothing."""
    return F.xxhash64(F.col(key))


def heavy_hashes(sampled: DataFrame, key: str, share: float) -> list[int]:
    """Hashes of the keys that hold at least share of the sampled rows, by one bounded top-k sketch: at most 1/share numbers."""
    most = int(1 / share)
    sketch = F.expr(f"approx_top_k(__sl_h, {most}, {max(10_000, 10 * most)})")
    row = sampled.select(F.when(F.col(key).isNotNull(), key_hash(key)).alias("__sl_h")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in row["top"] if r["item"] is not None and r["count"] >= share * row["n"]]


def hashes_of_totals(totals: DataFrame, key: str, rows: str, share: float) -> list[int]:
    """Hashes of the keys that hold at least share of all rows, from counts per key (key, rows): at most 1/share numbers."""
    whole = totals.agg(F.sum(rows)).first()[0] or 0
    return [r[0] for r in totals.filter(F.col(rows) >= whole * share).select(key_hash(key)).collect()] if whole else []


def _one_join(a: DataFrame, b: DataFrame, key: str, how: str, condition: str | None, more: Column | None = None) -> DataFrame:
    on = F.expr("`" + key + "` = __sl_right_key" + (f" and ({condition})" if condition else ""))
    return a.join(b.withColumnRenamed(key, "__sl_right_key"), on if more is None else on & more, how).drop("__sl_right_key")


def join_heavy(left: DataFrame, few: DataFrame, key: str, how: str, condition: str | None = None) -> DataFrame:
    """Join the left rows of heavy keys with all right rows of those keys.

    Up to FEW_ROWS right rows are broadcast and the left ones stay where they are; beyond that left rows are salted by
    their partition and the right ones sent to every salt.  Each left row has one salt, so no match is lost or doubled.
    """
    few = durable(few)
    if few.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return _one_join(left, F.broadcast(few), key, how, condition)
    salted = left.withColumn("__sl_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = few.withColumn("__sl_right_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _one_join(salted, copies, key, how, condition, F.col("__sl_salt") == F.col("__sl_right_salt")).drop("__sl_salt", "__sl_right_salt")


def skew_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", condition: str | None = None, share: float = 0.01, hot: list[int] | None = None
) -> DataFrame:
    """Join rows with a table of few rows per key although a few keys hold most rows of the left side.

    Heavy keys (at most 1/share) are told from a sample of the left rows, unless their hashes are known (hot).  Heavy keys are joined by join_heavy, others by shuffle.  Without heavy keys it is one
    ordinary join.  how: inner, left, left_semi or left_anti.  condition: a further SQL condition on columns of both
    sides, whose names must differ but for the key.  A null key matches nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how = {how!r}")
    if hot is None:
        hot = heavy_hashes(left.select(key).sample(SAMPLED, seed=1), key, share)
    if not hot:
        return _one_join(left, right, key, how, condition)
    is_hot = F.col(key).isNotNull() & key_hash(key).isin(hot)
    light = _one_join(left.filter(~is_hot), right.filter(~is_hot), key, how, condition)
    return join_heavy(left.filter(is_hot), right.filter(is_hot), key, how, condition).unionByName(light)
