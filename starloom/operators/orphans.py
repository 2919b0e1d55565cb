"""References to records that do not exist: composite keys with partial nulls and validity in time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.heavy_keys import SAMPLED, heavy_hashes, join_heavy, key_hash, skew_join
from starloom.plans.durable import durable


def null_masks(refs: DataFrame, keys: Sequence[str], match: str = "simple") -> list[tuple[tuple[str, ...], DataFrame]]:
    """References grouped by which key columns are filled: (filled columns, references) for each mask that needs a check.

    match follows SQL: simple takes a reference with any null as satisfied, partial checks the filled columns only, full
    takes an all-null reference as satisfied and a partly null one as an orphan by itself (returned with no columns).
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match = {match!r}")
    found = []
    for mask in product((True, False), repeat=len(keys)):
        filled = tuple(k for k, on in zip(keys, mask, strict=True) if on)
        if not filled or (match == "simple" and len(filled) < len(keys)):
            continue
        condition = F.lit(True)
        for k, on in zip(keys, mask, strict=True):
            condition = condition & (F.col(k).isNotNull() if on else F.col(k).isNull())
        part = refs.filter(condition)
        found.append((filled if match != "full" or len(filled) == len(keys) else (), part))
    return found


def orphan_references(refs: DataFrame, parents: DataFrame, keys: Sequence[str], match: str = "simple") -> DataFrame:
    """The references without a parent, each mask of null key columns anti-joined on its filled columns.

    Parent rows with a null in a filled column match nothing.  Repeated references stay repeated.  Columns of refs only.
    """
    parts = []
    for filled, part in null_masks(refs, keys, match):
        if not filled:
            parts.append(part)
            continue
        keyed = part.withColumn("__sl_k", F.struct(*filled))
        known = parents.dropna(subset=list(filled)).select(F.struct(*filled).alias("__sl_k")).distinct()
        parts.append(skew_join(keyed, known, "__sl_k", "left_anti").select(*refs.columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def live_spells(files: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merged spells (keys, live_from, live_to) in which a key is live, from possibly overlapping registrations.

    A spell runs from start until before end; a null end never ends (live_to is then the largest timestamp), an empty
    spell is dropped.  The running maximum of the ends is built over days of a key first and inside a day second, so that
    a key with very many registrations is not sorted in one task.
    """
    forever = F.lit("9999-12-31 00:00:00").cast(files.schema[end].dataType)
    rows = (
        files.select(*keys, F.col(start).alias("live_from"), F.coalesce(F.col(end), forever).alias("live_to"))
        .filter("live_from is not null and live_to > live_from")
        .distinct()
        .withColumn("_day", F.to_date("live_from"))
    )
    days = rows.groupBy(*keys, "_day").agg(F.max("live_to").alias("_day_to"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_carry", F.max("_day_to").over(before)).drop("_day_to")
    inside = Window.partitionBy(*keys, "_day").orderBy("live_from", "live_to").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.join(days, [*keys, "_day"]).withColumn("_seen", F.greatest("_carry", F.max("live_to").over(inside)))
    starts = seen.withColumn("_new", (F.col("_seen").isNull() | (F.col("_seen") < F.col("live_from"))).cast("int"))
    # only the first row of a spell and the end before it matter from here on: few rows per key
    heads = starts.filter("_new = 1").select(*keys, "live_from", F.col("_seen").alias("_last_to"))
    last = rows.groupBy(*keys).agg(F.max("live_to").alias("_final_to"))
    following = Window.partitionBy(*keys).orderBy("live_from")
    return (
        heads.withColumn("_next_to", F.lead("_last_to").over(following))
        .join(last, list(keys))
        .select(*keys, "live_from", F.coalesce("_next_to", "_final_to").alias("live_to"))
    )


def _thinned(spells: DataFrame, key: str, start: str, end: str, sampled: DataFrame, share: float = 0.001) -> DataFrame:
    """Registrations of keys with very many of them merged into spells; those of all other keys as they are."""
    many = heavy_hashes(sampled, key, share)
    if not many:
        return spells
    is_hot = key_hash(key).isin(many)
    merged = live_spells(spells.filter(is_hot), [key], start, end).select(key, F.col("live_from").alias(start), F.col("live_to").alias(end))
    return spells.filter(~is_hot).unionByName(merged)


def _with_reasons(keyed: DataFrame, known: DataFrame, hot: list[int]) -> DataFrame:
    """Rows of keyed (__sl_k, __sl_at, ...) without a spell of known (__sl_k, __sl_from, __sl_to) around their time, with __sl_first.

    __sl_first is the first start of the key, null if there is none.  References of hot keys are neither shuffled for the
    anti-join nor for the reason: both meet a broadcast of the hot keys' spells (counted first) and first starts (one row
    per hot key).  The others and all their spells are shuffled by key once, for both.
    """
    around = "__sl_from <= __sl_at and __sl_at < __sl_to"

    def firsts(spells: DataFrame) -> DataFrame:
        return spells.groupBy("__sl_k").agg(F.min("__sl_from").alias("__sl_first"), F.max("__sl_to").alias("__sl_last"))

    def absent(refs: DataFrame, spells: DataFrame) -> DataFrame:
        right = spells.withColumnRenamed("__sl_k", "__sl_right_key")
        return refs.join(right, F.expr(f"__sl_k = __sl_right_key and {around}"), "left_anti")

    is_hot = key_hash("__sl_k").isin(hot) if hot else F.lit(False)
    spells = known.filter(~is_hot).repartition("__sl_k")  # the one exchange of the spells, read by both joins
    judged = absent(keyed.filter(~is_hot), spells).join(firsts(spells), "__sl_k", "left")
    if hot:
        few = durable(known.filter(is_hot))
        lost = join_heavy(keyed.filter(is_hot), few, "__sl_k", "left_anti", around)
        judged = judged.unionByName(lost.join(F.broadcast(firsts(few)), "__sl_k", "left"))  # one row per hot key
    return judged


def dated_orphans(
    refs: DataFrame,
    files: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    match: str = "simple",
    samples: tuple[DataFrame, DataFrame] | None = None,
    share: float = 0.01,
) -> DataFrame:
    """References whose key is not live at their own time, with reason deleted, late or missing.

    deleted: live earlier; late: registered only afterwards; missing: never registered.  A reference without a time can't
    be placed and is no orphan.  Null keys follow match (see null_masks).  Result: columns of refs and reason; a column
    of refs that is itself called reason is left out, other names may be any.  Keys with many references or files are
    told from samples (rows of refs and of files with the key columns; drawn here unless given).
    """
    refs = refs.drop("reason")
    forever = F.lit("9999-12-31 00:00:00").cast(files.schema[end].dataType)
    drawn = samples or (refs.select(*keys).sample(SAMPLED, seed=1), files.select(*keys).sample(SAMPLED, seed=2))
    parts = []
    for filled, part in null_masks(refs.filter(F.col(at).isNotNull()), keys, match):
        if not filled:
            parts.append(part.withColumn("reason", F.lit("missing")))
            continue
        by_key = lambda df: df.dropna(subset=list(filled)).select(F.struct(*filled).alias("__sl_k"))  # noqa: B023, E731
        spells = (
            files.dropna(subset=list(filled))
            .select(F.struct(*filled).alias("__sl_k"), F.col(start).alias("__sl_from"), F.coalesce(F.col(end), forever).alias("__sl_to"))
            .filter("__sl_from is not null and __sl_to > __sl_from")
        )
        known = _thinned(spells, "__sl_k", "__sl_from", "__sl_to", by_key(drawn[1]))
        # the key columns travel once, inside the key
        others = [F.col(c) for c in refs.columns if c not in filled and c != at]
        keyed = part.select(F.struct(*filled).alias("__sl_k"), F.col(at).alias("__sl_at"), *others)
        judged = _with_reasons(keyed, known, heavy_hashes(by_key(drawn[0]), "__sl_k", share))
        reason = (
            F.when(F.col("__sl_first").isNull() | F.col("__sl_last").isNull(), "missing").when(F.col("__sl_first") <= F.col("__sl_at"), "deleted").otherwise("late")
        )
        back = {**{c: F.col(f"__sl_k.`{c}`") for c in filled}, at: F.col("__sl_at")}
        parts.append(judged.select(*(back.get(c, F.col(c)).alias(c) for c in refs.columns), reason.alias("reason")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
