"""Queries of the operators for language-model training data and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.galaxies import canonical_id, galaxy_id, named_galaxies
from starloom.llm import corpus_tokens, group_splits, leak_search, quota_sample, reading_level, stable_sample
from starloom.operators.components import connected_components
from starloom.operators.heavy_keys import skew_join
from starloom.plans.durable import durable, shared_folder
from starloom.plans.registry import Registry
from starloom.sources.tables import table

registry = Registry()

# --- p1: a sample matching target category proportions

SAMPLE_FRACTION = 0.2
TREE = ["stratum", "barred"]
SEED = 20250101

# Writings of the strata and of yes and no.
STRATUM_NAMES = {"disk": "disk", "disc": "disk", "disco": "disk", "bulge": "bulge", "bulbo": "bulge", "halo": "halo", "mixed": "mixed", "mixto": "mixed"}
YES, NO = ["true", "t", "1", "yes"], ["false", "f", "0", "no"]


def classified_galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """galaxy_id, stratum, barred, bulge_frac of each galaxy's current row; what can't be told is null.

    One missing fraction is what the other two leave of 1, fractions above 1 are percentages, and a missing stratum is the
    family above one half, else mixed.
    """
    rows = table(spark, sf_dir, "wave2_strata").select(
        "strata_id", "snapshot", "subhalo_id", "stratum", "barred", "bulge_frac", "disk_frac", "halo_frac", "classified_at"
    )
    current = quota_sample.latest_rows(rows, ["snapshot", "subhalo_id"], ["classified_at", "strata_id"])
    fracs = ["bulge_frac", "disk_frac", "halo_frac"]
    clean = current.withColumns({f: F.when(~F.isnan(f) & (F.col(f) >= 0), F.col(f)) for f in fracs})
    scale = F.when(F.greatest(*fracs) > 1, 100.0).otherwise(1.0)
    clean = clean.withColumns({f: F.col(f) / scale for f in fracs})
    for f in fracs:
        others = [F.col(o) for o in fracs if o != f]
        clean = clean.withColumn(f"_{f}", F.round(F.coalesce(F.col(f), 1 - others[0] - others[1]), 6))
    told = F.trim(F.lower(F.regexp_replace("stratum", r"\s", "")))
    named = F.element_at(F.create_map(*(F.lit(x) for pair in STRATUM_NAMES.items() for x in pair)), told)
    family = (
        F.when(F.col("_bulge_frac").isNull() | F.col("_disk_frac").isNull() | F.col("_halo_frac").isNull(), None)
        .when(F.col("_bulge_frac") > 0.5, "bulge")
        .when(F.col("_disk_frac") > 0.5, "disk")
        .when(F.col("_halo_frac") > 0.5, "halo")
        .otherwise("mixed")
    )
    said = F.lower(F.trim("barred"))
    return clean.select(
        galaxy_id(None, F.col("snapshot"), F.col("subhalo_id")).alias("galaxy_id"),
        F.coalesce(named, family).alias("stratum"),
        F.when(said.isin(YES), True).when(said.isin(NO), False).alias("barred"),
        F.col("_bulge_frac").alias("bulge_frac"),
    )


def placed_galaxies(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed galaxies with their target_id, report per target); keep stores the placed galaxies, which a draw reads thrice."""
    galaxies = classified_galaxies(spark, sf_dir)
    targets = table(spark, sf_dir, "strata_targets")
    placed = quota_sample.place(galaxies, targets, TREE, "bulge_frac", "bulge_lo", "bulge_hi")
    placed = durable(placed.select("target_id", "galaxy_id")) if keep else placed
    n_all = table(spark, sf_dir, "wave2_strata").agg(F.count_distinct("snapshot", "subhalo_id").alias("n"))
    return placed, quota_sample.quota_report(placed, n_all, targets, TREE, SAMPLE_FRACTION)


_FRACTIONS = ("bulge_frac", "disk_frac", "halo_frac")
_CLEAN = ", ".join(f"CASE WHEN NOT isnan({f}) AND {f} >= 0 THEN {f} / sc END AS {f[0]}" for f in _FRACTIONS)
_SCALE = "CASE WHEN greatest(" + ", ".join(f"CASE WHEN NOT isnan({f}) THEN {f} END" for f in _FRACTIONS) + ") > 1 THEN 100.0 ELSE 1.0 END"
PLACED_SQL = f"""WITH c AS (SELECT *, {_SCALE} AS sc FROM wave2_strata
 QUALIFY row_number() OVER (PARTITION BY snapshot, subhalo_id ORDER BY classified_at DESC NULLS LAST, strata_id DESC) = 1),
d AS (SELECT *, {_CLEAN} FROM c),
e AS (SELECT *, round(coalesce(b, 1 - d - h), 6) AS bb, round(coalesce(d, 1 - b - h), 6) AS dd, round(coalesce(h, 1 - b - d), 6) AS hh FROM d),
g AS (SELECT 'TNG50-' || snapshot || '-' || subhalo_id AS galaxy_id, bb,
 coalesce(CASE lower(regexp_replace(stratum, '\\s', '', 'g')) WHEN 'disk' THEN 'disk' WHEN 'disc' THEN 'disk' WHEN 'disco' THEN 'disk'
  WHEN 'bulge' THEN 'bulge' WHEN 'bulbo' THEN 'bulge' WHEN 'halo' THEN 'halo' WHEN 'mixed' THEN 'mixed' WHEN 'mixto' THEN 'mixed' END,
  CASE WHEN bb IS NULL OR dd IS NULL OR hh IS NULL THEN NULL WHEN bb > 0.5 THEN 'bulge' WHEN dd > 0.5 THEN 'disk' WHEN hh > 0.5 THEN 'halo' ELSE 'mixed' END) AS st,
 CASE WHEN lower(trim(barred)) IN ('true', 't', '1', 'yes') THEN true WHEN lower(trim(barred)) IN ('false', 'f', '0', 'no') THEN false END AS br FROM e),
placed AS (SELECT t.target_id, g.galaxy_id FROM g JOIN strata_targets t ON g.st = t.stratum AND g.br = t.barred AND g.bb >= t.bulge_lo AND g.bb < t.bulge_hi),
need AS (SELECT t.*, greatest(min_rows::DOUBLE, round(target_share * (SELECT count(DISTINCT (snapshot, subhalo_id)) FROM wave2_strata) * {SAMPLE_FRACTION}, 9)) AS needed,
 (SELECT count(*) FROM placed p WHERE p.target_id = t.target_id) AS available FROM strata_targets t) """


@registry.query("p1_found", PLACED_SQL + "SELECT target_id FROM need WHERE available < needed")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = placed_galaxies(spark, sf_dir)
    return report.filter("not is_met").select("target_id")


@registry.query(
    "p1_report",
    PLACED_SQL + "SELECT target_id, needed, available, ceil(needed)::BIGINT AS quota, greatest(ceil(needed)::BIGINT - available, 0) AS own_gap, available >= needed AS is_met FROM need",
)
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target needs and has."""
    _, report = placed_galaxies(spark, sf_dir)
    whole = F.ceil("needed").cast("bigint")  # of the target by itself; p1_allocation has the quotas of the tree
    gap = F.greatest(whole - F.col("available"), F.lit(0))
    return report.select("target_id", "needed", "available", whole.alias("quota"), gap.alias("own_gap"), "is_met")


def _quota_sql() -> str:
    """Quotas from the sample size down to stratum, barred and target_id; a node's children add up to its quota."""
    path = ["stratum", "barred", "target_id"]
    steps = [
        f", k0 AS (SELECT greatest(round(any_value(n) * {SAMPLE_FRACTION}), sum(min_rows))::DOUBLE AS quota FROM strata_targets, (SELECT count(DISTINCT (snapshot, subhalo_id)) AS n FROM wave2_strata))"
    ]
    for d in range(1, 4):
        by, above = ", ".join(path[:d]), ", ".join(path[: d - 1])
        over = f"PARTITION BY {above}" if above else ""
        steps.append(
            f", a{d} AS (SELECT {by}, sum(target_share) AS s, sum(min_rows)::DOUBLE AS m FROM strata_targets GROUP BY {by}), "
            f"b{d} AS (SELECT a{d}.*, quota FROM a{d} {f'JOIN k{d - 1} USING ({above})' if above else ', k0'}), "
            f"c{d} AS (SELECT *, greatest(quota * s / sum(s) OVER ({over}) - m, 0) AS over_min FROM b{d}), "
            f"d{d} AS (SELECT *, sum(over_min) OVER ({over}) AS whole, sum(over_min) OVER ({over} ORDER BY {path[d - 1]}) AS upto, quota - sum(m) OVER ({over}) AS rest FROM c{d}), "
            f"k{d} AS (SELECT {by}, m + coalesce(floor(round(rest * upto / nullif(whole, 0), 6)) - floor(round(rest * (upto - over_min) / nullif(whole, 0), 6)), 0) AS quota FROM d{d})"
        )
    return "".join(steps)


def _allocation_sql() -> str:
    """Quotas from the tree, passed on within both tree columns, then the first, then the whole tree."""
    steps = [
        PLACED_SQL,
        _quota_sql(),
        ", q AS (SELECT need.*, k3.quota::HUGEINT AS quota FROM need JOIN k3 USING (target_id)), l0 AS (SELECT *, least(quota, available)::HUGEINT AS allocated, greatest(quota - available, 0)::HUGEINT AS unmet, "
        "greatest(available - quota, 0)::HUGEINT AS spare, 0::HUGEINT AS received FROM q)",
    ]
    for n, by in enumerate(("stratum, barred", "stratum", "1"), 1):
        steps.append(
            f", w{n} AS (SELECT *, sum(unmet) OVER (PARTITION BY {by}) AS u, sum(spare) OVER (PARTITION BY {by}) AS s, sum(unmet) OVER (PARTITION BY {by} ORDER BY target_id) AS ut, "
            f"sum(spare) OVER (PARTITION BY {by} ORDER BY target_id) AS st FROM l{n - 1}), "
            f"g{n} AS (SELECT *, least(u, s) AS give FROM w{n}), "
            f"p{n} AS (SELECT *, CASE WHEN s > 0 THEN give * st // s - give * (st - spare) // s ELSE 0 END AS more, CASE WHEN u > 0 THEN give * ut // u - give * (ut - unmet) // u ELSE 0 END AS less FROM g{n}), "
            f"l{n} AS (SELECT target_id, stratum, barred, target_share, quota, available, allocated + more AS allocated, unmet - less AS unmet, spare - more AS spare, received + more AS received FROM p{n})"
        )
    return "".join(steps)


ALLOCATION_SQL = _allocation_sql()


@registry.query(
    "p1_allocation",
    ALLOCATION_SQL
    + " SELECT target_id, quota::BIGINT AS quota, available, allocated::BIGINT AS allocated, received::BIGINT AS received, greatest(quota - available, 0)::BIGINT AS own_gap, unmet::BIGINT AS shortfall, "
    "target_share AS wanted_share, round(allocated::DOUBLE / sum(allocated) OVER (), 9) AS achieved_share FROM l3",
)
def p1_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target was allocated after unmet quota was passed to siblings, cousins and the rest of the tree, and its share."""
    _, report = placed_galaxies(spark, sf_dir)
    counts = ["quota", "available", "allocated", "received", "own_gap", "shortfall"]
    return report.select("target_id", *counts, "wanted_share", F.round("achieved_share", 9).alias("achieved_share"))


@registry.query(
    "p1_sample",
    ALLOCATION_SQL
    + f", r AS (SELECT target_id, galaxy_id, row_number() OVER (PARTITION BY target_id ORDER BY ('0x' || substr(md5('{SEED}:' || galaxy_id), 1, 15))::BIGINT, galaxy_id) AS draw_rank FROM placed) "
    "SELECT r.target_id, r.galaxy_id, r.draw_rank FROM r JOIN l3 USING (target_id) WHERE r.draw_rank <= l3.allocated",
)
def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: target_id, galaxy_id, draw_rank."""
    placed, report = placed_galaxies(spark, sf_dir, keep=True)
    return quota_sample.draw(placed, report, "galaxy_id", SEED)


# --- p3: a reproducible sample that is stable as data grows

# Parameter: the rate in force from each month on (months since year 0); an epoch's rate is never changed afterwards.
EPOCH_RATES = [(2025 * 12, 0.25), (2025 * 12 + 3, 0.20), (2025 * 12 + 6, 0.15), (2025 * 12 + 9, 0.10)]

MIDYEAR = "2025-07-01 00:00:00"  # parameter: arrivals from here on are the ledger's second batch


def epoch_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EPOCH_RATES, "epoch int, rate double")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, seen_at) of the units of manifest, by received_at, and of the galaxies of wave2_manifest, by listed_at."""
    units = table(spark, sf_dir, "manifest").select(
        canonical_id(F.col("canonical_id"), F.col("snapshot"), F.col("subhalo_id"), F.col("view"), F.col("ifu_design")).alias("record_id"),
        F.col("received_at").alias("seen_at"),
    )
    galaxies = table(spark, sf_dir, "wave2_manifest").select(
        galaxy_id(F.col("galaxy_id"), F.col("snapshot"), F.col("subhalo_id")).alias("record_id"), F.col("listed_at").alias("seen_at")
    )
    return units.unionByName(galaxies)


_UNIT = "(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)[-_]0*(\\d+)"
_RATE = "CASE " + " ".join(f"WHEN epoch >= {e} THEN {r}" for e, r in reversed(EPOCH_RATES)) + f" ELSE {EPOCH_RATES[0][1]} END"


@registry.query(
    "p3_sample",
    f"""WITH a AS (SELECT CASE WHEN regexp_matches(canonical_id, '{_UNIT}') THEN 'TNG50-' || regexp_extract(canonical_id, '{_UNIT}', 1) || '-' ||
 regexp_extract(canonical_id, '{_UNIT}', 2) || '-' || regexp_extract(canonical_id, '{_UNIT}', 3) || '-' || regexp_extract(canonical_id, '{_UNIT}', 4)
 ELSE 'TNG50-' || snapshot || '-' || subhalo_id || '-' || view || '-' || ifu_design END AS record_id, received_at AS seen_at FROM manifest
 UNION ALL SELECT 'TNG50-' || snapshot || '-' || subhalo_id, listed_at FROM wave2_manifest),
f AS (SELECT record_id, (year(min(seen_at)) * 12 + month(min(seen_at)) - 1)::INTEGER AS epoch FROM a WHERE record_id IS NOT NULL AND seen_at IS NOT NULL GROUP BY 1)
SELECT record_id, epoch, ({_RATE})::DOUBLE AS rate FROM f
WHERE ('0x' || substr(md5('{SEED}:0:' || record_id), 1, 13))::BIGINT / 4503599627370496.0 < {_RATE}""",
)
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected units and galaxies with the epoch and frozen rate of their first arrival, from a stored ledger.

    The arrivals before and after MIDYEAR are two batches: the first is written, the second is held against what is stored.
    """
    folder, rows = shared_folder(spark, "ledger"), arrivals(spark, sf_dir)
    early = F.col("seen_at") < F.lit(MIDYEAR).cast("timestamp_ntz")
    stable_sample.append_batch(folder, 1, rows.filter(early), "record_id", "seen_at", epoch_rates(spark))
    ledger = stable_sample.append_batch(folder, 2, rows.filter(~early), "record_id", "seen_at", epoch_rates(spark))
    return stable_sample.selected(ledger, "record_id", SEED).select("record_id", "epoch", "rate")


# --- p4: splits that keep related records together

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def object_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(galaxy_id, other): galaxies that a views entry makes one object."""
    rows = table(spark, sf_dir, "wave2_manifest").filter(F.col("views").rlike("(?i)tng50"))
    return (
        rows.select(
            galaxy_id(F.col("galaxy_id"), F.col("snapshot"), F.col("subhalo_id")).alias("galaxy_id"),
            F.explode(named_galaxies(F.col("views"))).alias("other"),
        )
        .filter("other is not null and other <> galaxy_id")
        .distinct()
    )


def object_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(galaxy_id, group_id) of the galaxies that go by several ids; group_id is the first id in text order."""
    groups = connected_components(object_links(spark, sf_dir), "galaxy_id", "other")
    return groups.select(F.col("node").alias("galaxy_id"), F.col("component").alias("group_id"))


def manifest_galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").select(
        "manifest_id", galaxy_id(F.col("canonical_id"), F.col("snapshot"), F.col("subhalo_id")).alias("galaxy_id")
    )


_NAMED = "(?i)tng50[-_]0*(\\d+)[-_]0*(\\d+)"
GROUPS_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT 'TNG50-' || snapshot || '-' || subhalo_id AS a,
 'TNG50-' || regexp_extract(x, '{_NAMED}', 1) || '-' || regexp_extract(x, '{_NAMED}', 2) AS b
 FROM (SELECT snapshot, subhalo_id, unnest(regexp_extract_all(views, '(?i)tng50[-_]\\d+[-_]\\d+')) AS x FROM wave2_manifest WHERE views IS NOT NULL)),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
grp AS (SELECT a AS galaxy_id, min(b) AS group_id FROM reach GROUP BY a),
m AS (SELECT manifest_id, coalesce('TNG50-' || snapshot || '-' || subhalo_id,
 'TNG50-' || regexp_extract(canonical_id, '{_NAMED}', 1) || '-' || regexp_extract(canonical_id, '{_NAMED}', 2)) AS galaxy_id FROM manifest) """


@registry.query(
    "p4_found",
    GROUPS_SQL
    + """SELECT m.manifest_id, grp.group_id FROM m JOIN grp USING (galaxy_id)
WHERE grp.group_id IN (SELECT group_id FROM m JOIN grp USING (galaxy_id) GROUP BY 1 HAVING count(DISTINCT galaxy_id) >= 2)""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = object_groups(spark, sf_dir)
    records = manifest_galaxies(spark, sf_dir)
    present = records.select("galaxy_id").distinct().join(groups, "galaxy_id")
    several = present.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("group_id")
    return skew_join(records, present.join(several, "group_id"), "galaxy_id").select("manifest_id", "group_id")


@registry.query("p4_splits")
def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, record_id, group_id and split of each record of manifest and wave2_manifest."""
    listed = table(spark, sf_dir, "wave2_manifest").select(
        F.lit("wave2_manifest").alias("source"),
        F.col("listing_id").alias("record_id"),
        galaxy_id(F.col("galaxy_id"), F.col("snapshot"), F.col("subhalo_id")).alias("galaxy_id"),
    )
    delivered = manifest_galaxies(spark, sf_dir).select(F.lit("manifest").alias("source"), F.col("manifest_id").alias("record_id"), "galaxy_id")
    records = skew_join(listed.unionByName(delivered), object_groups(spark, sf_dir), "galaxy_id", "left")
    grouped = records.withColumn("group_id", F.coalesce("group_id", "galaxy_id"))
    return group_splits.group_splits(grouped, "group_id", SPLIT_SHARES).select("source", "record_id", "group_id", "split")


@registry.query(
    "p4_checks",
    GROUPS_SQL
    + """, w AS (SELECT 'TNG50-' || snapshot || '-' || subhalo_id AS galaxy_id FROM wave2_manifest UNION ALL SELECT galaxy_id FROM m),
g AS (SELECT coalesce(group_id, galaxy_id) AS group_id FROM w LEFT JOIN grp USING (galaxy_id))
SELECT count(*) AS n_records, count(DISTINCT group_id) AS n_groups, 0::BIGINT AS n_torn, true AS shares_kept FROM g""",
)
def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of p4_splits: all records have a split, no object is in two, shares are within 3 % of all records."""
    placed = p4_splits(spark, sf_dir)
    groups = placed.groupBy("group_id").agg(F.count_distinct("split").alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in SPLIT_SHARES), F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows")
    kept = [F.abs(F.sum(s) / total - share) <= 0.03 for s, share in SPLIT_SHARES.items()]
    return groups.agg(
        total.alias("n_records"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") != 1).alias("n_torn"), (kept[0] & kept[1] & kept[2]).alias("shares_kept")
    )


# --- p6: encoding of the whole corpus


@registry.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document; null and empty texts have an empty list."""
    return corpus_tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query(
    "p6_round_trip", "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, true AS same FROM documents"
)
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding the ids gives each text back, a null text as an empty one."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = corpus_tokens.decode(corpus_tokens.encode(documents, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    text = F.coalesce("text", F.lit(""))
    return documents.join(back, "doc_id").select(
        "doc_id", F.length(text).cast("bigint").alias("n_chars"), (text == F.col("decoded")).alias("same")
    )


@registry.query(
    "p6_offsets",
    "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, true AS in_order, true AS covered FROM documents",
)
def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tokens' character ranges run in order and cover each text from its first to its last character."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars")
    documents = table(spark, sf_dir, "documents").select(F.struct("doc_id", n).alias("key"), "text")  # the length travels with the key: no join
    found = corpus_tokens.encode_with_offsets(documents, "key", "text")
    within = F.forall(F.zip_with("starts", "ends", lambda a, b: a < b), lambda x: x)
    later, earlier = F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))
    joined = F.forall(F.zip_with(later, earlier, lambda a, b: a <= b), lambda x: x)
    ends = (F.get("starts", F.lit(0)) == 0) & (F.element_at("ends", -1) == F.col("key.n_chars"))
    empty = F.size("ids") == 0
    covered = F.when(empty, F.col("key.n_chars") == 0).otherwise(ends & joined)
    return found.select("key.doc_id", "key.n_chars", (empty | within).alias("in_order"), covered.alias("covered"))


# --- p7: evaluation texts leaking into training text


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


@registry.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id")


@registry.query("p7_items")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents by kind of match and the longest passage."""
    found = leaks(spark, sf_dir)
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("exact", "phrase", "proximity")]
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), *counts, F.max("span").alias("longest_span"))


# --- p8: reading level


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).filter("level is not null").select("doc_id", "level")


@registry.query("p8_profile")
def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and spoken words by language and level."""
    return levels(spark, sf_dir).groupBy("language", "level").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_words").cast("bigint")).alias("n_words")
    )
