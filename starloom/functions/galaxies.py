"""Ids and paths in their plain form, as Column expressions (whole-stage code, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how galaxy and unit ids are written; separators, padding, case and prefixes vary.
GALAXY_PATTERN = r"(?i)tng50[-_]0*(\d+)[-_]0*(\d+)"
UNIT_PATTERN = r"(?i)tng50[-_]0*(\d+)[-_]0*(\d+)[-_]0*(\d+)[-_]0*(\d+)"

# What stands for "no path", after trimming.
PATH_PLACEHOLDERS = ["", "-", "nan", "NaN", "None", "none", "null", "NULL", "N/A", "n/a"]


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def galaxy_id(text: Column | None = None, snapshot: Column | None = None, subhalo_id: Column | None = None) -> Column:
    """TNG50-<snapshot>-<subhalo_id> from the number columns, else from any writing of the id; null if neither names a galaxy."""
    forms = []
    if snapshot is not None and subhalo_id is not None:
        forms.append(F.concat(F.lit("TNG50-"), snapshot.cast("string"), F.lit("-"), subhalo_id.cast("string")))
    if text is not None:
        forms.append(F.concat(F.lit("TNG50-"), _part(text, GALAXY_PATTERN, 1), F.lit("-"), _part(text, GALAXY_PATTERN, 2)))
    return F.coalesce(*forms)


def canonical_id(text: Column, snapshot: Column, subhalo_id: Column, view: Column, ifu_design: Column) -> Column:
    """TNG50-<snapshot>-<subhalo_id>-<view>-<ifu_design>, from the text where it parses, else from the number columns."""
    parsed = F.concat_ws("-", F.lit("TNG50"), *(_part(text, UNIT_PATTERN, k) for k in (1, 2, 3, 4)))
    built = F.concat(F.lit("TNG50"), *(F.concat(F.lit("-"), c.cast("string")) for c in (snapshot, subhalo_id, view, ifu_design)))
    return F.when(text.rlike(UNIT_PATTERN), parsed).otherwise(built)


def named_galaxies(views: Column) -> Column:
    """Array of the galaxies (plain form) that the entries of a views list name, directly or by a unit; empty for none or null."""
    plain = F.lower(F.coalesce(views, F.lit("")))
    names = F.regexp_extract_all(plain, F.lit(r"(tng50[-_]\d+[-_]\d+)"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda x: galaxy_id(x)))


def plain_path(path: Column) -> Column:
    """One writing per file: outer white space, file:// and ./ dropped, separators unified, dir/.. resolved; case kept.

    A null, blank or placeholder path gives null.
    """
    text = F.regexp_replace(path, r"^[\s\x00]+|[\s\x00]+$", "")
    text = F.when(text.isin(PATH_PLACEHOLDERS), None).otherwise(text)
    text = F.regexp_replace(F.translate(text, "\\", "/"), r"^(?i:file):/+", "/")
    flat = F.regexp_replace(F.regexp_replace(text, r"(?:/\.)+(?=/|$)", ""), r"/{2,}", "/")
    steps = F.filter(F.split(text, "/"), lambda s: ~s.isin("", "."))
    resolved = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(
            F.concat(kept, F.array(s))
        ),
    )
    root = F.when(text.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    usual = path.rlike(r"^(?:/[A-Za-z0-9_][^/\\\s]*)+$")  # already plain: nothing else needs to be looked at
    return F.when(usual, path).when(text.contains(".."), F.concat(root, F.array_join(resolved, "/"))).otherwise(flat)
