"""Skewed keys, orphan references, components and plain forms on small frames: nulls, ties, repeats, empty tables."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from starloom.functions.galaxies import canonical_id, galaxy_id, named_galaxies, plain_path
from starloom.operators import heavy_keys as H
from starloom.operators.components import connected_components
from starloom.operators.orphans import dated_orphans, live_spells, orphan_references


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


KEYED = "key string, a double, b double, cell int, total string"


@pytest.fixture()
def skewed(spark):
    random.seed(3)
    data = [("hot" if random.random() < 0.4 else f"k{random.randrange(300)}", float(random.randrange(10)), None, 1, "x") for _ in range(4000)]
    data += [(None, 5.0, 1.0, 1, "x"), ("nan", float("nan"), -1.0, 1, "x"), ("", 3.0, 2.0, 1, "x")]
    return spark.createDataFrame(data, KEYED).withColumns({"a": H.usable(F.col("a")), "b": H.usable(F.col("b"))})


def test_heavy_totals_are_exact(skewed):
    expected = defaultdict(float)
    whole = defaultdict(float)
    for r in skewed.collect():
        for m in ("a", "b"):
            whole[m] += r[m] or 0
            if r["key"] is not None:
                expected[r["key"], m] += r[m] or 0
    found = {(r["key"], r["measure"]): r["total"] for r in H.heavy_totals(skewed, "key", ["a", "b"], 0.02).collect()}
    assert found == {k: v for k, v in expected.items() if v > 0 and v >= 0.02 * whole[k[1]]}
    assert ("hot", "a") in found and ("", "b") in found


def test_heavy_totals_of_nothing(spark):
    empty = spark.createDataFrame([], KEYED)
    assert H.heavy_totals(empty, "key", ["a", "b"], 0.02).count() == 0
    assert H.skewed_totals(empty, "key", ["a"]).count() == 0


def test_share_reached_exactly_is_heavy(spark):
    df = spark.createDataFrame([("a", 1.0)] * 1 + [("b", 49.0)], "key string, v double")
    assert {r["key"] for r in H.heavy_totals(df, "key", ["v"], 0.02).collect()} == {"a", "b"}


def test_skewed_totals(skewed):
    expected = Counter(r["key"] for r in skewed.collect() if r["key"] is not None)
    found = H.skewed_totals(skewed, "key", ["a", "b"])
    assert {r["key"]: r["n_rows"] for r in found.collect()} == expected
    assert [r["key"] for r in found.filter("is_heavy").orderBy("key").collect()] == ["", "hot"]
    assert found.filter("key = 'hot'").first()["b"] is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("sampled", [H.SAMPLED, 1.0])
def test_skew_join(skewed, spark, monkeypatch, how, sampled):
    monkeypatch.setattr(H, "SAMPLED", sampled)
    left = skewed.select("key", "a", "cell", F.lit("mine").alias("_c0"), F.lit("also").alias("_h0"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4), (None, 5)], "key string, value int")
    assert rows(H.skew_join(left, right, "key", how)) == rows(left.join(right, "key", how))


def test_skew_join_with_condition(skewed, spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLED", 1.0)
    right = spark.createDataFrame([("hot", 4.0), ("k1", 2.0)], "key string, least double")
    found = H.skew_join(skewed.select("key", "a"), right, "key", "left_semi", "a >= least")
    assert all(a >= (4.0 if k == "hot" else 2.0) for k, a in rows(found)) and found.count() > 0
    with pytest.raises(ValueError):
        H.skew_join(skewed, right, "key", "cross")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_beyond_the_broadcast_bound(skewed, spark, monkeypatch, how):
    monkeypatch.setattr(H, "SAMPLED", 1.0)
    monkeypatch.setattr(H, "FEW_ROWS", 0)
    left = skewed.select("key", "a").repartition(7)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 2), ("other", 4), (None, 5)], "key string, value int")
    found = H.skew_join(left, right, "key", how)
    assert "__sl_salt" in found._jdf.queryExecution().toString()
    assert rows(found) == rows(left.join(right, "key", how))


def test_only_right_rows_of_heavy_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLED", 1.0)
    kept = []
    monkeypatch.setattr(H, "durable", lambda df: kept.append(df.count()) or df)
    left = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 30)).otherwise(F.col("id").cast("string")).alias("key"))
    right = spark.range(200_000).select(F.concat(F.lit("hot"), F.col("id")).alias("key"), "id")
    assert H.skew_join(left, right, "key", "left_semi").count() == 30_000
    assert kept == [15]


def test_heavy_hashes(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 300, "hot").when(F.col("id") < 900, None).otherwise(F.col("id").cast("string")).alias("key"))
    assert H.heavy_hashes(df, "key", 0.01) == [df.filter("id = 0").select(H.key_hash("key")).first()[0]]
    assert H.heavy_hashes(df.limit(0), "key", 0.01) == []


def test_hashes_of_totals(spark):
    totals = spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "key string, n bigint")
    assert len(H.hashes_of_totals(totals, "key", "n", 0.3)) == 2 and H.hashes_of_totals(totals.limit(0), "key", "n", 0.3) == []
    left = spark.createDataFrame([(k, i) for k, n in (("a", 60), ("b", 30), ("d", 10), (None, 3)) for i in range(n)], "key string, i int")
    hot = H.hashes_of_totals(totals, "key", "n", 0.3)
    assert rows(H.skew_join(left, totals, "key", "left", hot=hot)) == rows(left.join(totals, "key", "left"))


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_against_brute_force(spark):
    random.seed(5)
    links = [(f"n{random.randrange(400):03d}", f"n{random.randrange(400):03d}") for _ in range(260)]
    links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a long chain
    links += [("hub", f"h{i:03d}") for i in range(200)]  # a hub
    links += [("self", "self"), links[0], links[0]]
    df = spark.createDataFrame([*links, (None, "lost"), ("lost", None)], "a string, b string")
    found = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert found == brute_components(links)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


REFS = "id int, k string, at timestamp_ntz, live_from string"
FILES = "k string, start timestamp_ntz, end timestamp_ntz, id int"


def orphans_of(spark, refs, files, match="simple"):
    found = dated_orphans(spark.createDataFrame(refs, "id int, k string, at timestamp_ntz"), spark.createDataFrame(files, FILES), ["k"], "at", "start", "end", match)
    return {r["id"]: r["reason"] for r in found.collect()}


def test_dated_orphans(spark):
    files = [
        ("a", day(0), day(10), 1),
        ("a", day(5), day(7), 2),  # inside the first spell
        ("a", day(20), None, 3),
        ("b", day(3), None, 4),
        ("empty", day(3), day(3), 5),
        (None, day(0), None, 6),
        ("null start", None, None, 7),
    ]
    refs = [
        (1, "a", day(8)), (2, "a", day(10)), (3, "a", day(15)), (4, "a", day(20)), (5, "a", day(-1)),
        (6, "b", day(2)), (7, "b", day(3)), (8, "c", day(1)), (9, None, day(1)), (10, "a", None),
        (11, "empty", day(5)), (12, "null start", day(5)), (13, "a", day(15)),
    ]
    expected = {2: "deleted", 3: "deleted", 13: "deleted", 5: "late", 6: "late", 8: "missing", 11: "missing", 12: "missing"}
    assert orphans_of(spark, refs, files) == expected
    odd = spark.createDataFrame([(1, "a", day(15), "x", "y", "z")], "id int, k string, at timestamp_ntz, live_from string, reason string, _c0 string")
    kept = dated_orphans(odd, spark.createDataFrame(files, FILES), ["k"], "at", "start", "end").collect()
    assert [tuple(r) for r in kept] == [(1, "a", day(15), "x", "z", "deleted")]
    assert orphans_of(spark, [], files) == {}
    assert orphans_of(spark, [(1, "a", day(1))], []) == {1: "missing"}


def test_dated_orphans_against_brute_force(spark, monkeypatch):
    from starloom.operators import orphans as O

    monkeypatch.setattr(O, "SAMPLED", 1.0)
    monkeypatch.setattr(H, "SAMPLED", 1.0)
    random.seed(11)
    key = lambda: "hot" if random.random() < 0.4 else f"k{random.randrange(40)}"
    files = [(key(), day(s := random.randrange(100)), random.choice([None, day(s + random.randrange(0, 12))]) if random.random() < 0.3 else day(s + random.randrange(0, 4)), i) for i in range(400)]
    files = [(k if k != "hot" else k, a, b if k != "hot" or b else day(100), i) for k, a, b, i in files]
    refs = [(i, key(), day(random.randrange(110))) for i in range(1500)]
    expected = {}
    for i, k, at in refs:
        own = [(a, b or dt.datetime.max) for x, a, b, _ in files if x == k and (b is None or b > a)]
        if not any(a <= at < b for a, b in own):
            expected[i] = "missing" if not own else "deleted" if min(a for a, _ in own) <= at else "late"
    assert orphans_of(spark, refs, files) == expected


@pytest.mark.parametrize("few", [100_000, 0])
def test_one_missing_file_that_half_the_references_name(spark, monkeypatch, few):
    from starloom.operators import orphans as O

    monkeypatch.setattr(O, "SAMPLED", 1.0)
    monkeypatch.setattr(H, "FEW_ROWS", few)
    files = spark.createDataFrame([(f"f{i}", day(i % 9), day(20), i) for i in range(0, 300, 2)] + [("late", day(90), None, -1)], FILES)
    refs = spark.range(2000).select(
        F.col("id").cast("int"),
        F.when(F.col("id") % 2 == 0, "gone").when(F.col("id") % 7 == 0, "late").otherwise(F.concat(F.lit("f"), F.col("id") % 300)).alias("k"),
        F.lit(day(10)).alias("at"),
    )
    found = dated_orphans(refs, files, ["k"], "at", "start", "end")
    assert found.columns == ["id", "k", "at", "reason"]
    counts = {(r["k"] if r["k"] in ("gone", "late") else "f", r["reason"]): r["n"] for r in found.groupBy(F.when(F.col("k").isin("gone", "late"), F.col("k")).otherwise("f").alias("k"), "reason").agg(F.count("*").alias("n")).collect()}
    late = sum(1 for i in range(1, 2000, 2) if i % 7 == 0)
    assert counts == {("gone", "missing"): 1000, ("late", "late"): late, ("f", "missing"): 1000 - late}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text if few else "__sl_salt" in text


def test_live_spells_merge(spark):
    files = spark.createDataFrame([("a", day(0), day(2), 1), ("a", day(1), day(4), 1), ("a", day(4), day(5), 1), ("a", day(9), None, 1), ("a", day(9), None, 2)], FILES)
    found = [(r[1], r[2]) for r in sorted(live_spells(files, ["k"], "start", "end").collect())]
    assert found == [(day(0), day(5)), (day(9), dt.datetime(9999, 12, 31))]


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 2), (4, None, None), (5, "z", None), (6, "z", 9), (6, "z", 9)], "id int, x string, y int")
    parents = spark.createDataFrame([("a", 1), ("b", 2), (None, 7)], "x string, y int")
    ids = lambda match: sorted(r["id"] for r in orphan_references(refs, parents, ["x", "y"], match).collect())
    assert ids("simple") == [6, 6]
    assert ids("partial") == [5, 6, 6]
    assert ids("full") == [2, 3, 5, 6, 6]
    with pytest.raises(ValueError):
        orphan_references(refs, parents, ["x"], "none")


def test_plain_paths(spark):
    cases = {
        "/depot/a/b.fits.gz": "/depot/a/b.fits.gz",
        " \t/depot//a/./b.fits\n": "/depot/a/b.fits",
        "file:///depot/a/old/../b.fits": "/depot/a/b.fits",
        "\\depot\\a\\B.fits": "/depot/a/B.fits",
        "//depot/a/x/y/../../b": "/depot/a/b",
        "/../a": "/a",
        "-": None, "nan": None, "None": None, "": None, "  ": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", plain_path(F.col("p"))).collect()} == cases


def test_plain_ids(spark):
    df = spark.createDataFrame(
        [(" tng50_085_00012 ", None, None), (None, 85, 12), ("nothing", None, None), (None, None, None), ("TNG50-85-0", None, None)], "g string, s int, h bigint"
    )
    found = [r[0] for r in df.select(galaxy_id(F.col("g"), F.col("s"), F.col("h"))).collect()]
    assert found == ["TNG50-85-12", "TNG50-85-12", None, None, "TNG50-85-0"]
    units = spark.createDataFrame([("manga-TNG50-85-012-1-37.cube", 1, 1, 1, 1), (None, 85, 12, 0, 19), ("TNG50-85-12", 85, 12, 2, 61)], "c string, s int, h bigint, v int, i int")
    assert [r[0] for r in units.select(canonical_id(*(F.col(c) for c in "cshvi"))).collect()] == ["TNG50-85-12-1-37", "TNG50-85-12-0-19", "TNG50-85-12-2-61"]
    views = spark.createDataFrame([("0;=tng50_85_012-1,TNG50-85-12",), ("0|1",), (None,), ("",)], "v string")
    assert [r[0] for r in views.select(named_galaxies(F.col("v"))).collect()] == [["TNG50-85-12"], [], [], []]
