"""Quota sampling, stable sampling and group splits on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starloom.llm import group_splits as G
from starloom.llm import quota_sample as Q
from starloom.llm import stable_sample as S

TARGETS = "target_id int, stratum string, barred boolean, bulge_lo double, bulge_hi double, target_share double, min_rows int"
LEAVES = "target_id int, a string, b string, quota bigint, available bigint"


def test_quota_goes_to_siblings_then_cousins_then_the_rest(spark):
    leaves = [
        (1, "x", "p", 10, 4),  # 6 unmet
        (2, "x", "p", 5, 7),  # sibling takes 2
        (3, "x", "q", 5, 8),  # cousin takes 3
        (4, "y", "p", 5, 5),
        (5, "y", "q", 5, 50),  # the rest takes 1
    ]
    found = {r["target_id"]: r for r in Q.pass_quota(spark.createDataFrame(leaves, LEAVES), "target_id", ["a", "b"]).collect()}
    assert [found[k]["allocated"] for k in range(1, 6)] == [4, 7, 8, 5, 6]
    assert [found[k]["received"] for k in range(1, 6)] == [0, 2, 3, 0, 1]
    assert found[1]["own_gap"] == 6 and sum(r["shortfall"] for r in found.values()) == 0


def brute_quotas(leaves, size):
    """Top-down quotas in plain Python: leaves are (leaf, a, b, share, least)."""
    from math import floor

    def split(quota, rows, depth, out):
        if depth == 3:
            out[rows[0][0]] = int(quota)
            return
        nodes = {}
        for r in rows:
            nodes.setdefault((r[1], r[2], r[0])[depth], []).append(r)
        share = sum(r[3] for r in rows)
        over = {k: max(quota * sum(r[3] for r in v) / share - sum(r[4] for r in v), 0) for k, v in nodes.items()}
        rest, whole, upto = quota - sum(r[4] for r in rows), sum(over.values()), 0.0
        cut = lambda x: floor(round(rest * x / whole, 6)) if whole else 0
        for k in sorted(nodes):
            before, upto = upto, upto + over[k]
            split(sum(r[4] for r in nodes[k]) + cut(upto) - cut(before), nodes[k], depth + 1, out)

    found = {}
    split(max(size, sum(r[4] for r in leaves)), leaves, 0, found)
    return found


@pytest.mark.parametrize("size", [0, 10, 97, 1000])
def test_quotas_come_down_the_tree_within_the_sample_size(spark, size):
    random.seed(size)
    leaves = [(i, random.choice("xyz"), random.choice("pq"), random.random(), random.randrange(4)) for i in range(25)]
    frame = spark.createDataFrame(leaves, "leaf int, a string, b string, share double, least int")
    found = {r["leaf"]: r["quota"] for r in Q.tree_quotas(frame, "leaf", ["a", "b"], "share", "least", spark.createDataFrame([(float(size),)], "n double")).collect()}
    least = {r[0]: r[4] for r in leaves}
    assert sum(found.values()) == max(size, sum(least.values())) and all(found[k] >= least[k] for k in found)
    assert found == brute_quotas(leaves, size)


def test_report_has_achieved_shares(spark):
    targets = spark.createDataFrame([(1, "x", True, 0.0, 1.0, 0.5, 0), (2, "y", True, 0.0, 1.0, 0.3, 0), (3, "z", True, 0.0, 1.0, 0.2, 30)], TARGETS)
    placed = spark.createDataFrame([(1, f"a{i}") for i in range(400)] + [(2, f"b{i}") for i in range(10)] + [(3, f"c{i}") for i in range(90)], "target_id int, galaxy_id string")
    n_all = spark.createDataFrame([(500,)], "n bigint")
    found = {r["target_id"]: r for r in Q.quota_report(placed, n_all, targets, ["stratum", "barred"], 0.2).collect()}
    assert [found[k]["quota"] for k in (1, 2, 3)] == [43, 27, 30] and sum(found[k]["allocated"] for k in found) == 100
    assert found[2]["allocated"] == 10 and found[2]["own_gap"] == 17 and found[2]["shortfall"] == 0
    assert found[1]["achieved_share"] == found[1]["allocated"] / 100 and [found[k]["is_met"] for k in (1, 2, 3)] == [True, False, True]


@pytest.mark.parametrize("seed", range(4))
def test_allocation_keeps_bounds_and_totals(spark, seed):
    random.seed(seed)
    leaves = [(i, random.choice("xyz"), random.choice("pq"), random.randrange(30), random.randrange(40)) for i in range(40)]
    rows = Q.pass_quota(spark.createDataFrame(leaves, LEAVES), "target_id", ["a", "b"]).collect()
    assert all(0 <= r["allocated"] <= r["available"] for r in rows)
    wanted, have = sum(x[3] for x in leaves), sum(x[4] for x in leaves)
    assert sum(r["allocated"] for r in rows) == min(wanted, have)
    assert sum(r["shortfall"] for r in rows) == max(0, wanted - have)
    assert all(r["allocated"] >= min(r["quota"], r["available"]) for r in rows)


def test_empty_and_zero_quotas(spark):
    assert Q.pass_quota(spark.createDataFrame([], LEAVES), "target_id", ["a", "b"]).count() == 0
    row = Q.pass_quota(spark.createDataFrame([(1, None, None, 0, 0)], LEAVES), "target_id", ["a", "b"]).first()
    assert (row["allocated"], row["shortfall"]) == (0, 0)


def test_place_leaves_out_what_is_null(spark):
    targets = spark.createDataFrame([(1, "disk", True, 0.0, 0.5, 0.5, 1), (2, "disk", True, 0.5, 1.0, 0.5, 1)], TARGETS)
    rows = spark.createDataFrame(
        [("a", "disk", True, 0.5, 9), ("b", "disk", True, 0.0, 9), ("c", None, True, 0.1, 9), ("d", "disk", None, 0.1, 9), ("e", "disk", True, None, 9), ("f", "disk", True, 1.0, 9)],
        "galaxy_id string, stratum string, barred boolean, bulge_frac double, min_rows int",
    )
    placed = Q.place(rows, targets, ["stratum", "barred"], "bulge_frac", "bulge_lo", "bulge_hi")
    assert {r["galaxy_id"]: (r["target_id"], r["min_rows"]) for r in placed.collect()} == {"a": (2, 9), "b": (1, 9)}


def test_draw_is_ranked_and_the_same_in_any_partitioning(spark, monkeypatch):
    placed = spark.range(3000).select((F.col("id") % 3).cast("int").alias("target_id"), F.concat(F.lit("g"), "id").alias("galaxy_id"))
    placed = placed.unionByName(placed.limit(50))  # repeated rows rank as one
    report = spark.createDataFrame([(0, 400), (1, 0), (2, 5000)], "target_id int, allocated bigint")
    drawn = Q.draw(placed, report, "galaxy_id", 7).distinct()
    counts = {r["target_id"]: (r["n"], r["lo"], r["hi"]) for r in drawn.groupBy("target_id").agg(F.count("*").alias("n"), F.min("draw_rank").alias("lo"), F.max("draw_rank").alias("hi")).collect()}
    assert counts == {0: (400, 1, 400), 2: (1000, 1, 1000)}
    again = Q.draw(placed.repartition(5), report, "galaxy_id", 7).distinct()
    assert sorted(drawn.collect()) == sorted(again.collect())
    one = sorted((Q_turn(r["galaxy_id"], 7), r["galaxy_id"]) for r in placed.filter("target_id = 0").distinct().collect())
    assert [r["galaxy_id"] for r in drawn.filter("target_id = 0").orderBy("draw_rank").collect()] == [g for _, g in one[:400]]


def Q_turn(key, seed):
    import hashlib

    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)


def test_latest_rows(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "a", t, 1), (2, "a", t, 2), (3, "a", None, 3), (4, None, None, 4)], "id int, k string, at timestamp_ntz, n int")
    assert sorted(r["id"] for r in Q.latest_rows(df, ["k"], ["at", "id"]).collect()) == [2, 4]


RECORDS = "record_id string, seen_at timestamp_ntz, rate string"


def records(spark, first, last, every=1):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(f"r{i}", t + dt.timedelta(days=i // 10), "x") for i in range(first, last, every)], RECORDS)


def test_members_stay_when_records_arrive(spark):
    rates = spark.createDataFrame([(24300, 0.5), (24302, 0.2)], "epoch int, rate double")
    before = S.extend_ledger(None, records(spark, 0, 600), "record_id", "seen_at", rates)
    sample = {r["record_id"] for r in S.selected(before, "record_id", 5).collect()}
    other_rates = spark.createDataFrame([(24300, 0.01), (24302, 0.9)], "epoch int, rate double")
    late = records(spark, 0, 1200).withColumn("seen_at", F.expr("seen_at - interval 400 days"))  # arrives earlier than anything before
    after = S.extend_ledger(before, late, "record_id", "seen_at", other_rates)
    assert after.count() == 1200
    grown = {r["record_id"] for r in S.selected(after.repartition(13), "record_id", 5).collect()}
    assert sample <= grown and {x for x in grown if int(x[1:]) < 600} == sample
    assert 0.3 < len(sample) / 600 < 0.6
    assert {r["record_id"] for r in S.selected(before.coalesce(1), "record_id", 6).collect()} != sample


def test_stored_ledger_keeps_members_with_rising_rates_and_late_earlier_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    low = spark.createDataFrame([(24300, 0.1)], "epoch int, rate double")
    high = spark.createDataFrame([(24300, 0.9), (24250, 0.9)], "epoch int, rate double")
    assert S.read_ledger(spark, folder) is None
    first = S.append_batch(folder, 1, records(spark, 0, 600), "record_id", "seen_at", low)
    before = {r["record_id"]: (r["epoch"], r["rate"]) for r in first.collect()}
    sample = {r["record_id"] for r in S.selected(first, "record_id", 5).collect()}
    late = records(spark, 0, 1200).withColumn("seen_at", F.expr("seen_at - interval 400 days"))
    for _ in range(2):  # a batch that is written again stays the same
        second = S.append_batch(folder, 2, late, "record_id", "seen_at", high)
        after = {r["record_id"]: (r["epoch"], r["rate"]) for r in second.collect()}
        assert len(after) == 1200 and {k: after[k] for k in before} == before
        grown = {r["record_id"] for r in S.selected(second, "record_id", 5).collect()}
        assert {x for x in grown if x in before} == sample and len(grown) > 2 * len(sample)
    assert S.append_batch(folder, 3, late.limit(0), "record_id", "seen_at", high).count() == 1200


def test_stable_sample_edge_cases(spark):
    rates = spark.createDataFrame([(24300, 1.0)], "epoch int, rate double")
    t = dt.datetime(2025, 2, 1)
    odd = spark.createDataFrame([(None, t, ""), ("a", None, ""), ("b", t, ""), ("b", t, ""), ("", t, "")], RECORDS)
    ledger = S.extend_ledger(None, odd, "record_id", "seen_at", rates)
    assert sorted(r["record_id"] for r in S.selected(ledger, "record_id", 1).collect()) == ["", "b"]
    assert S.extend_ledger(None, odd.limit(0), "record_id", "seen_at", rates).count() == 0


def test_largest_differencing_balances():
    random.seed(2)
    weights = [int(random.paretovariate(1.2) * 10) for _ in range(3000)]
    weights = [min(w, sum(weights) // 400) for w in weights]
    at = G.largest_differencing(weights, 20)
    sums = [sum(w for w, b in zip(weights, at, strict=True) if b == k) for k in range(20)]
    assert max(sums) - min(sums) <= max(weights) * 0.2
    assert G.largest_differencing(weights, 20) == at
    assert G.largest_differencing([], 5) == [] and G.largest_differencing([7], 5) in ([0], [1], [2], [3], [4])


def test_groups_stay_together_with_the_wanted_shares(spark):
    random.seed(4)
    data = [(i, f"g{int(random.paretovariate(0.9)) % 4000}", "s", "x") for i in range(20000)] + [(-1, None, "s", "x")] + [(90000 + i, "third", "s", "x") for i in range(10000)]
    df = spark.createDataFrame(data, "id int, grp string, _light string, weight string")
    out = G.group_splits(df, "grp", {"train": 0.6, "validation": 0.2, "test": 0.2})
    assert out.columns == ["id", "grp", "_light", "weight", "split"] and out.count() == len(data)
    assert out.filter("_light <> 's' or weight <> 'x'").count() == 0
    assert out.filter("grp is not null").groupBy("grp").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("grp is null").first()["split"] is None
    shares = {r["split"]: r["n"] / 30000 for r in out.filter("grp is not null").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert shares.keys() == {"train", "validation", "test"} and abs(shares["train"] - 0.6) < 0.1
    same = G.group_splits(df.repartition(9), "grp", {"train": 0.6, "validation": 0.2, "test": 0.2})
    assert sorted((r["id"], r["split"] or "") for r in same.collect()) == sorted((r["id"], r["split"] or "") for r in out.collect())
    assert G.group_splits(df.limit(0), "grp", {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        G.group_splits(df, "grp", {"train": 0.5})
