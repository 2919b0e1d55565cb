"""Operators against NumPy or brute force on small frames, with nulls, ties and empty groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.operators import catalog as C
from starloom.operators import grids as G
from starloom.operators import labels as L
from starloom.operators import models as M
from starloom.operators import particles as P
from starloom.operators import running as R
from starloom.operators import spectral as X
from starloom.operators import statistics as T
from starloom.operators import validation as V
from starloom.sources import files
from starloom.streaming import events as E


def one(spark, column, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns, F.lit(0).alias("zero")).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: S.threshold_key(F.lit(0.5)), "050"),
        (lambda: S.threshold_key(F.lit(0.125)), "012"),
        (lambda: S.age_from_token(F.lit("500Myr")), 0.5),
        (lambda: S.age_from_token(F.lit("2.0Gyr")), 2.0),
        (lambda: S.age_from_token(F.lit("old")), None),
        (lambda: S.metallicity_from_token(F.lit("z02")), 0.02),
        (lambda: S.metallicity_from_token(F.lit("z0.03")), 0.03),
        (lambda: S.plain_name(F.lit("vel_sigma (km/s)")), "VELSIGMAKMS"),
        (lambda: S.first_argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), 1),
        (lambda: S.unit_vector(F.array(F.lit(3.0), F.lit(0.0), F.lit(4.0))), [0.6, 0.0, 0.8]),
        (lambda: S.unit_vector(F.array(F.lit(0.0), F.lit(0.0))), None),
        (lambda: S.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), 2), 1.0),
        (lambda: S.js_divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), 1.0),
        (lambda: S.all_agree([F.lit(3), F.lit(None), F.lit(3)], F.lit(3)), True),
        (lambda: S.all_agree([F.lit(None).cast("int")], F.lit(3)), None),
        (lambda: S.none_if_nan(F.lit(float("nan"))), None),
        (lambda: S.sparse_ladder(F.lit(None).cast("double"), [1.0], ["low", "high"]), "missing"),
        (lambda: S.sparse_ladder(F.lit(1.0), [1.0], ["low", "high"]), "high"),
    ],
)
def test_scalars(spark, column, expected):
    found = one(spark, column())
    assert found == pytest.approx(expected) if expected is not None else found is None


def test_ages_match_the_integral(spark):
    grid = np.linspace(1e-8, 0.6, 400_001)
    values = 1 / (grid * np.sqrt(S.OMEGA_M / grid**3 + 1 - S.OMEGA_M))
    expected = S.HUBBLE_TIME_GYR * np.sum((values[1:] + values[:-1]) / 2 * np.diff(grid))
    assert one(spark, S.cosmic_time_gyr(F.lit(0.6))) == pytest.approx(expected, rel=1e-4)


@pytest.fixture(scope="module")
def numbers(spark):
    random.seed(6)
    data = [(random.choice("ab"), i, round(random.uniform(0, 20), 1), float(random.randrange(5))) for i in range(600)] + [("a", -1, None, 1.0), ("c", -2, 3.0, 0.0), ("d", -3, 4.0, None)]
    return spark.createDataFrame(data, "k string, id int, x double, w double")


def groups(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["k"], []).append((r["x"], r["id"], r["w"]))
    return found


def test_running_sums(numbers):
    rows = numbers.filter("x is not null")
    out = R.running_sums(rows, ["k"], ["x", "id"], {"total": F.col("w")}, F.floor("x"))
    found = {r["id"]: r["total"] for r in out.collect()}
    for members in groups(rows).values():
        run = 0.0
        for _, i, w in sorted(members, key=lambda m: m[:2]):
            run += w or 0
            assert found[i] == pytest.approx(run)
    assert out.columns == ["k", "id", "x", "w", "total"]


def test_weighted_quantile_is_a_step(numbers):
    found = {r["k"]: r["quantile"] for r in R.weighted_quantile(numbers, ["k"], "x", "w", 0.3, F.floor("x")).collect()}
    expected = {}
    for k, members in groups(numbers).items():
        used = sorted((x, w) for x, _, w in members if x is not None and w and w > 0)
        total, run = sum(w for _, w in used), 0.0
        for x, w in used:
            run += w
            if run >= 0.3 * total:
                expected[k] = x
                break
    assert found == expected and "c" not in found


@pytest.mark.parametrize("points", [[0.5], [0.0, 0.1, 0.37, 1.0]])
def test_linear_quantiles(numbers, points):
    found = {r["k"]: r["q"] for r in R.linear_quantiles(numbers, ["k"], "x", points, F.floor("x")).collect()}
    for k, members in groups(numbers).items():
        assert found[k] == pytest.approx(list(np.quantile([x for x, *_ in members if x is not None], points)))
    whole = R.linear_quantiles(numbers, [], "x", points, F.floor(F.col("x") / 3)).first()["q"]
    assert whole == pytest.approx(list(np.quantile([x for m in groups(numbers).values() for x, *_ in m if x is not None], points)))
    assert R.linear_quantiles(numbers.limit(0), ["k"], "x", points, F.floor("x")).count() == 0


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "k string, x double")
    found = sorted(((r["k"], r["x"], r["avg_rank"]) for r in R.ranks(df, ["k"], "x", F.floor("x")).collect()), key=repr)
    assert found == sorted([("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("a", None, None), ("b", 5.0, 1.0)], key=repr)


def dense(df, bins, value="value"):
    grid = np.zeros((bins, bins))
    for r in df.collect():
        grid[r["iy"], r["ix"]] += r[value]
    return grid


@pytest.mark.parametrize("nearest", [False, True])
def test_blur(spark, nearest):
    rng = np.random.default_rng(3)
    cells = [(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 9, 12), rng.integers(0, 9, 12), rng.random(12), strict=True)]
    grid = np.zeros((9, 9))
    for a, b, v in cells:
        grid[a, b] += v
    kernel = np.array(G.kernel_1d(0.8))
    reach = len(kernel) // 2
    padded = np.pad(grid, reach, mode="edge" if nearest else "constant")
    rows = sum(kernel[k] * padded[:, k : k + 9] for k in range(len(kernel)))
    expected = sum(kernel[k] * rows[k : k + 9] for k in range(len(kernel)))
    df = spark.createDataFrame(cells, "iy int, ix int, value double").groupBy("iy", "ix").agg(F.sum("value").alias("value"))
    assert dense(G.blur(df, [], 0.8, 9, nearest=nearest), 9) == pytest.approx(expected)


def test_deposits_keep_mass(spark):
    df = spark.createDataFrame([("g", 0.3, 0.2, 2.0), ("g", -1.2, 1.9, 3.0), ("g", 99.0, 0.0, 5.0)], "k string, x double, y double, m double")
    assert G.deposit_nearest(df, ["k"], "x", "y", "m", 1.0, 8).agg(F.sum("value")).first()[0] == 5.0
    assert G.deposit_cic(df, ["k"], "x", "y", "m", 1.0, 8).agg(F.sum("value")).first()[0] == pytest.approx(5.0)
    gathered = G.gather(df, G.deposit_nearest(df, ["k"], "x", "y", "m", 1.0, 8), ["k"], "x", "y", 1.0, 8)
    assert sorted(r["gathered"] for r in gathered.collect()) == [0.0, 2.0, 3.0]


def test_bin_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.999,), (1.0,), (1.001,), (None,)], "x double")
    assert [r[0] for r in df.select(G.bin_closed(F.col("x"), -1.0, 1.0, 4)).collect()] == [0, 3, 3, None, None]
    assert [r[0] for r in df.select(G.bin_open(F.col("x"), 0.5, 4)).collect()] == [0, 3, None, None, None]


def test_turning_four_times_is_nothing(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (3, 2, 5.0)], "iy int, ix int, value double")
    turned = df
    for _ in range(4):
        turned = G.dihedral(turned, 4, 1, False)
    assert sorted(turned.collect()) == sorted(df.collect())
    twice = G.dihedral(G.dihedral(df, 4, 0, True), 4, 0, True)
    assert sorted(twice.collect()) == sorted(df.collect())
    assert sorted(G.dihedral(df, 4, 2, False).collect()) == sorted(G.dihedral(G.dihedral(df, 4, 1, False), 4, 1, False).collect())


@pytest.mark.parametrize("bins", [None, 12])
def test_islands_against_flood_fill(spark, bins):
    rng = np.random.default_rng(8)
    cells = [("g", y, x) for y in range(12) for x in range(12) if rng.random() < 0.45] + [("h", 0, 0), ("h", 0, 2)]
    left, expected = set(cells), {}
    while left:
        first = min(left)
        queue, island = [first], {first}
        while queue:
            k, y, x = queue.pop()
            for n in ((k, y + 1, x), (k, y - 1, x), (k, y, x + 1), (k, y, x - 1)):
                if n in left and n not in island:
                    island.add(n)
                    queue.append(n)
        left -= island
        expected |= {c: first for c in island}
    found = G.connected_cells(spark.createDataFrame(cells, "k string, iy int, ix int"), ["k"], bins).collect()
    names = {}
    for r in found:
        names.setdefault(r["island"], set()).add((r["k"], r["iy"], r["ix"]))
    assert sorted(map(sorted, names.values())) == sorted(sorted(c for c in expected if expected[c] == f) for f in set(expected.values()))
    assert {f"{k}|{y:05d}|{x:05d}" for k, y, x in expected.values()} == set(names)
    assert G.connected_cells(spark.createDataFrame([], "k string, iy int, ix int"), ["k"], bins).count() == 0


def test_closing_fills_a_hole(spark):
    ring = [("g", y, x) for y in range(3, 6) for x in range(3, 6) if (y, x) != (4, 4)]
    df = spark.createDataFrame(ring, "k string, iy int, ix int")
    closed = G.erode(G.dilate(df, ["k"], 10), ["k"], 10)
    assert {(r["iy"], r["ix"]) for r in closed.collect()} == {(y, x) for y in range(3, 6) for x in range(3, 6)}


def test_face_on_rotation_aligns_momentum(spark):
    rng = np.random.default_rng(4)
    rows = [("g", i, *map(float, rng.normal(size=3)), *map(float, rng.normal(size=3) + [0.3, 0, 0]), float(rng.random())) for i in range(50)]
    rows += [("flip", 0, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0), ("still", 0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, pid int, x double, y double, z double, vx double, vy double, vz double, mass double")
    turned = P.rotate_face_on(df, P.angular_momentum(df, ["k"]), ["k"])
    after = {r["k"]: r for r in P.angular_momentum(turned, ["k"]).collect()}
    for k in ("g", "flip"):
        assert abs(after[k]["lx"]) < 1e-9 and abs(after[k]["ly"]) < 1e-9 and after[k]["lz"] > 0
    still = turned.filter("k = 'still'").first()
    assert (still["x"], still["y"], still["z"]) == (1.0, 2.0, 3.0)


def test_mixture_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-2, 0.5, 300), rng.normal(1, 0.4, 200), rng.normal(3, 0.6, 100)])
    w, v = np.full(3, 1 / 3), np.full(3, x.var())
    m = x.min() + (x.max() - x.min()) * (np.arange(3) + 0.5) / 3
    logs = []
    for _ in range(5):
        d = w * np.exp(-((x[:, None] - m) ** 2) / (2 * v)) / np.sqrt(2 * math.pi * v)
        logs.append(np.log(d.sum(1)).sum())
        r = d / d.sum(1, keepdims=True)
        n = r.sum(0)
        w, m = n / len(x), (r * x[:, None]).sum(0) / n
        v = (r * x[:, None] ** 2).sum(0) / n - m**2
    df = spark.createDataFrame([("a", float(t)) for t in x], "k string, x double")
    row = M.fit_mixture(df, ["k"], "x", 3, 5).first()
    assert row["mean"] == pytest.approx(list(m)) and row["weight"] == pytest.approx(list(w)) and row["loglik"] == pytest.approx(logs[-1])
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:], strict=False))


def test_neighbours_across_segments(spark):
    df = spark.createDataFrame([("a", w, w * 2) for w in (0.0, 0.4, 5.0, 12.0)] + [("b", 3.0, 1.0)], "k string, wave double, flux double")
    found = {(r["k"], r["wave"]): (r["prev_wave"], r["next_flux"]) for r in X.with_neighbours(df, ["k"], "wave", 1.0, ["flux"]).collect()}
    assert found == {("a", 0.0): (None, 0.8), ("a", 0.4): (0.0, 10.0), ("a", 5.0): (0.4, 24.0), ("a", 12.0): (5.0, None), ("b", 3.0): (None, None)}
    area = {r["k"]: r["integral"] for r in X.trapezoid(df, ["k"], "wave", "flux", 1.0).collect()}
    assert area == {"a": pytest.approx(144.0), "b": 0.0}


def test_simpson_is_exact_for_cubics(spark):
    df = spark.createDataFrame([("a", k, float((k * 0.5) ** 3)) for k in range(9)], "k string, n int, v double")
    assert X.simpson(df, ["k"], "n", "v", 0.5).first()["integral"] == pytest.approx(4.0**4 / 4)


def test_simpson_reaches_the_last_point(spark):
    df = spark.createDataFrame([(n, k, float(k)) for n in (0, 1, 2, 119, 120) for k in range(n + 1)], "last int, n int, v double")
    found = {r["last"]: r["integral"] for r in X.simpson_closed(df, ["last"], "n", "v", 0.5).collect()}
    assert found == {n: pytest.approx(0.5 * n * n / 2) for n in (0, 1, 2, 119, 120)}


def test_each_run_meets_the_next(spark):
    df = spark.createDataFrame([(s, c, f"{s}{c}") for s in ("9", "10", "100") for c in (1, 2)] + [("x", 1, "x")], "snap string, c int, v string")
    found = {tuple(r) for r in V.next_runs(df, "snap", ["c"], "v").collect()}
    assert found == {(a, b, c, f"{a}{c}", f"{b}{c}") for a, b in (("9", "10"), ("10", "100")) for c in (1, 2)}


def test_helpers_refuse_unbounded_libraries(spark):
    with pytest.raises(ValueError):
        T.nearest_template(spark.range(3), spark.range(5).withColumnRenamed("id", "t").withColumn("a", F.lit(1.0)), ["a"], "t", 4)
    with pytest.raises(ValueError):
        M.midpoint_nodes(spark.range(3), spark.range(5).select(F.col("id").cast("double").alias("node")), "id", "node", 4)


@pytest.mark.parametrize("unrolled", [64, 0])
def test_nearest_template(spark, monkeypatch, unrolled):
    monkeypatch.setattr(T, "UNROLLED", unrolled)
    library = spark.createDataFrame([(2, 0.0, 0.0), (1, 2.0, 0.0), (3, 0.0, 9.0)], "t int, a double, b double")
    rows = spark.createDataFrame([(1.0, 0.0), (0.1, 0.0), (0.0, 8.0)], "a double, b double")
    assert [r["t"] for r in T.nearest_template(rows, library, ["a", "b"], "t").orderBy("b", F.desc("a")).collect()] == [1, 2, 3]
    assert [r["t"] for r in T.nearest_template(rows, library.limit(0), ["a", "b"], "t").collect()] == [None] * 3


@pytest.mark.parametrize("library_bound", [T.LIBRARY, 0])
@pytest.mark.parametrize("shape", ["plane", "line", "point", "clusters"])
def test_nearest_in_plane_against_brute_force(spark, monkeypatch, shape, library_bound):
    monkeypatch.setattr(T, "LIBRARY", library_bound)
    rng = np.random.default_rng(4)
    library = rng.integers(0, 40, (300, 2)) / 4.0
    if shape == "line":
        library[:, 1] = 2.0
    if shape == "point":
        library[:] = 3.0
    if shape == "clusters":
        library[:150] = library[:150] / 1000 + 500
    places = np.concatenate((rng.random((100, 2)) * 10, rng.normal(0, 300, (30, 2)), library[:20]))
    templates = spark.createDataFrame([(k, *map(float, t)) for k, t in enumerate(library)], "t int, a double, b double")
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)] + [(999, None, 1.0)], "k int, a double, b double")
    found = {r["k"]: r["t"] for r in T.nearest_in_plane(rows, templates, "a", "b", "t").collect()}
    expected = {k: int(np.argmin(((library - p) ** 2).sum(axis=1))) for k, p in enumerate(places)}
    assert found == expected | {999: None}
    assert {r["t"] for r in T.nearest_in_plane(rows, templates.limit(0), "a", "b", "t").collect()} == {None}


def test_kernel_discrepancy_counts_every_pair(spark):
    rng = np.random.default_rng(6)
    vectors, sides = rng.normal(0, 1, (150, 4)), rng.integers(0, 2, 150)
    df = spark.createDataFrame([(list(map(float, v)), int(s)) for v, s in zip(vectors, sides, strict=True)], "e array<double>, side int")
    k = np.exp(-((vectors[:, None] - vectors[None]) ** 2).sum(axis=2) / 8)
    x, y = sides == 0, sides == 1
    expected = k[x][:, x].mean() + k[y][:, y].mean() - 2 * k[x][:, y].mean()
    found = T.kernel_discrepancy_all(df, "e", "side", [2.0], 16)
    assert found.first()["mmd"] == pytest.approx(expected)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_range_join_against_brute_force(spark):
    rng = np.random.default_rng(9)
    a, b = rng.uniform(-3, 3, (80, 2)), rng.uniform(-3, 3, (60, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, x double, y double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, u double, v double")
    found = {(r["i"], r["j"]) for r in T.range_join(left, right, "x", "y", "u", "v", 0.7).collect()}
    assert found == {(i, j) for i in range(80) for j in range(60) if math.dist(a[i], b[j]) <= 0.7}


def test_asof_beyond_the_ends_and_without_points(spark):
    curve = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "k string, cx double, cy double")
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 1.0)], "k string, x double")
    found = sorted(((r["k"], r["x"], r["interpolated"]) for r in T.asof_interpolate(rows, curve, ["k"], "x", "cx", "cy").collect()))
    assert found == [("a", 0.0, 10.0), ("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 9.0, 30.0), ("b", 1.0, None)]


def test_guarded_statistics_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(T.guarded_corr("a", "b")).first()[0] == 0.0
    assert df.limit(0).agg(T.guarded_corr("a", "b")).first()[0] == 0.0
    assert T.auroc(spark.createDataFrame([(0.5, True)], "s double, p boolean"), "s", "p").first()[0] is None
    assert T.effective_count(df, ["a"], "b").first()["n_eff"] == pytest.approx(25 / 13)


def test_catalogue_helpers(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", None), (4, "b", 7), (5, "b", 2)], "id int, k string, v int")
    assert {r["k"]: (r["id"], r["repeat_count"]) for r in C.last_wins(df, ["k"], "id").collect()} == {"a": (2, 2), "b": (5, 3)}
    assert {r["k"]: r["m"] for r in C.mode_smallest(df, ["k"], "v", "m").collect()} == {"a": 5, "b": 2}
    reasons = df.select(C.exclusion_reasons({"odd": F.col("id") % 2 == 0, "small": F.col("v") > 4}).alias("r"), "id")
    assert {r["id"]: r["r"] for r in reasons.collect()} == {1: ["odd"], 2: [], 3: ["odd", "small"], 4: [], 5: ["odd", "small"]}
    assert {r["reason"]: r["n"] for r in C.reason_counts(reasons, "r").collect()} == {"odd": 3, "small": 2}


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "37.0", float("nan"), ""), (2, "x", 1.5, "t")], "id int, dsn string, mb double, note string")
    files.write_csv(df, str(tmp_path / "c.csv"), ["id", "dsn", "mb", "note"])
    columns = {"id": (["id"], "int"), "design": (["ifu", "dsn"], "int"), "mb": (["mb"], "double"), "none": (["nowhere"], "int")}
    found = files.read_catalog(spark, str(tmp_path / "c.csv"), columns)
    assert sorted(map(tuple, found.collect())) == [(1, 37, None, None), (2, None, 1.5, None)]
    assert files.check_schema(found, {"id": "int", "mb": "int", "gone": "int"}) == ["mb: double", "gone: missing"]
    assert files.list_files(spark, str(tmp_path), "*.csv").count() >= 1


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    like = spark.createDataFrame([(1, 2.0)], "k int, v double")
    merge = lambda b: b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    for value in (2.0, 5.0):
        spark.createDataFrame([(1, value)], "k int, v double").coalesce(1).write.mode("append").parquet(source)
        E.upsert_totals(E.file_stream(spark, source, "*.parquet", like), sink, state, ["k"], merge)
    assert [tuple(r) for r in E.merged_totals(spark, sink, ["k"]).collect()] == [(1, 2, 7.0)]


def test_stream_keeps_the_first_row_of_a_key_however_late(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    like = spark.createDataFrame([(1, 2.0)], "k int, v double")
    for rows in ([(1, 1.0), (1, 1.5), (2, 2.0), (None, 0.0)], [(2, 9.0), (3, 3.0)], [(1, 9.0)]):
        spark.createDataFrame(rows, "k int, v double").coalesce(1).write.mode("append").parquet(source)
        E.append_new(E.file_stream(spark, source, "*.parquet", like), sink, state, "k")
    found = {r["k"]: r["v"] for r in spark.read.parquet(sink).collect()}
    assert found.keys() == {1, 2, 3} and found[1] in (1.0, 1.5) and found[2] == 2.0 and found[3] == 3.0


def test_unique_lookup(spark):
    rows = spark.createDataFrame([(k,) for k in "abcdefa"], "k string")
    listed = [("a", 2.0), ("a", 2.0), ("a", None), ("b", 1.0), ("b", 3.0), ("c", None), ("d", -1.0), ("e", float("nan")), ("z", 1.0)]
    found = L.unique_lookup(rows, spark.createDataFrame(listed, "k string, v double"), ["k"], "v").collect()
    assert {r["k"]: (r["n_rows"], r["status"], r["v"]) for r in found} == {
        "a": (3, "ok", 2.0), "b": (2, "several", None), "c": (1, "invalid", None), "d": (1, "invalid", None), "e": (1, "invalid", None), "f": (0, "none", None)
    }
    assert L.unique_lookup(rows.limit(0), spark.createDataFrame(listed, "k string, v double"), ["k"], "v").count() == 0


def test_priors_and_responsibilities(spark):
    rows = spark.createDataFrame([(1, 2.0, 6.0), (2, None, -1.0), (3, float("nan"), 0.0), (4, 0.0, 1.0)], "i int, a double, b double")
    found = {r["i"]: (r["p"], r["q"], r["confidence"]) for r in rows.select("i", *L.priors([F.col("a"), F.col("b")], ["p", "q"], 0.5)).collect()}
    assert found == {1: (0.25, 0.75, 0.5), 2: (0.5, 0.5, 0.0), 3: (0.5, 0.5, 0.0), 4: (0.0, 1.0, 0.5)}
    row = rows.select(*(r.alias(f"r{k}") for k, r in enumerate(L.responsibilities(F.lit(1.0), [(0.5, 0.0, 1.0), (0.5, 2.0, 1.0)])))).first()
    assert (row["r0"], row["r1"]) == (0.5, 0.5)


def test_legacy_roles_with_ties(spark):
    rows = [("far", 0, 0.9, 1.0, 1.0), ("far", 1, 0.1, 0.2, 9.0), ("far", 2, 0.2, 0.8, 1.0), ("near", 0, 0.1, 0.50, 5.0), ("near", 1, 0.9, 0.1, 1.0), ("near", 2, 0.1, 0.52, 2.0), ("same", 0, 0.5, 0.5, 1.0), ("same", 1, 0.5, 0.5, 1.0), ("same", 2, 0.5, 0.5, 1.0)]
    found = L.legacy_roles(spark.createDataFrame(rows, "k string, n int, s double, e double, r double"), ["k"], "n", "s", "e", "r").collect()
    assert {r["k"]: (r["bulge"], r["disk"], r["halo"]) for r in found} == {"far": (1, 0, 2), "near": (2, 1, 0), "same": (1, 0, 2)}


def test_ladder_fills_with_the_nearest_mean(spark):
    rows = [("a", 1, 0.9), ("a", 2, -0.9), ("a", 3, 0.5), ("a", 4, -0.2), ("b", 5, 0.1), ("a", 6, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    found = {r["i"]: r["class"] for r in L.ladder_classes(df, ["k"], "v", [("high", F.col("v") > 0.8), ("low", F.col("v") < -0.8)]).collect()}
    assert found == {1: "high", 2: "low", 3: "high", 4: "low", 5: None, 6: None} | {6: found[6]}
    assert L.ladder_classes(df.limit(0), ["k"], "v", [("high", F.col("v") > 0.8)]).count() == 0


def test_tokens_match_the_longest(spark):
    files = spark.createDataFrame([("/a/TNG-1-2.npz",), ("/a/TNG-1-2.png",), ("/b/TNG-1-2-3.png",), ("/c/none.png",)], "path string")
    index = L.token_index(files, "path", r"TNG-\d+-\d+(?:-\d+)?", F.when(F.col("path").endswith(".png"), 0).otherwise(1))
    assert {r["token"]: r["path"] for r in index.collect()} == {"TNG-1-2": "/a/TNG-1-2.png", "TNG-1-2-3": "/b/TNG-1-2-3.png"}
    rows = spark.createDataFrame([(1, "TNG-1-2", "TNG-1-2-3"), (2, "TNG-1-2", None), (3, None, "TNG-9-9"), (1, "TNG-1-2", "TNG-1-2-3")], "i int, a string, b string")
    found = L.match_tokens(rows, "i", F.array("a", "b"), index, "path").collect()
    assert {r["i"]: r["path"] for r in found} == {1: "/b/TNG-1-2-3.png", 2: "/a/TNG-1-2.png"}


def test_affine_resample_keeps_the_identity_and_mirrors(spark):
    grid = spark.createDataFrame([("g", 0, 0, 1.0), ("g", 1, 2, 5.0)], "k string, iy int, ix int, value double")
    assert sorted(map(tuple, L.affine_resample(grid, ["k"], 3, 1.0, 0.0, flip=False).collect())) == [("g", 0, 0, 1.0), ("g", 1, 2, 5.0)]
    assert sorted(map(tuple, L.affine_resample(grid, ["k"], 3, 1.0, 0.0, flip=True).collect())) == [("g", 0, 2, 1.0), ("g", 1, 0, 5.0)]
    assert sum(r["value"] for r in L.affine_resample(grid.filter("iy = 1"), ["k"], 3, 1.0, 0.5, flip=False).collect()) == 5.0


def test_line_spread_keeps_constants(spark):
    df = spark.createDataFrame([("a", k, 7.0) for k in range(20)] + [("b", 3, 2.0)], "s string, k int, v double")
    found = L.line_spread(df, ["s"], "k", "v", F.lit(1.5), 4).collect()
    assert len(found) == 21 and all(r["spread"] == pytest.approx(7.0 if r["s"] == "a" else 2.0) for r in found)


def test_extinction_over_all_branches(spark):
    waves = [4.0, 2.2, 0.5495, 0.2, 0.15, 0.11, None]
    found = [r[0] for r in spark.createDataFrame([(w,) for w in waves], "w double").select(V.extinction(F.col("w"), F.lit(1.0))).collect()]
    assert found[0] is None and found[-1] is None and found[2] == pytest.approx(1.0, abs=0.01)
    assert found[1] == pytest.approx(0.114, abs=0.01) and found[3] == pytest.approx(2.84, abs=0.1) and found[4] == pytest.approx(2.66, abs=0.1) and found[5] > 3.5


def test_kinematic_checks(spark):
    cells = [("g", 100.0 + k, 50.0, float(-k), 0.0, 0.9, 0.0) for k in range(6)] + [("g", 0.5 * k, 90.0, 0.0, 0.9, 0.0, 0.0) for k in range(6)]
    cells += [("g", 10.0 * k, 70.0, float(-k), 0.0, 0.0, 0.9) for k in range(6)] + [("few", 1.0, 50.0, 0.0, 0.9, 0.0, 0.0), ("few", None, 50.0, 0.0, 0.9, 0.0, 0.0)]
    df = spark.createDataFrame(cells, "k string, v double, sigma double, h3 double, bulge double, disk double, bar double")
    found = {r["k"]: r for r in V.kinematic_checks(df, ["k"]).collect()}
    good = found["g"]
    assert (good["rotation"], good["dispersion"], good["bar_sigma"], good["h3_signature"]) == ("PASS", "PASS", "PASS", "PASS") and good["coherence"] == 1.0
    assert found["few"]["n_applicable"] == 0 and found["few"]["coherence"] is None and found["few"]["rotation"] == "N/A"
