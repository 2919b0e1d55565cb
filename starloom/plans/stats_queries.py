"""Queries of statistics, joins with helpers and spectra."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.operators import spectral as X
from starloom.operators import statistics as T
from starloom.operators.running import linear_quantiles, ranks
from starloom.plans.registry import Registry
from starloom.plans.views import SPECTRA_SQL, STARS_SQL, spectra, stars
from starloom.sources.tables import table

registry = Registry()
query = registry.query

# --- distributions and agreement


@query("percentile_stats", f"WITH {SPECTRA_SQL} SELECT kind, " + ", ".join(f"round(quantile_cont(flux, {q}), 6) AS p{round(100 * q):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM e GROUP BY 1")
def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.percentiles(spectra(spark, sf_dir), ["kind"], "flux", (0.1, 0.25, 0.5, 0.75, 0.9), F.floor("flux"))
    return found.select("kind", *(F.round(c, 6).alias(c) for c in found.columns if c != "kind"))


@query("norm_stats", f"WITH {SPECTRA_SQL} SELECT kind, count(flux) AS n, round(avg(flux), 6) AS mean, round(stddev_pop(flux), 6) AS spread, min(flux) AS low, max(flux) AS high FROM e GROUP BY 1")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.normal_stats(spectra(spark, sf_dir), ["kind"], "flux")
    return found.select("kind", "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "low", "high")


@query("scaled_values", f"WITH {SPECTRA_SQL}, t AS (SELECT kind, avg(flux) AS m, stddev_pop(flux) AS d FROM e GROUP BY 1) SELECT event_id, round((flux - m) / greatest(d, 1e-6), 5) AS z, round(sign(flux - 100) * ln(1 + abs(flux - 100)), 5) AS slog, round(2500.0 / (flux * flux + 2500.0), 6) AS certain FROM e JOIN t USING (kind)")
def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score within the kind, signed logarithm and certainty of each value."""
    rows = spectra(spark, sf_dir)
    stats = rows.groupBy("kind").agg(F.avg("flux").alias("m"), F.stddev_pop("flux").alias("d"))
    joined = rows.join(stats, "kind")
    return joined.select(
        "event_id",
        F.round(S.z_score(F.col("flux"), F.col("m"), F.col("d")), 5).alias("z"),
        F.round(S.symlog(F.col("flux") - 100), 5).alias("slog"),
        F.round(S.certainty(F.col("flux"), 50.0), 6).alias("certain"),
    )


_LADDER = "CASE WHEN v IS NULL THEN 'missing' WHEN v < 20 THEN 'low' WHEN v < 80 THEN 'middle' ELSE 'high' END"


@query("value_ladder", f"WITH u AS (SELECT event_type AS kind, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) SELECT kind, {_LADDER} AS label, count(*) AS n FROM u GROUP BY 1, 2")
def value_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a ladder of thresholds, missing ones included."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    label = S.sparse_ladder(value, [20.0, 80.0], ["low", "middle", "high"])
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "spearman_average",
    f"WITH {STARS_SQL}, r AS (SELECT component, rank() OVER (ORDER BY mass) + (count(*) OVER (PARTITION BY mass) - 1) / 2.0 AS a, rank() OVER (ORDER BY abs(z)) + (count(*) OVER (PARTITION BY abs(z)) - 1) / 2.0 AS b FROM s) SELECT component, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1",
)
def spearman_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of mass and height over all stars, ties sharing their mean rank; ranks are counted over bins."""
    rows = stars(spark, sf_dir).select("component", "mass", F.abs("z").alias("h"))
    both = ranks(ranks(rows, ["component"], "mass", F.floor(F.col("mass") / 1000), "a"), ["component"], "h", F.floor(F.col("h") * 64), "b")
    return both.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(T.guarded_corr("a", "b"), 6).alias("rho"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a truth (from the sample) and a probability that rises with the estimated size."""
    rows = table(spark, sf_dir, "wave2_manifest").filter("n_star_part >= 0 and n_gas_cell >= 0")
    p = F.round(F.col("n_star_part") / (F.col("n_star_part") + F.col("n_gas_cell") + 1), 6)
    return rows.select("listing_id", (F.col("sample_manga") == 1).alias("truth"), p.alias("p"), "ifu_design").filter("truth is not null")


SCORED_SQL = "v AS (SELECT listing_id, sample_manga = 1 AS truth, round(n_star_part / (n_star_part + n_gas_cell + 1), 6) AS p, ifu_design FROM wave2_manifest WHERE n_star_part >= 0 AND n_gas_cell >= 0 AND sample_manga IS NOT NULL)"


@query("soft_scores", f"WITH {SCORED_SQL} SELECT count(*) AS n, round(avg(pow(p - truth::INTEGER, 2)), 6) AS brier, round(avg(-ln(greatest(CASE WHEN truth THEN p ELSE 1 - p END, 1e-6))), 6) AS nll FROM v")
def soft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and log loss of probabilities."""
    truth = F.col("truth").cast("int")
    right = F.when(F.col("truth"), F.col("p")).otherwise(1 - F.col("p"))
    return _scored(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") - truth) ** 2), 6).alias("brier"), F.round(F.avg(-F.ln(F.greatest(right, F.lit(1e-6)))), 6).alias("nll")
    )


@query("calibration_error", f"WITH {SCORED_SQL}, b AS (SELECT greatest(ceil(p * 10), 1) AS b, count(*) AS n, avg(p) AS c, avg(truth::INTEGER) AS a FROM v GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.calibration_error(_scored(spark, sf_dir), "p", "truth", 10).select(F.round("ece", 6).alias("ece"))


@query("auroc", f"WITH {SCORED_SQL}, r AS (SELECT truth, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM v) SELECT round((sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2.0) / (count(*) FILTER (truth) * count(*) FILTER (NOT truth)), 6) AS auroc FROM r")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("p", F.col("p") * 1000)
    return T.auroc(scored, "p", "truth").select(F.round("auroc", 6).alias("auroc"))


@query("confusion_scores", f"WITH {SCORED_SQL}, k AS (SELECT CASE WHEN truth THEN 'primary' ELSE 'other' END AS t, CASE WHEN p >= 0.5 THEN 'primary' ELSE 'other' END AS g FROM v), c AS (SELECT unnest(['primary', 'other']) AS class) "
       "SELECT class, round(count(*) FILTER (t = class AND g = class) / count(*) FILTER (t = class OR g = class), 6) AS iou, round(2 * count(*) FILTER (t = class AND g = class) / (count(*) FILTER (t = class) + count(*) FILTER (g = class)), 6) AS dice, round(count(*) FILTER (t = g) / count(*), 6) AS accuracy FROM k, c GROUP BY 1")
def confusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(
        F.when(F.col("truth"), "primary").otherwise("other").alias("t"), F.when(F.col("p") >= 0.5, "primary").otherwise("other").alias("g")
    )
    found = T.confusion_scores(rows, ["primary", "other"], "t", "g")
    return found.select("class", *(F.round(c, 6).alias(c) for c in ("iou", "dice", "accuracy")))


@query("conformal_thresholds", f"WITH {SCORED_SQL}, x AS (SELECT ifu_design, round(1 - CASE WHEN truth THEN p ELSE 1 - p END, 6) AS s FROM v WHERE ifu_design IS NOT NULL), "
       "n AS (SELECT ifu_design, count(*) AS n, list(s) AS l FROM x GROUP BY 1), a AS (SELECT count(*) AS n, list(s) AS l FROM x), "
       "q AS (SELECT ifu_design, n, list_sort(l) AS l, least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1) AS h FROM n), qa AS (SELECT list_sort(l) AS l, least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1) AS h FROM a) "
       "SELECT q.ifu_design, q.n, round(CASE WHEN q.n >= 10 THEN q.l[floor(q.h)::INTEGER + 1] + (q.h - floor(q.h)) * (q.l[ceil(q.h)::INTEGER + 1] - q.l[floor(q.h)::INTEGER + 1]) ELSE qa.l[floor(qa.h)::INTEGER + 1] + (qa.h - floor(qa.h)) * (qa.l[ceil(qa.h)::INTEGER + 1] - qa.l[floor(qa.h)::INTEGER + 1]) END, 6) AS threshold FROM q, qa")
def conformal_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite-sample 90 % thresholds of nonconformity per design."""
    rows = _scored(spark, sf_dir).filter("ifu_design is not null")
    score = F.round(1 - F.when(F.col("truth"), F.col("p")).otherwise(1 - F.col("p")), 6)
    found = T.conformal_thresholds(rows.select("ifu_design", score.alias("s")), "ifu_design", "s", 0.1, 10)
    return found.select("ifu_design", "n", F.round("threshold", 6).alias("threshold"))


@query("grouping_sets_summary", "SELECT snapshot, ifu_design, count(*) AS n, max(n_star_part) AS most_stars FROM wave2_manifest GROUP BY GROUPING SETS ((snapshot), (ifu_design), ())")
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groupings in one pass over a first, fine grouping."""
    fine = table(spark, sf_dir, "wave2_manifest").groupBy("snapshot", "ifu_design").agg(F.count(F.lit(1)).alias("c"), F.max("n_star_part").alias("m"))
    return fine.groupingSets([["snapshot"], ["ifu_design"], []], "snapshot", "ifu_design").agg(F.sum("c").alias("n"), F.max("m").alias("most_stars"))


@query("topk_extremes", f"WITH {SPECTRA_SQL} (SELECT 'high' AS side, event_id, flux FROM e ORDER BY flux DESC, event_id LIMIT 20) UNION ALL (SELECT 'low', event_id, flux FROM e ORDER BY flux, event_id LIMIT 20)")
def topk_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest and lowest values."""
    rows = spectra(spark, sf_dir).select("event_id", "flux")
    high = rows.orderBy(F.desc("flux"), "event_id").limit(20).select(F.lit("high").alias("side"), "event_id", "flux")
    low = rows.orderBy("flux", "event_id").limit(20).select(F.lit("low").alias("side"), "event_id", "flux")
    return high.unionByName(low)


@query("threshold_sweep", f"WITH {SPECTRA_SQL} SELECT kind, t AS threshold, count(*) FILTER (flux >= t) AS n_over, round(count(*) FILTER (flux >= t) / count(*), 6) AS share FROM e, (SELECT unnest([10.0, 50.0, 100.0, 200.0, 400.0])::DOUBLE AS t) GROUP BY 1, 2")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or over each of several thresholds, counted in one pass."""
    steps = [10.0, 50.0, 100.0, 200.0, 400.0]
    counts = spectra(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(t).alias("t"), F.count_if(F.col("flux") >= t).alias("c")) for t in steps)).alias("over")
    )
    each = counts.select("kind", "n", F.explode("over").alias("o"))
    return each.select("kind", F.col("o.t").alias("threshold"), F.col("o.c").alias("n_over"), F.round(F.col("o.c") / F.col("n"), 6).alias("share"))


@query("json_wide_report", "SELECT event_type, count(*) FILTER (k < 25) AS q1, count(*) FILTER (k >= 25 AND k < 50) AS q2, count(*) FILTER (k >= 50) AS q3 FROM (SELECT event_type, (json_extract(props, '$.k'))::INTEGER AS k FROM events) GROUP BY 1")
def json_wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, binned and pivoted to columns."""
    k = F.from_json("props", "k int").getField("k")
    name = F.when(k < 25, "q1").when(k < 50, "q2").when(k >= 50, "q3")
    wide = table(spark, sf_dir, "events").select("event_type", name.alias("q")).groupBy("event_type").pivot("q", ["q1", "q2", "q3"]).count()
    return wide.na.fill(0, ["q1", "q2", "q3"])


@query("quantity_delta", f"WITH {SPECTRA_SQL}, d AS (SELECT kind, (wave / 86400)::INTEGER // 10 AS run, avg(flux) AS m FROM e GROUP BY 1, 2) SELECT a.kind, a.run, round(b.m - a.m, 5) AS delta FROM d a JOIN d b ON a.kind = b.kind AND b.run = a.run + 1")
def quantity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the mean from one run of ten days to the next."""
    day = F.bround(F.col("wave") / 86400, 0).cast("int")
    runs = spectra(spark, sf_dir).groupBy("kind", F.floor(day / 10).cast("int").alias("run")).agg(F.avg("flux").alias("m"))
    after = runs.select("kind", (F.col("run") - 1).alias("run"), F.col("m").alias("n"))
    return runs.join(after, ["kind", "run"]).select("kind", "run", F.round(F.col("n") - F.col("m"), 5).alias("delta"))


@query("embedding_pool", "SELECT label, dim - 1 AS dim, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2")
def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


# --- joins that need a helper


_NEAREST_SQL = (
    "WITH t AS (SELECT p_partkey AS template, p_size / 10.0 AS a, p_retailprice / 200.0 AS b FROM part), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10.0 AS a, l_extendedprice / 10000.0 AS b FROM lineitem) "
    "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, arg_min(template, {'d': (t.a - c.a) * (t.a - c.a) + (t.b - c.b) * (t.b - c.b), 'i': template}) AS template FROM c, t GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, c.a, c.b"
)


@query("nearest_template", _NEAREST_SQL)
@query("nearest_template_all", _NEAREST_SQL)
def nearest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest of all templates for each row."""
    library = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("template"), (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 200.0).alias("b")
    )
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10.0).alias("a"), (F.col("l_extendedprice") / 10000.0).alias("b")
    )
    return T.nearest_in_plane(rows, library, "a", "b", "template").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "template").distinct()


@query("fibre_neighbours", f"WITH {STARS_SQL}, f AS (SELECT DISTINCT s_suppkey AS fibre, (s_suppkey * 7 % 64) / 4.0 - 8.0 AS fx, (s_suppkey * 13 % 64) / 4.0 - 8.0 AS fy FROM supplier) "
       "SELECT fibre, count(*) AS n, round(sum(mass * exp(-0.5 * (pow(x - fx, 2) + pow(y - fy, 2)))) / sum(exp(-0.5 * (pow(x - fx, 2) + pow(y - fy, 2)))), 3) AS flux FROM f JOIN s ON abs(x - fx) <= 1 AND abs(y - fy) <= 1 AND sqrt(pow(x - fx, 2) + pow(y - fy, 2)) <= 1 GROUP BY 1")
def fibre_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian-weighted mean mass of the stars within a radius of each fibre, by a bucketed range join."""
    key = F.col("s_suppkey")
    fibres = table(spark, sf_dir, "supplier").select(key.alias("fibre"), ((key * 7 % 64) / 4.0 - 8.0).alias("fx"), ((key * 13 % 64) / 4.0 - 8.0).alias("fy")).distinct()
    near = T.range_join(stars(spark, sf_dir).select("x", "y", "mass"), fibres, "x", "y", "fx", "fy", 1.0)
    w = F.exp(-0.5 * ((F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2))
    return near.groupBy("fibre").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("mass") * w) / F.sum(w), 3).alias("flux"))


@query("asof_interpolation", f"WITH {SPECTRA_SQL}, c AS (SELECT kind, floor(wave / 86400)::INTEGER * 86400.0 + 43200 AS x, avg(flux) AS y FROM e GROUP BY ALL), "
       "b AS (SELECT e.event_id, e.wave, lo.x AS x0, lo.y AS y0, hi.x AS x1, hi.y AS y1 FROM e ASOF LEFT JOIN c lo ON e.kind = lo.kind AND e.wave >= lo.x ASOF LEFT JOIN c hi ON e.kind = hi.kind AND e.wave < hi.x) "
       "SELECT event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (wave - x0) / (x1 - x0) END, 5) AS daily FROM b")
def asof_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of its kind, interpolated to the time of each event."""
    rows = spectra(spark, sf_dir)
    day = F.floor(F.col("wave") / 86400).cast("int") * 86400.0 + 43200
    curve = rows.groupBy("kind", day.alias("x")).agg(F.avg("flux").alias("y"))
    found = T.asof_interpolate(rows.select("event_id", "kind", "wave"), curve, ["kind"], "wave", "x", "y", 86400.0)
    return found.select("event_id", F.round("interpolated", 5).alias("daily"))


# --- spectra

SEGMENT = 86400.0 * 3
POINTS_SQL = SPECTRA_SQL + ", w AS (SELECT spaxel, wave, avg(flux) AS flux FROM e GROUP BY 1, 2)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum points with distinct waves per spaxel."""
    return spectra(spark, sf_dir).groupBy("spaxel", "wave").agg(F.avg("flux").alias("flux"))


@query("wave_gradient", f"WITH {POINTS_SQL} SELECT spaxel, wave, round(CASE WHEN lag(wave) OVER o IS NOT NULL AND lead(wave) OVER o IS NOT NULL THEN (lead(wave) OVER o - lag(wave) OVER o) / 2 ELSE coalesce(wave - lag(wave) OVER o, lead(wave) OVER o - wave) END, 7) AS step FROM w WINDOW o AS (PARTITION BY spaxel ORDER BY wave)")
def wave_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.gradient(points(spark, sf_dir), ["spaxel"], "wave", SEGMENT)
    return found.select("spaxel", "wave", F.round("step", 7).alias("step"))


@query("trapezoid_flux", f"WITH {POINTS_SQL}, t AS (SELECT spaxel, (lead(wave) OVER o - wave) * (lead(flux) OVER o + flux) / 2 AS a FROM w WINDOW o AS (PARTITION BY spaxel ORDER BY wave)) SELECT spaxel, round(coalesce(sum(a), 0.0) / 1e6, 6) AS integral FROM t GROUP BY 1")
def trapezoid_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.trapezoid(points(spark, sf_dir), ["spaxel"], "wave", "flux", SEGMENT)
    return found.select("spaxel", F.round(F.col("integral") / 1e6, 6).alias("integral"))


@query("spectral_resample", f"WITH {POINTS_SQL}, n AS (SELECT spaxel, wave, flux, lead(wave) OVER o AS w1, lead(flux) OVER o AS f1 FROM w WINDOW o AS (PARTITION BY spaxel ORDER BY wave)), k AS (SELECT unnest(range(120)) AS k) "
       "SELECT spaxel, k::INTEGER AS k, round(flux + (f1 - flux) * (k * 21600.0 - wave) / (w1 - wave), 5) AS flux FROM n JOIN k ON k * 21600.0 >= wave AND k * 21600.0 < w1")
def spectral_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra on a regular axis, linear between their points."""
    found = X.resample_linear(points(spark, sf_dir), ["spaxel"], "wave", "flux", 0.0, 21600.0, 120, SEGMENT)
    return found.select("spaxel", "k", F.round("resampled", 5).alias("flux"))


def _all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean flux per kind on points six hours apart, to the last one."""
    k = F.floor(F.col("wave") / 21600).cast("int")
    return spectra(spark, sf_dir).groupBy("kind", k.alias("k")).agg(F.avg("flux").alias("flux"))


def _simpson_all_sql(even: str) -> str:
    return (
        f"WITH {SPECTRA_SQL}, h AS (SELECT kind, floor(wave / 21600)::INTEGER AS k, avg(flux) AS flux FROM e GROUP BY 1, 2), m AS (SELECT *, max(k) OVER (PARTITION BY kind) AS z FROM h), n AS (SELECT *, z - z % 2 AS y FROM m) "
        "SELECT kind, round(0.25 / 3 * (coalesce(sum(flux) FILTER (y > 0 AND (k = 0 OR k = y)), 0) + 4 * coalesce(sum(flux) FILTER (k % 2 = 1 AND k < y), 0) + "
        f"2 * coalesce({even}, 0)) + 0.25 / 2 * coalesce(sum(flux) FILTER (z > y AND k >= y), 0), 5) AS integral FROM n GROUP BY 1"
    )


_SIMPSON_SQL = _simpson_all_sql("sum(flux) FILTER (k % 2 = 0 AND k > 0 AND k < y)")
_LEGACY_SQL = _simpson_all_sql("count(*) FILTER (k % 2 = 0 AND k > 0 AND k < y) * max(flux) FILTER (k = y - 1)")


@query("simpson", _SIMPSON_SQL)
@query("simpson_all", _SIMPSON_SQL)
def simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simpson's rule over the whole spectrum."""
    return X.simpson_closed(_all_points(spark, sf_dir), ["kind"], "k", "flux", 0.25).select("kind", F.round("integral", 5).alias("integral"))


@query("simpson_legacy", _LEGACY_SQL)
@query("simpson_all_legacy", _LEGACY_SQL)
def simpson_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole spectrum with the fault of old products, for comparison."""
    return X.simpson_closed(_all_points(spark, sf_dir), ["kind"], "k", "flux", 0.25, legacy=True).select("kind", F.round("integral", 5).alias("integral"))


_LINES = [200000.0, 900000.0, 1500000.0]


@query("good_pixels", f"WITH {SPECTRA_SQL} SELECT spaxel, count(*) FILTER (" + " AND ".join(f"abs(wave - {x}) > 30000" for x in _LINES) + ") AS n_good, count(*) AS n FROM e GROUP BY 1")
def good_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = X.good_pixels(F.col("wave"), _LINES, 30000.0)
    return spectra(spark, sf_dir).groupBy("spaxel").agg(F.count_if(good).alias("n_good"), F.count(F.lit(1)).alias("n"))


@query("window_snr", f"WITH {SPECTRA_SQL}, i AS (SELECT spaxel, flux FROM e WHERE wave BETWEEN 400000 AND 1600000), m AS (SELECT spaxel, median(flux) AS m FROM i GROUP BY 1), d AS (SELECT spaxel, any_value(m) AS m, median(abs(flux - m)) AS s FROM i JOIN m USING (spaxel) GROUP BY 1) SELECT spaxel, round(m / nullif(s, 0), 5) AS snr FROM d")
def window_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.window_snr(spectra(spark, sf_dir), ["spaxel"], "flux", F.col("wave").between(400000, 1600000))
    return found.select("spaxel", F.round("snr", 5).alias("snr"))


_START, _WIDTH = X.log_bins(1e4, 2.4e6, 32)


@query("log_rebin", f"WITH {SPECTRA_SQL} SELECT kind, least(floor((ln(wave) - {_START!r}) / {_WIDTH!r})::INTEGER, 31) AS bin, round(avg(flux), 5) AS flux FROM e WHERE wave >= 10000 AND wave < 2400000 GROUP BY 1, 2")
def log_rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log_rebin(spectra(spark, sf_dir), ["kind"], "wave", "flux", 1e4, 2.4e6, 32).withColumn("flux", F.round("flux", 5))


@query("band_fill", f"WITH {SPECTRA_SQL}, b AS (SELECT spaxel, floor(wave / 300000)::INTEGER AS band, CASE WHEN count(*) > 6 THEN avg(flux) END AS flux FROM e GROUP BY 1, 2) SELECT spaxel, band, round(coalesce(last_value(flux IGNORE NULLS) OVER (PARTITION BY spaxel ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(flux IGNORE NULLS) OVER (PARTITION BY spaxel ORDER BY band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS filled FROM b")
def band_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band means with few points taken from a neighbouring band."""
    bands = spectra(spark, sf_dir).groupBy("spaxel", F.floor(F.col("wave") / 300000).cast("int").alias("band")).agg(
        F.when(F.count(F.lit(1)) > 6, F.avg("flux")).alias("flux")
    )
    return X.fill_bands(bands, ["spaxel"], "band", "flux").select("spaxel", "band", F.round("filled", 5).alias("filled"))


# --- quality

_QA = "CASE WHEN mass_error > 0.05 THEN 'mass' END, CASE WHEN n < 30 THEN 'few' END, CASE WHEN valid < 0.3 THEN 'valid' END"


@query("quality_flags", f"WITH {STARS_SQL}, a AS (SELECT galaxy_id, count(*) AS n, round(abs(sum(mass) FILTER (sqrt(x * x + y * y) < 8) / sum(mass) - 1), 6) AS mass_error, round(count(*) FILTER (abs(z) < 1) / count(*), 6) AS valid FROM s GROUP BY 1) "
       f"SELECT galaxy_id, n, array_to_string(list_filter([{_QA}], lambda x: x IS NOT NULL), ';') AS flags FROM a")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of galaxies whose mass, count or share of thin-disk stars is off."""
    inside = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) < 8
    sums = stars(spark, sf_dir).groupBy("galaxy_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.abs(F.sum(F.when(inside, F.col("mass"))) / F.sum("mass") - 1), 6).alias("mass_error"),
        F.round(F.count_if(F.abs("z") < 1) / F.count(F.lit(1)), 6).alias("valid"),
    )
    flags = F.array_compact(
        F.array(F.when(F.col("mass_error") > 0.05, "mass"), F.when(F.col("n") < 30, "few"), F.when(F.col("valid") < 0.3, "valid"))
    )
    return sums.select("galaxy_id", "n", F.array_join(flags, ";").alias("flags"))


@query("success_report", "SELECT ifu_design, count(*) AS n, round(count(*) FILTER (n_star_part >= 100000) / count(*), 6) AS success, round(median(re_kpc) FILTER (n_star_part >= 100000), 6) AS median_re FROM wave2_manifest GROUP BY 1")
def success_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of and median over the rows that pass, per design."""
    rows = table(spark, sf_dir, "wave2_manifest").select("ifu_design", "re_kpc", (F.col("n_star_part") >= 100000).alias("good"))
    rates = rows.groupBy("ifu_design").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("good") / F.count(F.lit(1)), 6).alias("success"))
    middle = linear_quantiles(rows.filter("good"), ["ifu_design"], "re_kpc", [0.5], F.floor(F.col("re_kpc") * 8))
    return rates.join(middle, "ifu_design", "left").select("ifu_design", "n", "success", F.round(F.col("q")[0], 6).alias("median_re"))


_SCALES = [1.0, 2.0, 4.0, 8.0]


_MMD_SQL = (
    "WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, label % 2 AS side FROM embeddings), p AS (SELECT a.side AS s, b.side AS t, list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(z[1] - z[2], 2))) AS d FROM m a, m b) "
    "SELECT round(sum(CASE WHEN s = t THEN k / n ELSE -k / n END), 5) AS mmd FROM (SELECT s, t, sum(" + " + ".join(f"exp(-d / {2 * s * s})" for s in _SCALES) + ") AS k, count(*) AS n FROM p GROUP BY 1, 2)"
)


@query("mmd_rbf", _MMD_SQL)
@query("mmd_rbf_all", _MMD_SQL)
def mmd_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel discrepancy of the vectors of even and of odd labels, all of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 2).alias("side"))
    return T.kernel_discrepancy_all(rows, "e", "side", _SCALES).select(F.round("mmd", 5).alias("mmd"))
