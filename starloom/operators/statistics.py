"""Agreement, calibration and distribution statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.running import linear_quantiles, running_sums
from starloom.operators.spectral import with_neighbours
from starloom.plans.durable import durable, spread


UNROLLED = 64
LIBRARY = 500_000  # distinct places of a library that are broadcast (12 MB)


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation from sums; 0 where either side is constant or there are no pairs."""
    n, va, vb = F.count(F.lit(1)), F.var_pop(a), F.var_pop(b)
    return F.when((n > 1) & (va > 0) & (vb > 0), F.try_divide(F.covar_pop(a, b), F.sqrt(va) * F.sqrt(vb))).otherwise(0.0)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], bin_of: Column) -> DataFrame:
    """Linear percentiles p<100 q> per key, exact, over bins of the value."""
    found = linear_quantiles(df, keys, value, points, bin_of)
    return found.select(*keys, *(F.col("q")[k].alias(f"p{round(100 * q):02d}") for k, q in enumerate(points)))


def soft_iou(df: DataFrame, item: str, group: str, place: Sequence[str], value: str) -> DataFrame:
    """(item, a, b, iou): sum of minima over sum of maxima of the values of two groups in the same places; a < b in order.

    A place that only one group fills adds its value to the union.  No value at all gives null.
    """
    totals = df.groupBy(item, group).agg(F.sum(value).alias("_t"))
    pairs = totals.alias("l").join(totals.alias("r"), item).filter(F.col(f"l.{group}") < F.col(f"r.{group}"))
    pairs = pairs.select(item, F.col(f"l.{group}").alias("a"), F.col(f"r.{group}").alias("b"), (F.col("l._t") + F.col("r._t")).alias("_both"))
    left = df.select(item, *place, F.col(group).alias("a"), F.col(value).alias("_x"))
    right = df.select(item, *place, F.col(group).alias("b"), F.col(value).alias("_y"))
    shared = left.join(right, [item, *place]).filter("a < b").groupBy(item, "a", "b").agg(F.sum(F.least("_x", "_y")).alias("_i"))
    joined = pairs.join(shared, [item, "a", "b"], "left").withColumn("_i", F.coalesce("_i", F.lit(0.0)))
    return joined.select(item, "a", "b", F.try_divide(F.col("_i"), F.nullif(F.col("_both") - F.col("_i"), F.lit(0.0))).alias("iou"))


def confusion_scores(df: DataFrame, classes: Sequence[str], truth: str, guess: str) -> DataFrame:
    """(class, iou, dice, accuracy) of hard labels; null where a class occurs on neither side."""
    counts = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("_n"))  # classes squared
    sums = []
    for c in classes:
        t, g = F.col(truth) == c, F.col(guess) == c
        hit, either = F.sum(F.when(t & g, F.col("_n"))), F.sum(F.when(t | g, F.col("_n")))
        both = F.coalesce(F.sum(F.when(t, F.col("_n"))), F.lit(0)) + F.coalesce(F.sum(F.when(g, F.col("_n"))), F.lit(0))
        hit = F.coalesce(hit, F.lit(0))
        sums.append(F.struct(F.lit(c).alias("class"), F.try_divide(hit, either).alias("iou"), F.try_divide(2 * hit, F.nullif(both, F.lit(0))).alias("dice")))
    accuracy = F.try_divide(F.sum(F.when(F.col(truth) == F.col(guess), F.col("_n")).otherwise(0)), F.sum("_n"))
    whole = counts.agg(F.array(*sums).alias("_c"), accuracy.alias("accuracy"))
    return whole.select(F.explode("_c").alias("_c"), "accuracy").select("_c.*", "accuracy")


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int) -> DataFrame:
    """(ece): mean gap of confidence and accuracy over bins (lo, hi], weighted by their rows."""
    at = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1)).cast("int")
    gaps = df.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg(confidence).alias("_c"), F.avg(F.col(correct).cast("double")).alias("_a"))
    return gaps.agg((F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auroc): rank-sum area, ties halved; null unless both classes occur.

    Distinct scores are combined first and summed over bins between their percentiles, so the scale of the scores is free.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    edges = counts.agg(F.percentile_approx(score, [k / 100 for k in range(1, 100)], 1000).alias("_edges"))
    binned = counts.join(F.broadcast(edges), F.lit(True))  # one row
    bins = binned.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(score)))).drop("_edges")
    totals = bins.groupBy("_b").agg(F.sum("_q").alias("_bq"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bin
    carried = totals.select("_b", F.coalesce(F.sum("_bq").over(before), F.lit(0)).alias("_c"))
    inside = Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    under = bins.join(carried, "_b").withColumn("_u", F.col("_c") + F.coalesce(F.sum("_q").over(inside), F.lit(0)))
    wins = F.sum(F.col("_p") * (F.col("_u") + F.col("_q") / 2.0))
    return under.agg(F.try_divide(wins, F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0)).cast("double")).alias("auroc"))


def effective_count(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """(keys, n_eff): squared sum of weights over sum of squares, 0 without weight."""
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(weight) ** 2, F.nullif(F.sum(F.col(weight) ** 2), F.lit(0.0))), F.lit(0.0)).alias("n_eff"))


def normal_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, spread, low, high): population deviation; nulls left out."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def conformal_thresholds(df: DataFrame, stratum: str, score: str, alpha: float, least: int, bins: int = 1000) -> DataFrame:
    """(stratum, n, threshold): finite-sample quantile of the scores of each stratum, the overall one where it has too few rows.

    Scores lie in [0, 1] and are counted over bins first, so neither a stratum nor the whole is sorted in one task.
    """
    counts = df.groupBy(stratum, score).agg(F.count(F.lit(1)).alias("_n"))

    def quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.sum("_n").alias("_all"))
        level = F.least(F.lit(1.0), F.ceil((F.col("_all") + 1) * (1 - alpha)) / F.col("_all"))
        run = running_sums(rows, keys, [score], {"_run": F.col("_n").cast("double")}, F.floor(F.col(score) * bins))
        placed = run.join(sizes, keys) if keys else run.join(F.broadcast(sizes), F.lit(True))  # one row
        at = placed.withColumn("_h", level * (F.col("_all") - 1))
        lower = F.min(F.when(F.col("_run") > F.floor("_h"), F.col(score)))
        upper = F.min(F.when(F.col("_run") > F.ceil("_h"), F.col(score)))
        part = F.max(F.col("_h") - F.floor("_h"))
        return at.groupBy(*keys).agg(F.max("_all").alias("n"), (lower + part * (upper - lower)).alias("threshold"))

    merged = counts.groupBy(score).agg(F.sum("_n").alias("_n")).withColumn("_whole", F.lit(0))
    overall = quantiles(merged, ["_whole"]).select(F.col("threshold").alias("_overall"))
    joined = quantiles(counts, [stratum]).join(F.broadcast(overall), F.lit(True))  # one row
    return joined.select(stratum, "n", F.when(F.col("n") >= least, F.col("threshold")).otherwise(F.col("_overall")).alias("threshold"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, dim, mean): mean of each component of array rows."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "_v")).groupBy(*keys, "dim").agg(F.avg(F.col("_v").cast("double")).alias("mean"))


def nearest_template(rows: DataFrame, templates: DataFrame, features: Sequence[str], template: str, max_templates: int = 10_000) -> DataFrame:
    """Rows with their nearest template (Euclidean, smallest id of equals).  templates is a library of checked size.

    Nothing is paired up or shuffled: a library of up to UNROLLED templates becomes one compiled expression, a larger one
    a broadcast array that each row scans.
    """
    listed = templates.select(template, *features).limit(max_templates + 1).collect()
    if len(listed) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    kind = templates.schema[template].dataType

    def squared(of: dict) -> Column:
        return sum(((of[f] - F.col(f)) ** 2 for f in features[1:]), (of[features[0]] - F.col(features[0])) ** 2)

    if len(listed) <= UNROLLED:
        pairs = [F.struct(squared({f: F.lit(float(t[f])) for f in features}).alias("d"), F.lit(t[template]).cast(kind).alias("id")) for t in listed]
        best = F.array_min(F.array(*pairs)) if pairs else F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast(kind).alias("id"))
        joined = rows.withColumn("_best", best)
    else:
        array = templates.agg(F.collect_list(F.struct(template, *features)).alias("_t"))
        scanned = F.array_min(F.transform("_t", lambda t: F.struct(squared({f: t[f] for f in features}).alias("d"), t[template].alias("id"))))
        joined = rows.join(F.broadcast(array), F.lit(True)).withColumn("_best", scanned)  # one row
    return joined.select(*[F.col(c) for c in rows.columns], F.col("_best.id").alias(template), F.sqrt("_best.d").alias("distance"))


class _Strips:
    """A library of places in strips of the first coordinate, each in order of the second; finds the nearest of many places at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count = max(1, int(math.sqrt(len(a))))
        by_a = np.argsort(a, kind="stable")
        strip = np.empty(len(a), dtype=int)
        strip[by_a] = np.arange(len(a)) * self.count // len(a)
        self.order = np.lexsort((b, strip))  # place in the given library of each sorted one
        self.a, self.b, strip = a[self.order], b[self.order], strip[self.order]
        self.start, self.end = np.searchsorted(strip, np.arange(self.count)), np.searchsorted(strip, np.arange(self.count), "right")
        self.low, self.high = (np.array([f(self.a[i:j]) for i, j in zip(self.start, self.end, strict=True)]) for f in (np.min, np.max))
        self.b_low, self.b_range = b.min(), (b.max() - b.min()) * (1 + 1e-9) or 1.0
        self.key = strip + (self.b - self.b_low) / self.b_range * 0.999

    def _scan(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, strip: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Go up and down a strip from each place's own height until nothing there can be nearer."""
        height = np.clip((y[at] - self.b_low) / self.b_range, 0, 1) * 0.999
        middle = np.clip(np.searchsorted(self.key, strip + height), self.start[strip], self.end[strip])
        for step, here in ((1, middle), (-1, middle - 1)):
            who, place, bound = at, here, self.end[strip] if step > 0 else self.start[strip] - 1
            while len(who):
                live = place < bound if step > 0 else place > bound
                who, place, bound = who[live], place[live], bound[live]
                rise = (self.b[place] - y[who]) ** 2
                live = rise <= best[who]
                who, place, bound, rise = who[live], place[live], bound[live], rise[live]
                d = (self.a[place] - x[who]) ** 2 + rise
                nearer = (d < best[who]) | ((d == best[who]) & (self.order[place] < found[who]))
                best[who[nearer]], found[who[nearer]] = d[nearer], self.order[place[nearer]]
                place = place + step

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, place in the library, the first of equals) for each place."""
        best, found = np.full(len(x), np.inf), np.full(len(x), len(self.a))
        own = np.clip(np.searchsorted(self.low, x, "right") - 1, 0, self.count - 1)
        everyone = np.arange(len(x))
        self._scan(x, y, everyone, own, best, found)
        for step in (1, -1):
            at, strip = everyone, own + step
            while len(at):
                inside = (strip >= 0) & (strip < self.count)
                at, strip = at[inside], strip[inside]
                gap = np.maximum(self.low[strip] - x[at] if step > 0 else x[at] - self.high[strip], 0)
                near = gap**2 <= best[at]
                at, strip = at[near], strip[near]
                self._scan(x, y, at, strip, best, found)
                strip = strip + step
        return best, found


def _search_sorted(library: DataFrame, kind: str) -> Callable[[Column, Column], Column]:
    """Nearest template (_id, _d squared) of a place as a vectorised function over the broadcast library."""
    listed = library.orderBy("_id").toPandas()  # LIBRARY rows at most; in order of id, so that the first of equals has the smallest
    a, b = (listed[c].to_numpy(float) for c in ("_ta", "_tb"))
    shared = library.sparkSession.sparkContext.broadcast((_Strips(a, b), listed["_id"].to_numpy()))

    @F.pandas_udf(f"_id {kind}, _d double")
    def search(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        strips, ids = shared.value
        xs, ys = a.to_numpy(float), b.to_numpy(float)
        good = ~np.isnan(xs) & ~np.isnan(ys)
        best, found = strips.nearest(xs[good], ys[good])
        names, squared = np.full(len(xs), None, dtype=object), np.full(len(xs), np.nan)
        names[good], squared[good] = ids[found], best
        return pd.DataFrame({"_id": pd.Series(names, dtype=object), "_d": squared})

    return search


def nearest_in_plane(rows: DataFrame, templates: DataFrame, a: str, b: str, template: str) -> DataFrame:
    """Rows with the nearest of any number of templates in the plane of a and b (smallest id of equals), and its distance.

    A library of at most LIBRARY distinct places is broadcast and searched in vectorised batches, without any shuffle of the
    rows; a larger one by joins over cells, as follows.  Templates are put in square cells of about one each.  A place looks into rings of cells around its own that double in
    width until the best distance is not larger than the way to the edge of the ring.  Only the places that are not proven
    go to the next round, at a cell size of the ring's width, where each is joined with the nine cells around it; the last round's
    cell holds the whole library, so it always ends.  Places without templates, or with a null or NaN, have a null template.
    """
    kind = templates.schema[template].dataType
    number = lambda c: F.col(c).cast("double")
    good = lambda x, y: x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    library = templates.select(number(a).alias("_ta"), number(b).alias("_tb"), F.col(template).alias("_id")).filter(good(F.col("_ta"), F.col("_tb")))
    library = durable(library.groupBy("_ta", "_tb").agg(F.min("_id").alias("_id")))
    box = library.agg(F.count(F.lit(1)), F.min("_ta"), F.max("_ta"), F.min("_tb"), F.max("_tb")).first()
    places = rows.select(number(a).alias("_a"), number(b).alias("_b")).distinct()
    if not box[0]:
        found = places.select("_a", "_b", F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("double").alias("_d")).limit(0)
    elif box[0] <= LIBRARY:
        best = spread(rows).withColumn("_best", _search_sorted(library, kind.simpleString())(number(a), number(b)))
        return best.select(*[F.col(c) for c in rows.columns], F.col("_best._id").alias(template), F.sqrt("_best._d").alias("distance"))
    else:
        found = _search_rings(places.filter(good(F.col("_a"), F.col("_b"))), library, box)
    keyed = rows.withColumns({"_ka": number(a), "_kb": number(b)})
    joined = keyed.join(found, F.col("_ka").eqNullSafe(F.col("_a")) & F.col("_kb").eqNullSafe(F.col("_b")), "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.col("_id").alias(template), F.sqrt("_d").alias("distance"))


def _search_rings(places: DataFrame, library: DataFrame, box: tuple) -> DataFrame:
    """(_a, _b, _id, _d): nearest of the library for each distinct place, _d squared; box: count and bounds of the library."""
    count, low_a, high_a, low_b, high_b = box
    wide, high = high_a - low_a, high_b - low_b
    whole = max(wide, high)
    size = max(math.sqrt(wide * high / count), whole / count) or 1.0
    # a place outside the library is searched from the nearest point of its box; rings grow around that
    to_box = {"_ca": F.greatest(F.lit(low_a), F.least(F.lit(high_a), F.col("_a"))), "_cb": F.greatest(F.lit(low_b), F.least(F.lit(high_b), F.col("_b")))}
    left = places.withColumns(to_box)
    done = []
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    cell = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(size)).cast("bigint")
    while True:
        last = size > whole
        cells = library.withColumns({"_la": cell("_ta", low_a), "_lb": cell("_tb", low_b)})
        near = left.withColumns({"_x": cell("_ca", low_a), "_y": cell("_cb", low_b)}).withColumn("_s", steps)
        near = near.withColumns({"_la": F.col("_x") + F.col("_s.i"), "_lb": F.col("_y") + F.col("_s.j")})
        da, db = F.col("_ta") - F.col("_a"), F.col("_tb") - F.col("_b")
        d = da * da + db * db
        best = near.join(cells, ["_la", "_lb"], "left").groupBy("_a", "_b", "_ca", "_cb", "_x", "_y").agg(
            F.min(F.when(F.col("_id").isNotNull(), F.struct(d.alias("d"), F.col("_id").alias("id")))).alias("_best")
        )
        if last:
            return reduce(DataFrame.unionByName, [*done, best.select("_a", "_b", F.col("_best.id").alias("_id"), F.col("_best.d").alias("_d"))])
        # templates outside the nine cells are at least this far from the place, as the box lies on one side of it
        edge = F.least(
            F.col("_ca") - (F.lit(low_a) + (F.col("_x") - 1) * size), F.lit(low_a) + (F.col("_x") + 2) * size - F.col("_ca"),
            F.col("_cb") - (F.lit(low_b) + (F.col("_y") - 1) * size), F.lit(low_b) + (F.col("_y") + 2) * size - F.col("_cb"),
        )
        beyond = (F.col("_a") - F.col("_ca")) ** 2 + (F.col("_b") - F.col("_cb")) ** 2 + edge * edge
        best = durable(best.withColumn("_sure", F.coalesce(F.col("_best.d") < beyond * (1 - 1e-9), F.lit(False))))
        done.append(best.filter("_sure").select("_a", "_b", F.col("_best.id").alias("_id"), F.col("_best.d").alias("_d")))
        left = best.filter(~F.col("_sure")).select("_a", "_b", "_ca", "_cb")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        size *= 2


def range_join(
    left: DataFrame, right: DataFrame, x: str, y: str, rx: str, ry: str, radius: float, equal: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Pairs within a radius in the plane: right rows are sent to the 9 cells around their own, then joined by cell.

    equal: further (left, right) columns that must agree; column names of the two sides must differ.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = right.withColumn("_m", F.explode(steps)).withColumns({"_cx": cell(rx) + F.col("_m.a"), "_cy": cell(ry) + F.col("_m.b")}).drop("_m")
    near = left.withColumns({"_lx": cell(x), "_ly": cell(y)})
    on = (F.col("_lx") == F.col("_cx")) & (F.col("_ly") == F.col("_cy"))
    for a, b in equal:
        on = on & (F.col(a) == F.col(b))
    near = near.join(spread, on)
    squared = (F.col(x) - F.col(rx)) ** 2 + (F.col(y) - F.col(ry)) ** 2
    return near.withColumn("distance", F.sqrt(squared)).filter(F.col("distance") <= radius).drop("_cx", "_cy", "_lx", "_ly")


def asof_interpolate(rows: DataFrame, curve: DataFrame, keys: Sequence[str], x: str, cx: str, cy: str, width: float | None = None) -> DataFrame:
    """Rows with the curve's value at x: linear between its points, flat beyond its ends; a key without points gives null.

    The stretches between neighbouring points are put into the bins of the given width that they touch (unless given, the
    mean distance of the points), and rows meet them by key and bin: no curve is held in one row, and a hot key is spread over its bins.
    Points at the same place count once, with the smallest value; a null x gives null.
    """
    points = curve.filter(F.col(cx).isNotNull()).groupBy(*keys, F.col(cx).cast("double").alias("_x0")).agg(F.min(cy).alias("_y0"))
    if width is None:
        n, low, high = points.agg(F.count(F.lit(1)), F.min("_x0"), F.max("_x0")).first()
        width = (high - low) / n if n and high > low else 1.0
    nxt = with_neighbours(points, keys, "_x0", width * 64, ["_y0"])
    bin_of = lambda c: F.floor(c / width).cast("bigint")
    stretches = nxt.filter("next__x0 is not null").withColumn("_b", F.explode(F.sequence(bin_of(F.col("_x0")), bin_of(F.col("next__x0")))))
    stretches = stretches.select(*keys, "_b", "_x0", "_y0", F.col("next__x0").alias("_x1"), F.col("next__y0").alias("_y1"))
    first, last = F.min_by("_y0", "_x0").alias("_y_first"), F.max_by("_y0", "_x0").alias("_y_last")
    ends = points.groupBy(*keys).agg(F.min("_x0").alias("_x_first"), first, F.max("_x0").alias("_x_last"), last)
    near = rows.withColumn("_b", bin_of(F.col(x)))
    names = lambda df: df.select(*(F.col(k).alias(f"_r_{k}") if k in keys else F.col(k).alias("_r_b") if k == "_b" else F.col(k) for k in df.columns))
    right = names(stretches)
    on = (F.col("_b") == F.col("_r_b")) & (F.col(x) >= F.col("_x0")) & (F.col(x) < F.col("_x1"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    joined = near.join(right, on, "left").drop(*(f"_r_{k}" for k in keys), "_r_b").join(ends, list(keys), "left")
    inner = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    value = F.when(F.col(x) < F.col("_x_first"), F.col("_y_first")).when(F.col(x) >= F.col("_x_last"), F.col("_y_last")).otherwise(inner)
    return joined.select(*[F.col(c) for c in rows.columns], value.alias("interpolated"))


def kernel_discrepancy_all(df: DataFrame, vector: str, side: str, scales: Sequence[float], block: int = 256) -> DataFrame:
    """(mmd): mean Gaussian kernel within both sides less twice that between them, pairs of a vector with itself included.

    Every pair counts, so the work grows with the square of the vectors; null vectors and sides are left out.  The vectors
    are stored in blocks of at most block; each pair of blocks is one row, its kernel sums are one matrix product, and the
    pairs are spread over all tasks.  No side is collected or broadcast.
    """
    valid = df.filter(F.col(vector).isNotNull() & F.col(side).isNotNull()).select(F.col(vector).alias("_v"), F.col(side).alias("_s"))
    dealt = valid.repartition(valid.sparkSession.sparkContext.defaultParallelism)
    numbered = durable(dealt.withColumn("_n", F.monotonically_increasing_id()))
    blocks = durable(numbered.groupBy("_s", F.floor(F.col("_n") / block).alias("_b")).agg(F.collect_list("_v").alias("_es")))  # at most block vectors each
    others = blocks.select(F.col("_s").alias("_t"), F.col("_b").alias("_c"), F.col("_es").alias("_fs"))
    pairs = blocks.crossJoin(others.hint("shuffle_replicate_nl")).filter("_s < _t or (_s = _t and _b <= _c)")

    @F.pandas_udf("double")
    def kernel_sum(es: pd.Series, fs: pd.Series) -> pd.Series:
        sums = []
        for x, y in zip(es, fs, strict=True):
            x, y = np.stack(x).astype(float), np.stack(y).astype(float)
            d = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0.0)
            sums.append(float(sum(np.exp(-d / (2 * s * s)).sum() for s in scales)))
        return pd.Series(sums)

    # a pair of two blocks of one side stands for both orders, as does the pair of two sides
    twice = F.when((F.col("_s") == F.col("_t")) & (F.col("_b") == F.col("_c")), 1).otherwise(2)
    sums = pairs.select("_s", "_t", twice.alias("_w"), kernel_sum("_es", "_fs").alias("_k"))
    sizes = blocks.groupBy("_s").agg(F.sum(F.size("_es")).alias("_n"))  # one row per side
    same, apart = F.col("_s") == F.col("_t"), F.col("_s") != F.col("_t")
    totals = sums.groupBy("_s", "_t").agg(F.sum(F.col("_w") * F.col("_k")).alias("_k"))
    counts = totals.join(sizes, "_s").join(sizes.select(F.col("_s").alias("_t"), F.col("_n").alias("_m")), "_t")
    return counts.agg((F.sum(F.when(same, F.col("_k") / (F.col("_n") * F.col("_m")))) - F.coalesce(F.sum(F.when(apart, F.col("_k") / (F.col("_n") * F.col("_m")))), F.lit(0.0))).alias("mmd"))


