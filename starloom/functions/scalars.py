"""Scalar library: unit conversion, ages, ids, labels and small array helpers as Column expressions.

Ratios are guarded (a zero divisor gives null, ANSI mode never raises); NaN inputs are expected to be null already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HUBBLE = 0.6774
OMEGA_M = 0.3089
HUBBLE_TIME_GYR = 977.792221 / 67.74
BYTES_STAR, BYTES_GAS = 9 * 8, 12 * 8


def none_if_nan(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def physical_length(value: Column, scale: Column) -> Column:
    """Comoving to physical kpc."""
    return value * scale / HUBBLE


def physical_mass(value: Column) -> Column:
    """Code mass to solar masses."""
    return value * 1e10 / HUBBLE


def peculiar_velocity(value: Column, scale: Column) -> Column:
    return value * F.sqrt(scale)


def physical_potential(value: Column, scale: Column) -> Column:
    return value / scale


def linear_age_gyr(scale: Column) -> Column:
    """Linear age proxy of a formation scale factor, at least 0.001."""
    return F.greatest(F.lit(1e-3), 13.8 * (1 - F.greatest(F.lit(1e-4), F.least(scale, F.lit(1.0)))))


def cosmic_time_gyr(scale: Column) -> Column:
    """Age of the universe at a scale factor, flat universe with cosmological constant, closed form."""
    dark = 1 - OMEGA_M
    return 2 / (3 * math.sqrt(dark)) * HUBBLE_TIME_GYR * F.asinh(math.sqrt(dark / OMEGA_M) * F.pow(scale, F.lit(1.5)))


def stellar_age_gyr(formation: Column, now: Column, floor: float = 1e-3) -> Column:
    """Time between formation and now, not below floor."""
    return F.greatest(F.lit(floor), cosmic_time_gyr(now) - cosmic_time_gyr(formation))


def cutout_megabytes(n_star: Column, n_gas: Column) -> Column:
    """Estimated size of a particle cutout."""
    return (n_star * BYTES_STAR + n_gas * BYTES_GAS) / 1e6


def coverage_radius(re_kpc: Column, sample: Column) -> Column:
    """Coverage radius: 2.5 effective radii in the secondary sample (2), else 1.5; re at least 1e-6."""
    return F.greatest(re_kpc, F.lit(1e-6)) * F.when(sample == 2, 2.5).otherwise(1.5)


def threshold_key(threshold: Column) -> Column:
    """Percent key of three digits, halves rounded to even."""
    return F.lpad(F.bround(threshold * 100, 0).cast("int").cast("string"), 3, "0")


def age_from_token(token: Column) -> Column:
    """Gyr from a token such as 500Myr or 2.0Gyr; null for anything else."""
    number = F.nullif(F.regexp_extract(token, r"(?i)([0-9]*\.?[0-9]+)\s*[MG]yr", 1), F.lit("")).cast("double")
    return F.when(F.lower(token).contains("myr"), number / 1000).otherwise(number)


def metallicity_from_token(token: Column) -> Column:
    """Metallicity from z02 or z0.02: digits without a point follow a point."""
    digits = F.nullif(F.regexp_extract(token, r"(?i)z([0-9.]+)", 1), F.lit(""))
    return F.when(digits.contains("."), digits).otherwise(F.concat(F.lit("0."), digits)).cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def certainty(sigma: Column, reference: float) -> Column:
    """reference^2 / (sigma^2 + reference^2)."""
    return reference**2 / (sigma * sigma + reference**2)


def z_score(x: Column, mean: Column, spread: Column) -> Column:
    return (x - mean) / F.greatest(spread, F.lit(1e-6))


def sparse_ladder(value: Column, edges: list[float], labels: list[str], missing: str = "missing") -> Column:
    """Label of the first edge that value lies under; the last label beyond all, missing for null."""
    found = F.when(value.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        found = found.when(value < edge, label)
    return found.otherwise(labels[-1])


def plain_name(name: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def unit_vector(vector: Column) -> Column:
    """Array scaled to length 1; null for a zero vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(vector, lambda v: v / norm))


def first_argmax(values: Column) -> Column:
    """Position from 0 of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def entropy(values: Column, classes: int) -> Column:
    """Entropy of probabilities over ln(classes); zero probabilities add nothing."""
    total = F.aggregate(values, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return total / math.log(classes)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two probability arrays."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)

    pairs = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def all_agree(values: list[Column], wanted: Column) -> Column:
    """Whether all filled values equal wanted; null if none is filled."""
    filled = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(filled) > 0, F.forall(filled, lambda v: v == wanted))


def truth(text: Column) -> Column:
    """Whether a text says yes: 1, true, yes or y in any case; everything else, null too, is no."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def clamped_int(text: Column, default: int, low: int, high: int) -> Column:
    """Whole number from a text, the default where it is none, kept within bounds."""
    return F.greatest(F.lit(low), F.least(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(high)))


def point_limit(wanted: Column, upper: int) -> Column:
    """How many points to show: 0, negative or null means all up to upper."""
    return F.when(wanted > 0, F.least(wanted, F.lit(upper))).otherwise(F.lit(upper))


def noise_shape(wave: Column) -> Column:
    """Throughput of a spectrograph over wavelength: logistic edges of 100 at 3900 and 10100, on a floor of 1."""
    return 1 / (1 + F.exp(-(wave - 3900) / 100)) / (1 + F.exp((wave - 10100) / 100)) + 1


def noise_amplitude(wave: Column, level: Column, signal_to_noise: float = 5.0) -> Column:
    """Noise amplitude at a wavelength for a flux level; 1.7361 is the gain of combining dithers."""
    return 3.0 * level / (signal_to_noise / 1.7361) / noise_shape(wave)


def isotropic_views() -> list[tuple[float, float, float]]:
    """The six view directions of an icosahedron turned so that one vertex lies on x: by falling x, y and z."""
    golden = (1 + math.sqrt(5)) / 2
    norm = math.hypot(1, golden)
    c, s = golden / norm, 1 / norm
    corners = [(a * p, b * q, 0.0) for p in (1, -1) for q in (1, -1) for a, b in ((1, golden),)]
    corners = [v for x, y, z in corners for v in ((x, y, z), (z, x, y), (y, z, x))]
    turned = [tuple(round(v / norm, 12) + 0.0 for v in (c * x + s * z, y, c * z - s * x)) for x, y, z in corners]
    return sorted((v for v in turned if v[0] > 0), reverse=True)


def view_vector(view: Column, repeats: Column) -> Column:
    """Direction of a view: a coordinate axis where a galaxy has at most three views, else an isotropic one; null beyond the last."""
    arrays = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    axes = arrays([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])
    return F.when(repeats <= 3, F.get(axes, view)).otherwise(F.get(arrays(isotropic_views()), view))


def json_vector(text: Column, name: str, long_name: str) -> Column:
    """Vector of three numbers from JSON under any of three namings: name_x, name_y and name_z; name; long_name."""
    parts = F.array(*(F.get_json_object(text, f"$.{name}_{a}").try_cast("double") for a in "xyz"))
    listed = [F.from_json(F.get_json_object(text, f"$.{n}"), "array<double>") for n in (name, long_name)]
    return F.coalesce(F.when(F.forall(parts, lambda v: v.isNotNull()), parts), *listed)


def wave_axis(n: Column, start: Column, step: Column, reference: Column) -> Column:
    """Array of n wavelengths of a linear axis: start is the wavelength of the reference pixel, counted from 1."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: start + (i - reference) * step)


def unwrapped(value: Column, box: float) -> Column:
    """Coordinate of a periodic box moved to around its corner: the half beyond the middle is taken to the other side."""
    moved = value + box / 2
    return F.when(moved > box, moved - box).otherwise(moved) - box / 2
