"""Scalar expressions: geometry, normal distribution, clips, monotone transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in miles.
EARTH_MILES = 3958.8

# Coefficients of the double-precision normal CDF approximation
# (G. West, "Better approximations to cumulative normal functions", 2005).
WEST_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
          112.079291497871, 221.213596169931, 220.206867912376)
WEST_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
          296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Clip that keeps null (``greatest`` and ``least`` alone would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, _num(low))
    if high is not None:
        out = F.least(out, _num(high))
    return F.when(x.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(chord)) * (2 * EARTH_MILES)


def _horner(coefficients, z: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + F.lit(c)
    return out


#: From here on the tail is Laplace's continued fraction, cut after so many terms (relative error below 1e-10).
FAR, TERMS = 7.0, 8


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, with its tails."""
    z = F.abs(x)
    density = F.exp(-z * z / 2)
    near = density * _horner(WEST_P, z) / _horner(WEST_Q, z)
    fraction = z
    for k in range(TERMS, 0, -1):
        fraction = z + F.lit(float(k)) / fraction
    tail = F.when(z > FAR, density / (F.lit(math.sqrt(2 * math.pi)) * fraction)).otherwise(near)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same expression as SQL text; ``x`` must be a column name."""
    def horner(cs):
        text = repr(cs[0])
        for c in cs[1:]:
            text = f"({text} * abs({x}) + {c!r})"
        return text
    fraction = f"abs({x})"
    for k in range(TERMS, 0, -1):
        fraction = f"(abs({x}) + {float(k)} / {fraction})"
    density = f"exp(-abs({x}) * abs({x}) / 2)"
    tail = (f"(CASE WHEN abs({x}) > {FAR} THEN {density} / ({math.sqrt(2 * math.pi)!r} * {fraction})"
            f" ELSE {density} * {horner(WEST_P)} / {horner(WEST_Q)} END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_sf(x: Column) -> Column:
    return normal_cdf(-x)


def normal_log_cdf(x: Column) -> Column:
    """log CDF; the leading asymptotic terms replace the log of an underflowed tail."""
    deep = -x * x / 2 - F.log(-x) - 0.9189385332046727 + F.log1p(-1 / (x * x))
    return F.when(x < -6.5, deep).otherwise(F.log(normal_cdf(x)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def signed_square(x: Column) -> Column:
    return F.signum(x) * x * x


def weighted_difference(factors: Sequence[tuple[float, Column, Column]]) -> Column:
    """Sum of weight x (home - away) over the factors; null where any side of any factor is unknown."""
    first, *rest = [weight * (home - away) for weight, home, away in factors]
    return reduce(lambda total, part: total + part, rest, first)


def pythagorean(scored: Column, allowed: Column, exponent: float) -> Column:
    o = F.pow(clip(scored, low=1.0), F.lit(exponent))
    d = F.pow(clip(allowed, low=1.0), F.lit(exponent))
    return o / (o + d)


def half_even(x: Column, digits: int) -> Column:
    """Round half to even, as numpy does."""
    return F.bround(x, digits)


def value_bucket(x: Column) -> Column:
    """Coarse, order-preserving integer bucket of a double.

    16 buckets per power of two: about 4% relative width, independent of the
    data, so a skewed group is spread without a sampling pass. Nulls get the
    lowest bucket.
    """
    v = x.cast("double")
    step = F.floor(F.log2(F.abs(v)) * 16).cast("int") + 20_000
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(-100_000))
        .when(v > 0, step)
        .when(v < 0, -step)
        .otherwise(F.lit(0))
    )
