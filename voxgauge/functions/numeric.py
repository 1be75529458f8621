"""Numeric helpers shared by the verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    An expression repeated inside a lambda is recomputed per element; binding it as the single element of an
    array keeps it computed once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def is_finite(value: Column) -> Column:
    """Neither NaN nor infinite; null stays null."""
    value = value.cast("double")
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def known_false(value: Column, condition: Column) -> Column:
    """A comparison with NaN is false (Spark orders NaN above every number); null stays null."""
    return F.when(F.isnan(value.cast("double")), F.lit(False)).otherwise(condition)


def round4(value: Column) -> Column:
    """Round to four places; NaN and infinities become null."""
    value = value.cast("double")
    return F.when(is_finite(value), F.round(value, 4))


def clamp_half_even(value: Column, top: int) -> Column:
    """Half-even integer in ``0..top``; anything that is not a finite number counts as 0."""
    text = value.cast("string")
    number = F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))  # "3d" is not a number here

    def clamp(x: Column) -> Column:
        usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        whole = F.bround(F.least(F.greatest(x, F.lit(-1.0)), F.lit(top + 1.0)), 0).cast("int")
        return F.when(usable, F.least(F.greatest(whole, F.lit(0)), F.lit(top))).otherwise(F.lit(0))

    return let(number, clamp)


def duration_seconds(frames: Column, sample_rate: Column) -> Column:
    """Frames over rate; null when the rate is zero or unknown."""
    return F.when(sample_rate != 0, frames.cast("double") / sample_rate.cast("double"))


def gain(output: Column, source: Column) -> Column:
    """Output minus source; null when either side is missing."""
    return output - source


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors whose norms are already known; null when either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), dot(a, b) / F.greatest(norm_a * norm_b, F.lit(1e-8)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def calibrate(raw: Column, coefficients: tuple[float, float, float]) -> Column:
    """Quadratic calibration in Horner form."""
    a, b, c = coefficients
    return (F.lit(a) * raw + F.lit(b)) * raw + F.lit(c)


def nearest_rank(n: Column, p: float) -> Column:
    """Zero-based index of the nearest-rank percentile: half-even ``(n-1)*p`` kept inside the list."""
    index = F.bround((n - 1).cast("double") * F.lit(p), 0).cast("bigint")
    return F.least(n - 1, F.greatest(F.lit(0).cast("bigint"), index))
