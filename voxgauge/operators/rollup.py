"""Multi-dimension roll-ups of three-valued verdicts in one pass over the details."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.functions.numeric import is_finite

SCALE = 10_000  # results carry four decimals
EXACT = "decimal(38,12)"  # row measures are summed as decimals: the same sum in any order
LARGE = 1e15  # larger values are summed as doubles; below it a decimal holds the sum of 10^11 rows


@dataclass(frozen=True)
class Measure:
    """Additive parts per row and how to finish them once summed."""

    parts: Mapping[str, Column]
    finish: object = field(repr=False)


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _four_places(units: Column, n: Column) -> Column:
    """``units / n`` in whole ten-thousandths, rounded half away from zero in integers; null when ``n`` is 0."""
    whole = F.call_function("div", F.abs(units) * 2 + n, F.nullif(n * 2, F.lit(0)))
    return F.sign(units) * whole / F.lit(float(SCALE))


def rate(flag: Column, among: Column | None = None) -> Measure:
    """True over non-null, four decimals; null when nothing is known."""
    keep = flag.isNotNull() if among is None else (flag.isNotNull() & among)
    return Measure(
        {"hit": _one(keep & flag), "n": _one(keep)}, lambda p: _four_places(p["hit"] * SCALE, p["n"]))


def mean(value: Column, among: Column | None = None, empty: float | None = None) -> Measure:
    """Mean of finite values, rounded to four decimals at the end; ``empty`` (null by default) when there is none.

    Values of ``LARGE`` and beyond count too; only their part of the sum is a sum of doubles.
    """
    keep = F.coalesce(is_finite(value), F.lit(False))
    keep = keep if among is None else keep & among
    small = F.abs(value) < LARGE
    total = F.coalesce(F.when(keep & small, value.cast(EXACT)), F.lit(0).cast(EXACT))
    return Measure(
        {"sum": total, "large": F.when(keep & ~small, value.cast("double")), "n": _one(keep)},
        lambda p: F.coalesce(F.round((p["sum"].cast("double") + F.coalesce(p["large"], F.lit(0.0)))
                                     / F.nullif(p["n"], F.lit(0)), 4), F.lit(empty)))


def count_if(condition: Column) -> Measure:
    return Measure({"n": _one(condition)}, lambda p: p["n"])


def share(condition: Column, of: Column | None = None) -> Measure:
    """True rows over all rows (false and null count against), 0.0 when there is no row."""
    base = F.lit(True) if of is None else of
    return Measure(
        {"hit": _one(condition & base), "n": _one(base)},
        lambda p: F.coalesce(_four_places(p["hit"] * SCALE, p["n"]), F.lit(0.0)))


def ratio_of(hits: Column, total: Column) -> Measure:
    """Pooled ratio of two row counts, e.g. passed components over known components."""
    zero = F.lit(0).cast("bigint")
    return Measure(
        {"hit": F.coalesce(hits.cast("bigint"), zero), "n": F.coalesce(total.cast("bigint"), zero)},
        lambda p: _four_places(p["hit"] * SCALE, p["n"]))


def _parts(measures: Mapping[str, Measure]) -> dict[str, Column]:
    return {f"{m}__{p}": c for m, spec in measures.items() for p, c in spec.parts.items()}


def partial_sums(details: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Measure]) -> DataFrame:
    """All measures summed per combination of dimension values; additive, so partial tables can be stacked."""
    return details.groupBy(*[c.cast("string").alias(f"_{d}") for d, c in dims.items()]).agg(
        *[F.sum(c).alias(n) for n, c in _parts(measures).items()])


def merge_partials(partials: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Measure]) -> DataFrame:
    """Stacked partial sums as one: same columns, one row per combination of dimension values."""
    return partials.groupBy(*[f"_{d}" for d in dims]).agg(*[F.sum(n).alias(n) for n in _parts(measures)])


def finish_summary(partials: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Measure]) -> DataFrame:
    """Long summary from (stacked) partial sums: one ``overall`` row and one row per value of every dimension."""
    names, parts = list(dims), list(_parts(measures))
    # the overall row exists even when there are no details
    nothing = partials.sparkSession.range(1).select(
        *[F.lit(None).cast("string").alias(f"_{d}") for d in names],
        *[F.lit(0).cast("bigint").alias(n) for n in parts])
    cells = F.array(
        F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("key")),
        *[F.struct(F.lit(f"by_{d}").alias("dim"), F.col(f"_{d}").alias("key")) for d in names],
    )
    summed = (
        partials.select(*[f"_{d}" for d in names], *parts).unionByName(nothing)
        .select(F.explode(F.filter(cells, lambda c: c["key"].isNotNull())).alias("_c"), *parts)
        .groupBy(F.col("_c.dim").alias("dim"), F.col("_c.key").alias("key"))
        .agg(*[F.sum(n).alias(n) for n in parts])
    )
    return summed.select("dim", "key", *[
        spec.finish({p: F.col(f"{m}__{p}") for p in spec.parts}).alias(m) for m, spec in measures.items()
    ])


def summarise(details: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Measure]) -> DataFrame:
    """Long summary ``(dim, key, measures…)`` in one pass.

    Measures are first summed per combination of dimension values (map-side combined, so details shrink before any
    shuffle); only that small result is multiplied by the number of dimensions. A null dimension value leaves the row
    out of that dimension. The order of ``key`` is left to the reader (``orderBy('dim', 'key')``).
    """
    return finish_summary(partial_sums(details, dims, measures), dims, measures)


def or_unknown(column: Column) -> Column:
    """Default of an absent dimension."""
    return F.coalesce(column, F.lit("unknown"))


def non_empty(column: Column) -> Column:
    """Dimension that leaves out empty values instead of grouping them."""
    return F.nullif(column, F.lit(""))


def coverage_measures(has_output: Column, error: Column) -> dict[str, Measure]:
    """Totals over all samples; every rate beside them stays over evaluated rows."""
    return {
        "total": count_if(F.lit(True)),
        "outputs_evaluated": count_if(has_output),
        "missing_outputs": count_if(~has_output),
        "coverage": share(has_output),
        "error_count": count_if(has_output & (F.coalesce(error, F.lit("")) != "")),
    }
