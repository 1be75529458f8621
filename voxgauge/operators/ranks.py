"""Exact order statistics per group by radix selection: no group is sorted, none is brought together.

A double has an order-preserving 64-bit image. Each of four rounds counts, per group, how often the next 16 bits occur among the
values that a pick has left, and narrows the pick to one value of these bits; after the last round one value is left. Counts
are combined before they are shuffled and there are 65,536 at most per group and pick. From the second round on only different
values under the picks' first 16 bits take part, with their counts.
"""

from __future__ import annotations

import functools

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.functions.numeric import nearest_rank
from voxgauge.operators.lookup import ROWS_PER_TASK, spread_lookup
from voxgauge.session import stage

BITS, ROUNDS = 16, 4  # bits of an image that one round decides

Pick = tuple[float, Callable[[Column], Column]]


def _key(groups: Sequence[str]) -> Column:
    return F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))


def with_image(rows: DataFrame, value: str, image: str) -> DataFrame:
    """Add a long for every double, in the same order: exponent and fraction as in its IEEE bits, negative values mirrored.

    All operations are exact: powers of two scale without rounding. Zeros are one value, NaN is above infinity, as in Spark's own
    order. Each step is a column of its own, so logarithm and powers are computed once per row.
    """
    size = F.abs(F.col(value))
    least, unit = -1022, 2.0 ** -1074  # smallest normal exponent, smallest positive value
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    steps = rows.withColumn("_guess", F.least(F.greatest(F.floor(F.log2(size)), F.lit(least)), F.lit(1023)))
    steps = steps.withColumn("_scaled", size / power(F.col("_guess")))
    # the logarithm may be one off next to a power of two
    over, below = F.col("_scaled") >= 2, (F.col("_scaled") < 1) & (F.col("_guess") > least)
    steps = steps.withColumn("_exponent", F.col("_guess") + F.when(over, 1).when(below, -1).otherwise(0)).withColumn(
        "_scaled", F.when(over, F.col("_scaled") / 2).when(below, F.col("_scaled") * 2).otherwise(F.col("_scaled")))
    positive = (
        F.when(F.isnan(value), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size == 0, F.lit(0))
        .when(size < 2.0 ** least, (size / F.lit(unit)).cast("bigint"))
        .otherwise(F.shiftleft((F.col("_exponent") + 1023).cast("bigint"), 52) + (
            (F.col("_scaled") - 1) * F.lit(2.0 ** 52)).cast("bigint")))
    return steps.withColumn("_positive", positive.cast("bigint")).withColumn(
        image, F.when(F.col(value) < 0, -F.col("_positive")).otherwise(F.col("_positive"))).drop(
        "_guess", "_scaled", "_exponent", "_positive")


#: Of a pick ``p`` and the counts ``c`` of the digits under its bits, ascending: the digit that holds its rank, the rank within
#: the digit, and the digit's smallest value. Nulls if the group has no such rank.
_NARROWED = """aggregate(filter(_counts, c -> c.bits = p.bits),
    named_struct('digit', cast(null as bigint), 'left', p.rank, 'v', cast(null as double)),
    (s, c) -> CASE WHEN s.digit IS NOT NULL OR s.left < 0 THEN s
        WHEN s.left < c.n THEN named_struct('digit', c.digit, 'left', s.left, 'v', c.v)
        ELSE named_struct('digit', s.digit, 'left', s.left - c.n, 'v', s.v) END,
    s -> named_struct('pick', p.pick, 'bits', shiftleft(p.bits, {bits}) + s.digit, 'rank', s.left, 'v', s.v))"""


def _round(values: DataFrame, step: int) -> DataFrame:
    """One more digit of every pick. ``values`` has ``_g, _n, _picks`` and ``_image, _v, _c``; ``_bits`` are those decided."""
    low = 64 - BITS * step
    digit = F.shiftright("_image", low) if step == 1 else F.shiftright("_image", low).bitwiseAND(F.lit((1 << BITS) - 1))
    counted = values.groupBy("_g", "_bits", digit.alias("_digit")).agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_v"), F.first("_n").alias("_n"), F.first("_picks").alias("_picks"))
    cells = F.struct(F.col("_bits").alias("bits"), F.col("_digit").alias("digit"), F.col("_c").alias("n"), F.col("_v").alias("v"))
    return counted.groupBy("_g").agg(
        F.sort_array(F.collect_list(cells)).alias("_counts"), F.first("_n").alias("_n"), F.first("_picks").alias("_picks"))


def _narrowed(counted: DataFrame) -> DataFrame:
    return counted.select("_g", "_n", F.expr(f"transform(_picks, p -> {_NARROWED.format(bits=BITS)})").alias("_picks"))


def exact_ranks(rows: DataFrame, groups: Sequence[str], value: str, picks: Mapping[str, Pick]) -> DataFrame:
    """Columns ``groups…, n, <picks…>``: the value at an exact zero-based rank for each pick.

    A pick is ``(p, rank_of_n)``; the rank is a function of the group's count. Null values are left out; a null group is a
    group; groups without a value have no row. A rank outside the group gives null.
    """
    known = rows.where(F.col(value).isNotNull()).select(
        _key(groups).alias("_g"), F.col(value).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
    known = with_image(known, "_v", "_image")
    start = known.select("*", F.lit(0).cast("bigint").alias("_bits"), F.lit(None).alias("_n"), F.lit(None).alias("_picks"))
    wanted = F.array(*[F.struct(
        F.lit(name).alias("pick"), F.lit(0).cast("bigint").alias("bits"), fn(F.col("_n")).cast("bigint").alias("rank"))
        for name, (_, fn) in picks.items()])
    first = _round(start, 1).withColumn("_n", F.expr("aggregate(_counts, 0L, (s, c) -> s + c.n)")).withColumn("_picks", wanted)
    state = stage(_narrowed(first), "first-digits")
    met = spread_lookup(known, state, "_g", "_v", "inner", frequent=state.select("_g", "_n"))
    met = met.where(F.expr(f"exists(_picks, p -> p.bits = shiftright(_image, {64 - BITS}))"))
    under = met.groupBy("_g", "_image").agg(F.min("_v").alias("_v"), F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
    # a large group meets its picks in as many splits as it has portions of rows
    splits = F.ceil(F.col("_n") / ROWS_PER_TASK).cast("int")
    under = stage(under.select("_g", "_image", "_v", "_c", F.pmod(F.xxhash64("_image"), splits).cast("int").alias("_split")), "values")
    for step in range(2, ROUNDS + 1):
        spread = state.withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1)))
        met = under.join(spread, ["_g", "_split"]).withColumn("_bits", F.shiftright("_image", 64 - BITS * (step - 1)))
        state = _narrowed(_round(met.where("exists(_picks, p -> p.bits = _bits)"), step))
    found = F.col("_picks")
    return state.select(*[F.col(f"_g.{g}").alias(g) for g in groups], F.col("_n").alias("n"), *[
        F.get(found, i)["v"].alias(name) for i, name in enumerate(picks)])


def nearest_rank_pick(p: float) -> Pick:
    return p, lambda n: nearest_rank(n, p)


MEDIAN_PICKS: dict[str, Pick] = {
    "median_low": (0.5, lambda n: F.floor((n - 1) / 2)),
    "median_high": (0.5, lambda n: F.ceil((n - 1) / 2)),
}


def exact_median(rows: DataFrame, groups: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median per group: the middle value, or the mean of the two middle values."""
    both = exact_ranks(rows, groups, value, MEDIAN_PICKS)
    return both.select(*groups, "n", ((F.col("median_low") + F.col("median_high")) / 2).alias(name))


def distribution(rows: DataFrame, groups: Sequence[str], value: str,
                 short_limits: Sequence[float] = ()) -> DataFrame:
    """Minimum, p05, median, p95, maximum (four decimals) and counts below each limit; a null group is a group."""
    ranked = exact_ranks(rows, groups, value, {
        "_p05": nearest_rank_pick(0.05), "_p95": nearest_rank_pick(0.95), **MEDIAN_PICKS})
    plain = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        *[F.count_if(F.col(value) < limit).alias(_short_name(limit)) for limit in short_limits])
    plain = plain.select(*[F.col(g).alias(f"_same_{g}") for g in groups], *[c for c in plain.columns if c not in groups])
    same = functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_same_{g}")) for g in groups], F.lit(True))
    joined = ranked.join(plain, same)
    return joined.select(
        *groups, "n",
        F.round("_min", 4).alias("min"), F.round("_p05", 4).alias("p05"),
        F.round((F.col("median_low") + F.col("median_high")) / 2, 4).alias("median"),
        F.round("_p95", 4).alias("p95"), F.round("_max", 4).alias("max"),
        *[_short_name(limit) for limit in short_limits],
    )


def _short_name(limit: float) -> str:
    return f"lt_{str(limit).replace('.', '_')}s"
