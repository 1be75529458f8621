"""Skew-safe lookups of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
HOT_KEYS = 65_536


def spread_lookup(facts: DataFrame, reference: DataFrame, key: str, spread_by: str,
                  how: str = "left", frequent: DataFrame | None = None,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join ``facts`` to a ``reference`` that has one row per ``key``, splitting frequent keys by their count.

    A key with more than ``rows_per_task`` rows is dealt over as many splits as it has such portions, so no task gets
    more of it; ``spread_by`` is a column of ``facts`` that varies within a key (a row id), so the split is the same when
    a task is rerun. Only the reference rows of such keys are repeated, once per split. No row is dropped.

    The list of split keys is the only forced broadcast: it has one row per ``rows_per_task`` facts and never more than
    ``HOT_KEYS``; beyond that number of split keys, the rarest of them stay whole and hold less than 1/65,536 of all rows
    each. ``frequent`` (``key, _n``) saves counting when the frequencies are known; counting needs the key column alone.
    """
    if frequent is None:
        frequent = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = (
        frequent.where(F.col("_n") > rows_per_task).orderBy(F.desc("_n"), key).limit(HOT_KEYS)
        .select(F.col(key).alias("_hot_key"), F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    left = (
        facts.join(F.broadcast(hot), facts[key] == hot["_hot_key"], "left")
        .withColumn("_split", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_hot_key", "_parts")
    )
    right = (
        reference.join(F.broadcast(hot), reference[key] == hot["_hot_key"], "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot_key", "_parts")
    )
    return left.join(right, [key, "_split"], how).drop("_split")


def binned_range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str,
                      width: float) -> DataFrame:
    """Pairs with equal ``key`` and ``start <= at <= end`` (both ends included).

    Points and ranges meet on ``(key, time bin)``, so a long clip is spread over its bins instead of landing in
    one task. ``width`` is the bin length in units of ``at``.
    """
    binned_points = points.withColumn("_bin", F.floor(F.col(at) / F.lit(width)))
    binned_ranges = ranges.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width)))))
    return (
        binned_ranges.join(binned_points, [key, "_bin"])
        .where(F.col(at).between(F.col(start), F.col(end)))
        .drop("_bin")
    )
