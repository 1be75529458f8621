"""Speaker similarity of path pairs: every distinct path is looked up once per side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.numeric import cosine, known_false, norm
from voxgauge.operators.lookup import spread_lookup


def needed_paths(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct paths of both sides: what has to be embedded at all."""
    return pairs.select(F.col(left).alias("path")).union(pairs.select(F.col(right).alias("path"))).where(
        F.col("path").isNotNull()).distinct()


def pair_similarity(pairs: DataFrame, embeddings: DataFrame, sample: str, left: str, right: str,
                    out: str) -> DataFrame:
    """Add ``out``: cosine of the two recordings' embeddings, four decimals, null when one is missing.

    ``embeddings`` has ``path, embedding`` with one row per path. Norms are computed once per recording. A reference
    shared by a large part of the samples is spread over tasks.
    """
    normed = embeddings.select("path", "embedding", norm(F.col("embedding")).alias("norm"))
    sides = {left: ("_le", "_ln"), right: ("_re", "_rn")}
    joined = pairs
    for path, (vector, length) in sides.items():
        # counted on the pairs themselves, before any vector is attached
        frequent = pairs.where(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
        side = normed.select(F.col("path").alias(path), F.col("embedding").alias(vector), F.col("norm").alias(length))
        joined = spread_lookup(joined, side, path, sample, frequent=frequent)
    score = cosine(F.col("_le"), F.col("_re"), F.col("_ln"), F.col("_rn"))
    return joined.withColumn(out, F.round(score, 4)).drop("_le", "_ln", "_re", "_rn")


def speaker_target(similarity):
    """Target verdict on the rounded similarity; null stays null, NaN fails."""
    return known_false(similarity, similarity >= fv.SPEAKER_TARGET_MIN)


def speaker_preserved(similarity):
    """Source-speaker preservation verdict on the rounded similarity; null stays null, NaN fails."""
    return known_false(similarity, similarity >= fv.SPEAKER_PRESERVATION_MIN)
