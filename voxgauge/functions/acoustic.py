"""Enhancement, reverberation and scene verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.numeric import known_false


def enhancement_verdict(ovrl_gain: Column, bak_gain: Column) -> Column:
    """Both gains above zero; null when either is missing, false when either is NaN."""
    return F.when(
        ovrl_gain.isNotNull() & bak_gain.isNotNull(),
        known_false(ovrl_gain, ovrl_gain > fv.PERCEPTUAL_OVRL_GAIN)
        & known_false(bak_gain, bak_gain > fv.PERCEPTUAL_BAK_GAIN))


def decay_bounds(target_range: Column) -> tuple[Column, Column]:
    """Tolerated decay range of a two-element target range, null otherwise."""
    valid = F.size(target_range) == 2
    low = F.when(valid, F.get(target_range, 0) * fv.DECAY_TOLERANCE_LOW)
    high = F.when(valid, F.get(target_range, 1) * fv.DECAY_TOLERANCE_HIGH)
    return low, high


def reverb_verdict(measured: Column, target_range: Column) -> Column:
    """Measured decay inside the tolerated range, compared before rounding; NaN on any side fails."""
    low, high = decay_bounds(target_range)
    return F.when(
        measured.isNotNull() & low.isNotNull() & high.isNotNull(),
        known_false(measured + low + high, measured.between(low, high)))


def decay_time(count_wide: Column, slope_wide: Column, count_narrow: Column, slope_narrow: Column,
               sample_rate: Column) -> Column:
    """Seconds to fall by 60 dB from the line fits of the wide and the narrow decay range."""
    enough_wide = count_wide >= F.floor(F.lit(0.025) * sample_rate)
    enough_narrow = count_narrow >= F.floor(F.lit(0.015) * sample_rate)
    slope = F.when(enough_wide, slope_wide).when(enough_narrow, slope_narrow)
    floor, ceiling = F.lit(fv.DECAY_FLOOR_SECONDS), F.lit(fv.DECAY_CEILING_SECONDS)
    seconds = F.least(F.greatest(F.lit(-60.0) / slope, floor), ceiling)
    return F.when(slope.isNull() | (slope >= -3.0), floor).otherwise(seconds)


def scene_group_scores(scores: Column) -> dict[str, Column]:
    """Best label score per scene group from ``map<label, score>``; a missing label counts as 0."""
    return {
        group: F.greatest(*[F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0)) for x in labels])
        for group, labels in fv.SCENE_LABELS.items()
    }


def scene_verdict(predicted: Column, target: Column, score: Column, source_score: Column) -> Column:
    """Right scene, loud enough, and clearly louder than in the source; NaN on either side fails."""
    hit, gain = F.coalesce(predicted == target, F.lit(False)), score - source_score
    return F.when(
        predicted.isNotNull(),
        hit & known_false(score, score >= fv.SCENE_SCORE_MIN) & known_false(gain, gain >= fv.SCENE_GAIN_MIN))


def top_scene_labels(scores: Column, k: int = fv.TOP_SCENE_LABELS) -> Column:
    """The ``k`` best ``(label, score)`` of a map, best first; the label breaks ties."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct(
        (-e["value"]).alias("neg"), e["key"].alias("label"), F.round(e["value"], 4).alias("score")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(
        e["label"].alias("label"), e["score"].alias("score")))
