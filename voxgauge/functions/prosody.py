"""Speed, pitch and prominence verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.numeric import known_false, round4


def speed_verdict(input_seconds: Column, output_seconds: Column, direction: Column) -> Column:
    """Struct ``(passed, direction_correct, duration_ratio, change_ratio, error)``; compared before rounding, NaN fails."""
    ratio = F.when(input_seconds > 0, output_seconds / input_seconds)
    way = F.lower(direction)
    faster, slower = way == "faster", way == "slower"
    passed = F.when(faster, known_false(ratio, ratio <= 1.0 - fv.SPEED_CHANGE_MIN)).when(
        slower, known_false(ratio, ratio >= 1.0 + fv.SPEED_CHANGE_MIN))
    correct = F.when(faster, known_false(ratio, ratio < 1.0)).when(slower, known_false(ratio, ratio > 1.0))
    error = F.when(ratio.isNull(), "input duration is zero").when(
        ~F.coalesce(faster | slower, F.lit(False)), F.concat(F.lit("unsupported speed direction: "), F.coalesce(direction, F.lit("None"))))
    return F.struct(
        passed.alias("passed"), correct.alias("direction_correct"),
        round4(ratio).alias("duration_ratio"), round4(ratio - 1.0).alias("change_ratio"), error.alias("error"))


def pitch_verdict(input_f0: Column, output_f0: Column, direction: Column) -> Column:
    """Struct ``(passed, direction_correct, shift_semitone, error)``; both medians must exist, NaN is none."""
    voiced = known_false(input_f0, input_f0 > 0) & known_false(output_f0, output_f0 > 0)
    shift = F.when(voiced, F.lit(12.0) * F.log2(output_f0 / input_f0))
    way = F.lower(direction)
    higher, lower = way == "higher", way == "lower"
    step = fv.PITCH_SHIFT_MIN_SEMITONES
    passed = F.when(higher, shift >= step).when(lower, shift <= -step)
    correct = F.when(higher, shift > 0).when(lower, shift < 0)
    error = F.when(shift.isNull(), "unable to compute voiced F0 median").when(
        passed.isNull(), F.concat(F.lit("unsupported pitch direction: "), F.coalesce(direction, F.lit("None"))))
    return F.struct(
        passed.alias("passed"), correct.alias("direction_correct"),
        round4(shift).alias("shift_semitone"), error.alias("error"))


def clip_window(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Window kept inside the clip and at least 20 ms long."""
    first = F.greatest(F.lit(0.0), F.least(start, duration))
    last = F.greatest(first + fv.PROMINENCE_MIN_WINDOW_SECONDS, F.least(end, duration))
    return first, last


def prominence(segment_rms: Column, clip_rms: Column, segment_f0: Column, clip_f0: Column,
               segment_seconds: Column, clip_seconds: Column) -> Column:
    """Struct ``(score, energy_score, f0_score, duration_score)`` of one window against its clip."""
    eps = F.lit(fv.PROMINENCE_EPS)

    def or_eps(value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit(0.0)) != 0, value).otherwise(eps)

    energy = F.ln(or_eps(segment_rms) / (or_eps(clip_rms) + eps) + eps)
    has_f0 = (F.coalesce(segment_f0, F.lit(0.0)) != 0) & (F.coalesce(clip_f0, F.lit(0.0)) != 0)
    f0 = F.when(has_f0, F.log2((segment_f0 + eps) / (clip_f0 + eps))).otherwise(F.lit(0.0))
    length = F.ln(segment_seconds / F.greatest(clip_seconds, eps) + eps)
    w = fv.PROMINENCE_WEIGHTS
    score = F.lit(w["energy"]) * energy + F.lit(w["f0"]) * f0 + F.lit(w["duration"]) * length
    return F.struct(
        score.alias("score"), energy.alias("energy_score"), f0.alias("f0_score"), length.alias("duration_score"))
