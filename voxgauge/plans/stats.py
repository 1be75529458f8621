"""Measures and dimensions of each task's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.operators.rollup import (
    Measure, count_if, coverage_measures, mean, non_empty, or_unknown, rate, ratio_of, share, summarise,
)


def _evaluated() -> Column:
    return F.col("has_output")


def _coverage() -> dict[str, Measure]:
    return coverage_measures(_evaluated(), F.col("error"))


def _dims(names: list[str]) -> dict[str, Column]:
    """Dimensions of evaluated rows; absent values are grouped as ``unknown``."""
    return {n: F.when(_evaluated(), or_unknown(F.col(c))) for n, c in (
        (x, {"dataset": "source_dataset"}.get(x, x)) for x in names)}


def _means(names: list[str]) -> dict[str, Measure]:
    return {f"avg_{n}": mean(F.col(n)) for n in names}


def _rates() -> dict[str, Measure]:
    return {
        "target_success_rate": rate(F.col("target_success")),
        "content_preservation_pass_rate": rate(F.col("content_preservation_pass")),
        "joint_success_rate": rate(F.col("joint_success")),
    }


def content_summary(scored: DataFrame) -> DataFrame:
    """Exact-match and edit-success shares count every evaluated row; empty groups read 0.0."""
    done = _evaluated()
    return summarise(scored, _dims(["edit_type", "dataset", "language"]), {
        **_coverage(),
        "exact_match_rate": share(F.col("exact_match"), done),
        "edit_success_rate": share(F.col("edit_success"), done),
        "target_success_rate": share(F.col("edit_success"), done),
        "joint_success_rate": share(F.col("edit_success"), done),
        "avg_wer": mean(F.col("wer"), empty=0.0),
        "avg_cer": mean(F.col("cer"), empty=0.0),
        "exact_match_count": count_if(F.col("exact_match")),
        "edit_success_count": count_if(F.col("edit_success")),
        **_means(["utmos", "source_output_speaker_similarity"]),
    })


def speaker_summary(scored: DataFrame) -> DataFrame:
    lang = F.col("language")
    return summarise(scored, _dims(["language", "dataset", "target_speaker"]), {
        **_coverage(), **_rates(),
        "avg_speaker_similarity": mean(F.col("speaker_similarity")),
        "avg_en_wer": mean(F.col("wer"), lang == "en"),
        "avg_zh_cer": mean(F.col("cer"), lang == "zh"),
        "avg_content_preservation_error": mean(F.when(lang == "zh", F.col("cer")).otherwise(F.col("wer"))),
        "avg_utmos": mean(F.col("utmos")),
    })


def _judge_measures() -> dict[str, Measure]:
    return {
        **_coverage(),
        "accuracy": share(F.col("correct"), _evaluated()),
        "correct": count_if(F.col("correct")),
        **_rates(),
        **_means(["content_preservation_error", "utmos", "source_output_speaker_similarity"]),
    }


def emotion_summary(scored: DataFrame) -> DataFrame:
    return summarise(scored, _dims([
        "dataset", "subset", "target_emotion", "source_emotion", "language", "emotion_taxonomy"]), _judge_measures())


def style_summary(scored: DataFrame) -> DataFrame:
    return summarise(scored, _dims([
        "dataset", "subset", "target_style", "source_style", "language"]), _judge_measures())


def paralinguistic_summary(scored: DataFrame) -> DataFrame:
    both = F.when(_evaluated(), F.concat_ws("/", or_unknown(F.col("operation")), or_unknown(F.col("event"))))
    return summarise(scored, {
        **_dims(["operation", "event"]), "operation_event": both, **_dims(["dataset", "language"]),
    }, _judge_measures())


def _verdict_measures() -> dict[str, Measure]:
    known = F.col("target_success").isNotNull()
    return {
        **_coverage(),
        "evaluated": count_if(known),
        "pass_rate": rate(F.col("joint_success"), known),
        **_rates(),
    }


def prosody_summary(scored: DataFrame) -> DataFrame:
    known = F.col("target_success").isNotNull()
    return summarise(scored, _dims(["prosody_type", "language", "dataset"]), {
        **_verdict_measures(),
        "direction_accuracy": rate(F.col("passed"), known & F.col("prosody_type").isin("speed", "pitch")),
        "avg_duration_ratio": mean(F.col("duration_ratio"), known),
        "avg_f0_semitone_shift": mean(F.col("shift_semitone"), known),
        "avg_rpg": mean(F.col("rpg"), known),
        **_means(["utmos", "content_preservation_error", "source_output_speaker_similarity"]),
    })


ACOUSTIC_MEANS = [
    "dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "dnsmos_sig_gain", "dnsmos_bak_gain", "dnsmos_ovrl_gain",
    "content_preservation_error", "pesq", "stoi", "pesq_gain", "stoi_gain", "utmos",
    "source_output_speaker_similarity",
]


def acoustic_summary(scored: DataFrame) -> DataFrame:
    """Empty degradation and environment values are left out of their dimension instead of being grouped."""
    optional = {
        n: F.when(_evaluated(), non_empty(F.col(n))) for n in ("degradation_type", "env_type", "env_subtype")}
    return summarise(scored, {**_dims(["subtask"]), **optional, **_dims(["language", "dataset"])}, {
        **_verdict_measures(),
        **_means(ACOUSTIC_MEANS),
        "avg_rt60": mean(F.col("rt60_measured")),
        "avg_target_scene_score": mean(F.col("target_scene_score")),
    })


def compositional_summary(scored: DataFrame) -> DataFrame:
    """``component_success_rate`` pools components; the sample average of rates stands beside it."""
    combo = F.when(_evaluated(), F.concat_ws("::", or_unknown(F.col("combo_type")), or_unknown(F.col("language"))))
    return summarise(scored, {**_dims(["difficulty", "combo_type", "language"]), "combo_language": combo}, {
        **_coverage(),
        "joint_success_rate": rate(F.col("joint_success")),
        "component_success_rate": ratio_of(F.col("components_passed"), F.col("components_known")),
        "preservation_success_rate": rate(F.col("preservation_success")),
        "avg_sample_component_success_rate": mean(F.col("component_success_rate")),
        **_means(["utmos", "source_output_speaker_similarity"]),
    })
