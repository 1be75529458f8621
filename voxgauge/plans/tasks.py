"""Verdict tables of the eight tasks.

Each function takes matched samples (``has_output`` plus the score columns it names) and returns one row per sample
with the verdict columns filled. Rows without an output keep ``has_output = false`` and null verdicts, so the same
table feeds details (``where has_output``), missing outputs and the roll-up.

Failure polarity differs by task on purpose: content and the judged tasks score a failed row as false, the measured
tasks leave it null and out of the rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.functions import acoustic as ac
from voxgauge.functions import labels as lb
from voxgauge.functions import prosody as pr
from voxgauge.functions import text as tx
from voxgauge.functions.numeric import gain, round4
from voxgauge.operators.match import speaker_reference
from voxgauge.operators.similarity import speaker_target

NO_TRANSCRIPT = "no transcript for output"
NO_ANSWER = "no judge answer for output"


def _done(column: Column) -> Column:
    return F.when(F.col("has_output"), column)


def _language() -> Column:
    return F.coalesce("language", F.lit("en"))


def _false_on_failure(flag: Column, error: Column) -> Column:
    return _done(F.when(error.isNull(), F.coalesce(flag, F.lit(False))).otherwise(F.lit(False)))


def _keep_texts(df: DataFrame, keep: Column) -> DataFrame:
    """Null text measurements on rows that never reached them."""
    return df.withColumns({name: F.when(keep, F.col(name)) for name in tx.PRESERVATION_COLUMNS})


def content_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``anchor`` fields ``edit_type, transcript_target, edit_original, edit_target, insert_after`` as
    columns, ``transcript_predicted`` and ``language``."""
    texts = tx.with_text_errors(matched, "transcript_target", "transcript_predicted")
    lang = _language()
    checked = texts.withColumns({
        name: tx.normalize(F.col(name), lang) for name in ("edit_original", "edit_target", "insert_after")
    }).withColumn("_edit", tx.edit_success(
        F.col("edit_type"), F.col("edit_original"), F.col("edit_target"), F.col("insert_after"),
        F.col("norm_predicted")))
    error = F.when(F.col("has_output") & F.col("transcript_predicted").isNull(), NO_TRANSCRIPT)
    success = _false_on_failure(F.col("_edit.success"), error)
    return checked.withColumns({
        "error": error,
        "exact_match": _false_on_failure(F.col("norm_target") == F.col("norm_predicted"), error),
        "edit_success": success,
        "edit_success_reason": F.when(error.isNull(), _done(F.col("_edit.reason"))),
        "target_success": success,
        "joint_success": success,
        # the text is the target here, so nothing is left to preserve
        "content_preservation_metric": F.lit(None).cast("string"),
        "content_preservation_error": F.lit(None).cast("double"),
        "content_preservation_threshold": F.lit(None).cast("double"),
        "content_preservation_pass": F.lit(None).cast("boolean"),
    }).drop("_edit")


def speaker_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``reference_audio_path, reference_wav, speaker_similarity, transcript, transcript_predicted``."""
    reference, missing = speaker_reference(F.col("reference_audio_path"), F.col("reference_wav"))
    error = _done(F.coalesce(missing, F.when(F.col("transcript_predicted").isNull(), NO_TRANSCRIPT)))
    texts = tx.with_preservation(matched, "transcript", "transcript_predicted").withColumns({
        "reference": reference, "error": error})
    # a row without a reference never reaches the transcript
    judged = _keep_texts(texts, F.col("error").isNull())
    ok = F.col("has_output") & F.col("error").isNull()
    target = F.when(ok, speaker_target(F.col("speaker_similarity")))
    both = F.when(target.isNotNull() & F.col("content_preservation_pass").isNotNull(),
                  target & F.col("content_preservation_pass"))
    return judged.withColumns({"target_success": target, "joint_success": both})


def _judged(texts: DataFrame, correct: Column, error: Column) -> DataFrame:
    """Shared tail of the judged tasks: plain conjunction, failures are false."""
    right = _false_on_failure(correct, error)
    cleared = _keep_texts(texts.withColumn("error", error), error.isNull() & F.col("has_output"))
    return cleared.withColumns({
        "correct": right,
        "target_success": right,
        "joint_success": _done(right & F.coalesce(F.col("content_preservation_pass"), F.lit(False))),
    })


def _judge_error() -> Column:
    answered = lb.is_json_object(F.col("_answer"))
    return _done(F.when(~answered, NO_ANSWER).when(F.col("transcript_predicted").isNull(), NO_TRANSCRIPT))


def emotion_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``target_emotion, source_emotion, emotion_taxonomy, anchor_taxonomy, judge_text`` and the texts."""
    taxonomy = lb.emotion_taxonomy(
        F.col("emotion_taxonomy"), F.col("anchor_taxonomy"), F.col("source_dataset"), _language())
    texts = tx.with_preservation(matched, "transcript", "transcript_predicted").withColumns({
        "_answer": lb.parse_judge_json(F.col("judge_text")),
        "_allowed": lb.allowed_emotions(taxonomy),
    })
    named = texts.withColumns({
        "_error": _judge_error(),
        "target_emotion": lb.emotion_label(F.col("target_emotion")),
        "source_emotion": lb.emotion_label(F.col("source_emotion")),
        "emotion_taxonomy": F.coalesce(
            F.nullif("emotion_taxonomy", F.lit("")), "anchor_taxonomy", F.lit("unknown")),
        "predicted_emotion": _done(lb.predicted_emotion(lb.field(F.col("_answer"), "predicted_emotion"),
                                                        F.col("_allowed"))),
    })
    return _judged(named, F.col("predicted_emotion") == F.col("target_emotion"), F.col("_error")).withColumn(
        "predicted_emotion", F.when(F.col("error").isNull(), F.col("predicted_emotion"))
    ).drop("_answer", "_allowed", "_error")


def style_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``target_style, source_style, judge_text`` and the texts."""
    texts = tx.with_preservation(matched, "transcript", "transcript_predicted").withColumn(
        "_answer", lb.parse_judge_json(F.col("judge_text")))
    named = texts.withColumn("_error", _judge_error()).withColumn(
        "_style", F.when(F.col("has_output") & F.col("_error").isNull(),
                         lb.style_verdict(F.col("_answer"), F.col("target_style"))))
    flat = named.withColumns({
        "target_style_score": F.col("_style.target_style_score"),
        "dominant_style": F.col("_style.dominant_style"),
        "predicted_style": F.col("_style.dominant_style"),
    })
    return _judged(flat, F.col("_style.target_style_success"), F.col("_error")).drop("_answer", "_style", "_error")


def paralinguistic_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``operation, event, judge_text`` and the texts."""
    texts = tx.with_preservation(matched, "transcript", "transcript_predicted").withColumn(
        "_answer", lb.parse_judge_json(F.col("judge_text")))
    named = texts.withColumn("_error", _judge_error()).withColumn(
        "predicted_score", F.when(F.col("has_output") & F.col("_error").isNull(),
                                  lb.event_score(F.col("_answer"), F.col("event"))))
    return _judged(named, lb.event_verdict(F.col("operation"), F.col("predicted_score")), F.col("_error")).drop(
        "_answer", "_error")


def prosody_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``prosody_type, direction, input_duration, output_duration, input_f0, output_f0, stress_passed, rpg``
    and the texts. ``stress_passed`` and ``rpg`` come from the stress roll-up."""
    kind = F.col("prosody_type")
    speed = pr.speed_verdict(F.col("input_duration"), F.col("output_duration"), F.col("direction"))
    pitch = pr.pitch_verdict(F.col("input_f0"), F.col("output_f0"), F.col("direction"))
    scored = tx.with_preservation(matched, "transcript", "transcript_predicted").withColumns({
        "_speed": speed, "_pitch": pitch})
    measure_error = (
        F.when(kind == "speed", F.col("_speed.error"))
        .when(kind == "pitch", F.col("_pitch.error"))
        .when(kind == "stress", F.when(F.col("stress_passed").isNull(), "stress_words is empty"))
        .otherwise(F.concat(F.lit("unknown prosody_type: "), F.coalesce(kind, F.lit("None"))))
    )
    no_text = F.when(F.col("transcript_predicted").isNull(), NO_TRANSCRIPT)
    passed = (
        F.when(kind == "speed", F.col("_speed.passed"))
        .when(kind == "pitch", F.col("_pitch.passed"))
        .when(kind == "stress", F.col("stress_passed"))
    )
    ok = F.col("has_output") & F.col("_measure_error").isNull()
    measured = scored.withColumn("_measure_error", measure_error).withColumns({
        "error": _done(F.coalesce(F.col("_measure_error"), no_text)),
        "passed": F.when(ok, passed),
        "duration_ratio": F.when(ok & (kind == "speed"), F.col("_speed.duration_ratio")),
        "shift_semitone": F.when(ok & (kind == "pitch"), F.col("_pitch.shift_semitone")),
        "rpg": F.when(ok & (kind == "stress"), F.col("rpg")),
    })
    judged = _keep_texts(measured, ok)
    target = F.when(F.col("error").isNull(), F.col("passed"))
    preserved = F.col("content_preservation_pass")
    return judged.withColumns({
        "target_success": target,
        "joint_success": F.when(preserved.isNotNull(), F.coalesce(target & preserved, F.lit(False))),
    }).drop("_speed", "_pitch", "_measure_error")


def acoustic_verdicts(matched: DataFrame) -> DataFrame:
    """Needs ``subtask, env_type, env_subtype, rt60_target_range``, the perceptual scores ``dnsmos_*`` and
    ``source_dnsmos_*``, ``pesq, stoi`` pairs, ``rt60``, the scene maps ``scenes, source_scenes`` and the texts."""
    subtask, env = F.col("subtask"), F.col("env_type")
    enhancing = F.col("has_output") & (subtask == "enhancement")
    moving = F.col("has_output") & (subtask == "env_transfer")
    reverb, noise = moving & (env == "reverb"), moving & (env == "noise")
    scored = tx.with_preservation(matched, "transcript", "transcript_predicted")
    for name in ("dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "pesq", "stoi"):
        scored = scored.withColumn(f"{name}_gain_raw", F.when(
            enhancing, gain(F.col(name), F.col(f"source_{name}"))))
        scored = scored.withColumns({
            f"{name}_gain": F.round(f"{name}_gain_raw", 4),
            name: F.when(enhancing, F.round(name, 4)),
        })
    groups = ac.scene_group_scores(F.col("scenes"))
    source_groups = ac.scene_group_scores(F.col("source_scenes"))
    have_scenes = noise & F.col("scenes").isNotNull() & F.col("source_scenes").isNotNull()

    def of_target(scores: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("env_subtype") == g, s) for g, s in scores.items()], F.lit(0.0))

    low, high = ac.decay_bounds(F.col("rt60_target_range"))
    scored = scored.withColumns({
        "_score": F.when(have_scenes, of_target(groups)),
        "_source_score": F.when(have_scenes, of_target(source_groups)),
        "predicted_env_subtype": F.when(have_scenes, lb.argmax_label(groups)),
        "top_scene_labels": F.when(have_scenes, ac.top_scene_labels(F.col("scenes"))),
    })
    passed = (
        F.when(enhancing, ac.enhancement_verdict(F.col("dnsmos_ovrl_gain_raw"), F.col("dnsmos_bak_gain_raw")))
        .when(reverb, ac.reverb_verdict(F.col("rt60"), F.col("rt60_target_range")))
        .when(noise, ac.scene_verdict(F.col("predicted_env_subtype"), F.col("env_subtype"),
                                      F.col("_score"), F.col("_source_score")))
    )
    errors = F.array_compact(F.array(
        F.when(reverb & F.col("rt60").isNull(), F.coalesce("rt60_error", F.lit("no decay estimate"))),
        F.when(noise & ~have_scenes, "no scene scores"),
        F.when(F.col("has_output") & F.col("transcript_predicted").isNull(),
               f"content_preservation: {NO_TRANSCRIPT}")))
    final = scored.withColumns({
        "rt60_measured": F.when(reverb, round4(F.col("rt60"))),
        "rt60_tolerated_min": F.when(reverb, F.round(low, 4)),
        "rt60_tolerated_max": F.when(reverb, F.round(high, 4)),
        "target_scene_score": F.round("_score", 4),
        "source_target_scene_score": F.round("_source_score", 4),
        "target_scene_gain": F.round(F.col("_score") - F.col("_source_score"), 4),
        "passed": passed,
        "target_success": passed,
        "error": F.when(F.size(errors) > 0, F.array_join(errors, "; ")),
    })
    both = F.col("target_success").isNotNull() & F.col("content_preservation_pass").isNotNull()
    return final.withColumn(
        "joint_success", F.when(both, F.col("target_success") & F.col("content_preservation_pass"))
    ).drop("_score", "_source_score", *[
        f"{n}_gain_raw" for n in ("dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "pesq", "stoi")])
