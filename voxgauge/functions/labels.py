"""Label and judge-answer parsing, and the verdicts built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.numeric import clamp_half_even, let
from voxgauge.functions.text import strip

_FENCE = r"```(?:json)?\s*([\s\S]+?)\s*```"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def emotion_label(label: Column) -> Column:
    """Lower case, blanks and underscores to one dash, then the alias table."""
    key = F.regexp_replace(F.lower(strip(F.coalesce(label, F.lit("")))), r"[\s_]+", "-")
    return F.coalesce(F.try_element_at(_literal_map(fv.EMOTION_ALIASES), key), key)


def emotion_taxonomy(taxonomy: Column, anchor_taxonomy: Column, source_dataset: Column, language: Column) -> Column:
    """Taxonomy that decides the allowed labels: declared, else by source dataset, else by language."""
    declared = F.coalesce(F.nullif(taxonomy, F.lit("")), anchor_taxonomy)
    known = F.when(declared.isin(*fv.EMOTIONS_BY_TAXONOMY), declared)
    by_dataset = F.try_element_at(_literal_map(fv.TAXONOMY_BY_DATASET), source_dataset)
    by_language = F.when(language == "zh", "csemotions_zh").otherwise("iemocap_en")
    return F.coalesce(known, by_dataset, by_language)


def allowed_emotions(resolved_taxonomy: Column) -> Column:
    options = F.create_map(*[
        part for name, labels in fv.EMOTIONS_BY_TAXONOMY.items()
        for part in (F.lit(name), F.array(*[F.lit(x) for x in labels]))
    ])
    return F.try_element_at(options, resolved_taxonomy)


def predicted_emotion(answer: Column, allowed: Column) -> Column:
    """Normalised answer, or ``unknown`` when it is not an allowed label."""
    label = emotion_label(answer)
    return F.when(F.array_contains(allowed, label), label).otherwise(F.lit("unknown"))


def parse_judge_json(text: Column) -> Column:
    """VARIANT of a judge answer: the whole text, else its first fenced block, else null."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    direct = F.try_parse_json(F.nullif(trimmed, F.lit("")))
    fenced = F.try_parse_json(F.nullif(F.regexp_extract(trimmed, _FENCE, 1), F.lit("")))
    return F.coalesce(direct, fenced)


def is_json_object(parsed: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))


def field(parsed: Column, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT, null when absent or not convertible."""
    return F.try_variant_get(parsed, f"$.{path}", kind)


def field_type(parsed: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(parsed, f"$.{path}", "variant"))


def score_field(parsed: Column, path: str, top: int) -> Column:
    """Clamped half-even score; booleans count as 1 and 0, unparsable values as 0."""
    as_text = field(parsed, path)
    number = F.when(F.lower(as_text) == "true", F.lit("1")).otherwise(strip(as_text))
    return clamp_half_even(number, top)


def truthy(parsed: Column, path: str) -> Column:
    """Booleans as they are, numbers by being non-zero, text by the list of yes-words."""
    kind = field_type(parsed, path)
    as_text = field(parsed, path)
    numeric = F.startswith(kind, F.lit("BIGINT")) | F.startswith(kind, F.lit("DECIMAL")) | kind.isin(
        "DOUBLE", "FLOAT")
    verdict = (
        F.when(kind == "BOOLEAN", field(parsed, path, "boolean"))
        .when(numeric, as_text.try_cast("double") != 0)
        .when(kind == "STRING", F.lower(strip(as_text)).isin(*fv.TRUTHY_WORDS))
    )
    return F.coalesce(verdict, F.lit(False))


def argmax_label(scores: dict[str, Column]) -> Column:
    """Label with the highest score; the label declared first wins a tie."""
    labels = F.array(*[F.lit(x) for x in scores])
    best = let(F.array(*scores.values()), lambda a: F.array_position(a, F.array_max(a)))
    return F.try_element_at(labels, F.nullif(best, F.lit(0)).cast("int"))


def style_scores(parsed: Column) -> Column:
    """Diagnostic scores in the declared order of the styles."""
    return F.array(*[score_field(parsed, f"style_scores['{s}']", fv.STYLE_SCORE_MAX) for s in fv.STYLES])


def style_verdict(parsed: Column, target_style: Column) -> Column:
    """Struct ``(target_style_score, target_style_success, dominant_style)`` of a judge answer."""
    styles = F.array(*[F.lit(s) for s in fv.STYLES])
    flag_kind = field_type(parsed, "target_style_success")

    def at(values: Column, position: Column) -> Column:
        return F.try_element_at(values, F.nullif(position, F.lit(0)).cast("int"))

    def score_of(diagnostic: Column) -> Column:
        stated = field_type(parsed, "target_style_score").isNotNull()
        fallback = F.coalesce(at(diagnostic, F.array_position(styles, target_style)), F.lit(0))
        return F.when(stated, score_field(parsed, "target_style_score", fv.STYLE_SCORE_MAX)).otherwise(fallback)

    def verdict(p: Column) -> Column:
        strong = p["score"] >= fv.STYLE_SCORE_MIN
        success = F.when(p["flag"].isNull() | (p["flag"] == "VOID"), strong).otherwise(p["truthy"] & strong)
        named = F.when(p["named"].isin(*fv.STYLES), p["named"])
        return F.struct(
            p["score"].alias("target_style_score"),
            success.alias("target_style_success"),
            F.coalesce(named, at(styles, F.array_position(p["all"], F.array_max(p["all"])))).alias("dominant_style"),
        )

    return let(style_scores(parsed), lambda diagnostic: let(F.struct(
        diagnostic.alias("all"),
        score_of(diagnostic).alias("score"),
        flag_kind.alias("flag"),
        truthy(parsed, "target_style_success").alias("truthy"),
        F.lower(strip(F.coalesce(field(parsed, "dominant_style"), F.lit("")))).alias("named"),
    ), verdict))


def event_score(parsed: Column, event: Column) -> Column:
    """Score of the wanted event in a judge answer; 0 when the event is unknown or not scored."""
    return F.coalesce(
        *[F.when(event == e, score_field(parsed, f"event_scores.{e}", fv.EVENT_SCORE_MAX)) for e in fv.EVENTS],
        F.lit(0),
    )


def event_verdict(operation: Column, score: Column) -> Column:
    return (
        F.when(operation == "add", score >= fv.EVENT_PRESENT_MIN)
        .when(operation == "remove", score <= fv.EVENT_ABSENT_MAX)
        .otherwise(F.lit(False))
    )


def style_judge_request(target_style: Column, definition: Column, transcript: Column, language: Column) -> Column:
    """Request text for the style judge (own wording; the answer format is what matters)."""
    spoken = F.coalesce(F.nullif(strip(transcript), F.lit("")), F.lit("not available, judge the audio alone"))
    english = F.format_string(
        "Rate how strongly the recording is spoken in the style '%s' (%s). Rate delivery only, never the topic. "
        "Transcript: %s. Answer with one JSON object holding target_style_score 0-4, target_style_success, "
        "dominant_style, style_scores, confidence and rationale.", target_style, definition, spoken)
    chinese = F.format_string(
        "请判断这段语音在多大程度上呈现“%s”风格（%s）。只看说话方式，不看话题。转写：%s。"
        "只回答一个 JSON 对象，包含 target_style_score 0-4、target_style_success、dominant_style、"
        "style_scores、confidence、rationale。", target_style, definition, spoken)
    return F.when(language == "zh", chinese).otherwise(english)


def emotion_judge_request(allowed: Column, transcript: Column, language: Column) -> Column:
    """Request text for the emotion judge (own wording)."""
    options = F.array_join(allowed, ", ")
    english = F.format_string(
        "Name the main emotion you hear in the recording, judging the voice and not the words. Transcript: %s. "
        "Choose one of: %s. Answer with one JSON object holding predicted_emotion, confidence and rationale.",
        transcript, options)
    chinese = F.format_string(
        "请根据声音而非文字，给出录音的主要情感。转写：%s。从中选一个：%s。"
        "只回答一个 JSON 对象，包含 predicted_emotion、confidence、rationale。", transcript, options)
    return F.when(language == "zh", chinese).otherwise(english)


def request_key(caller_tag: Column, model: Column, audio_path: Column, request: Column) -> Column:
    """Stable key of a judge request."""
    return F.sha1(F.concat_ws("\n", caller_tag, model, audio_path, request))
