"""Schemas of the tables the engine reads. One wide anchor struct covers every task; absent fields are null."""

from __future__ import annotations

ANCHOR = (
    "STRUCT<edit_type:STRING, transcript_target:STRING, edit_original:STRING, edit_target:STRING,"
    " insert_after:STRING, reference_wav:STRING, source_speaker:STRING, target_speaker:STRING,"
    " reference_speaker_id:STRING, source_emotion:STRING, target_emotion:STRING, emotion_taxonomy:STRING,"
    " source_style:STRING, target_style:STRING, prosody_type:STRING, direction:STRING,"
    " stress_words:ARRAY<STRING>, transcript:STRING, operation:STRING, event:STRING, subtask:STRING,"
    " degradation_type:STRING, env_type:STRING, env_subtype:STRING, rt60_target_range:ARRAY<DOUBLE>,"
    " rt60_reference:DOUBLE, target_reference_path:STRING>"
)

COMPONENT = (
    f"STRUCT<component_type:STRING, edit_type:STRING, anchor:{ANCHOR}, reference_audio_path:STRING,"
    " source_dataset:STRING, source_language:STRING, emotion_taxonomy:STRING>"
)

SAMPLES = (
    "sample_id STRING, task STRING, audio_path STRING, instruction STRING, transcript STRING, language STRING,"
    " source_dataset STRING, benchmark_version STRING, subset STRING, emotion_taxonomy STRING,"
    " duration_tag STRING, difficulty STRING, combo_type STRING, base_component STRING, base_sample_id STRING,"
    f" reference_audio_path STRING, anchor {ANCHOR}, components ARRAY<{COMPONENT}>"
)

TOKENS = "ARRAY<STRUCT<text:STRING, normalized:STRING, start:DOUBLE, end:DOUBLE>>"

MANIFEST = (
    "benchmark STRING, version STRING, tasks ARRAY<STRUCT<task_id:STRING, samples_jsonl:STRING, samples:BIGINT,"
    " samples_sha256:STRING, audio_files:BIGINT, audio_bytes:BIGINT>>"
)

RESPONSE_LOG = "ts STRING, key STRING, caller_tag STRING, model STRING, audio_path STRING, obj STRING"
