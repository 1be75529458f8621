"""Evaluation tables derived from the driver tables.

The statements use only SQL that Spark and DuckDB read alike, so the same derived input feeds a query and its check;
the operators under test are never part of them. ``{name}`` is a driver table; the statements cover whole tables.

Conversation turns play the samples (one per turn), the following turn of a conversation plays the model output, so
the last turn of every conversation is a sample without an output.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from voxgauge.session import table

TURNS = """
SELECT conv_id, turn, role, text, length(text) AS n,
       concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS sample_id
FROM {conversations}
"""

#: Turns as evaluation texts: what assistants say in conversations of even number is written in ideographs, one per letter.
LATIN, IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz", "一二三四五六七八九十百千万人口日月山水火木金土天地上"
SAID = f"""
SELECT conv_id, turn, role, n, sample_id, CASE WHEN role = 'assistant' AND conv_id % 2 = 0
  THEN translate(text, '{LATIN}', '{IDEOGRAPHS}') ELSE text END AS text
FROM ({TURNS}) t
"""

SAMPLES = f"""
SELECT sample_id, conv_id, turn, n,
  CASE WHEN role = 'assistant' THEN 'zh' ELSE 'en' END AS language,
  CASE n % 5 WHEN 0 THEN 'iemocap' WHEN 1 THEN 'csemotions' WHEN 2 THEN 'aishell3_test'
             WHEN 3 THEN 'libritts_test_clean' END AS source_dataset,
  CASE n % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'challenging' END AS subset,
  CASE n % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE n % 4 WHEN 0 THEN 'content+speaker' WHEN 1 THEN 'prosody+emotion' ELSE 'mixed' END AS combo_type,
  concat('data/task/audio/', sample_id, '.wav') AS audio_path,
  CASE WHEN n % 29 = 0 THEN '' ELSE text END AS transcript,
  CASE turn % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' ELSE 'swap' END AS edit_type,
  concat(text, CASE WHEN n % 2 = 0 THEN '' ELSE ' one more' END) AS transcript_target,
  CASE WHEN n % 9 = 0 THEN NULL WHEN n % 2 = 0 THEN 'zzz' ELSE split_part(text, ' ', 1) END AS edit_original,
  CASE WHEN n % 8 = 0 THEN '' ELSE split_part(text, ' ', 3) END AS edit_target,
  CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN split_part(text, ' ', 5)
       ELSE split_part(text, ' ', 2) END AS insert_after,
  CASE WHEN n % 19 = 0 THEN NULL WHEN n % 2 = 0 THEN '' ELSE concat('data/ref/', CAST(n % 6 AS STRING), '.wav')
       END AS reference_audio_path,
  CASE WHEN n % 6 = 0 THEN NULL ELSE concat('data/ref/', CAST(n % 5 AS STRING), '.wav') END AS reference_wav,
  CASE WHEN n % 7 = 0 THEN NULL ELSE concat('spk', CAST(n % 7 AS STRING)) END AS target_speaker,
  CASE n % 4 WHEN 0 THEN 'Neutral' WHEN 1 THEN 'sad' WHEN 2 THEN 'Fear' ELSE 'playful' END AS source_emotion,
  CASE n % 5 WHEN 0 THEN 'happy' WHEN 1 THEN 'Fearful' WHEN 2 THEN 'excited' WHEN 3 THEN 'playfulness'
       ELSE 'public broadcast' END AS target_emotion,
  CASE WHEN n % 3 = 0 THEN 'iemocap_en' WHEN n % 3 = 1 THEN '' END AS emotion_taxonomy,
  CASE WHEN n % 4 = 0 THEN 'csemotions_zh' WHEN n % 4 = 1 THEN 'home_made' END AS anchor_taxonomy,
  CASE n % 3 WHEN 0 THEN 'intimate' WHEN 1 THEN 'dramatic' ELSE 'conversational' END AS source_style,
  CASE n % 6 WHEN 0 THEN 'public-broadcast' WHEN 1 THEN 'intimate' WHEN 2 THEN 'dramatic'
       WHEN 3 THEN 'restrained-flat' WHEN 4 THEN 'storytelling' ELSE 'whispered' END AS target_style,
  CASE n % 5 WHEN 0 THEN 'mute' WHEN 1 THEN 'remove' WHEN 2 THEN 'remove' ELSE 'add' END AS operation,
  CASE n % 6 WHEN 0 THEN 'breath' WHEN 1 THEN 'laugh' WHEN 2 THEN 'cough' WHEN 3 THEN 'sigh' ELSE 'sneeze' END
    AS event,
  CASE n % 7 WHEN 0 THEN 'speed' WHEN 1 THEN 'speed' WHEN 2 THEN 'pitch' WHEN 3 THEN 'pitch' WHEN 4 THEN 'stress'
       WHEN 5 THEN 'stress' ELSE 'tempo' END AS prosody_type,
  CASE n % 14 WHEN 0 THEN 'faster' WHEN 1 THEN 'Slower' WHEN 2 THEN 'higher' WHEN 3 THEN 'LOWER'
       WHEN 7 THEN 'slower' WHEN 8 THEN 'sideways' WHEN 9 THEN 'lower' WHEN 10 THEN 'higher' END AS direction,
  CASE WHEN n % 9 < 3 THEN 'enhancement' WHEN n % 9 < 8 THEN 'env_transfer' ELSE 'other' END AS subtask,
  CASE WHEN n % 9 < 3 THEN concat('kind', CAST(n % 3 AS STRING)) ELSE '' END AS degradation_type,
  CASE WHEN n % 9 < 3 THEN NULL WHEN n % 2 = 0 THEN 'reverb' ELSE 'noise' END AS env_type,
  CASE WHEN n % 9 < 3 THEN NULL WHEN n % 2 = 0 THEN '' WHEN n % 3 = 0 THEN 'outdoor' WHEN n % 3 = 1 THEN 'crowd'
       ELSE 'music' END AS env_subtype,
  CASE WHEN n % 31 = 0 THEN NULL ELSE CAST(n % 7 AS DOUBLE) / 10 END AS decay_low,
  CAST(n % 7 AS DOUBLE) / 10 + 3e-1 AS decay_high
FROM ({SAID}) t
"""

# every turn after the first is the output of the sample before it, listed under one to three file names
_OUTPUT_OF = "concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING))"
CANDIDATES = f"""
SELECT {_OUTPUT_OF} AS sample_id, 0 AS dir_rank, 0 AS ext_rank, concat('out/', {_OUTPUT_OF}, '.wav') AS path
FROM ({TURNS}) t WHERE turn >= 1 AND role = 'assistant'
UNION ALL
SELECT {_OUTPUT_OF}, 0, 2, concat('out/', {_OUTPUT_OF}, '.mp3') FROM ({TURNS}) t WHERE turn >= 1 AND n > 300
UNION ALL
SELECT {_OUTPUT_OF}, 1, 1, concat('out/audio/', {_OUTPUT_OF}, '.flac') FROM ({TURNS}) t WHERE turn >= 1
"""

# scores of each output: the sample's own turn is s, the turn that plays the output is o
SCORES = f"""
SELECT s.sample_id,
  CASE WHEN o.n % 11 = 0 THEN NULL
       WHEN s.n % 5 = 0 THEN concat(' ', s.text, '!') WHEN s.n % 5 = 1 THEN s.text
       WHEN s.n % 5 = 2 THEN replace(s.text, ' the ', ' ') WHEN s.n % 5 = 3 THEN o.text
       ELSE concat(s.text, ' one more') END AS transcript_predicted,
  CASE WHEN o.n % 13 = 0 THEN NULL ELSE CAST(o.n % 400 AS DOUBLE) / 100 + 1 END AS utmos,
  CASE WHEN o.n % 17 = 0 THEN NULL ELSE CAST(o.n % 101 AS DOUBLE) / 100 END AS source_output_speaker_similarity,
  CASE WHEN o.n % 17 = 0 THEN NULL ELSE CAST(s.n % 101 AS DOUBLE) / 100 END AS speaker_similarity,
  CASE o.n % 6 WHEN 0 THEN '{{{{"predicted_emotion": "Happy", "confidence": 0.9}}}}'
       WHEN 1 THEN concat('Sure:', chr(10), '```json', chr(10), '{{{{"predicted_emotion": "fear"}}}}', chr(10), '```')
       WHEN 2 THEN 'It sounds angry to me' WHEN 3 THEN '{{{{"predicted_emotion": "playful"}}}}'
       WHEN 4 THEN '["happy"]' ELSE '{{{{"predicted_emotion": " Excited "}}}}' END AS emotion_judge,
  concat('{{{{"target_style_score": ',
       CASE o.n % 7 WHEN 0 THEN '2.5' WHEN 1 THEN '"3"' WHEN 2 THEN '3.5' WHEN 3 THEN '9' WHEN 4 THEN '"x"'
            WHEN 5 THEN '-1' ELSE 'null' END,
       CASE o.n % 5 WHEN 0 THEN ', "target_style_success": true' WHEN 1 THEN ', "target_style_success": "Yes"'
            WHEN 2 THEN ', "target_style_success": 0' WHEN 3 THEN '' ELSE ', "target_style_success": null' END,
       ', "dominant_style": "', CASE WHEN o.n % 3 = 0 THEN 'Dramatic' ELSE 'uncertain' END,
       '", "style_scores": {{{{"intimate": ', CAST(o.n % 5 AS STRING), ', "dramatic": ', CAST(s.n % 5 AS STRING),
       ', "storytelling": ', CAST(s.n % 4 AS STRING), '}}}}}}}}') AS style_judge,
  CASE WHEN o.n % 23 = 0 THEN '' ELSE
    concat('{{{{"event_scores": {{{{"breath": ', CAST(o.n % 4 AS STRING), ', "laugh": "', CAST(s.n % 4 AS STRING),
       '", "cough": 1.5}}}}, "confidence": 0.5}}}}') END AS event_judge,
  CASE WHEN s.n % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(s.n AS DOUBLE) / 16 END AS input_duration,
  CAST(o.n AS DOUBLE) / 16 AS output_duration,
  CASE WHEN s.n % 41 = 0 THEN NULL ELSE CAST(s.n % 200 AS DOUBLE) + 90 END AS input_f0,
  CASE WHEN o.n % 43 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o.n % 200 AS DOUBLE) + 90 END AS output_f0,
  CASE WHEN o.n % 10 = 0 THEN NULL ELSE o.n % 3 = 0 END AS stress_passed,
  CASE WHEN o.n % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(5e-1 AS DOUBLE) END AS rpg,
  CASE WHEN o.n % 12 = 0 THEN NULL ELSE CAST(o.n % 50 AS DOUBLE) / 10 END AS dnsmos_sig,
  CAST(o.n % 40 AS DOUBLE) / 10 AS dnsmos_bak,
  CASE WHEN o.n % 14 = 0 THEN NULL ELSE CAST(o.n % 45 AS DOUBLE) / 10 END AS dnsmos_ovrl,
  CAST(s.n % 50 AS DOUBLE) / 10 AS source_dnsmos_sig,
  CAST(s.n % 40 AS DOUBLE) / 10 AS source_dnsmos_bak,
  CAST(s.n % 45 AS DOUBLE) / 10 AS source_dnsmos_ovrl,
  CAST(o.n % 30 AS DOUBLE) / 8 AS pesq, CAST(s.n % 30 AS DOUBLE) / 8 AS source_pesq,
  CAST(o.n % 100 AS DOUBLE) / 128 AS stoi, CAST(s.n % 100 AS DOUBLE) / 128 AS source_stoi,
  CASE WHEN o.n % 15 = 0 THEN NULL ELSE CAST(o.n % 90 AS DOUBLE) / 64 END AS rt60,
  CASE WHEN o.n % 16 = 0 THEN NULL ELSE CAST(o.n % 64 AS DOUBLE) / 64 END AS scene_rain,
  CAST(o.n % 50 AS DOUBLE) / 64 AS scene_crowd, CAST(o.n % 70 AS DOUBLE) / 128 AS scene_music,
  CAST(s.n % 30 AS DOUBLE) / 64 AS source_rain, CAST(s.n % 20 AS DOUBLE) / 64 AS source_crowd,
  CAST(s.n % 25 AS DOUBLE) / 64 AS source_music
FROM ({SAID}) s JOIN ({SAID}) o ON o.conv_id = s.conv_id AND o.turn = s.turn + 1
"""


def _tables(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived table in Spark."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in _tables(sql)})


def duck(sql: str) -> str:
    """The same statement for DuckDB, where driver tables are views of their own name."""
    return sql.format(**{name: name for name in _tables(sql)})
