"""The eight task evaluations: verdict tables, summaries and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions import text as tx
from voxgauge.operators.match import expected_transcript, match_outputs, materialise_components
from voxgauge.operators.rollup import mean, rate, summarise
from voxgauge.plans import all_tasks
from voxgauge.plans import compositional as comp
from voxgauge.plans import stats, tasks
from voxgauge.session import spread, stage
from voxgauge.workload import duck_text as dt
from voxgauge.workload.standins import CANDIDATES, SAMPLES, SCORES, spark_table


def matched_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with their best output and the scores of it."""
    samples = spread(spark_table(spark, sf, SAMPLES), "sample_id")  # the text errors that follow are heavy per row
    matched = match_outputs(samples, spark_table(spark, sf, CANDIDATES), "sample_id",
                            [F.col("dir_rank"), F.col("ext_rank")], ["path"])
    scores = spark_table(spark, sf, SCORES)
    return matched.withColumnRenamed("path", "output_path").join(scores, "sample_id", "left")


#: The score that the labels of a scene group share; which label of the group is how loud depends on the text length.
GROUP_SCORES = {"outdoor": "rain", "crowd": "crowd", "music": "music"}
LABEL_PLACES = list(enumerate((label, group) for group, labels in fv.SCENE_LABELS.items() for label in labels))


def _with_scenes(matched: DataFrame) -> DataFrame:
    """Scene maps of all labels of all groups, and one label outside of them."""
    def scenes(prefix: str):
        loud = [F.col(f"{prefix}_{GROUP_SCORES[group]}") * ((F.col("n") + 3 * place) % 11) / 8
                for place, (_, group) in LABEL_PLACES]
        return F.map_from_arrays(F.array(*[F.lit(label) for _, (label, _) in LABEL_PLACES], F.lit("Speech")),
                                 F.array(*loud, F.lit(0.99)))

    return matched.withColumns({
        "scenes": F.when(F.col("scene_rain").isNotNull(), scenes("scene")),
        "source_scenes": F.when(F.col("source_rain").isNotNull(), scenes("source")),
        "rt60_target_range": F.when(F.col("decay_low").isNull(), F.array(F.col("decay_high"))).otherwise(
            F.array("decay_low", "decay_high")),
        "rt60_error": F.lit(None).cast("string"),
    })


# --- scored tables -------------------------------------------------------------------------------------------

def scored_content(spark, sf):
    return tasks.content_verdicts(matched_samples(spark, sf))


def scored_speaker(spark, sf):
    return tasks.speaker_verdicts(matched_samples(spark, sf))


def scored_emotion(spark, sf):
    return tasks.emotion_verdicts(matched_samples(spark, sf).withColumnRenamed("emotion_judge", "judge_text"))


def scored_style(spark, sf):
    return tasks.style_verdicts(matched_samples(spark, sf).withColumnRenamed("style_judge", "judge_text"))


def scored_paralinguistic(spark, sf):
    return tasks.paralinguistic_verdicts(matched_samples(spark, sf).withColumnRenamed("event_judge", "judge_text"))


def scored_prosody(spark, sf):
    return tasks.prosody_verdicts(matched_samples(spark, sf))


def scored_acoustic(spark, sf):
    return tasks.acoustic_verdicts(_with_scenes(matched_samples(spark, sf)))


def _components(matched: DataFrame) -> DataFrame:
    """Zero to eight components per sample, of every kind that has a judge and one that has none."""
    n = F.col("n")
    kinds = F.filter(F.array(
        F.when(n % 7 < 2, "content"), F.when(n % 3 == 0, "speaker"), F.when(n % 2 == 0, "prosody"),
        F.when(n % 5 == 0, "emotion"), F.when(n % 13 == 0, "hum"), F.when(n % 6 == 1, "acoustic"),
        F.when(n % 11 < 2, "style"), F.when(n % 4 == 3, "paralinguistic")), lambda k: k.isNotNull())
    return matched.where("has_output").select(
        F.col("sample_id").alias("parent_id"), "*", F.posexplode(kinds).alias("component_index", "component_type"))


def _component_verdicts(matched: DataFrame, acoustic=lambda df: tasks.acoustic_verdicts(_with_scenes(df))) -> DataFrame:
    judges = {
        "content": tasks.content_verdicts,
        "speaker": tasks.speaker_verdicts,
        "prosody": tasks.prosody_verdicts,
        "emotion": lambda df: tasks.emotion_verdicts(df.withColumnRenamed("emotion_judge", "judge_text")),
        "style": lambda df: tasks.style_verdicts(df.withColumnRenamed("style_judge", "judge_text")),
        "paralinguistic": lambda df: tasks.paralinguistic_verdicts(df.withColumnRenamed("event_judge", "judge_text")),
        "acoustic": acoustic,
    }
    return comp.component_verdicts(_components(matched), judges)


def component_rows(spark, sf):
    return _component_verdicts(stage(matched_samples(spark, sf), "matched"))


def _measured(spark, sf):
    """Matched samples with their text errors, measured once for all the branches that follow."""
    return stage(tx.with_preservation(matched_samples(spark, sf), "transcript", "transcript_predicted"), "measured")


def _compositional(measured: DataFrame, **judges) -> DataFrame:
    checked = measured.withColumn(
        "preservation_error", F.when(F.col("transcript_predicted").isNull(), tasks.NO_TRANSCRIPT))
    return comp.compositional_verdicts(checked, _component_verdicts(measured, **judges))


def scored_compositional(spark, sf):
    return _compositional(_measured(spark, sf))


def all_scored(spark, sf):
    """Scored tables of the eight tasks over one staged measurement."""
    matched = _measured(spark, sf)

    def judged(name):
        return matched.withColumnRenamed(f"{name}_judge", "judge_text")

    composed = _compositional(matched)
    return {
        "acoustic_editing": tasks.acoustic_verdicts(_with_scenes(matched)),
        "content_editing": tasks.content_verdicts(matched),
        "compositional_editing": composed.withColumn("content_preservation_pass", F.col("preservation_success")),
        "emotion_editing": tasks.emotion_verdicts(judged("emotion")),
        "paralinguistic_editing": tasks.paralinguistic_verdicts(judged("event")),
        "prosody_editing": tasks.prosody_verdicts(matched),
        "speaker_editing": tasks.speaker_verdicts(matched),
        "style_editing": tasks.style_verdicts(judged("style")),
    }


def all_tasks_summary(spark, sf):
    return all_tasks.all_tasks_summary(all_tasks.common_verdicts(all_scored(spark, sf)))


def component_samples(spark, sf):
    """Samples with up to three components turned into atomic samples, and the transcript each should end up with."""
    s = spark_table(spark, sf, SAMPLES)
    n = F.col("n")

    def component(kind, anchor, dataset, taxonomy):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("component_type"), F.lit(f"{kind}_editing").alias("edit_type"),
            F.struct(*[anchor.get(k, none).alias(k) for k in ("transcript_target", "emotion_taxonomy")]).alias("anchor"),
            none.alias("reference_audio_path"), dataset.alias("source_dataset"), taxonomy.alias("emotion_taxonomy"))

    null = F.lit(None).cast("string")
    built = s.withColumns({
        "instruction": F.col("transcript"), "benchmark_version": F.lit("v1.1"), "duration_tag": null,
        "components": F.array_compact(F.array(
            F.when(n % 3 == 0, component("speaker", {}, F.lit("own"), null)),
            F.when(n % 2 == 0, component(
                "content", {"transcript_target": F.when(n % 4 == 0, F.lit("")).otherwise(F.col("transcript_target"))},
                null, null)),
            F.when(n % 5 < 2, component(
                "emotion", {"emotion_taxonomy": F.lit("iemocap_en")}, null, F.when(n % 5 == 0, F.lit("csemotions_zh")))))),
    }).withColumn("expected", expected_transcript(F.col("components"), F.col("transcript")))
    expected = built.select(F.col("sample_id").alias("parent_id"), F.md5("expected").alias("expected_md5"))
    return materialise_components(built).join(expected, "parent_id").select(
        "sample_id", "parent_id", F.col("component_index").cast("bigint").alias("component_index"), "component_type", "task",
        "language", "source_dataset", "subset", "emotion_taxonomy", "expected_md5")


# --- details: whole verdict tables --------------------------------------------------------------------------

COMMON = ["sample_id", "target_success", "joint_success", "error"]
TEXT = ["wer", "cer", "content_preservation_error", "content_preservation_pass"]


def _details(scored: DataFrame, *columns: str) -> DataFrame:
    return scored.where("has_output").select(*columns)


def content_details(spark, sf):
    return _details(scored_content(spark, sf), *COMMON, "exact_match", "edit_success", "edit_success_reason",
                    "wer", "cer")


def speaker_details(spark, sf):
    return _details(scored_speaker(spark, sf), *COMMON, *TEXT, "reference")


def emotion_details(spark, sf):
    return _details(scored_emotion(spark, sf), *COMMON, *TEXT, "predicted_emotion", "target_emotion",
                    "emotion_taxonomy")


def style_details(spark, sf):
    return _details(scored_style(spark, sf), *COMMON, *TEXT, "target_style_score", "dominant_style")


def paralinguistic_details(spark, sf):
    return _details(scored_paralinguistic(spark, sf), *COMMON, *TEXT, "predicted_score")


def prosody_details(spark, sf):
    return _details(scored_prosody(spark, sf), *COMMON, *TEXT, "passed", "duration_ratio", "shift_semitone", "rpg")


def acoustic_details(spark, sf):
    return _details(scored_acoustic(spark, sf), *COMMON, *TEXT, "dnsmos_sig_gain", "dnsmos_bak_gain",
                    "dnsmos_ovrl_gain", "pesq_gain", "stoi_gain", "rt60_measured", "rt60_tolerated_min",
                    "rt60_tolerated_max", "predicted_env_subtype", "target_scene_score", "target_scene_gain")


def compositional_details(spark, sf):
    return _details(scored_compositional(spark, sf), "sample_id", "joint_success", "preservation_success",
                    "components_total", "components_known", "components_passed", "component_success_rate",
                    "component_error_count", "preservation_error_count", "error")


def preservation_by_language(spark, sf):
    """Flagship: content preservation of all outputs by language, dataset and subset."""
    scored = tx.with_preservation(matched_samples(spark, sf), "transcript", "transcript_predicted")
    dims = {
        "language": F.col("language"), "dataset": F.coalesce("source_dataset", F.lit("unknown")),
        "subset": F.coalesce("subset", F.lit("unknown")),
    }
    return summarise(scored.where("has_output"), dims, {
        "content_preservation_pass_rate": rate(F.col("content_preservation_pass")),
        "avg_content_preservation_error": mean(F.col("content_preservation_error")),
        "avg_wer": mean(F.col("wer")), "avg_cer": mean(F.col("cer")),
    })


def preservation_verdict_only(spark, sf):
    """The same verdict with the edit distance cut off at the error budget."""
    matched = matched_samples(spark, sf).where(F.col("transcript_predicted").isNotNull())
    normed = matched.select(
        "sample_id", "language",
        tx.normalize(F.col("transcript"), F.col("language")).alias("r"),
        tx.normalize(F.col("transcript_predicted"), F.col("language")).alias("h"))
    return normed.select("sample_id", tx.within_error_budget(F.col("r"), F.col("h"), F.col("language")).alias(
        "content_preservation_pass"))


# --- checks ---------------------------------------------------------------------------------------------------

NO_TEXT, NO_ANSWER = tasks.NO_TRANSCRIPT, tasks.NO_ANSWER

CONTENT_SQL = f"""c0 AS (SELECT *, {dt.norm("coalesce(edit_original, '')")} AS eo,
    {dt.norm("coalesce(edit_target, '')")} AS et, {dt.norm("coalesce(insert_after, '')")} AS ia,
    CASE WHEN has_output AND transcript_predicted IS NULL THEN '{NO_TEXT}' END AS error FROM scored),
c1 AS (SELECT *,
    contains(np, et) AS t_ok, (eo = '' OR NOT contains(np, eo)) AS o_gone,
    (contains(np, ia) AND contains(np, et) AND strpos(np, ia) <= strpos(np, et)) AS in_order FROM c0),
c2 AS (SELECT *, CASE
    WHEN edit_type = 'replace' THEN CASE WHEN et = '' THEN FALSE ELSE t_ok AND o_gone END
    WHEN edit_type = 'insert' THEN CASE WHEN et = '' THEN FALSE WHEN ia = '' THEN t_ok ELSE in_order END
    WHEN edit_type = 'delete' THEN CASE WHEN eo = '' THEN FALSE ELSE NOT contains(np, eo) END
    ELSE FALSE END AS es,
  CASE
    WHEN edit_type = 'replace' AND et = '' THEN 'replace_missing_edit_target'
    WHEN edit_type = 'replace' AND t_ok AND o_gone THEN 'replace_target_present_original_absent'
    WHEN edit_type = 'replace' THEN 'replace_target_present=' || CASE WHEN t_ok THEN 'True' ELSE 'False' END
         || ';original_absent=' || CASE WHEN o_gone THEN 'True' ELSE 'False' END
    WHEN edit_type = 'insert' AND et = '' THEN 'insert_missing_edit_target'
    WHEN edit_type = 'insert' AND ia = '' THEN CASE WHEN t_ok THEN 'insert_target_present'
         ELSE 'insert_target_absent' END
    WHEN edit_type = 'insert' AND in_order THEN 'insert_target_present_after_anchor'
    WHEN edit_type = 'insert' THEN 'insert_target_present=' || CASE WHEN t_ok THEN 'True' ELSE 'False' END
         || ';after_before_target=' || CASE WHEN in_order THEN 'True' ELSE 'False' END
    WHEN edit_type = 'delete' AND eo = '' THEN 'delete_missing_edit_original'
    WHEN edit_type = 'delete' THEN CASE WHEN contains(np, eo) THEN 'delete_original_present'
         ELSE 'delete_original_absent' END
    ELSE 'unsupported_edit_type=' || edit_type END AS why FROM c1),
content AS (SELECT *, CASE WHEN has_output THEN error IS NULL AND es END AS edit_success,
    CASE WHEN has_output THEN error IS NULL AND nt = np END AS exact_match,
    CASE WHEN has_output THEN error IS NULL AND es END AS target_success,
    CASE WHEN has_output THEN error IS NULL AND es END AS joint_success,
    CASE WHEN has_output AND error IS NULL THEN why END AS edit_success_reason FROM c2)"""

SPEAKER_SQL = f"""s0 AS (SELECT *, coalesce(nullif(reference_audio_path, ''), nullif(reference_wav, '')) AS reference
    FROM scored),
s1 AS (SELECT *, CASE WHEN has_output THEN coalesce(
        CASE WHEN reference IS NULL THEN 'missing reference_audio_path/reference_wav' END,
        CASE WHEN np IS NULL THEN '{NO_TEXT}' END) END AS error FROM s0),
speaker AS (SELECT * EXCLUDE (wer, cer, cp_error, cp_pass), CASE WHEN error IS NULL THEN wer END AS wer,
    CASE WHEN error IS NULL THEN cer END AS cer, CASE WHEN error IS NULL THEN cp_error END AS cp_error,
    CASE WHEN error IS NULL THEN cp_pass END AS cp_pass,
    CASE WHEN has_output AND error IS NULL THEN speaker_similarity >= 0.5 END AS target_success,
    CASE WHEN has_output AND error IS NULL AND speaker_similarity IS NOT NULL
         THEN speaker_similarity >= 0.5 AND cp_pass END AS joint_success FROM s1)"""


def _alias(label: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.EMOTION_ALIASES.items())
    key = rf"regexp_replace(trim(lower(coalesce({label}, ''))), '[\s_]+', '-', 'g')"
    return f"CASE {key} {cases} ELSE {key} END"


def _answer(column: str) -> str:
    fence = rf"regexp_extract({column}, '```(?:json)?\s*([\s\S]+?)\s*```', 1)"
    return (f"CASE WHEN json_valid({column}) THEN {column} WHEN json_valid({fence}) THEN {fence} END")


def _judge_cte(name: str, judge: str) -> str:
    return f"""{name}0 AS (SELECT *, {_answer(judge)} AS answer FROM scored),
{name}1 AS (SELECT *, CASE WHEN has_output THEN CASE
    WHEN answer IS NULL OR json_type(answer) <> 'OBJECT' THEN '{NO_ANSWER}'
    WHEN np IS NULL THEN '{NO_TEXT}' END END AS error FROM {name}0)"""


def _judge_tail(name: str, source: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (wer, cer, cp_error, cp_pass),
    CASE WHEN has_output AND error IS NULL THEN wer END AS wer,
    CASE WHEN has_output AND error IS NULL THEN cer END AS cer,
    CASE WHEN has_output AND error IS NULL THEN cp_error END AS cp_error,
    CASE WHEN has_output AND error IS NULL THEN cp_pass END AS cp_pass,
    CASE WHEN has_output THEN error IS NULL AND coalesce(hit, FALSE) END AS correct,
    CASE WHEN has_output THEN error IS NULL AND coalesce(hit, FALSE) END AS target_success,
    CASE WHEN has_output THEN error IS NULL AND coalesce(hit, FALSE) AND coalesce(cp_pass, FALSE) END
        AS joint_success FROM {source})"""


def _quoted(labels) -> str:
    return ", ".join(f"'{x}'" for x in labels)


EMOTION_SQL = f"""{_judge_cte('e', 'emotion_judge')},
e2 AS (SELECT * REPLACE ({_alias('target_emotion')} AS target_emotion, {_alias('source_emotion')} AS source_emotion,
        coalesce(nullif(emotion_taxonomy, ''), anchor_taxonomy, 'unknown') AS emotion_taxonomy),
    CASE WHEN coalesce(nullif(emotion_taxonomy, ''), anchor_taxonomy) IN ('iemocap_en', 'csemotions_zh')
           THEN coalesce(nullif(emotion_taxonomy, ''), anchor_taxonomy)
         WHEN source_dataset IN ('iemocap', 'libritts_test_clean') THEN 'iemocap_en'
         WHEN source_dataset IN ('csemotions', 'aishell3_test') THEN 'csemotions_zh'
         WHEN language = 'zh' THEN 'csemotions_zh' ELSE 'iemocap_en' END AS tx,
    {_alias("json_extract_string(answer, '$.predicted_emotion')")} AS said FROM e1),
e3 AS (SELECT *, CASE WHEN has_output AND error IS NULL THEN
    CASE WHEN tx = 'iemocap_en' AND said IN ({_quoted(fv.EMOTIONS_BY_TAXONOMY['iemocap_en'])}) THEN said
         WHEN tx = 'csemotions_zh' AND said IN ({_quoted(fv.EMOTIONS_BY_TAXONOMY['csemotions_zh'])}) THEN said
         ELSE 'unknown' END END AS predicted_emotion FROM e2),
e4 AS (SELECT *, predicted_emotion = target_emotion AS hit FROM e3),
{_judge_tail('emotion', 'e4')}"""


def _score(path: str, top: int) -> str:
    raw = f"json_extract_string(answer, '{path}')"
    return (f"least({top}, greatest(0, coalesce(round_even(try_cast({raw} AS DOUBLE), 0)::INT, 0)))")


def _style_score(style: str) -> str:
    return _score(f'$.style_scores."{style}"', fv.STYLE_SCORE_MAX)


STYLE_SQL = f"""{_judge_cte('y', 'style_judge')},
y2 AS (SELECT *, {", ".join(f"{_style_score(s)} AS st{i}" for i, s in enumerate(fv.STYLES))},
    json_type(answer, '$.target_style_score') AS stated, json_type(answer, '$.target_style_success') AS flag_type,
    lower(trim(coalesce(json_extract_string(answer, '$.dominant_style'), ''))) AS named FROM y1),
y3 AS (SELECT *, CASE WHEN stated IS NOT NULL THEN {_score('$.target_style_score', 4)}
    ELSE CASE target_style {" ".join(f"WHEN '{s}' THEN st{i}" for i, s in enumerate(fv.STYLES))} ELSE 0 END
    END AS score FROM y2),
y4 AS (SELECT *, CASE WHEN has_output AND error IS NULL THEN score END AS target_style_score,
    CASE WHEN has_output AND error IS NULL THEN CASE WHEN named IN ({_quoted(fv.STYLES)}) THEN named
      ELSE CASE greatest(st0, st1, st2, st3, st4, st5)
        {" ".join(f"WHEN st{i} THEN '{s}'" for i, s in enumerate(fv.STYLES))} END END END AS dominant_style,
    score >= 3 AND CASE WHEN flag_type IS NULL OR flag_type = 'NULL' THEN TRUE
      WHEN flag_type = 'BOOLEAN' THEN json_extract_string(answer, '$.target_style_success') = 'true'
      WHEN flag_type = 'VARCHAR' THEN lower(trim(json_extract_string(answer, '$.target_style_success')))
           IN ({_quoted(fv.TRUTHY_WORDS)})
      ELSE json_extract_string(answer, '$.target_style_success')::DOUBLE <> 0 END AS hit FROM y3),
{_judge_tail('style', 'y4')}"""

EVENT_SQL = f"""{_judge_cte('v', 'event_judge')},
v2 AS (SELECT *, CASE WHEN has_output AND error IS NULL THEN CASE event
    {" ".join(f"WHEN '{e}' THEN {_score(f'$.event_scores.{e}', 3)}" for e in fv.EVENTS)} ELSE 0 END END
    AS predicted_score FROM v1),
v3 AS (SELECT *, CASE operation WHEN 'add' THEN predicted_score >= 2 WHEN 'remove' THEN predicted_score <= 1
    ELSE FALSE END AS hit FROM v2),
{_judge_tail('paralinguistic', 'v3')}"""

PROSODY_SQL = f"""p0 AS (SELECT *, lower(direction) AS way,
    CASE WHEN input_duration > 0 THEN output_duration / input_duration END AS ratio,
    CASE WHEN input_f0 > 0 AND output_f0 > 0 THEN 12 * log2(output_f0 / input_f0) END AS shift FROM scored),
p1 AS (SELECT *, CASE prosody_type
      WHEN 'speed' THEN CASE WHEN ratio IS NULL THEN 'input duration is zero'
        WHEN way IS NULL OR way NOT IN ('faster', 'slower')
          THEN 'unsupported speed direction: ' || coalesce(direction, 'None') END
      WHEN 'pitch' THEN CASE WHEN shift IS NULL THEN 'unable to compute voiced F0 median'
        WHEN way IS NULL OR way NOT IN ('higher', 'lower')
          THEN 'unsupported pitch direction: ' || coalesce(direction, 'None') END
      WHEN 'stress' THEN CASE WHEN stress_passed IS NULL THEN 'stress_words is empty' END
      ELSE 'unknown prosody_type: ' || prosody_type END AS bad,
    CASE prosody_type
      WHEN 'speed' THEN CASE way WHEN 'faster' THEN ratio <= (1 - 0.05::DOUBLE) WHEN 'slower' THEN
        ratio >= (1 + 0.05::DOUBLE) END
      WHEN 'pitch' THEN CASE way WHEN 'higher' THEN shift >= 0.3::DOUBLE WHEN 'lower' THEN shift <= -(0.3::DOUBLE) END
      WHEN 'stress' THEN stress_passed END AS verdict FROM p0),
p2 AS (SELECT * EXCLUDE (rpg), has_output AND bad IS NULL AS ok, rpg AS rpg_in,
    CASE WHEN has_output THEN coalesce(bad, CASE WHEN np IS NULL THEN '{NO_TEXT}' END) END AS error FROM p1),
prosody AS (SELECT * EXCLUDE (wer, cer, cp_error, cp_pass),
    CASE WHEN ok THEN wer END AS wer, CASE WHEN ok THEN cer END AS cer, CASE WHEN ok THEN cp_error END AS cp_error,
    CASE WHEN ok THEN cp_pass END AS cp_pass, CASE WHEN ok THEN verdict END AS passed,
    CASE WHEN ok AND prosody_type = 'speed' THEN {dt.r4('ratio')} END AS duration_ratio,
    CASE WHEN ok AND prosody_type = 'pitch' THEN {dt.r4('shift')} END AS shift_semitone,
    CASE WHEN ok AND prosody_type = 'stress' THEN rpg_in END AS rpg,
    CASE WHEN ok AND error IS NULL THEN verdict END AS target_success,
    CASE WHEN ok AND cp_pass IS NOT NULL THEN verdict AND cp_pass END AS joint_success FROM p2)"""

def _group_score(prefix: str, group: str) -> str:
    return "greatest(" + ", ".join(f"{prefix}_{GROUP_SCORES[group]} * ((n + {3 * place}) % 11) / 8::DOUBLE"
                                   for place, (_, of) in LABEL_PLACES if of == group) + ")"


def _by_scene(prefix: str) -> str:
    return "CASE env_subtype " + " ".join(f"WHEN '{g}' THEN {prefix}_{g}" for g in fv.SCENE_LABELS) + " ELSE 0 END"


ACOUSTIC_SQL = f"""a0 AS (SELECT * EXCLUDE (dnsmos_sig, dnsmos_bak, dnsmos_ovrl, pesq, stoi),
    has_output AND subtask = 'enhancement' AS enh,
    coalesce(has_output AND subtask = 'env_transfer' AND env_type = 'reverb', FALSE) AS rev,
    coalesce(has_output AND subtask = 'env_transfer' AND env_type = 'noise', FALSE) AS noi,
    {", ".join(f"CASE WHEN has_output AND subtask = 'enhancement' THEN {x} END AS {x}, "
               f"CASE WHEN has_output AND subtask = 'enhancement' THEN {x} - source_{x} END AS {x}_g"
               for x in ("dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "pesq", "stoi"))} FROM scored),
ag AS (SELECT *, {", ".join(f"{_group_score('scene', g)} AS o_{g}, {_group_score('source', g)} AS s_{g}"
                         for g in fv.SCENE_LABELS)} FROM a0),
a1 AS (SELECT *, noi AND scene_rain IS NOT NULL AS sc, {_by_scene('o')} AS ts, {_by_scene('s')} AS ss,
    CASE greatest(o_outdoor, o_crowd, o_music) WHEN o_outdoor THEN 'outdoor' WHEN o_crowd THEN 'crowd'
         ELSE 'music' END AS best_scene FROM ag),
a2 AS (SELECT *, CASE
    WHEN enh THEN CASE WHEN dnsmos_ovrl_g IS NOT NULL AND dnsmos_bak_g IS NOT NULL
                       THEN dnsmos_ovrl_g > 0 AND dnsmos_bak_g > 0 END
    WHEN rev THEN CASE WHEN rt60 IS NOT NULL AND decay_low IS NOT NULL
                       THEN rt60 BETWEEN decay_low * 0.8::DOUBLE AND decay_high * 1.2::DOUBLE END
    WHEN sc THEN best_scene = env_subtype AND ts >= 0.1::DOUBLE AND ts - ss >= 0.03::DOUBLE END AS target_success,
    nullif(concat_ws('; ', CASE WHEN rev AND rt60 IS NULL THEN 'no decay estimate' END,
        CASE WHEN noi AND NOT sc THEN 'no scene scores' END,
        CASE WHEN has_output AND np IS NULL THEN 'content_preservation: {NO_TEXT}' END), '') AS error FROM a1),
acoustic AS (SELECT *, CASE WHEN target_success IS NOT NULL AND cp_pass IS NOT NULL
        THEN target_success AND cp_pass END AS joint_success,
    {", ".join(f"{dt.r4(f'{x}_g')} AS {x}_gain" for x in ("dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "pesq", "stoi"))},
    CASE WHEN rev THEN {dt.r4('rt60')} END AS rt60_measured,
    CASE WHEN rev AND decay_low IS NOT NULL THEN {dt.r4('decay_low * 0.8::DOUBLE')} END AS rt60_tolerated_min,
    CASE WHEN rev AND decay_low IS NOT NULL THEN {dt.r4('decay_high * 1.2::DOUBLE')} END AS rt60_tolerated_max,
    CASE WHEN sc THEN best_scene END AS predicted_env_subtype, CASE WHEN sc THEN {dt.r4('ts')} END AS target_scene_score,
    CASE WHEN sc THEN {dt.r4('ts - ss')} END AS target_scene_gain FROM a2)"""

POOLED_SQL = f"""parts AS (
    SELECT sample_id, 'content' AS kind, target_success AS ok, error FROM content WHERE has_output AND n % 7 < 2
    UNION ALL SELECT sample_id, 'speaker', target_success, error FROM speaker WHERE has_output AND n % 3 = 0
    UNION ALL SELECT sample_id, 'prosody', target_success, error FROM prosody WHERE has_output AND n % 2 = 0
    UNION ALL SELECT sample_id, 'emotion', target_success, error FROM emotion WHERE has_output AND n % 5 = 0
    UNION ALL SELECT sample_id, 'style', target_success, error FROM style WHERE has_output AND n % 11 < 2
    UNION ALL SELECT sample_id, 'paralinguistic', target_success, error FROM paralinguistic WHERE has_output AND n % 4 = 3
    UNION ALL SELECT sample_id, 'acoustic', target_success, error FROM acoustic WHERE has_output AND n % 6 = 1
    UNION ALL SELECT sample_id, 'hum', NULL, 'unknown component_type: hum' FROM scored
        WHERE has_output AND n % 13 = 0),
pooled AS (SELECT sample_id, count(*) AS total, count(ok) AS known, count(*) FILTER (WHERE ok) AS passed,
    count(error) AS errors, bool_or(kind = 'content') AS has_content FROM parts GROUP BY 1),
k0 AS (SELECT s.*, coalesce(p.total, 0) AS c_total, coalesce(p.known, 0) AS c_known, coalesce(p.passed, 0) AS c_passed,
    coalesce(p.errors, 0) AS c_errors, has_output AND NOT coalesce(p.has_content, FALSE) AND transcript <> '' AS chk
    FROM scored s LEFT JOIN pooled p ON p.sample_id = s.sample_id),
compositional AS (SELECT *,
    CASE WHEN has_output THEN c_total END AS components_total, CASE WHEN has_output THEN c_known END AS components_known,
    CASE WHEN has_output THEN c_passed END AS components_passed,
    CASE WHEN has_output THEN c_errors END AS component_error_count,
    CASE WHEN has_output THEN (chk AND np IS NULL)::BIGINT END AS preservation_error_count,
    CASE WHEN chk THEN cp_pass END AS preservation_success,
    CASE WHEN has_output AND c_known > 0 THEN {dt.r4('c_passed::DOUBLE / c_known')} END AS component_success_rate,
    CASE WHEN NOT has_output OR c_known <> c_total OR (chk AND cp_pass IS NULL) THEN NULL
         ELSE c_passed = c_total AND (NOT chk OR cp_pass) END AS joint_success,
    CASE WHEN has_output THEN nullif(concat_ws('; ',
        CASE WHEN c_errors > 0 THEN c_errors::VARCHAR || ' component errors' END,
        CASE WHEN chk AND np IS NULL THEN '{NO_TEXT}' END), '') END AS error FROM k0)"""

COMPOSITIONAL_SQL = (f"{CONTENT_SQL}, {SPEAKER_SQL}, {PROSODY_SQL}, {EMOTION_SQL}, {STYLE_SQL}, {EVENT_SQL}, {ACOUSTIC_SQL}, "
                     f"{POOLED_SQL}")

_TEXT_SQL = ("wer, cer, cp_error AS content_preservation_error, cp_pass AS content_preservation_pass")
_RATES = {
    "target_success_rate": dt.rate("target_success"),
    "content_preservation_pass_rate": dt.rate("cp_pass"),
    "joint_success_rate": dt.rate("joint_success"),
}
_JUDGE = {
    **dt.COVERAGE,
    "accuracy": dt.share("correct", "has_output"), "correct": dt.count("correct"), **_RATES,
    "avg_content_preservation_error": dt.mean("cp_error"), "avg_utmos": dt.mean("utmos"),
    "avg_source_output_speaker_similarity": dt.mean("source_output_speaker_similarity"),
}
_KNOWN = "target_success IS NOT NULL"
_VERDICT = {
    **dt.COVERAGE, "evaluated": dt.count(_KNOWN), "pass_rate": dt.rate("joint_success", _KNOWN), **_RATES,
}


def _dims(names: list[str]) -> dict[str, str]:
    return {n: dt.unknown({"dataset": "source_dataset"}.get(n, n)) for n in names}


def _with(ctes: str, tail: str, target: str = "transcript") -> str:
    return f"WITH RECURSIVE {dt.text_ctes(target)},\n{ctes}\n{tail}"


def _detail_sql(ctes: str, source: str, columns: str, target: str = "transcript") -> str:
    return _with(ctes, f"SELECT {columns} FROM {source} WHERE has_output", target)


_COMMON_SQL = "sample_id, target_success, joint_success, error"

COMPOSITIONAL_COLUMNS = (
    "sample_id, joint_success, preservation_success, components_total, components_known, components_passed, "
    "component_success_rate, component_error_count, preservation_error_count, error")
COMPOSITIONAL_SUMMARY = dt.summary("compositional", {
    **_dims(["difficulty", "combo_type", "language"]),
    "combo_language": "CASE WHEN has_output THEN combo_type || '::' || language END"}, {
    **dt.COVERAGE, "joint_success_rate": dt.rate("joint_success"),
    "component_success_rate":
        dt.four_places("(sum(components_passed) * 10000)", "sum(components_known)"),
    "preservation_success_rate": dt.rate("preservation_success"),
    "avg_sample_component_success_rate": dt.mean("component_success_rate"), "avg_utmos": dt.mean("utmos"),
    "avg_source_output_speaker_similarity": dt.mean("source_output_speaker_similarity")})

QUERIES = {
    "preservation_by_language": preservation_by_language,
    "preservation_verdict_only": preservation_verdict_only,
    "content_details": content_details,
    "content_summary": lambda s, d: stats.content_summary(scored_content(s, d)),
    "speaker_details": speaker_details,
    "speaker_summary": lambda s, d: stats.speaker_summary(scored_speaker(s, d)),
    "emotion_details": emotion_details,
    "emotion_summary": lambda s, d: stats.emotion_summary(scored_emotion(s, d)),
    "style_details": style_details,
    "style_summary": lambda s, d: stats.style_summary(scored_style(s, d)),
    "paralinguistic_details": paralinguistic_details,
    "paralinguistic_summary": lambda s, d: stats.paralinguistic_summary(scored_paralinguistic(s, d)),
    "prosody_details": prosody_details,
    "prosody_summary": lambda s, d: stats.prosody_summary(scored_prosody(s, d)),
    "acoustic_details": acoustic_details,
    "acoustic_summary": lambda s, d: stats.acoustic_summary(scored_acoustic(s, d)),
    "compositional_details": compositional_details,
    "compositional_summary": lambda s, d: stats.compositional_summary(scored_compositional(s, d)),
    "all_tasks_summary": all_tasks_summary,
    "component_samples": component_samples,
    "component_errors": lambda s, d: comp.component_errors(component_rows(s, d)).select(
        F.col("parent_id").alias("sample_id"), "component_type", "error"),
}

ORACLES = {
    "preservation_by_language": _with(
        "done AS (SELECT * FROM scored WHERE has_output)",
        dt.summary("done", {"language": "language", "dataset": "coalesce(source_dataset, 'unknown')",
                            "subset": "coalesce(subset, 'unknown')"}, {
            "content_preservation_pass_rate": dt.rate("cp_pass"),
            "avg_content_preservation_error": dt.mean("cp_error"),
            "avg_wer": dt.mean("wer"), "avg_cer": dt.mean("cer")})),
    "preservation_verdict_only": _with(
        "done AS (SELECT * FROM scored WHERE np IS NOT NULL)",
        "SELECT sample_id, cp_pass AS content_preservation_pass FROM done"),
    "content_details": _detail_sql(
        CONTENT_SQL, "content", f"{_COMMON_SQL}, exact_match, edit_success, edit_success_reason, wer, cer",
        "transcript_target"),
    "content_summary": _with(CONTENT_SQL, dt.summary("content", _dims(["edit_type", "dataset", "language"]), {
        **dt.COVERAGE,
        "exact_match_rate": dt.share("exact_match", "has_output"),
        **{f"{k}_rate": dt.share("edit_success", "has_output")
           for k in ("edit_success", "target_success", "joint_success")},
        "avg_wer": dt.mean("wer", empty="0.0"), "avg_cer": dt.mean("cer", empty="0.0"),
        "exact_match_count": dt.count("exact_match"), "edit_success_count": dt.count("edit_success"),
        "avg_utmos": dt.mean("utmos"),
        "avg_source_output_speaker_similarity": dt.mean("source_output_speaker_similarity"),
    }), "transcript_target"),
    "speaker_details": _detail_sql(SPEAKER_SQL, "speaker", f"{_COMMON_SQL}, {_TEXT_SQL}, reference"),
    "speaker_summary": _with(SPEAKER_SQL, dt.summary("speaker", _dims(["language", "dataset", "target_speaker"]), {
        **dt.COVERAGE, **_RATES, "avg_speaker_similarity": dt.mean("speaker_similarity"),
        "avg_en_wer": dt.mean("wer", "language = 'en'"), "avg_zh_cer": dt.mean("cer", "language = 'zh'"),
        "avg_content_preservation_error": dt.mean("cp_error"), "avg_utmos": dt.mean("utmos")})),
    "emotion_details": _detail_sql(
        EMOTION_SQL, "emotion", f"{_COMMON_SQL}, {_TEXT_SQL}, predicted_emotion, target_emotion, emotion_taxonomy"),
    "emotion_summary": _with(EMOTION_SQL, dt.summary("emotion", _dims([
        "dataset", "subset", "target_emotion", "source_emotion", "language", "emotion_taxonomy"]), _JUDGE)),
    "style_details": _detail_sql(
        STYLE_SQL, "style", f"{_COMMON_SQL}, {_TEXT_SQL}, target_style_score, dominant_style"),
    "style_summary": _with(STYLE_SQL, dt.summary("style", _dims([
        "dataset", "subset", "target_style", "source_style", "language"]), _JUDGE)),
    "paralinguistic_details": _detail_sql(
        EVENT_SQL, "paralinguistic", f"{_COMMON_SQL}, {_TEXT_SQL}, predicted_score"),
    "paralinguistic_summary": _with(EVENT_SQL, dt.summary("paralinguistic", {
        **_dims(["operation", "event"]),
        "operation_event": "CASE WHEN has_output THEN operation || '/' || event END",
        **_dims(["dataset", "language"])}, _JUDGE)),
    "prosody_details": _detail_sql(
        PROSODY_SQL, "prosody", f"{_COMMON_SQL}, {_TEXT_SQL}, passed, duration_ratio, shift_semitone, rpg"),
    "prosody_summary": _with(PROSODY_SQL, dt.summary("prosody", _dims(["prosody_type", "language", "dataset"]), {
        **_VERDICT,
        "direction_accuracy": dt.rate("passed", f"{_KNOWN} AND prosody_type IN ('speed', 'pitch')"),
        "avg_duration_ratio": dt.mean("duration_ratio", _KNOWN),
        "avg_f0_semitone_shift": dt.mean("shift_semitone", _KNOWN), "avg_rpg": dt.mean("rpg", _KNOWN),
        "avg_utmos": dt.mean("utmos"), "avg_content_preservation_error": dt.mean("cp_error"),
        "avg_source_output_speaker_similarity": dt.mean("source_output_speaker_similarity")})),
    "acoustic_details": _detail_sql(
        ACOUSTIC_SQL, "acoustic", f"{_COMMON_SQL}, {_TEXT_SQL}, dnsmos_sig_gain, dnsmos_bak_gain, dnsmos_ovrl_gain, "
        "pesq_gain, stoi_gain, rt60_measured, rt60_tolerated_min, rt60_tolerated_max, predicted_env_subtype, "
        "target_scene_score, target_scene_gain"),
    "acoustic_summary": _with(ACOUSTIC_SQL, dt.summary("acoustic", {
        **_dims(["subtask"]),
        **{n: f"CASE WHEN has_output THEN nullif({n}, '') END"
           for n in ("degradation_type", "env_type", "env_subtype")},
        **_dims(["language", "dataset"])}, {
        **_VERDICT,
        # rows of this task carry four decimals
        **{f"avg_{n}": dt.mean(dt.r4({"content_preservation_error": "cp_error"}.get(n, n))) for n in stats.ACOUSTIC_MEANS},
        "avg_rt60": dt.mean("rt60_measured"), "avg_target_scene_score": dt.mean("target_scene_score")})),
    "compositional_details": _detail_sql(COMPOSITIONAL_SQL, "compositional", COMPOSITIONAL_COLUMNS),
    "compositional_summary": _with(COMPOSITIONAL_SQL, COMPOSITIONAL_SUMMARY),
    "all_tasks_summary": _with(
        f"""{COMPOSITIONAL_SQL},
every_task AS ({" UNION ALL ".join(
    f"SELECT '{name}_editing' AS task, language, source_dataset, has_output, {target} AS target_success, {kept} AS cp_pass,"
    f" joint_success, utmos, error FROM {name}"
    for name, target, kept in (
        ("acoustic", "target_success", "cp_pass"), ("content", "target_success", "NULL::BOOLEAN"),
        ("compositional", "NULL::BOOLEAN", "preservation_success"), ("emotion", "target_success", "cp_pass"),
        ("paralinguistic", "target_success", "cp_pass"), ("prosody", "target_success", "cp_pass"),
        ("speaker", "target_success", "cp_pass"), ("style", "target_success", "cp_pass")))})""",
        dt.summary("every_task", {
            "task": "task", **_dims(["language", "dataset"]),
            "task_language": "CASE WHEN has_output THEN task || '::' || language END"}, {
            **dt.COVERAGE, **_RATES, "avg_utmos": dt.mean("CASE WHEN has_output THEN utmos END")})),
    "component_samples": f"""WITH s AS ({dt.duck(SAMPLES)}),
p AS (SELECT sample_id AS parent_id, n, 0 AS rank, 'speaker' AS kind, language, 'own' AS source_dataset, subset, NULL AS tax
      FROM s WHERE n % 3 = 0
  UNION ALL SELECT sample_id, n, 1, 'content', language, coalesce(source_dataset, 'unknown'), subset, NULL FROM s WHERE n % 2 = 0
  UNION ALL SELECT sample_id, n, 2, 'emotion', language, coalesce(source_dataset, 'unknown'), subset,
      CASE WHEN n % 5 = 0 THEN 'csemotions_zh' ELSE 'iemocap_en' END FROM s WHERE n % 5 < 2)
SELECT parent_id || '::' || kind AS sample_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY rank) - 1
    AS component_index, kind AS component_type, kind || '_editing' AS task, p.language, p.source_dataset,
    coalesce(p.subset, 'compositional') AS subset, tax AS emotion_taxonomy,
    md5(CASE WHEN s.n % 2 = 0 AND s.n % 4 <> 0 THEN transcript_target ELSE transcript END) AS expected_md5
FROM p JOIN s ON s.sample_id = p.parent_id""",
    "component_errors": _with(COMPOSITIONAL_SQL,
                              "SELECT sample_id, kind AS component_type, error FROM parts WHERE error IS NOT NULL"),
}
