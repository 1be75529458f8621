"""Task verdicts whose scores come from our own operators: embeddings, tokens and frames, impulse responses, scene maps,
perceptual segments.

Which recording a sample's source or output sounds like is dealt from the sample's numbers over the whole counted range of
``embeddings``; a reference sounds like the recording of its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgauge.operators import signal as sg
from voxgauge.operators import stress as st
from voxgauge.operators.similarity import pair_similarity
from voxgauge.plans import stats, tasks
from voxgauge.session import stage, table
from voxgauge.workload import duck_text as dt
from voxgauge.workload import signal_queries as sq
from voxgauge.workload import task_queries as tq

#: Factors of a sample's numbers (conversation, turn) that deal out recordings, per side.
DEAL = {"output": (31, 7), "source": (17, 5)}
SIDES = tuple(DEAL)
PERCEPTUAL = {"sig": "dnsmos_sig", "bak": "dnsmos_bak", "ovrl": "dnsmos_ovrl"}


def _recording(spark, sf, side: str) -> Column:
    """Number of a recording, from the counted range of all of them (a scalar subquery, no collect)."""
    a, b = DEAL[side]
    vectors = table(spark, sf, "embeddings")
    first = vectors.agg(F.min("vec_id")).scalar()
    size = vectors.agg(F.max("vec_id") - F.min("vec_id") + 1).scalar()
    return first + (F.col("conv_id") * a + F.col("turn") * b + F.col("n")) % size


def _with_speaker(spark, sf, matched: DataFrame) -> DataFrame:
    """Embeddings to the similarity of output and reference."""
    reference = F.coalesce(F.nullif("reference_audio_path", F.lit("")), F.nullif("reference_wav", F.lit("")))
    paths = matched.drop("speaker_similarity").withColumns({
        "_sounds": F.concat(F.lit("v"), _recording(spark, sf, "output").cast("string")),
        "_like": F.concat(F.lit("v"), F.regexp_extract(reference, r"(\d+)\.wav", 1))})
    recordings = table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), "embedding")
    return pair_similarity(paths, recordings, "sample_id", "_sounds", "_like", "speaker_similarity")


def _with_stress(spark, sf, matched: DataFrame) -> DataFrame:
    """Tokens and frames to word windows, prominence and stress verdicts."""
    stressed = st.stress_rollup(sq._verdicts(spark, sf)).select(
        "sample_id", F.col("passed").alias("stress_passed"), "rpg")
    return matched.drop("stress_passed", "rpg").join(stressed, "sample_id", "left")


def _with_perceptual(matched: DataFrame) -> DataFrame:
    """Planned windows of sources and outputs, their calibrated means as the perceptual scores of enhancement samples."""
    lengths = {"output": (F.col("output_duration") * 16).cast("bigint"), "source": F.col("n").cast("bigint")}
    clips = matched.where(F.col("has_output") & (F.col("subtask") == "enhancement")).select("sample_id", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), length.alias("units")) for side, length in lengths.items()])).alias("clip")
    ).select(F.struct("sample_id", "clip.side").alias("clip"), "clip.units", (F.col("clip.units") * 160).alias("samples"))
    units, segment = F.col("units"), F.col("segment")
    raw = sg.segment_plan(clips, "samples").select(
        "clip", ((units + segment) % 40 / 10).alias("sig_raw"), ((units + segment * 3) % 30 / 8).alias("bak_raw"),
        ((units * 7 + segment) % 50 / 16).alias("ovr_raw"), (segment % 5 / 4).alias("p808"))
    means = sg.segment_means(raw, "clip")
    names = {"output": "", "source": "source_"}
    wide = means.groupBy("clip.sample_id").agg(*[
        F.max(F.when(F.col("clip.side") == side, F.col(mean))).alias(names[side] + score)
        for side in SIDES for mean, score in PERCEPTUAL.items()])
    return matched.drop(*[prefix + score for prefix in names.values() for score in PERCEPTUAL.values()]).join(
        wide, "sample_id", "left")


def _with_acoustics(spark, sf, matched: DataFrame) -> DataFrame:
    """Impulse responses to decay times, embeddings as scene maps, segments as perceptual scores; unchanged outputs too."""
    responses = sq._sources_and_outputs(spark, sf)
    same = sg.is_unchanged(sg.mean_square_difference(F.col("source"), F.col("output")))
    times = sg.impulse_decay(responses, "vec_id", "source", sq.IMPULSE_RATE, same).select(
        F.col("vec_id").alias("_heard"), F.col("decay_seconds").alias("rt60"), F.col("error").alias("rt60_error"))
    scenes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_scene_of"), sq._scenes().alias("_scenes"))
    out = tq._with_scenes(matched).drop("rt60", "rt60_error", "scenes", "source_scenes").withColumns({
        "_heard": _recording(spark, sf, "output"), "_first": _recording(spark, sf, "source")})
    out = out.join(times, "_heard", "left")
    for name, of in (("scenes", "_heard"), ("source_scenes", "_first")):
        out = out.join(scenes.withColumnRenamed("_scenes", name), F.col(of) == F.col("_scene_of"), "left").drop("_scene_of")
    return _with_perceptual(out.drop("_heard", "_first"))


def speaker_end_to_end(spark, sf):
    """Embeddings to similarity to speaker verdicts."""
    scored = tasks.speaker_verdicts(_with_speaker(spark, sf, tq.matched_samples(spark, sf)))
    return scored.where("has_output").select(*tq.COMMON, *tq.TEXT, "reference", "speaker_similarity")


def prosody_end_to_end(spark, sf):
    """Tokens and frames to word windows, prominence and stress verdicts to prosody verdicts."""
    scored = tasks.prosody_verdicts(_with_stress(spark, sf, tq.matched_samples(spark, sf)))
    return scored.where("has_output").select(*tq.COMMON, *tq.TEXT, "passed", "duration_ratio", "shift_semitone", "rpg")


def acoustic_end_to_end(spark, sf):
    """Impulse responses, scene maps and perceptual segments to acoustic verdicts."""
    matched = stage(tq.matched_samples(spark, sf), "matched")
    scored = tasks.acoustic_verdicts(_with_acoustics(spark, sf, matched))
    return scored.where("has_output").select(
        *tq.COMMON, *tq.TEXT, "dnsmos_sig_gain", "dnsmos_bak_gain", "dnsmos_ovrl_gain", "rt60_measured",
        "predicted_env_subtype", "target_scene_score", "target_scene_gain")


def _composed(spark, sf):
    """Samples with the scores of all the operators above, staged once for the judges of the components."""
    measured = tq._measured(spark, sf)
    scored = _with_stress(spark, sf, _with_speaker(spark, sf, measured))
    return tq._compositional(stage(_with_acoustics(spark, sf, scored), "composed"), acoustic=tasks.acoustic_verdicts)


def compositional_end_to_end(spark, sf):
    """Components of seven kinds, each judged by its task from operator-made scores, pooled per sample."""
    return _composed(spark, sf).where("has_output").select(
        "sample_id", "joint_success", "preservation_success", "components_total", "components_known", "components_passed",
        "component_success_rate", "component_error_count", "preservation_error_count", "error")


QUERIES = {
    "speaker_end_to_end": speaker_end_to_end,
    "prosody_end_to_end": prosody_end_to_end,
    "acoustic_end_to_end": acoustic_end_to_end,
    "compositional_end_to_end": compositional_end_to_end,
    "compositional_end_to_end_summary": lambda s, d: stats.compositional_summary(_composed(s, d)),
}


def _deal(side: str) -> str:
    a, b = DEAL[side]
    return (f"(SELECT min(vec_id) FROM embeddings) + (conv_id * {a} + turn * {b} + n)"
            " % (SELECT max(vec_id) - min(vec_id) + 1 FROM embeddings)")


_SPEAKER = f"""v AS (SELECT 'v' || vec_id::VARCHAR AS path, embedding::DOUBLE[] AS e FROM embeddings),
heard AS (SELECT s.* EXCLUDE (speaker_similarity), {dt.r4("list_dot_product(a.e, b.e)"
    " / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))")} AS speaker_similarity
  FROM (SELECT *, 'v' || ({_deal('output')})::VARCHAR AS sounds FROM scored) s LEFT JOIN v a ON a.path = sounds
  LEFT JOIN v b ON b.path = 'v' || regexp_extract(coalesce(nullif(reference_audio_path, ''), nullif(reference_wav, '')),
    '([0-9]+)\\.wav', 1)),
{tq.SPEAKER_SQL.replace("FROM scored)", "FROM heard)", 1)}"""

_PROSODY = f"""st AS (WITH {sq._STRESS}, {sq._PROMINENCE}, r AS (SELECT sample_id, count(*) AS n_words,
    count(*) FILTER (WHERE passed) AS n_passed, bool_and(input_found AND output_found) AS all_found FROM vw GROUP BY 1)
  SELECT sample_id, all_found AND n_passed = n_words AS stress_passed, {dt.r4('n_passed::DOUBLE / n_words')} AS rpg FROM r),
stressed AS (SELECT s.* EXCLUDE (stress_passed, rpg), st.stress_passed, st.rpg FROM scored s LEFT JOIN st USING (sample_id)),
{tq.PROSODY_SQL.replace("FROM scored)", "FROM stressed)", 1)}"""

_RAW = {"sig": "((units + segment) % 40 / 10::DOUBLE)", "bak": "((units + segment * 3) % 30 / 8::DOUBLE)",
        "ovr": "((units * 7 + segment) % 50 / 16::DOUBLE)"}
_PERCEPTUAL = f"""pm AS (WITH c AS (SELECT sample_id, side, units, units * 160 AS samples FROM (
    SELECT sample_id, 'output' AS side, (output_duration * 16)::BIGINT AS units FROM scored
      WHERE has_output AND subtask = 'enhancement'
    UNION ALL SELECT sample_id, 'source', n::BIGINT FROM scored WHERE has_output AND subtask = 'enhancement')),
  {sq.plan_sql('sample_id, side, units')}
  SELECT sample_id, side, {", ".join(f"{dt.r4(f'avg({sq._calibrated(k, raw)})')} AS {k}" for k, raw in _RAW.items())}
  FROM plan GROUP BY 1, 2)"""

_ACOUSTIC = f"""dc AS ({sq._DECAY} SELECT vec_id, sec, CASE WHEN n < 20 AND vec_id % 3 <> 0
    THEN 'impulse response too short for RT60 estimate' END AS why FROM h),
sc AS (SELECT vec_id, {", ".join(f"{sq._scene_max(labels)} AS {g}" for g, labels in sq.fv.SCENE_LABELS.items())} FROM embeddings),
{_PERCEPTUAL},
m0 AS (SELECT s.* EXCLUDE (rt60), dc.sec AS rt60, dc.why, x.outdoor AS o_outdoor, x.crowd AS o_crowd, x.music AS o_music,
    y.outdoor AS s_outdoor, y.crowd AS s_crowd, y.music AS s_music, po.sig - ps.sig AS sig_g, po.bak - ps.bak AS bak_g,
    po.ovr - ps.ovr AS ovrl_g
  FROM (SELECT *, {_deal('output')} AS heard_as, {_deal('source')} AS first_as FROM scored) s
  LEFT JOIN dc ON dc.vec_id = heard_as LEFT JOIN sc x ON x.vec_id = heard_as LEFT JOIN sc y ON y.vec_id = first_as
  LEFT JOIN pm po ON po.sample_id = s.sample_id AND po.side = 'output'
  LEFT JOIN pm ps ON ps.sample_id = s.sample_id AND ps.side = 'source'),
m1 AS (SELECT *, subtask = 'enhancement' AS enhancing, subtask = 'env_transfer' AND env_type = 'reverb' AS reverb,
    subtask = 'env_transfer' AND env_type = 'noise' AS noise, o_outdoor IS NOT NULL AND s_outdoor IS NOT NULL AS heard,
    {tq._by_scene('o')} AS o_score, {tq._by_scene('s')} AS s_score,
    CASE greatest(o_outdoor, o_crowd, o_music) WHEN o_outdoor THEN 'outdoor' WHEN o_crowd THEN 'crowd' ELSE 'music' END AS best,
    decay_low * 0.8::DOUBLE AS low, decay_high * 1.2::DOUBLE AS high FROM m0),
m2 AS (SELECT *,
    {", ".join(f"CASE WHEN enhancing THEN {dt.r4(f'{k}_g')} END AS dnsmos_{k}_gain" for k in ("sig", "bak", "ovrl"))},
    CASE WHEN reverb THEN {dt.r4('rt60')} END AS rt60_measured,
    CASE WHEN noise AND heard THEN best END AS predicted_env_subtype,
    CASE WHEN noise AND heard THEN {dt.r4('o_score')} END AS target_scene_score,
    CASE WHEN noise AND heard THEN {dt.r4('o_score - s_score')} END AS target_scene_gain,
    CASE WHEN enhancing THEN CASE WHEN ovrl_g IS NOT NULL AND bak_g IS NOT NULL THEN ovrl_g > 0 AND bak_g > 0 END
      WHEN reverb THEN rt60 BETWEEN low AND high
      WHEN noise AND heard THEN coalesce(best = env_subtype, FALSE) AND o_score >= 0.1::DOUBLE AND o_score - s_score >= 0.03::DOUBLE
      END AS target_success,
    nullif(concat_ws('; ', CASE WHEN reverb AND rt60 IS NULL THEN coalesce(why, 'no decay estimate') END,
      CASE WHEN noise AND NOT heard THEN 'no scene scores' END,
      CASE WHEN np IS NULL THEN 'content_preservation: {tq.NO_TEXT}' END), '') AS error FROM m1),
acoustic AS (SELECT *, CASE WHEN target_success IS NOT NULL AND cp_pass IS NOT NULL THEN target_success AND cp_pass END
    AS joint_success FROM m2)"""

_COMPOSED = (f"{tq.CONTENT_SQL}, {_SPEAKER}, {_PROSODY}, {tq.EMOTION_SQL}, {tq.STYLE_SQL}, {tq.EVENT_SQL}, {_ACOUSTIC}, "
             f"{tq.POOLED_SQL}")

ORACLES = {
    "speaker_end_to_end": tq._detail_sql(
        _SPEAKER, "speaker", f"{tq._COMMON_SQL}, {tq._TEXT_SQL}, reference, speaker_similarity"),
    "prosody_end_to_end": tq._detail_sql(
        _PROSODY, "prosody", f"{tq._COMMON_SQL}, {tq._TEXT_SQL}, passed, duration_ratio, shift_semitone, rpg"),
    "acoustic_end_to_end": tq._detail_sql(
        _ACOUSTIC, "acoustic", f"{tq._COMMON_SQL}, {tq._TEXT_SQL}, dnsmos_sig_gain, dnsmos_bak_gain, dnsmos_ovrl_gain, "
        "rt60_measured, predicted_env_subtype, target_scene_score, target_scene_gain"),
    "compositional_end_to_end": tq._detail_sql(_COMPOSED, "compositional", tq.COMPOSITIONAL_COLUMNS),
    "compositional_end_to_end_summary": tq._with(_COMPOSED, tq.COMPOSITIONAL_SUMMARY),
}
