"""Stress check: where the words are spoken, how prominent they are, and whether every word gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.prosody import clip_window, prominence
from voxgauge.functions.timing import target_window
from voxgauge.operators.lookup import binned_range_join
from voxgauge.operators.signal import clip_statistics
from voxgauge.session import stage

BIN_SECONDS = 4.0


def word_windows(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Window of each target word on each side, null when it is not spoken.

    ``tokens``: ``sample_id, side, path, duration, tokens``; ``targets``: ``sample_id, language, word_index, word``. A target
    whose sample has no tokens at all stays with a null side.
    """
    window = F.when(F.col("tokens").isNotNull(), target_window(F.col("tokens"), F.col("word"), F.col("language")))
    return targets.join(tokens, "sample_id", "left").withColumn("_w", window).select(
        "sample_id", "side", "path", "duration", "language", "word_index", "word",
        F.col("_w.start").alias("start"), F.col("_w.end").alias("end"),
        F.col("_w.matched_text").alias("matched_text"),
        F.col("_w").isNotNull().alias("found"),
    )


def window_prominence(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """Prominence of every found window; ``frames`` has ``path, t, rms, f0``."""
    first, last = clip_window(F.col("start"), F.col("end"), F.col("duration"))
    found = windows.where("found").withColumns({"start": first, "end": last})
    clips = clip_statistics(frames, ["path"]).select(
        "path", F.col("mean_rms").alias("clip_rms"), F.col("median_f0").alias("clip_f0"))
    id_cols = ["sample_id", "side", "word_index"]
    inside = binned_range_join(frames, found.select(*id_cols, "path", "start", "end"), "path", "t", "start", "end",
                               BIN_SECONDS)
    segments = clip_statistics(inside, id_cols).select(
        *id_cols, F.col("mean_rms").alias("segment_rms"), F.col("median_f0").alias("segment_f0"))
    scored = found.join(segments, id_cols, "left").join(clips, "path", "left").withColumn("_p", prominence(
        F.col("segment_rms"), F.col("clip_rms"), F.col("segment_f0"), F.col("clip_f0"),
        F.col("end") - F.col("start"), F.col("duration")))
    return scored.select(
        *id_cols, F.col("_p.score").alias("score"), F.col("_p.energy_score").alias("energy_score"),
        F.col("_p.f0_score").alias("f0_score"), F.col("_p.duration_score").alias("duration_score"))


def word_verdicts(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per target word: found on both sides, prominence change, passed."""
    joined = windows.join(scores, ["sample_id", "side", "word_index"], "left")  # a null side has no score
    source, output = F.col("side") == "source", F.col("side") == "output"
    per_word = joined.groupBy("sample_id", "word_index").agg(
        F.max("word").alias("word"),
        F.coalesce(F.bool_or(F.when(source, F.col("found"))), F.lit(False)).alias("input_found"),
        F.coalesce(F.bool_or(F.when(output, F.col("found"))), F.lit(False)).alias("output_found"),
        F.max(F.when(source, F.col("score"))).alias("_in"),
        F.max(F.when(output, F.col("score"))).alias("_out"),
    )
    both = F.col("input_found") & F.col("output_found")
    delta = F.when(both, F.col("_out") - F.col("_in"))
    return per_word.select(
        "sample_id", "word_index", "word", "input_found", "output_found",
        F.round("_in", 4).alias("input_prominence"), F.round("_out", 4).alias("output_prominence"),
        F.round(delta, 4).alias("prominence_delta"),
        F.coalesce(delta > fv.PROMINENCE_GAIN_MIN, F.lit(False)).alias("passed"),
        F.when(~both, "target_not_found_in_timestamp_asr").alias("error"),
    )


def stress_verdicts(tokens: DataFrame, targets: DataFrame, frames: DataFrame) -> DataFrame:
    """Word verdicts from tokens, target words and frames; every target has its row, spoken or not.

    The windows are written once: frames are looked up in them and verdicts go over all of them, so they would be searched for
    again by each.
    """
    windows = stage(word_windows(tokens, targets), "windows")
    return word_verdicts(windows, window_prominence(windows, frames))


def stress_rollup(verdicts: DataFrame) -> DataFrame:
    """Per sample: words, passed words, share passed, all found, and the verdict (all found and all passed)."""
    per_sample = verdicts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("stress_words_total"),
        F.count_if(F.col("passed")).alias("stress_words_passed"),
        F.every(F.col("input_found") & F.col("output_found")).alias("target_found_all"),
    )
    complete = F.col("stress_words_passed") == F.col("stress_words_total")
    return per_sample.withColumns({
        "rpg": F.round(F.col("stress_words_passed") / F.col("stress_words_total"), 4),
        "passed": F.col("target_found_all") & complete,
    })
