"""Signals in long form ``(clip, idx, x)``: running energy, framed RMS, decay time, segments, clip statistics.

Prefix sums and frames work on blocks of neighbouring samples, so one very long clip is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions.acoustic import decay_time
from voxgauge.functions.numeric import calibrate
from voxgauge.operators.ranks import exact_median

BLOCK = 65_536


def explode_signal(rows: DataFrame, key: Sequence[str], samples: str) -> DataFrame:
    """Long form of an array signal."""
    return rows.select(*key, F.posexplode(samples).alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


def _with_clip_value(signal: DataFrame, key: str, idx: str, part: Column, whole: Column, block: int) -> DataFrame:
    """Signal with one value per clip, ``_clip``, found from one partial value per block (``part``, then ``whole`` of
    ``_part`` over the blocks). It travels back on ``(key, block)``, so a very long clip does not meet in one task."""
    blocked = signal.withColumn("_blk", F.floor(F.col(idx) / block))
    parts = blocked.groupBy(key, "_blk").agg(part.alias("_part"))
    clip = parts.select(key, "_blk", whole.over(Window.partitionBy(key)).alias("_clip"))
    return blocked.join(clip, [key, "_blk"]).drop("_blk")


def backward_sum(signal: DataFrame, key: str, idx: str, value: str, out: str, block: int = BLOCK,
                 total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` from this position to the end of the clip, and ``total`` over the clip.

    Block totals are summed first; the ordered part of a window is one block, whatever the length of the clip.
    """
    blocked = signal.withColumn("_blk", F.floor(F.col(idx) / block))
    totals = blocked.groupBy(key, "_blk").agg(F.sum(value).alias("_sum"))
    later = Window.partitionBy(key).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_sum").over(Window.partitionBy(key)).alias(total)] if total else []
    offsets = totals.select(
        key, "_blk", F.coalesce(F.sum("_sum").over(later), F.lit(0.0)).alias("_offset"), *extra)
    within = Window.partitionBy(key, "_blk").orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_run", F.sum(value).over(within))
        .join(offsets, [key, "_blk"])
        .withColumn(out, F.col("_run") + F.col("_offset"))
        .drop("_run", "_offset", "_blk")
    )


def peak_tail(signal: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Samples from the first largest absolute value on, with ``tail_idx`` counted from there.

    ``signal`` has ``key, idx, x``.
    """
    loudest = F.max(F.struct(F.abs("x").alias("a"), (-F.col("idx")).alias("i")))
    peaked = _with_clip_value(signal, key, "idx", loudest, F.max("_part"), block)
    at = -F.col("_clip.i")
    return peaked.where(F.col("idx") >= at).withColumn("tail_idx", F.col("idx") - at).drop("_clip")


def decay_times(signal: DataFrame, key: str, sample_rate: int, block: int = BLOCK) -> DataFrame:
    """Decay time per impulse response: columns ``key, tail_samples, decay_seconds, error``.

    Backward energy in dB against its maximum (the energy of the whole tail), a line fitted over -5..-25 dB, or
    -3..-15 dB when that range is too short; 0.03 s when no range will do or the level hardly falls.
    """
    tail = peak_tail(signal, key, block).withColumn("_e", F.col("x") * F.col("x"))
    energy = backward_sum(tail, key, "tail_idx", "_e", "_energy", block, "_top")
    db = F.when(F.col("_top") > 0, F.lit(10.0) * F.log10(
        F.greatest("_energy", F.lit(1e-12)) / F.col("_top")))
    leveled = energy.select(
        key, "_top", (F.col("tail_idx") / F.lit(float(sample_rate))).alias("_t"), db.alias("_db"))
    wide = F.col("_db").between(-25.0, -5.0)
    narrow = F.col("_db").between(-15.0, -3.0)
    fits = leveled.groupBy(key).agg(
        F.count(F.lit(1)).alias("tail_samples"),
        F.max("_top").alias("_top"),
        F.count_if(wide).alias("_n_wide"),
        F.regr_slope(F.when(wide, F.col("_db")), F.when(wide, F.col("_t"))).alias("_s_wide"),
        F.count_if(narrow).alias("_n_narrow"),
        F.regr_slope(F.when(narrow, F.col("_db")), F.when(narrow, F.col("_t"))).alias("_s_narrow"),
    )
    rate = F.lit(float(sample_rate))
    error = F.when(
        F.col("tail_samples") < F.floor(F.lit(0.05) * rate), fv.DECAY_ERRORS["short"]
    ).when(F.col("_top") <= 0, fv.DECAY_ERRORS["silent"])
    seconds = decay_time(F.col("_n_wide"), F.col("_s_wide"), F.col("_n_narrow"), F.col("_s_narrow"), rate)
    return fits.select(
        key, "tail_samples",
        F.when(error.isNull(), seconds).alias("decay_seconds"),
        error.alias("error"),
    )


def impulse_decay(responses: DataFrame, key: str, samples: str, sample_rate: int,
                  unchanged: Column | None = None) -> DataFrame:
    """``decay_times`` of impulse responses that are arrays in their rows: one vectorised pass, no shuffle.

    A response is some ten thousand values by protocol, so it stays in its row; ``decay_times`` is for signals of any
    length in long form. A response whose output is ``unchanged`` has the shortest decay time and no error.
    """
    rate, names = float(sample_rate), [key, "tail_samples", "decay_seconds", "error"]
    flag = F.coalesce(unchanged, F.lit(False)) if unchanged is not None else F.lit(False)
    rows = responses.select(F.col(key), F.col(samples).cast("array<double>").alias("_x"), flag.alias("_same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_decay(np.asarray(x.values, float) if x.is_valid else np.zeros(0), same.as_py(), rate)
                     for x, same in zip(batch.column(1), batch.column(2))]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = responses.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, tail_samples long, decay_seconds double, error string")


def _decay(x: np.ndarray, same: bool, rate: float) -> tuple[int, float | None, str | None]:
    """Tail length, decay time and error of one response; the rules of ``decay_times``."""
    tail = x[int(np.abs(x).argmax()):] if len(x) else x
    if same:
        return len(tail), fv.DECAY_FLOOR_SECONDS, None
    if len(tail) < math.floor(0.05 * rate):
        return len(tail), None, fv.DECAY_ERRORS["short"]
    energy = np.cumsum(tail[::-1] ** 2)[::-1]
    if not energy[0] > 0:
        return len(tail), None, fv.DECAY_ERRORS["silent"]
    level, t = 10 * np.log10(np.maximum(energy, 1e-12) / energy[0]), np.arange(len(tail)) / rate
    for high, low, least in ((-5.0, -25.0, 0.025), (-3.0, -15.0, 0.015)):
        inside = (level <= high) & (level >= low)
        if inside.sum() >= math.floor(least * rate):
            dt, dl = t[inside] - t[inside].mean(), level[inside] - level[inside].mean()
            slope = (dt * dl).sum() / (dt * dt).sum() if inside.sum() > 1 else -0.0
            seconds = fv.DECAY_FLOOR_SECONDS if slope >= -3.0 else min(
                max(-60.0 / slope, fv.DECAY_FLOOR_SECONDS), fv.DECAY_CEILING_SECONDS)
            return len(tail), float(seconds), None
    return len(tail), fv.DECAY_FLOOR_SECONDS, None


def mean_square_difference(source: Column, output: Column) -> Column:
    """Mean squared difference of two array signals over their common length; null if there is none."""
    n = F.least(F.size(source), F.size(output))
    pairs = F.zip_with(F.slice(source, F.lit(1), n), F.slice(output, F.lit(1), n), lambda a, b: (a - b) * (a - b))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / n)


def is_unchanged(mean_square: Column) -> Column:
    return mean_square <= fv.UNCHANGED_MEAN_SQUARE


def unchanged_pairs(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Per clip: mean squared difference of source and output over their common length, and whether it is ~0.

    An unchanged clip has the shortest decay time by definition.
    """
    both = source.select(key, "idx", F.col("x").alias("_s")).join(
        output.select(key, "idx", F.col("x").alias("_o")), [key, "idx"])
    diff = F.col("_s") - F.col("_o")
    return both.groupBy(key).agg(F.avg(diff * diff).alias("mean_square")).withColumn(
        "unchanged", is_unchanged(F.col("mean_square")))


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def framed_rms(signal: DataFrame, key: str, frame: int = fv.FRAME_LENGTH, hop: int = fv.FRAME_HOP,
               sample_rate: int = fv.SAMPLE_RATE) -> DataFrame:
    """Root mean square of centred frames: ``key, frame, t, rms``; positions outside the clip count as zero.

    Samples are first summed per block of ``gcd(hop, frame/2)`` positions (combined before the shuffle); frames are
    then made of whole blocks, so the rows that are repeated for overlapping frames are blocks, not samples.
    """
    half = frame // 2
    unit = _gcd(_gcd(hop, half), frame)
    per_hop, per_half, per_frame = hop // unit, half // unit, frame // unit
    blocks = (
        signal.groupBy(key, F.floor(F.col("idx") / unit).alias("_blk"))
        .agg(F.sum(F.col("x") * F.col("x")).alias("_e"), F.max("idx").alias("_last"))
    )
    # frame f covers blocks f*per_hop - per_half .. f*per_hop - per_half + per_frame - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("_blk") + per_half - per_frame + 1) / per_hop))
    last = F.floor((F.col("_blk") + per_half) / per_hop)
    sums = (
        blocks.where(last >= first)
        .select(key, "_e", "_last", F.explode(F.sequence(first, last)).alias("frame"))
        .groupBy(key, "frame").agg(F.sum("_e").alias("_e"), F.max("_last").alias("_last"))
    )
    # the last frame is centred at most one position behind the clip
    return (
        sums.where((F.col("frame") == 0) | (F.col("_last") >= F.col("frame") * hop - 1))
        .select(
            key, "frame",
            (F.col("frame") * hop / F.lit(float(sample_rate))).alias("t"),
            F.sqrt(F.col("_e") / float(frame)).alias("rms"))
    )


def _voiced(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (value > 0), value)


def track_statistics(frames: DataFrame, groups: Sequence[str], rms: str = "rms", f0: str = "f0") -> DataFrame:
    """Per clip (or window): frames, mean positive RMS, median positive F0, voiced ratio."""
    usable = frames.withColumns({"_rms": _voiced(F.col(rms)), "_f0": _voiced(F.col(f0))})
    plain = usable.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("_rms").alias("mean_rms"),
        (F.count("_f0") / F.count(F.lit(1))).alias("voiced_ratio"),
    )
    median = exact_median(usable, groups, "_f0", "median_f0").drop("n")
    return plain.join(median, list(groups), "left")


def clip_statistics(frames: DataFrame, groups: Sequence[str], rms: str = "rms", f0: str = "f0") -> DataFrame:
    """``track_statistics`` of groups that a clip bounds (a clip has some 60 frames a second): one aggregation.

    The built-in median holds a group's different values, so it is for clips and windows of clips, not for data sets.
    """
    energy, pitch = _voiced(F.col(rms)), _voiced(F.col(f0))
    return frames.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(energy).alias("mean_rms"), F.median(pitch).alias("median_f0"),
        (F.count(pitch) / F.count(F.lit(1))).alias("voiced_ratio"))


def segment_plan(clips: DataFrame, samples: str, sample_rate: int = fv.SAMPLE_RATE) -> DataFrame:
    """One row per scored window of a clip: ``…, segment, start, end`` in samples.

    Short clips are doubled until one window fits; windows start every second; a window that falls short of the
    full length is dropped. The number of hops truncates toward zero.
    """
    window = F.lit(int(fv.SEGMENT_SECONDS * sample_rate))
    n = F.col(samples)
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(window / n.cast("double"))).cast("int"))
    # log2 may be off by one step next to a power of two: settle it with whole numbers
    grown = F.call_function("shiftleft", n.cast("bigint"), doublings)
    length = F.when(grown < window, grown * 2).when(
        (doublings > 0) & (F.floor(grown / 2) >= window), F.floor(grown / 2)).otherwise(grown)
    rate = F.lit(float(sample_rate))
    hops = (F.floor(F.col("_len") / rate).cast("double") - fv.SEGMENT_SECONDS).cast("int") + 1
    start = F.col("segment") * F.lit(sample_rate)
    end = ((F.col("segment").cast("double") + fv.SEGMENT_SECONDS) * rate).cast("bigint")
    return (
        clips.where(n > 0).withColumn("_len", length).withColumn("_hops", hops)
        .where(F.col("_hops") > 0)
        .withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("_hops") - 1)))
        .withColumns({"start": start.cast("bigint"), "end": F.least(end, F.col("_len"))})
        .where(F.col("end") - F.col("start") >= window)
        .drop("_len", "_hops")
    )


def segment_means(segments: DataFrame, key: str) -> DataFrame:
    """Calibrated perceptual means per clip from raw segment scores ``sig_raw, bak_raw, ovr_raw, p808``."""
    def mean(column: Column, name: str) -> Column:
        return F.round(F.avg(column), 4).alias(name)

    return segments.groupBy(key).agg(
        F.count(F.lit(1)).alias("segments"),
        mean(calibrate(F.col("sig_raw"), fv.CALIBRATION["sig"]), "sig"),
        mean(calibrate(F.col("bak_raw"), fv.CALIBRATION["bak"]), "bak"),
        mean(calibrate(F.col("ovr_raw"), fv.CALIBRATION["ovr"]), "ovrl"),
        mean(F.col("p808"), "p808_mos"),
    )


def with_segment_errors(clips: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """Clips with their segment means; a clip without any segment carries an error."""
    return clips.join(means, key, "left").withColumn(
        "error", F.when(F.col("segments").isNull(), "unable to compute perceptual segments"))
