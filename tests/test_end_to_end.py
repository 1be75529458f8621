"""One task from files to summary and run report."""

import json

from pyspark.sql import functions as F

from voxgauge.operators.match import match_outputs
from voxgauge.plans import all_tasks, report, stats, tasks
from voxgauge.sources import files, samples


def test_prosody_from_files(spark, tmp_path):
    rows = [
        {"sample_id": f"s{i}", "language": "en", "source_dataset": "d", "transcript": "say it now please",
         "anchor": {"prosody_type": kind, "direction": way}}
        for i, (kind, way) in enumerate([("speed", "faster"), ("speed", "slower"), ("pitch", "higher"), ("tempo", "up"),
                                         ("speed", "faster")])]
    (tmp_path / "samples.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "out/audio").mkdir(parents=True)
    for name in ("s0.wav", "s1.mp3", "audio/s2.flac", "s3.wav"):
        (tmp_path / "out" / name).write_text("x")
    loaded = samples.flatten_anchor(samples.load_samples(spark, str(tmp_path / "samples.jsonl")))
    matched = match_outputs(loaded, files.list_outputs(spark, str(tmp_path / "out")), "sample_id",
                            [F.col("dir_rank"), F.col("ext_rank")], ["path"])
    scores = spark.createDataFrame([
        ("s0", "say it now please", 2.0, 1.5, None, None, 3.0), ("s1", "say it please", 2.0, 2.5, None, None, 4.0),
        ("s2", None, 2.0, 2.0, 100.0, 110.0, None), ("s3", "say it now please", 2.0, 2.0, None, None, None)],
        "sample_id string, transcript_predicted string, input_duration double, output_duration double, input_f0 double,"
        " output_f0 double, utmos double").withColumns({
            "stress_passed": F.lit(None).cast("boolean"), "rpg": F.lit(None).cast("double"),
            "source_output_speaker_similarity": F.lit(None).cast("double")})
    scored = tasks.prosody_verdicts(matched.join(scores, "sample_id", "left"))
    got = {r.sample_id: r for r in scored.collect()}
    assert (got["s0"].target_success, got["s0"].joint_success) == (True, True)
    assert (got["s1"].target_success, got["s1"].content_preservation_pass, got["s1"].joint_success) == (True, False, False)
    assert (got["s2"].passed, got["s2"].target_success, got["s2"].error) == (True, None, tasks.NO_TRANSCRIPT)
    assert got["s3"].error == "unknown prosody_type: tempo" and got["s3"].joint_success is None
    assert not got["s4"].has_output and got["s4"].error is None
    overall = stats.prosody_summary(scored).where("dim = 'overall'").first()
    assert (overall.total, overall.outputs_evaluated, overall.missing_outputs, overall.coverage) == (5, 4, 1, 0.8)
    assert (overall.evaluated, overall.pass_rate, overall.target_success_rate, overall.error_count) == (2, 0.5, 1.0, 2)
    assert overall.avg_utmos == 3.5
    verdicts = all_tasks.common_verdicts({"prosody_editing": scored})
    rows = all_tasks.overall_rows(all_tasks.all_tasks_summary(verdicts))
    none = spark.createDataFrame([], "task string, errors array<string>")
    status = report.task_status(rows, none, strict=True).first()
    assert status.validation_errors == ["missing model outputs: 1", "sample-level evaluation errors: 2"]
