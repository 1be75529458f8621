"""Inputs that the driver tables do not have: NaN scores, odd paths, ids that look like numbers, missing rows."""

import math

import pytest
from pyspark.sql import functions as F

from voxgauge.functions import acoustic, prosody, timing
from voxgauge.operators import digest, rollup, similarity, stress
from voxgauge.sources import files, history, samples

NAN = float("nan")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


@pytest.mark.parametrize("value", [NAN, None])
def test_nan_never_passes(spark, value):
    x, want = F.col("x"), None if value is None else False
    assert one(spark, similarity.speaker_target(x), x=value) is want
    assert one(spark, similarity.speaker_preserved(x), x=value) is want
    assert one(spark, acoustic.enhancement_verdict(x, F.lit(1.0)), x=value) is want
    assert one(spark, acoustic.enhancement_verdict(F.lit(1.0), x), x=value) is want
    assert one(spark, acoustic.reverb_verdict(x, F.array(F.lit(0.1), F.lit(0.5))), x=value) is want
    if value is not None:
        assert one(spark, acoustic.scene_verdict(F.lit("crowd"), F.lit("crowd"), x, F.lit(0.0)), x=value) is False
        assert one(spark, acoustic.scene_verdict(F.lit("crowd"), F.lit("crowd"), F.lit(0.9), x), x=value) is False
    for way in ("faster", "slower"):
        assert not one(spark, prosody.speed_verdict(F.lit(1.0), x, F.lit(way)), x=value).passed
    for way in ("higher", "lower"):
        got = one(spark, prosody.pitch_verdict(F.lit(100.0), x, F.lit(way)), x=value)
        assert not got.passed and got.error == "unable to compute voiced F0 median"


def test_means_leave_out_nan_and_round_at_the_end(spark):
    rows = [("a", 0.00004), ("a", 0.00004), ("a", NAN), ("a", None), ("a", math.inf), ("b", NAN)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.key: r.m for r in rollup.summarise(df, {"g": F.col("g")}, {"m": rollup.mean(F.col("v") * 1.5)}).collect()}
    assert got == {"all": 0.0001, "a": 0.0001, "b": None}


def test_run_status_keeps_tasks_outside_the_registry(spark):
    rows = [("r", "new_task", "error", "v1.1", 0), ("r", "style_editing", "ok", None, 0), ("s", "new_task", "ok", "v2", 0)]
    df = spark.createDataFrame(rows, "run_id string, task string, status string, dataset_version string, validation_count int")
    got = {r.run_id: r for r in digest.run_status(df).collect()}
    assert got["r"].failed_status_tasks == {"new_task": "error"} and got["r"].status == "failed"
    assert got["r"].dataset_versions == {"new_task": "v1.1"} and got["s"].dataset_versions == {"new_task": "v2"}


@pytest.mark.parametrize("path, root, rank", [
    ("hdfs://nn:8020/out/m/a.wav", "/out/m", 0), ("hdfs://nn:8020/out/m/audio/a.wav", "hdfs://nn:8020/out/m/", 1),
    ("file:/out/m+1/a.wav", "/out/m+1", 0), ("file:///out/m%201/a.wav", "/out/m 1", 0), ("/out/m/x/a.wav", "/out/m", None),
    ("/out/mm/a.wav", "/out/m", None), ("s3a://bucket/out/m/a.wav", "s3a://bucket/out/m", 0), ("out/m/a.wav", "out/m", 0),
])
def test_folder_rank(spark, path, root, rank):
    assert spark.range(1).select(files.folder_rank(F.lit(path), root).alias("r")).first().r == rank


def test_outputs_of_a_folder_with_signs_in_its_name(spark, tmp_path):
    root = tmp_path / "m+1 (a)"
    (root / "audio").mkdir(parents=True)
    for name in ("x.wav", "audio/y.flac", "audio/z.txt"):
        (root / name).write_bytes(b"x")
    got = {(r.sample_id, r.dir_rank) for r in files.list_outputs(spark, str(root)).collect()}
    assert got == {("x", 0), ("y", 1)}


def test_task_of_is_relative_to_the_root(spark):
    def task(path, *root):
        return spark.range(1).select(files.task_of(F.lit(path), *root).alias("r")).first().r

    assert task("/mnt/audio/data/t1/audio/x.wav", "/mnt/audio/data") == "t1"
    assert task("file:/mnt/audio/data/t1/samples.jsonl") == "t1"
    assert task("/mnt/audio/data/t1/audio/x.wav") == "t1"


def test_bad_lines_are_no_samples(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"sample_id": "s1"}\n{bad\n\n[{"sample_id": "x"}]\n123\n')
    assert [r.sample_id for r in samples.load_samples(spark, str(tmp_path / "s.jsonl")).collect()] == ["s1"]


def test_history_keeps_ids_as_text(spark, tmp_path):
    path = str(tmp_path / "h")
    for run in ("0001", "0002"):
        row = spark.createDataFrame([("007", "1e3", "2024", run, 1.5)], "model_name string, task_id string, eval_set string, run_id string, v double")
        history.append_run(row, path)
    runs = history.read_runs(spark, path)
    assert sorted((r.model_name, r.task_id, r.eval_set, r.run_id) for r in runs.collect()) == [
        ("007", "1e3", "2024", "0001"), ("007", "1e3", "2024", "0002")]
    assert [r.run_id for r in history.latest_runs(runs).collect()] == ["0002"]


def test_wide_blanks_and_odd_timestamps(spark):
    text = F.lit("你好　世界")
    spans = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))
    got = spark.range(1).select(timing.parse_spaced_text(text, spans).alias("t")).first().t
    assert [t.text for t in got] == ["你好", "世界"]
    three = F.array(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)))
    got = spark.range(1).select(timing.parse_spaced_text(text, three).alias("t")).first().t
    assert [t.text for t in got] == ["世界"]


def test_stress_words_without_tokens_stay(spark):
    token = "array<struct<text: string, normalized: string, start: double, end: double>>"
    tokens = spark.createDataFrame([("a", "source", "p", 1.0, [("hi", "hi", 0.0, 0.3)])], f"sample_id string, side string, path string, duration double, tokens {token}")
    targets = spark.createDataFrame([("a", "en", 0, "hi"), ("b", "en", 0, "word")], "sample_id string, language string, word_index int, word string")
    frames = spark.createDataFrame([("p", 0.1, 0.5, 100.0)], "path string, t double, rms double, f0 double")
    got = {r.sample_id: r for r in stress.stress_verdicts(tokens, targets, frames).collect()}
    assert got["a"].input_found and not got["a"].output_found
    assert not got["b"].input_found and got["b"].error == "target_not_found_in_timestamp_asr"
    assert {r.sample_id: r.passed for r in stress.stress_rollup(stress.stress_verdicts(tokens, targets, frames)).collect()} == {"a": False, "b": False}


def test_groups_without_a_name_are_groups(spark):
    from voxgauge.operators import ranks
    from voxgauge.plans import audit

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 5.0)], "g string, v double")
    assert {r.g: (r.n, r.median) for r in ranks.distribution(df, ["g"], "v").collect()} == {None: (2, 2.0), "g": (1, 5.0)}
    rows = spark.createDataFrame(
        [(None, "s1", "a.wav", "x"), (None, "s1", "b.wav", "x"), ("t", "s2", "a.wav", "y")],
        "task string, sample_id string, audio_path string, instruction string").withColumns({
            "transcript": F.lit("x"), "language": F.lit("en"), "source_dataset": F.lit("d"),
            "anchor": F.lit('{"event": "sigh"}'), "duration": F.lit(1.0)})
    rows = audit.with_audio_found(rows, spark.createDataFrame([("a.wav",)], "path string"))
    got = {r.task: r for r in audit.task_audit(rows).collect()}
    assert set(got) == {None, "t"}
    assert (got[None].samples, got[None].missing_audio_count, got[None].duplicate_sample_id_count) == (2, 1, 1)
    totals = {(r.total, r.task): r for r in audit.totals(rows).collect()}
    everything = totals[True, None]
    assert (everything.samples, everything.tasks, everything.missing_audio_count, everything.duplicate_sample_id_count) == (3, 2, 1, 1)
    assert totals[False, None].samples == 2
    assert {r.task for r in audit.label_histograms(rows, "task", "anchor").collect()} == {None, "t"}


def _files(spark, tmp_path, *batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_over_several_batches_and_a_replay(spark, tmp_path):
    import shutil

    from voxgauge.streaming import incremental as inc

    stream = _files(spark, tmp_path, [("a", 1.0), ("b", 2.0)], [("a", 3.0)], [("c", 4.0), ("b", NAN)])
    dims, measures = {"k": F.col("k")}, {"n": rollup.count_if(F.lit(True)), "m": rollup.mean(F.col("v"))}
    parts, state = str(tmp_path / "parts"), tmp_path / "state"
    inc.stream_partial_sums(stream, dims, measures, parts, str(state)).awaitTermination()
    want = {"all": (5, 2.5), "a": (2, 2.0), "b": (2, 2.0), "c": (1, 4.0)}
    summary = lambda: {r.key: (r.n, r.m) for r in inc.running_summary(spark, parts, dims, measures).collect()}
    assert summary() == want and spark.read.parquet(parts).select("batch").distinct().count() == 3
    for old in (state / "commits").glob("*2*"):  # as if the job had died before it noted the last batch
        old.unlink()
    shutil.copytree(state, tmp_path / "again")
    inc.stream_partial_sums(stream, dims, measures, parts, str(tmp_path / "again")).awaitTermination()
    assert summary() == want


def test_first_seen_keys_come_once_however_late(spark, tmp_path):
    from voxgauge.streaming import incremental as inc

    stream = _files(spark, tmp_path, [("a", 1.0), ("a", 1.0)], [("a", 2.0), ("b", 0.0)], [("b", 0.0), ("c", 0.0)])
    inc.stream_first_seen(stream, ["k"], str(tmp_path / "seen"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.batch, r.k) for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_lookup_splits_a_key_by_its_count(spark):
    from voxgauge.operators.lookup import spread_lookup

    facts = spark.range(10_000).select("id", F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.col("id")).alias("k"))
    reference = spark.createDataFrame([(1, "x"), (9, "y")], "k long, v string")
    got = spread_lookup(facts, reference, "k", "id", rows_per_task=1000)
    assert got.count() == 10_000 and got.where("v = 'x'").count() == 9_000 and got.where("v = 'y'").count() == 1


def test_repeated_keys_are_named(spark):
    from voxgauge.operators.match import require_one_row_per

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="k is not unique: 1"):
        require_one_row_per(df, "k")
    assert require_one_row_per(df.where("v <> 'b'"), "k").count() == 2


def test_stress_inputs_are_derived_once(spark):
    """Tokens and windows feed several branches: all read what was written, only the windows' own derivation reads turns."""
    from voxgauge.workload import signal_queries

    read = signal_queries._verdicts(spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "conversations" in f]
