import hashlib
import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from voxgauge.operators import match as mt
from voxgauge.sources import files, history, listing, samples


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def sample_line(i, **extra):
    return json.dumps({"sample_id": f"s{i}", "language": "en", "audio_path": f"data/t/audio/{i}.wav", **extra})


def test_load_and_validate_samples(spark, tmp_path):
    write(tmp_path / "s.jsonl", "\n".join([
        sample_line(1, anchor={"rt60_target_range": [0.5, 1.0], "stress_words": ["a", "b"]}), "", "   ",
        "{bad", "[1, 2]", '[{"sample_id": "x"}]', "123", sample_line(2)]))
    loaded = samples.load_samples(spark, str(tmp_path / "s.jsonl")).where("sample_id is not null")
    assert loaded.where("sample_id = 's1'").first().anchor.rt60_target_range == [0.5, 1.0]
    lines = samples.read_lines(spark, str(tmp_path / "s.jsonl"))
    assert sorted(r.sample_id for r in samples.valid_rows(lines).collect()) == ["s1", "s2"]
    errors = sorted(r.error.split(" is ")[1] for r in samples.line_errors(lines).collect())
    assert errors == ["not a JSON object"] * 3 + ["not valid JSON"]
    write(tmp_path / "empty.jsonl", "\n  \n")
    empty = samples.line_errors(samples.read_lines(spark, str(tmp_path / "empty.jsonl"))).collect()
    assert [r.error for r in empty] == ["samples_file contains no evaluable samples"]


def test_declared_paths_walk_every_value(spark):
    line = json.dumps({
        "audio_path": "data/a.wav", "anchor": {"reference_wav": "data/b.FLAC", "x": ["data/c.mp3", {"y": "data/d.aac"}]},
        "data/key.wav": "other", "note": 'say "data/quoted.wav" now', "back": "data/e\\f.ogg", "zh": "data/音频.m4a",
        "no": "xdata/g.wav", "txt": "data/h.txt", "long": "\\" * 30000 + '"'}, ensure_ascii=True)
    df = spark.createDataFrame([(line,), (sample_line(1),)], "line string").withColumn("task", F.lit("t"))
    got = {r.path for r in samples.declared_assets(df, "task").collect()}
    assert got == {"data/a.wav", "data/b.FLAC", "data/c.mp3", "data/d.aac", "data/e\\f.ogg", "data/音频.m4a",
                   "data/t/audio/1.wav"}


def test_allow_patterns_fall_back(spark):
    none = spark.createDataFrame([], "path string")
    assert [r.pattern for r in samples.allow_patterns(none, none).collect()] == ["data/**"]
    some = spark.createDataFrame([("data/b",), ("data/a",), ("data/b",)], "path string")
    assert [r.pattern for r in samples.allow_patterns(some, none).collect()] == ["data/a", "data/b"]


def test_outputs_are_matched_by_folder_then_extension(spark, tmp_path):
    root = tmp_path / "out"
    for name in ["s1.mp3", "s1.wav", "audio/s2.wav", "s2.flac", "audio/s3.mp3", "deep/er/s4.wav", "s5.txt", "a.b.wav"]:
        write(root / name, "x")
    found = files.list_outputs(spark, str(root))
    best = mt.best_outputs(found, "sample_id", [F.col("dir_rank"), F.col("ext_rank")], ["path"])
    got = {r.sample_id: r.path.split("/out/")[1] for r in best.collect()}
    assert got == {"s1": "s1.wav", "s2": "s2.flac", "s3": "audio/s3.mp3", "a.b": "a.b.wav"}


def test_listing_by_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "my outputs+1"
    names = ["a.wav", "b c.wav", "audio/a%20b.flac", "d1/d2/d3/x.wav", "d1/d2/y.wav", "ü/z.mp3", ".hidden.wav", "_tmp/q.wav"]
    for i, name in enumerate(names):
        write(root / name, "x" * i)
    want = {(f"{root}/{name}", i) for i, name in enumerate(names[:6])}
    source = listing.register(spark)
    for path in (str(root), f"{root}/", f"file://{quote(str(root))}"):
        rows = spark.read.format(source).load(path)
        assert {(r.path, r.length) for r in rows.collect()} == want
    assert rows.where("modified > current_timestamp() - INTERVAL 1 HOUR").count() == len(want)
    assert rows.schema.simpleString() == "struct<path:string,length:bigint,modified:timestamp>"
    # every number of opened folders gives the same files, each of them once
    for wanted in (0, 1, 3, 100):
        monkeypatch.setattr(listing, "FOLDERS_WANTED", wanted)
        reader = listing.FolderReader(str(root))
        found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch["path"].to_pylist()]
        assert sorted(found) == sorted(path for path, _ in want)
    (tmp_path / "empty").mkdir()
    assert spark.read.format(source).load(str(tmp_path / "empty")).count() == 0
    assert not listing.is_mounted("s3a://bucket/x") and listing.is_mounted("out/a:b")
    with pytest.raises(FileNotFoundError):
        listing.FolderReader(str(tmp_path / "none")).partitions()


def test_digest_of_a_file_larger_than_a_block(tmp_path, monkeypatch):
    body = bytes(range(256)) * 41
    (tmp_path / "x").write_bytes(body)
    for block in (1, 255, 256, len(body), 1 << 20):
        monkeypatch.setattr(listing, "BLOCK_BYTES", block)
        assert listing.file_digest(str(tmp_path / "x")) == hashlib.sha256(body).hexdigest()


def test_manifest_of_a_release(spark, tmp_path):
    text = sample_line(1) + "\n\n" + sample_line(2) + "\n"
    write(tmp_path / "data/t1/samples.jsonl", text)
    write(tmp_path / "data/t2/samples.jsonl", sample_line(3))
    write(tmp_path / "data/t1/audio/a.wav", "12345")
    write(tmp_path / "data/t1/audio/sub/b.OGG", "123")
    write(tmp_path / "data/t1/audio/c.m4a", "1")
    write(tmp_path / "data/t1/other.wav", "1")
    got = {r.task_id: r for r in files.asset_manifest(spark, str(tmp_path / "data")).collect()}
    assert (got["t1"].samples, got["t1"].audio_files, got["t1"].audio_bytes) == (2, 2, 8)
    assert got["t1"].samples_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (got["t2"].samples, got["t2"].audio_files) == (1, 0)
    write(tmp_path / "m.json", json.dumps({"version": "v", "tasks": [{"task_id": "t1", "samples": 2}, {"task_id": "t2"}]}, indent=1))
    assert {r.task_id: r.samples for r in files.load_manifest(spark, str(tmp_path / "m.json")).collect()} == {"t1": 2, "t2": None}


def test_history_keeps_runs_and_finds_the_latest(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, n in (("20240101_000000", 3), ("20240102_000000", 2)):
        rows = spark.range(n).withColumn("task_id", F.when(F.col("id") == 2, "b").otherwise("a"))
        history.append_run(history.stamp(rows, model_name="m", eval_set="full", run_id=run, samples_file=None), path)
    runs = history.read_runs(spark, path)
    assert runs.count() == 5
    got = sorted((r.task_id, r.run_id, r.id) for r in history.latest_runs(runs).collect())
    assert got == [("a", "20240102_000000", 0), ("a", "20240102_000000", 1), ("b", "20240101_000000", 2)]


def test_path_resolution_order(spark):
    rows = spark.createDataFrame([(1, "/abs/x.wav"), (2, "a.wav"), (3, "b.wav"), (4, "c.wav"), (5, None)], "id int, path string")
    there = spark.createDataFrame([("repo/s/a.wav",), ("repo/a.wav",), ("repo/b.wav",)], "path string")
    got = {r.id: r.resolved for r in mt.resolve_paths(rows, "id", "path", there, ["repo/s", "repo"], "repo").collect()}
    assert got == {1: "/abs/x.wav", 2: "repo/s/a.wav", 3: "repo/b.wav", 4: "repo/c.wav", 5: None}


def test_components_inherit_and_override(spark):
    schema = ("sample_id string, audio_path string, instruction string, transcript string, language string, source_dataset string,"
              " subset string, benchmark_version string, duration_tag string, components array<struct<component_type:string,"
              " edit_type:string, anchor:struct<transcript_target:string, emotion_taxonomy:string>, reference_audio_path:string,"
              " source_dataset:string, emotion_taxonomy:string>>")
    df = spark.createDataFrame([("s", "a", "i", "t", None, "base", None, "v", None, [
        ("content", "content_editing", ("new text", "x"), None, None, ""),
        ("speaker", "speaker_editing", (None, None), "r.wav", "own", "tax")]), ("e", "a", "i", "t", "zh", None, None, "v", None, None)], schema)
    got = [(r.sample_id, r.parent_id, r.language, r.source_dataset, r.emotion_taxonomy, r.subset)
           for r in mt.materialise_components(df).orderBy("component_index").collect()]
    assert got == [("s::content", "s", "en", "base", "x", "compositional"), ("s::speaker", "s", "en", "own", "tax", "compositional")]
    texts = df.select("sample_id", mt.expected_transcript(F.col("components"), F.col("transcript")).alias("t")).collect()
    assert {r.sample_id: r.t for r in texts} == {"s": "new text", "e": "t"}
