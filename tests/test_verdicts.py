import math

from pyspark.sql import functions as F

from voxgauge.functions import acoustic as ac
from voxgauge.functions import labels as lb
from voxgauge.functions import naming as nm
from voxgauge.functions import prosody as pr
from voxgauge.functions import timing as tm
from voxgauge.functions.numeric import calibrate, clamp_half_even, nearest_rank, round4
from voxgauge import fixed_values as fv


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_emotion_labels(spark):
    assert column(spark, ["Fear", "frustration", "public broadcast", " Sad_ly ", None], "string", lb.emotion_label) == [
        "fearful", "frustrated", "public-broadcast", "sad-ly", ""]


def test_scores_clamp_half_even(spark):
    values = ["2.5", "3.5", "x", None, "9", "-1", "NaN", "Infinity", "3d", " 1 "]
    assert column(spark, values, "string", lambda c: clamp_half_even(c, 4)) == [2, 4, 0, 0, 4, 0, 0, 0, 0, 1]


def test_judge_json(spark):
    texts = ['{"a": 1}', 'so:\n```json\n{"a": 2}\n```', "```\n{\"a\": 3}\n```", "nothing", "", None, "```{bad```"]
    parsed = column(spark, texts, "string", lambda c: lb.field(lb.parse_judge_json(c), "a", "int"))
    assert parsed == [1, 2, 3, None, None, None, None]


def style(spark, answer, target="dramatic"):
    df = spark.createDataFrame([(answer, target)], "a string, t string")
    return tuple(df.select(lb.style_verdict(lb.parse_judge_json(F.col("a")), F.col("t")).alias("v")).first()["v"])


def test_style_verdict(spark):
    assert style(spark, '{"target_style_score": 2, "target_style_success": true}')[:2] == (2, False)
    assert style(spark, '{"target_style_score": 3}')[:2] == (3, True)
    assert style(spark, '{"target_style_score": 4, "target_style_success": false}')[:2] == (4, False)
    assert style(spark, '{"target_style_score": 4, "target_style_success": "Yes"}')[:2] == (4, True)
    assert style(spark, '{"target_style_score": 4, "target_style_success": null}')[:2] == (4, True)
    assert style(spark, '{"style_scores": {"dramatic": 3, "intimate": 3}}') == (3, True, "intimate")
    assert style(spark, '{"dominant_style": " Storytelling "}') == (0, False, "storytelling")
    assert style(spark, '{"target_style_score": null, "style_scores": {"dramatic": 4}}')[:2] == (0, False)


def test_event_verdict(spark):
    df = spark.createDataFrame(
        [("add", 2, True), ("add", 1, False), ("remove", 1, True), ("remove", 0, True), ("mute", 3, False)],
        "o string, s int, want boolean")
    assert all(r.got == r.want for r in df.select("want", lb.event_verdict(F.col("o"), F.col("s")).alias("got")).collect())


def test_seconds_per_value(spark):
    assert column(spark, [100.0, 101.0, 0.5, None], "double", tm.seconds) == [100.0, 0.101, 0.5, None]


def test_speed_and_pitch(spark):
    df = spark.createDataFrame([
        (1.0, 0.95, "faster", True), (1.0, 0.96, "faster", False), (1.0, 1.05, "SLOWER", True), (0.0, 1.0, "faster", None),
        (1.0, 1.0, "faster", False), (1.0, 1.0, "up", None)], "a double, b double, d string, want boolean")
    got = df.select("want", pr.speed_verdict(F.col("a"), F.col("b"), F.col("d")).alias("v")).collect()
    assert [r.v["passed"] for r in got] == [r.want for r in got]
    assert [r.v["error"] for r in got][3:] == ["input duration is zero", None, "unsupported speed direction: up"]
    df = spark.createDataFrame([(200.0, 204.0, "higher"), (200.0, 203.0, "higher"), (None, 1.0, "higher")],
                               "a double, b double, d string")
    got = [r[0] for r in df.select(pr.pitch_verdict(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert [(g["shift_semitone"], g["passed"]) for g in got] == [(0.3428, True), (0.2578, False), (None, None)]


def test_prominence(spark):
    df = spark.createDataFrame([(0.2, 0.1, 220.0, 200.0, 0.5, 5.0), (0.1, 0.1, 200.0, 200.0, 0.5, 5.0),
                                (None, 0.0, None, 200.0, 0.5, 5.0)], "a double, b double, c double, d double, e double, f double")
    got = [r[0]["score"] for r in df.select(pr.prominence(*[F.col(c) for c in "abcdef"])).collect()]
    assert [round(g, 4) for g in got[:2]] == [-0.0727, -0.4605]
    eps = 1e-8
    want = 0.5 * math.log(eps / (eps + eps) + eps) + 0.2 * math.log(0.1 + eps)
    assert abs(got[2] - want) < 1e-12


def test_calibration(spark):
    got = [column(spark, [3.0], "double", lambda c, k=k: F.round(calibrate(c, fv.CALIBRATION[k]), 4))[0]
           for k in ("sig", "bak", "ovr")]
    assert got == [2.912, 3.2464, 2.7835]


def test_nearest_rank_index(spark):
    df = spark.createDataFrame([(10, 0.05, 0), (10, 0.95, 9), (11, 0.05, 0), (31, 0.05, 2), (1, 0.95, 0)], "n long, p double, want int")
    for r in df.collect():
        got = df.where(F.col("n") == r.n).where(F.col("p") == r.p).select(nearest_rank(F.col("n"), r.p)).first()[0]
        assert got == r.want


def test_reverb_and_round4(spark):
    got = column(spark, [0.4, 1.2, 1.21, None], "double", lambda c: ac.reverb_verdict(c, F.array(F.lit(0.5), F.lit(1.0))))
    assert got == [True, True, False, None]
    assert column(spark, [1.23456, float("nan"), float("inf"), None], "double", round4) == [1.2346, None, None, None]


def test_token_windows(spark):
    tokens = [{"text": t, "normalized": n, "start": i * 1.0, "end": i + 0.5}
              for i, (t, n) in enumerate([("The", "the"), ("don't", "don't"), ("go", "go"), ("go", "go")])]
    schema = "k array<struct<text:string,normalized:string,start:double,end:double>>, w string, l string"
    zh = [{"text": c, "normalized": c, "start": i * 1.0, "end": i + 1.0} for i, c in enumerate(["今天", "天", "", "气好"])]
    df = spark.createDataFrame([
        (tokens, "Don't GO", "en"), (tokens, "go go go", "en"), (tokens, "!!", "en"), (tokens, "go", "en"),
        (zh, "天天气", "zh"), (zh, "好天", "zh"), (zh, "？", "zh"), ([], "go", "en")], schema)
    got = [r[0] and tuple(r[0]) for r in df.select(tm.target_window(F.col("k"), F.col("w"), F.col("l"))).collect()]
    assert got == [(1.0, 2.5, "don't go"), None, None, (2.0, 2.5, "go"), (0.0, 4.0, "今天 天 气好"), None, None, None]


def test_names(spark):
    assert column(spark, [" My Model-v2! ", "***", "模型"], "string", nm.slug) == ["my_model_v2", "default", "default"]
    assert column(spark, ["x/model_output/A b/c", "x/y/Model_Output", "model_output"], "string", nm.model_name) == [
        "a_b", "model_output", "model_output"]
    assert column(spark, ["data/a/s.jsonl", "/data/a", "data_v2_13/x", "cache/x", None], "string", nm.dataset_version) == [
        "v1.1", "custom", "vv2.13", "custom", "unknown"]
    lists = spark.createDataFrame([(list("abcdef"),), (["a"],), ([],)], "v array<string>")
    assert [r[0] for r in lists.select(nm.shown_with_rest(F.col("v"), 4)).collect()] == [
        "a, b, c, d, ... (+2 more)", "a", "-"]
