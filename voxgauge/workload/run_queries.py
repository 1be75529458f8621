"""Response log, run history, sample files and streams on the driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions import labels as lb
from voxgauge.functions.naming import shown_with_rest
from voxgauge.operators import digest
from voxgauge.operators import responses as rs
from voxgauge.operators.rollup import count_if, finish_summary, mean, merge_partials, partial_sums, rate, summarise
from voxgauge.plans import report
from voxgauge.session import scratch_folder, table
from voxgauge.sources import files, history
from voxgauge.sources import samples as sm
from voxgauge.streaming import incremental as inc
from voxgauge.streaming import keyed, levels
from voxgauge.workload import duck_text as dt
from voxgauge.workload.standins import SAMPLES, duck, spark_table

# events are answers of a judge; some rows have no usable key, some answers are no JSON object
LOG = """
SELECT event_id, CAST(ts AS STRING) AS ts, CASE WHEN event_id % 19 = 0 THEN '  '
    ELSE concat(' ', event_type, '-', CAST(user_id AS STRING), ' ') END AS key,
  CASE WHEN event_id % 7 = 0 THEN '[1]' WHEN event_id % 11 = 0 THEN 'oops' ELSE props END AS obj, value
FROM {events}
"""


def last_response(spark, sf):
    """Last usable answer per key."""
    usable = rs.usable_responses(spark_table(spark, sf, LOG))
    return rs.last_per_key(usable, ["key"], ["ts", "event_id"], ["event_id", "obj", "value"])


def last_event(spark, sf):
    """Last event per user and type."""
    return rs.last_per_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"],
                           ["event_id", "value"])


ANSWERED = """
SELECT DISTINCT sha1(concat(event_type, chr(10), 'judge', chr(10), concat('out/', CAST(user_id AS STRING), '.wav'),
    chr(10), props)) AS key
FROM {events} WHERE value < 20
"""


def pending_requests(spark, sf):
    """Requests that the log has no answer for, one per request key."""
    events = table(spark, sf, "events")
    requests = events.select(
        "event_id", lb.request_key(
            F.col("event_type"), F.lit("judge"), F.concat(F.lit("out/"), F.col("user_id").cast("string"), F.lit(".wav")),
            F.col("props")).alias("key"))
    return rs.pending_requests(requests, spark_table(spark, sf, ANSWERED).select("key"))


def judge_requests(spark, sf):
    """Request texts of both judges and their keys, whole transcripts."""
    samples = spark_table(spark, sf, SAMPLES)
    taxonomy = lb.emotion_taxonomy(
        F.col("emotion_taxonomy"), F.col("anchor_taxonomy"), F.col("source_dataset"), F.col("language"))
    definition = F.concat(F.lit("speaking like "), F.col("target_style"))
    texts = samples.select(
        "sample_id", "language", "transcript", "audio_path",
        lb.style_judge_request(F.col("target_style"), definition, F.col("transcript"), F.col("language")).alias("style"),
        lb.emotion_judge_request(lb.allowed_emotions(taxonomy), F.col("transcript"), F.col("language")).alias("emotion"))
    return texts.select("sample_id", *[
        lb.request_key(F.lit(name), F.lit("m"), F.col("audio_path"), F.col(name)).alias(f"{name}_key")
        for name in ("style", "emotion")])


FILES = """
SELECT l_orderkey, l_linenumber, l_partkey, concat('/in/', CAST(l_partkey AS STRING), '.wav') AS path,
  CASE WHEN l_returnflag = 'R' THEN 'zh' ELSE 'en' END AS language,
  CAST(l_quantity AS BIGINT) AS size, l_suppkey * 1000 AS modified
FROM {lineitem}
"""
CACHED_QUANTITY = 25


def _keyed_files(spark, sf):
    files = spark_table(spark, sf, FILES)
    language = F.col("language")
    return files.withColumn("key", rs.cache_key(
        rs.timestamp_backend(language), language, F.col("path"), F.col("size"), F.col("modified")))


def cache_split(spark, sf):
    """Files with a cached result and files still to score, counted per language."""
    files = _keyed_files(spark, sf)
    cache = files.where(F.col("size") <= CACHED_QUANTITY).select("key").distinct()
    hits, misses = rs.split_by_cache(files, cache, "key")
    both = hits.withColumn("cached", F.lit(True)).unionByName(misses.withColumn("cached", F.lit(False)))
    return both.groupBy("language", "cached").agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("key").alias("keys"))


# orders are runs: customer = model, priority = task, status = evaluation set, date and number = run id
RUNS = """
SELECT concat('m', CAST(o_custkey AS STRING)) AS model_name, o_orderpriority AS task_id, o_orderstatus AS eval_set,
  concat(replace(substring(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '_', CAST(100000 + o_orderkey % 900000 AS STRING))
    AS run_id, o_orderkey, o_totalprice
FROM {orders}
"""


def latest_run(spark, sf):
    return history.latest_runs(spark_table(spark, sf, RUNS))


# events are detail rows of five tasks; error rows carry one of a few messages
DETAILS = """
SELECT event_id, event_type AS task, CASE WHEN value < 12 THEN concat(CASE WHEN user_id % 2 = 0 THEN ' ' ELSE '' END,
    'failure ', CAST(user_id % 9 AS STRING)) WHEN value < 14 THEN '' END AS error
FROM {events}
"""


def error_digest(spark, sf):
    return report.error_digest(spark_table(spark, sf, DETAILS), "event_id")


# orders per day and priority play one task of one run
RUN_TASKS = """
SELECT substring(CAST(o_orderdate AS STRING), 1, 7) AS run_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'content_editing' WHEN '2-HIGH' THEN 'speaker_editing'
    WHEN '3-MEDIUM' THEN 'prosody_editing' WHEN '5-LOW' THEN 'style_editing' ELSE 'a_task_outside_the_registry' END AS task,
  count(*) AS total, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS outputs_evaluated,
  count(*) - count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS missing_outputs,
  count(CASE WHEN o_totalprice > 490000 THEN 1 END) AS error_count
FROM {orders} GROUP BY 1, 2
"""
PREFLIGHT = """
SELECT DISTINCT substring(CAST(o_orderdate AS STRING), 1, 7) AS run_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'style_editing' ELSE 'a_task_outside_the_registry' END AS task FROM {orders}
WHERE o_totalprice > 499000
"""


def _task_rows(spark, sf, strict):
    overall = spark_table(spark, sf, RUN_TASKS)
    preflight = spark_table(spark, sf, PREFLIGHT).withColumn("errors", F.array(F.lit("missing scorer")))
    keyed = overall.withColumn("task", F.concat_ws("|", "run_id", "task")).drop("run_id")
    blocked = preflight.withColumn("task", F.concat_ws("|", "run_id", "task")).drop("run_id")
    rows = report.task_status(keyed, blocked, strict)
    return rows.select(
        F.split_part(F.col("task"), F.lit("|"), F.lit(1)).alias("run_id"),
        F.split_part(F.col("task"), F.lit("|"), F.lit(2)).alias("task"),
        "status", "validation_errors", "validation_count", F.lit(fv.DATASET_VERSION).alias("dataset_version"))


def task_status(spark, sf):
    return _task_rows(spark, sf, True).select(
        "run_id", "task", "status", F.array_join("validation_errors", "; ").alias("validation"))


def run_status(spark, sf):
    runs = digest.run_status(_task_rows(spark, sf, False))
    return runs.select(
        "run_id", "tasks", "ok_tasks", "status",
        F.array_join(F.map_keys("failed_status_tasks"), ",").alias("failed_tasks"),
        F.size("dataset_versions").cast("bigint").alias("versions"))


def selected_tasks(spark, sf):
    """Suppliers as a task registry: disabled ones are skipped with a reason."""
    registry = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("task"), (F.col("s_acctbal") > 0).alias("enabled"))
    return report.selected_tasks(registry).select("task", "skipped")


def selected_one(spark, sf):
    """One task asked for by name, and the whole registry with its disabled tasks."""
    registry = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("task"), (F.col("s_acctbal") > 0).alias("enabled"))
    one, everything = report.selected_tasks(registry, "7"), report.selected_tasks(registry, include_disabled=True)
    return one.withColumn("asked", F.lit("7")).unionByName(everything.withColumn("asked", F.lit("all"))).select(
        "asked", "task", "skipped")


MANIFEST_TASKS = """
SELECT source AS task_id, concat('data/', source, '/samples.jsonl') AS samples_jsonl, count(*) AS samples,
  count(DISTINCT n_chars) AS audio_files, sum(n_chars) AS audio_bytes
FROM {documents} GROUP BY source
"""


def manifest_scan(spark, sf):
    """A release manifest of the documents' sources, written as one JSON document and read back."""
    folder = scratch_folder(spark, "manifest")
    tasks = spark_table(spark, sf, MANIFEST_TASKS).agg(F.collect_list(F.struct("*")).alias("tasks"))  # a row per source
    tasks.select(F.lit("b").alias("benchmark"), F.lit("v1.1").alias("version"), "tasks").coalesce(1).write.json(folder)
    return files.load_manifest(spark, folder).select("task_id", "samples_jsonl", "samples", "audio_files", "audio_bytes")


def summary_sink(spark, sf):
    """A summary stamped with its run, appended to the history, read back as the latest."""
    folder = scratch_folder(spark, "summaries")
    dims, measures = _stream_parts()
    summary = summarise(table(spark, sf, "events"), dims, measures)
    for run_id in ("0001", "0002"):
        history.append_run(history.stamp(
            summary, dataset_version=fv.DATASET_VERSION, evaluator_version="1", model_name="007", task_id="style_editing",
            eval_set="2024", run_id=run_id), folder)
    return history.latest_runs(history.read_runs(spark, folder)).drop("task_id", "dataset_version", "evaluator_version")


GROUP_LISTS = "SELECT c_nationkey, c_mktsegment FROM {customer}"


def missing_shown(spark, sf):
    """Missing groups of a report line: the first four, then how many more."""
    groups = spark_table(spark, sf, GROUP_LISTS).distinct().groupBy("c_nationkey").agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("groups"))
    return groups.select("c_nationkey", shown_with_rest(F.col("groups"), fv.MISSING_GROUPS_SHOWN).alias("shown"))


# --- files ---------------------------------------------------------------------------------------------------------

JSON_LINES = """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '   ' WHEN event_id % 23 = 0 THEN concat('{{bad ', CAST(event_id AS STRING))
    WHEN event_id % 29 = 0 THEN concat('[{{"sample_id": ', CAST(event_id AS STRING), '}}]')
    WHEN event_id % 31 = 0 THEN CAST(event_id AS STRING)
    ELSE concat('{{"sample_id": "s', CAST(event_id AS STRING), '", "task": "', event_type, '", "language": "en", ',
      '"anchor": {{"direction": "faster", "rt60_target_range": [0.5, ', CAST(event_id % 5 AS STRING), ']}}}}') END AS line
FROM {events}
"""


def _written_lines(spark, sf):
    folder = scratch_folder(spark, "jsonl")
    spark_table(spark, sf, JSON_LINES).select(F.col("line").alias("value")).write.text(folder)
    return folder


def jsonl_scan(spark, sf):
    """Written sample lines, read back, checked and parsed."""
    lines = sm.read_lines(spark, _written_lines(spark, sf))
    return sm.valid_rows(lines).select(
        "sample_id", "task", "language", F.col("anchor.direction").alias("direction"),
        F.get("anchor.rt60_target_range", 1).alias("range_end"))


def line_errors(spark, sf):
    return sm.line_errors(sm.read_lines(spark, _written_lines(spark, sf)))


def line_status(spark, sf):
    """Line status straight from the table."""
    lines = spark_table(spark, sf, JSON_LINES).where(F.col("line").rlike(r"(?U)\S"))
    return lines.select("event_id", sm.line_status(F.col("line")).alias("status"))


def run_history(spark, sf):
    """Two appended runs, read back; the latest one with its metadata."""
    folder = scratch_folder(spark, "history")
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    for run_id, keep in (("20240101_000000", F.lit(True)), ("20240301_120000", F.col("c_acctbal") > 0)):
        stamped = history.stamp(
            rows.where(keep), dataset_version=fv.DATASET_VERSION, evaluator_version="1", model_name="m1",
            eval_set="full", samples_file="data/x/samples.jsonl", run_id=run_id
        ).withColumn("task_id", F.col("c_mktsegment"))
        history.append_run(stamped.drop("c_mktsegment"), folder)
    latest = history.latest_runs(history.read_runs(spark, folder))
    return latest.select("c_custkey", "c_acctbal", "task_id", "run_id", "dataset_version")


def response_log(spark, sf):
    """Responses appended as JSON lines in two parts and read back: last answer per key."""
    folder = scratch_folder(spark, "responses")
    log = spark_table(spark, sf, LOG).withColumns({
        "ts": F.concat_ws(".", "ts", F.lpad(F.col("event_id").cast("string"), 12, "0")),
        "caller_tag": F.lit("style"), "model": F.lit("judge"), "audio_path": F.lit("a.wav")})
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        history.append_responses(log.where(part).select("ts", "key", "caller_tag", "model", "audio_path", "obj"), folder)
    usable = rs.usable_responses(history.read_responses(spark, folder))
    return rs.last_per_key(usable, ["key"], ["ts"], ["obj"])


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark, sf, n_files=None):
    """The events as files of a growing folder; each trigger takes one, so there are as many batches as files."""
    folder = scratch_folder(spark, "arriving")
    events = table(spark, sf, "events")
    events.repartition(n_files or STREAM_FILES, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


STREAM_FILES = 3
COMPACTED_FILES = 5


def _stream_parts():
    dims = {"task": F.col("event_type"), "user": F.col("user_id")}
    measures = {
        "total": count_if(F.lit(True)),
        "target_success_rate": rate(F.when(F.col("user_id") % 7 != 0, F.col("value") > 30)),
        "avg_value": mean(F.col("value")),
    }
    return dims, measures


def _run_stream_summary(spark, sf):
    folder = scratch_folder(spark, "stream")
    dims, measures = _stream_parts()
    inc.stream_partial_sums(_stream(spark, sf), dims, measures, f"{folder}/parts", f"{folder}/state").awaitTermination()
    return inc.running_summary(spark, f"{folder}/parts", dims, measures)


def stream_compacted(spark, sf):
    """The running summary again, with partials that merge by twos while the stream runs."""
    folder = scratch_folder(spark, "stream")
    dims, measures = _stream_parts()
    levels.run_levels(
        _stream(spark, sf, COMPACTED_FILES), lambda b: partial_sums(b, dims, measures),
        lambda p: merge_partials(p, dims, measures), f"{folder}/parts", f"{folder}/state", fan=2).awaitTermination()
    return finish_summary(levels.live_partials(spark, f"{folder}/parts"), dims, measures)


def stream_progress(spark, sf):
    available = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"))
    return inc.progress(_run_stream_summary(spark, sf), available)


def stream_last_response(spark, sf):
    folder = scratch_folder(spark, "stream")
    keys, order, payload = ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]
    inc.stream_last_per_key(_stream(spark, sf), keys, order, ["ts", *payload], f"{folder}/parts",
                            f"{folder}/state").awaitTermination()
    return inc.merged_last_per_key(spark, f"{folder}/parts", keys, order, payload)


def stream_dedup(spark, sf):
    folder = scratch_folder(spark, "stream")
    inc.stream_first_seen(_stream(spark, sf), ["user_id", "event_type"], f"{folder}/seen",
                          f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/seen").select("user_id", "event_type")


ANSWER_FILES = 6
ANSWERS_LATE, ANSWERS_KEPT = timedelta(days=3), timedelta(hours=30)


def _arriving_answers(spark, sf):
    """The events in files of five days, written one after the other; each but the first also brings every third row of the
    days before again: some still in time, some too late, and rows of a file are in no order."""
    folder = scratch_folder(spark, "answers")
    events = table(spark, sf, "events").withColumn(
        "file", F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5), F.lit(ANSWER_FILES - 1)).cast("int"))
    for n in range(ANSWER_FILES):
        again = (F.col("file") == n - 1) & (F.col("event_id") % 3 == 0)
        arriving = events.where((F.col("file") == n) | again).drop("file")
        arriving.repartition(1, "event_id").sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(folder)
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_newest(spark, sf):
    """Changes of the newest event of each user and kind, batch by batch, with keys that are forgotten in between."""
    folder = scratch_folder(spark, "stream")
    keyed.stream_newest_answers(
        _arriving_answers(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], ["value"], ANSWERS_LATE, ANSWERS_KEPT,
        f"{folder}/changes", f"{folder}/state").awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    return changes.select(F.col("batch").cast("int").alias("batch"), "user_id", "event_type", "event_id", "value", "fresh")


def stream_details(spark, sf):
    """Details written batch by batch, read back, with the number of batches they came in."""
    folder = scratch_folder(spark, "stream")
    dims, measures = _stream_parts()
    evaluate = lambda b: b.select("event_id", "event_type", "user_id", "value", (F.col("value") > 30).alias("loud"))
    inc.stream_details(_stream(spark, sf), evaluate, dims, measures, folder, f"{folder}/state").awaitTermination()
    details = spark.read.parquet(f"{folder}/details")
    return details.groupBy("event_type", "loud").agg(
        F.count(F.lit(1)).alias("details"), F.countDistinct("batch").alias("batches"))


def cache_append(spark, sf):
    """A cache that grows in two appends with common keys; every key is there once."""
    folder = scratch_folder(spark, "cache")
    rows = table(spark, sf, "events").select(F.concat_ws("||", "event_type", "user_id").alias("key"), "event_type")
    for part in (F.col("event_type") != "click", F.lit(True)):
        rs.append_cache(rows.where(part), folder, "key")
    return spark.read.parquet(folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("keys"))


QUERIES = {
    "last_response": last_response,
    "last_event": last_event,
    "pending_requests": pending_requests,
    "judge_requests": judge_requests,
    "cache_split": cache_split,
    "latest_run": latest_run,
    "error_digest": error_digest,
    "task_status": task_status,
    "run_status": run_status,
    "selected_tasks": selected_tasks,
    "selected_one": selected_one,
    "manifest_scan": manifest_scan,
    "summary_sink": summary_sink,
    "missing_shown": missing_shown,
    "jsonl_scan": jsonl_scan,
    "line_errors": line_errors,
    "line_status": line_status,
    "run_history": run_history,
    "response_log": response_log,
    "stream_summary": _run_stream_summary,
    "stream_compacted": stream_compacted,
    "stream_progress": stream_progress,
    "stream_last_response": stream_last_response,
    "stream_dedup": stream_dedup,
    "stream_newest": stream_newest,
    "stream_details": stream_details,
    "cache_append": cache_append,
}

_USABLE = f"""u AS (SELECT *, trim(key) AS k FROM ({duck(LOG)}) WHERE trim(key) <> '' AND json_valid(obj)
    AND json_type(obj) = 'OBJECT')"""
_STATUS = """CASE WHEN NOT json_valid(line) THEN 'not valid JSON' WHEN json_type(line) = 'OBJECT' THEN 'ok'
    ELSE 'not a JSON object' END"""
_TASKS = f"""t AS ({duck(RUN_TASKS)}), p AS ({duck(PREFLIGHT)}),
r AS (SELECT coalesce(t.run_id, p.run_id) AS run_id, coalesce(t.task, p.task) AS task, t.total, t.outputs_evaluated,
    t.missing_outputs, t.error_count, p.run_id IS NOT NULL AS blocked
    FROM t FULL JOIN p ON p.run_id = t.run_id AND p.task = t.task)"""


def _style_text_sql() -> str:
    spoken = "coalesce(nullif(trim(transcript), ''), 'not available, judge the audio alone')"
    definition = "'speaking like ' || target_style"
    return f"""CASE WHEN language = 'zh' THEN '请判断这段语音在多大程度上呈现“' || target_style || '”风格（' || {definition}
    || '）。只看说话方式，不看话题。转写：' || {spoken} || '。只回答一个 JSON 对象，包含 target_style_score 0-4、target_style_success、dominant_style、style_scores、confidence、rationale。'
    ELSE 'Rate how strongly the recording is spoken in the style ''' || target_style || ''' (' || {definition}
    || '). Rate delivery only, never the topic. Transcript: ' || {spoken} || '. Answer with one JSON object holding target_style_score 0-4, target_style_success, dominant_style, style_scores, confidence and rationale.' END"""


def _emotion_text_sql() -> str:
    declared = "coalesce(nullif(emotion_taxonomy, ''), anchor_taxonomy)"
    options = f"""CASE WHEN {declared} IN ('iemocap_en', 'csemotions_zh') THEN {declared}
        WHEN source_dataset IN ('iemocap', 'libritts_test_clean') THEN 'iemocap_en'
        WHEN source_dataset IN ('csemotions', 'aishell3_test') THEN 'csemotions_zh'
        WHEN language = 'zh' THEN 'csemotions_zh' ELSE 'iemocap_en' END"""
    lists = " ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in fv.EMOTIONS_BY_TAXONOMY.items())
    names = f"CASE {options} {lists} END"
    return f"""CASE WHEN language = 'zh' THEN '请根据声音而非文字，给出录音的主要情感。转写：' || transcript || '。从中选一个：'
    || {names} || '。只回答一个 JSON 对象，包含 predicted_emotion、confidence、rationale。'
    ELSE 'Name the main emotion you hear in the recording, judging the voice and not the words. Transcript: ' || transcript
    || '. Choose one of: ' || {names} || '. Answer with one JSON object holding predicted_emotion, confidence and rationale.' END"""


_STREAM_SQL = dt.summary(
    "e", {"task": "event_type", "user": "user_id"},
    {"total": "count(*)", "target_success_rate": dt.rate("t"), "avg_value": dt.mean("value")})

ORACLES = {
    "last_response": f"""WITH {_USABLE} SELECT k AS key, event_id, obj, value FROM (SELECT *,
    row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM u) WHERE rn = 1""",
    "last_event": """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "pending_requests": """WITH r AS (SELECT event_id, value, sha1(event_type || chr(10) || 'judge' || chr(10) || 'out/'
    || user_id::VARCHAR || '.wav' || chr(10) || props) AS key FROM events)
SELECT event_id, key FROM r WHERE key NOT IN (SELECT key FROM r WHERE value < 20)""",
    "judge_requests": f"""SELECT sample_id,
    sha1('style' || chr(10) || 'm' || chr(10) || audio_path || chr(10) || ({_style_text_sql()})) AS style_key,
    sha1('emotion' || chr(10) || 'm' || chr(10) || audio_path || chr(10) || ({_emotion_text_sql()})) AS emotion_key
FROM ({duck(SAMPLES)})""",
    "cache_split": f"""WITH f AS (SELECT *, concat_ws('||', CASE WHEN language = 'zh' THEN 'paraformer_zh_timestamp'
    ELSE 'whisper_large_v3_word_timestamps' END, language, path, size::VARCHAR, modified::VARCHAR) AS k FROM ({duck(FILES)}))
SELECT language, k IN (SELECT k FROM f WHERE size <= {CACHED_QUANTITY}) AS cached, count(*) AS files,
    count(DISTINCT k) AS keys FROM f GROUP BY ALL""",
    "latest_run": f"""WITH r AS ({duck(RUNS)}) SELECT * FROM r WHERE run_id = (SELECT max(run_id) FROM r x
    WHERE x.model_name = r.model_name AND x.task_id = r.task_id AND x.eval_set = r.eval_set)""",
    "error_digest": f"""WITH e AS (SELECT task, trim(error) AS message, count(*) AS count, min(event_id) AS f
    FROM ({duck(DETAILS)}) WHERE coalesce(error, '') <> '' GROUP BY ALL)
SELECT task, rank, message, count FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY count DESC, f, message)::INT
    AS rank FROM e) WHERE rank <= 3""",
    "task_status": f"""WITH {_TASKS} SELECT run_id, task, CASE WHEN blocked THEN 'preflight_error' ELSE 'ok' END AS status,
    CASE WHEN blocked THEN '' ELSE concat_ws('; ',
        CASE WHEN total > 0 AND outputs_evaluated = 0 THEN 'no model outputs were evaluated' END,
        CASE WHEN missing_outputs > 0 THEN 'missing model outputs: ' || missing_outputs::VARCHAR END,
        CASE WHEN error_count > 0 THEN 'sample-level evaluation errors: ' || error_count::VARCHAR END) END AS validation
FROM r""",
    "run_status": f"""WITH {_TASKS}, s AS (SELECT *, NOT blocked AND total > 0 AND outputs_evaluated = 0 AS invalid FROM r)
SELECT run_id, count(*) AS tasks, count(*) FILTER (WHERE NOT blocked) AS ok_tasks,
    CASE WHEN bool_or(blocked OR invalid) THEN 'failed' ELSE 'ok' END AS status,
    coalesce(string_agg(task, ',' ORDER BY task) FILTER (WHERE blocked), '') AS failed_tasks, count(*) AS versions
FROM s GROUP BY 1""",
    "selected_tasks": """SELECT s_suppkey::VARCHAR AS task,
    CASE WHEN s_acctbal > 0 THEN NULL ELSE 'disabled in registry' END AS skipped FROM supplier""",
    "selected_one": """SELECT '7' AS asked, s_suppkey::VARCHAR AS task, NULL::VARCHAR AS skipped FROM supplier WHERE s_suppkey = 7
UNION ALL SELECT 'all', s_suppkey::VARCHAR, NULL FROM supplier""",
    "manifest_scan": duck(MANIFEST_TASKS),
    "summary_sink": f"""WITH e AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN value > 30 END AS t FROM events),
s AS ({_STREAM_SQL}) SELECT *, '007' AS model_name, '2024' AS eval_set, '0002' AS run_id FROM s""",
    "missing_shown": f"""WITH g AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS l FROM customer GROUP BY 1)
SELECT c_nationkey, array_to_string(l[1:4], ', ') || CASE WHEN len(l) > 4
    THEN ', ... (+' || (len(l) - 4)::VARCHAR || ' more)' ELSE '' END AS shown FROM g""",
    "jsonl_scan": f"""WITH l AS ({duck(JSON_LINES)}) SELECT json_extract_string(line, '$.sample_id') AS sample_id,
    json_extract_string(line, '$.task') AS task, json_extract_string(line, '$.language') AS language,
    json_extract_string(line, '$.anchor.direction') AS direction,
    json_extract_string(line, '$.anchor.rt60_target_range[1]')::DOUBLE AS range_end
FROM l WHERE trim(line) <> '' AND {_STATUS} = 'ok'""",
    "line_errors": f"""WITH l AS ({duck(JSON_LINES)}) SELECT 'samples_file line ' || sha1(line) || ' is ' || {_STATUS} AS error
FROM l WHERE trim(line) <> '' AND {_STATUS} <> 'ok'""",
    "line_status": f"SELECT event_id, {_STATUS} AS status FROM ({duck(JSON_LINES)}) WHERE trim(line) <> ''",
    "run_history": """WITH r AS (SELECT c_custkey, c_acctbal, c_mktsegment AS task_id, '20240101_000000' AS run_id FROM customer
    UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, '20240301_120000' FROM customer WHERE c_acctbal > 0)
SELECT *, 'v1.1' AS dataset_version FROM r WHERE run_id = (SELECT max(run_id) FROM r x WHERE x.task_id = r.task_id)""",
    "response_log": f"""WITH {_USABLE} SELECT k AS key, obj FROM (SELECT *,
    row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM u) WHERE rn = 1""",
    "stream_summary": "WITH e AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN value > 30 END AS t FROM events) " + _STREAM_SQL,
    "stream_compacted": "WITH e AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN value > 30 END AS t FROM events) " + _STREAM_SQL,
    "stream_progress": """SELECT count(*) AS processed_outputs, count(*) AS available_outputs, TRUE AS done FROM events""",
    "stream_last_response": """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_newest": f"""WITH e AS (SELECT *, least(datediff('day', DATE '2024-01-01', ts::DATE) // 5, {ANSWER_FILES - 1})::INT AS file FROM events),
f AS (SELECT * FROM e UNION ALL SELECT * REPLACE (file + 1 AS file) FROM e
    WHERE event_id % 3 = 0 AND file + 1 < {ANSWER_FILES}),
w AS (SELECT file, coalesce(max(max(epoch_ms(ts))) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - {int(ANSWERS_LATE.total_seconds() * 1000)}, 0) AS mark FROM f GROUP BY file),
b AS (SELECT user_id, event_type, file, mark, max(epoch_us(ts)) AS us, max({{'us': epoch_us(ts), 'id': event_id, 'value': value}}) AS best
    FROM f JOIN w USING (file) WHERE epoch_us(ts) > mark * 1000 GROUP BY ALL),
h AS (SELECT *, max(best) OVER p AS held, max(us) OVER p AS held_us FROM b
    WINDOW p AS (PARTITION BY user_id, event_type ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file AS batch, user_id, event_type, best.id AS event_id, best.value AS value,
    held IS NULL OR held_us // 1000 + {int(ANSWERS_KEPT.total_seconds() * 1000)} < mark AS fresh
FROM h WHERE held IS NULL OR (best.us, best.id) > (held.us, held.id)""",
    "stream_details": f"""SELECT event_type, value > 30 AS loud, count(*) AS details, {STREAM_FILES}::BIGINT AS batches
FROM events GROUP BY ALL""",
    "cache_append": "SELECT event_type, count(DISTINCT user_id) AS keys FROM events GROUP BY 1",
}
