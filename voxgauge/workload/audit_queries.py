"""Audit and readiness on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgauge import fixed_values as fv
from voxgauge.functions import text as tx
from voxgauge.operators.ranks import MEDIAN_PICKS, distribution, exact_ranks, nearest_rank_pick
from voxgauge.plans import audit, readiness
from voxgauge.session import scratch_folder, table
from voxgauge.sources.files import manifest_rows, write_document
from voxgauge.sources.samples import allow_patterns, declared_assets
from voxgauge.workload import duck_text as dt
from voxgauge.workload.standins import duck, spark_table

# documents are samples of four tasks (their language); the anchor is JSON text, null for unlabelled documents
AUDIT_ROWS = """
SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.lang END AS task,
  CASE WHEN d.n_chars % 40 = 0 THEN NULL ELSE concat('s', CAST(d.n_chars AS STRING)) END AS sample_id,
  concat('data/', d.source, '/', CAST(d.n_chars % 100 AS STRING), '.wav') AS audio_path,
  CASE WHEN d.n_chars % 33 = 0 THEN '  ' ELSE concat(CASE d.n_chars % 9
    WHEN 0 THEN 'Speak slightly slower BEFORE "the end". ' WHEN 1 THEN 'Make it angry, not Happy: '
    WHEN 2 THEN 'You need to keep “the text. ' WHEN 3 THEN 'Add a sigh with "warm" and "cold" feel. '
    WHEN 4 THEN '保持内容不变，自然一点 ' WHEN 5 THEN 'Use a public broadcast voice, preserve words: '
    WHEN 6 THEN 'One odd " quote ' ELSE '' END, d.text) END AS instruction,
  CASE WHEN d.n_chars % 21 = 0 THEN NULL ELSE d.text END AS transcript,
  CASE WHEN d.n_chars % 10 = 0 THEN NULL ELSE d.lang END AS language, d.source AS source_dataset,
  CASE WHEN l.doc_id IS NULL THEN NULL
    WHEN l.toxic = 1 THEN '{{"operation": "add", "event": "sigh", "note": 1}}'
    WHEN l.quality = 1 THEN '{{"target_style": "intimate", "source_style": "dramatic", "event": null}}'
    ELSE '{{"direction": "faster", "prosody_type": "speed"}}' END AS anchor,
  CASE WHEN d.n_chars % 25 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) / 1600 END AS duration
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

SHORT_TEMPLATE_ROWS = """
SELECT event_id, event_type AS task, concat('Make "', CAST(user_id % 7 AS STRING), '" sound ',
  CASE user_id % 5 WHEN 0 THEN 'Angry' WHEN 1 THEN 'public-broadcast' WHEN 2 THEN 'louder' WHEN 3 THEN 'sadly'
  ELSE 'SAD' END, CASE user_id % 3 WHEN 0 THEN ' now' WHEN 1 THEN '，很happy的' ELSE '' END) AS instruction
FROM {events}
"""


# three in four of the audio files are there
LISTED = """
SELECT DISTINCT concat('data/', source, '/', CAST(n_chars % 100 AS STRING), '.wav') AS path FROM {documents}
WHERE n_chars % 100 % 4 <> 3
"""


def _rows(spark, sf):
    return spark_table(spark, sf, AUDIT_ROWS)


def _rows_with_audio(spark, sf):
    return audit.with_audio_found(_rows(spark, sf), spark_table(spark, sf, LISTED))


def audit_totals(spark, sf):
    found = audit.totals(_rows_with_audio(spark, sf))
    return found.withColumn("task", F.when(F.col("total"), "(all)").otherwise(F.coalesce("task", F.lit("(none)")))).drop("total")


def audit_document(spark, sf):
    """The totals written as a document and read back."""
    found, folder = audit_totals(spark, sf), scratch_folder(spark, "audit")
    write_document(found, folder)
    return spark.read.schema(found.schema).json(folder)


def audit_duplicates(spark, sf):
    rows = _rows(spark, sf)
    found = audit.duplicate_values(rows, "task", "sample_id", "duplicate_sample_id_count")
    found = audit.beside(found, audit.duplicate_values(rows, "task", "audio_path", "duplicate_audio_path_count"), "task")
    return audit.beside(found, audit.distinct_texts(rows, "task", "instruction", "instruction_unique_count"), "task")


def audit_histograms(spark, sf):
    rows = _rows(spark, sf)
    return audit.histogram(rows, "task", "language").withColumn("field", F.lit("language")).unionByName(
        audit.histogram(rows, "task", "source_dataset").withColumn("field", F.lit("source_dataset")))


def audit_templates(spark, sf):
    return audit.top_templates(spark_table(spark, sf, SHORT_TEMPLATE_ROWS), "task", "instruction", "event_id")


def audit_templates_text(spark, sf):
    """Template form of every instruction, whole texts."""
    return _rows(spark, sf).select(
        "doc_id", F.md5(tx.template_of(F.col("instruction"))).alias("template_md5"))


def nearest_rank(spark, sf):
    """p05, median and p95 of prices per flag: groups large enough to be bracketed."""
    ranked = exact_ranks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {
        "p05": nearest_rank_pick(0.05), "p95": nearest_rank_pick(0.95), **MEDIAN_PICKS})
    return ranked.select("l_returnflag", "n", "p05", "p95",
                         F.round((F.col("median_low") + F.col("median_high")) / 2, 4).alias("median"))


def price_distribution(spark, sf):
    return distribution(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", (1000.0, 50000.0))


# --- readiness -----------------------------------------------------------------------------------------------

# pages as JSON sample lines that name assets at several depths; keys and other suffixes must not count
LINES = """
SELECT page_id, split_part(url, '/', 3) AS task_id,
  concat('{{"audio_path": "data/', CAST(page_id % 60 AS STRING), '.wav", "anchor": {{"reference_wav": "data/ref/',
    CAST(length(html) % 9 AS STRING), '.FLAC", "data/key.wav" : "x"}}, "note": "data/notes.txt", "said": "a ', chr(92),
    '"data/said.wav', chr(92), '" b", "more": ["data/m/', CAST(page_id % 4 AS STRING), '.mp3", "other/data/x.wav"], ',
    '"components": [{{"anchor": {{"target_reference_path": "data/c/', CAST(page_id % 17 AS STRING), '.m4a"}}}}]}}')
    AS line
FROM {pages}
"""

PRESENT = """
SELECT DISTINCT concat(CASE WHEN page_id % 60 < 45 THEN 'data/' ELSE 'elsewhere/' END, CAST(page_id % 60 AS STRING), '.wav')
  AS path FROM {pages}
UNION SELECT DISTINCT concat('data/ref/', CAST(length(html) % 9 AS STRING), '.FLAC') FROM {pages}
"""
MANIFEST = """
SELECT split_part(url, '/', 3) AS task_id, count(*) + (CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 0 END) AS samples,
  count(DISTINCT page_id % 60) + count(DISTINCT length(html) % 9) + count(DISTINCT page_id % 4)
    + count(DISTINCT page_id % 17) - (CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END) AS audio_files
FROM {pages} GROUP BY split_part(url, '/', 3)
"""
LOCAL = "SELECT split_part(url, '/', 3) AS task_id, count(*) * 5 AS n FROM {pages} GROUP BY split_part(url, '/', 3)"


def declared_paths(spark, sf):
    return declared_assets(spark_table(spark, sf, LINES), "task_id")


def manifest_reconcile(spark, sf):
    lines = spark_table(spark, sf, LINES)
    counts = lines.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return readiness.reconcile(
        spark_table(spark, sf, MANIFEST), counts, declared_assets(lines, "task_id"),
        spark_table(spark, sf, PRESENT), spark_table(spark, sf, LOCAL))


def declared_missing(spark, sf):
    return readiness.missing_paths(declared_paths(spark, sf), spark_table(spark, sf, PRESENT))


def first_missing(spark, sf):
    return readiness.first_missing_paths(declared_missing(spark, sf), "task_id", 3)


def asset_allow_list(spark, sf):
    files = spark_table(spark, sf, "SELECT DISTINCT concat('data/', split_part(url, '/', 3), '/samples.jsonl') AS path FROM {pages}")
    return allow_patterns(files, declared_paths(spark, sf))


# documents as sample files (one line of text per sample), line items as audio files of the same tasks
SAMPLE_FILES = "SELECT concat('/root/data/t', CAST(doc_id AS STRING), '/samples.jsonl') AS path, text FROM {documents}"
ASSET_FILES = """
SELECT concat('/root/data/t', CAST(l_suppkey AS STRING), CASE l_returnflag WHEN 'R' THEN '/audio/' WHEN 'A' THEN '/audio/sub/'
  ELSE '/docs/' END, CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), CASE l_linestatus WHEN 'O' THEN '.wav'
  ELSE '.m4a' END) AS path, l_partkey AS length FROM {lineitem}
"""


def asset_sha(spark, sf):
    files = spark_table(spark, sf, SAMPLE_FILES)
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("line"))
    return manifest_rows(files.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), lines,
                         spark_table(spark, sf, ASSET_FILES))


# documents as samples of six tasks; the anchor and component fields are derived from the length
REQUIREMENT_ROWS = """
SELECT doc_id, CASE CAST(substring(source, 4) AS INT) % 8 WHEN 0 THEN 'acoustic_editing' WHEN 1 THEN 'content_editing'
    WHEN 2 THEN 'compositional_editing' WHEN 3 THEN 'emotion_editing' WHEN 4 THEN 'speaker_editing'
    ELSE 'prosody_editing' END AS task,
  CASE WHEN source IN ('src1', 'src9') THEN '' WHEN lang = 'es' AND source <> 'src17' THEN 'zh' ELSE lang END AS language,
  CASE n_chars % 3 WHEN 0 THEN 'enhancement' ELSE 'env_transfer' END AS subtask,
  CASE n_chars % 4 WHEN 0 THEN 'noise' ELSE 'reverb' END AS env_type,
  CASE n_chars % 5 WHEN 0 THEN 'crowd' ELSE 'small_room' END AS env_subtype,
  CASE n_chars % 2 WHEN 0 THEN 'stress' ELSE 'speed' END AS prosody_type,
  CASE n_chars % 6 WHEN 0 THEN 'speaker' WHEN 1 THEN 'emotion_editing' WHEN 2 THEN 'prosody' WHEN 3 THEN 'acoustic'
    ELSE 'content' END AS kind,
  CASE WHEN n_chars % 7 = 0 THEN 'ja' END AS source_language
FROM {documents}
"""
AVAILABLE = """
SELECT CASE s_suppkey WHEN 0 THEN 'asr_en_whisper' WHEN 1 THEN 'asr_zh_paraformer' WHEN 2 THEN 'speaker_wavlm'
    WHEN 3 THEN 'dnsmos' WHEN 4 THEN 'panns' ELSE concat('spare', CAST(s_suppkey AS STRING)) END AS scorer_group,
  s_suppkey IN (0, 2) AS ok, s_suppkey = 3 AS auto_provision
FROM {supplier}
"""


def _requirement_samples(spark, sf):
    rows = spark_table(spark, sf, REQUIREMENT_ROWS)
    anchor = F.struct("subtask", "env_type", "env_subtype", "prosody_type")
    kind = F.col("kind")
    by_type = F.struct(
        F.when(~kind.endswith("_editing"), kind).alias("component_type"),
        F.when(kind.endswith("_editing"), kind).alias("edit_type"),
        anchor.alias("anchor"), F.col("source_language"))
    composed = F.col("task") == "compositional_editing"
    return rows.select("task", "language", anchor.alias("anchor"), F.when(composed, F.array(by_type)).alias("components"))


def required_groups(spark, sf):
    samples = _requirement_samples(spark, sf)
    return readiness.with_default_groups(readiness.required_groups(samples), samples)


def task_languages(spark, sf):
    languages = readiness.sample_languages(_requirement_samples(spark, sf))
    odd = readiness.unexpected_languages(languages).withColumn("unexpected", F.lit(True))
    return languages.join(odd, ["task", "language"], "left").select(
        "task", "language", F.coalesce("unexpected", F.lit(False)).alias("unexpected"))


def task_readiness(spark, sf):
    ready = readiness.task_readiness(required_groups(spark, sf), spark_table(spark, sf, AVAILABLE))
    return ready.select("task", "ready", *[
        F.array_join(c, ",").alias(c) for c in ("required_groups", "missing_groups", "unknown_groups")])


# --- checks ---------------------------------------------------------------------------------------------------

_WITH = f"WITH a AS ({duck(AUDIT_ROWS)})"


def _pattern_sql(pattern: str) -> str:
    # RE2 word boundaries are ASCII: give accented letters an ASCII stand-in first
    folded = "regexp_replace(coalesce(instruction, ''), '[À-ÖØ-öø-ÿœŒß]', 'x', 'g')"
    return f"count(*) FILTER (WHERE regexp_matches({folded}, '(?i){pattern}'))"


def _quotes_sql(text: str) -> str:
    def n(mark: str) -> str:
        return f"(length({text}) - length(replace({text}, '{mark}', '')))"

    curly = " OR ".join(f"{n(a)} <> {n(b)}" for a, b in (("“", "”"), ("‘", "’")))
    return f"""({n('"')} % 2 = 1 OR {curly})"""


def _rank_sql(source: str, group: str, value: str) -> str:
    return f"""r AS (SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS i,
    count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL),
rk AS (SELECT g, any_value(n) AS n, min(v) AS lo, max(v) AS hi, median(v) AS med,
    max(v) FILTER (WHERE i = round_even((n - 1) * 0.05::DOUBLE, 0)) AS p05,
    max(v) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY g)"""


_COUNTERS = f"""count(*) AS samples,
  count(*) FILTER (WHERE trim(coalesce(instruction, '')) = '') AS empty_instruction_count,
  count(*) FILTER (WHERE trim(coalesce(transcript, '')) = '') AS empty_transcript_count,
  count(*) FILTER (WHERE anchor IS NULL) AS missing_anchor_count,
  count(*) FILTER (WHERE {_quotes_sql("instruction")}) AS instruction_unbalanced_quote_count,
  count(*) FILTER (WHERE {_quotes_sql("transcript")}) AS transcript_unbalanced_quote_count,
  {", ".join(f"{_pattern_sql(p)} AS {name}" for name, p in fv.AUDIT_PATTERNS.items())}"""


def _dup_sql(column: str, name: str) -> str:
    return (f"(SELECT task, count(*) FILTER (WHERE n > 1) AS {name} FROM "
            f"(SELECT task, {column}, count(*) AS n FROM a GROUP BY ALL) GROUP BY 1)")


_DUPS = f"""SELECT x.task, x.duplicate_sample_id_count, y.duplicate_audio_path_count, z.instruction_unique_count
FROM (SELECT * FROM {_dup_sql('sample_id', 'duplicate_sample_id_count')}) x
JOIN (SELECT * FROM {_dup_sql('audio_path', 'duplicate_audio_path_count')}) y ON y.task IS NOT DISTINCT FROM x.task
JOIN (SELECT task, count(DISTINCT coalesce(instruction, '')) AS instruction_unique_count FROM a GROUP BY 1) z
    ON z.task IS NOT DISTINCT FROM x.task"""

_DECLARED = f"""l AS ({duck(LINES)}),
declared AS (SELECT DISTINCT task_id, unnest(regexp_extract_all(line,
    '[^\\\\]"(data/[^"]*\\.(?i:wav|flac|mp3|ogg|m4a|aac))"[^ :]', 1)) AS path FROM l)"""

_REQUIRED = f"""q AS ({duck(REQUIREMENT_ROWS)}),
langs AS (SELECT task, language FROM q WHERE language <> ''
    UNION SELECT task, source_language FROM q WHERE task = 'compositional_editing' AND source_language IS NOT NULL),
all_langs AS (SELECT * FROM langs UNION ALL
    SELECT DISTINCT task, 'en' FROM q WHERE task NOT IN (SELECT task FROM langs)),
k AS (SELECT *, CASE WHEN task = 'compositional_editing' THEN replace(kind, '_editing', '')
    ELSE replace(task, '_editing', '') END AS t,
    task IN (SELECT task FROM all_langs WHERE language = 'zh') AS zh FROM q),
need AS (
    SELECT task, CASE WHEN language = 'zh' THEN 'asr_zh_paraformer' ELSE 'asr_en_whisper' END AS scorer_group FROM all_langs
    UNION SELECT task, 'gemini' FROM k WHERE t IN ('emotion', 'style', 'paralinguistic')
    UNION SELECT task, 'speaker_wavlm' FROM k WHERE t = 'speaker'
    UNION SELECT task, 'asr_zh_timestamp' FROM k WHERE t = 'prosody' AND prosody_type = 'stress' AND zh
    UNION SELECT task, 'dnsmos' FROM k WHERE t = 'acoustic' AND subtask = 'enhancement'
    UNION SELECT task, 'panns' FROM k WHERE t = 'acoustic' AND subtask = 'env_transfer'
        AND (env_type = 'noise' OR env_subtype IN ('outdoor', 'crowd', 'music'))
    UNION SELECT task, scorer_group FROM (VALUES
        {", ".join(f"('{t}', '{g}')" for t, gs in fv.TASK_DEFAULT_GROUPS.items() for g in gs)}) AS d(task, scorer_group)
        WHERE task NOT IN (SELECT task FROM q))"""

_SHORT = ", ".join(
    f"count(*) FILTER (WHERE duration < {x}::DOUBLE) AS lt_{str(x).replace('.', '_')}s" for x in fv.SHORT_CLIP_SECONDS)
_SHORT_NAMES = ", ".join(f"lt_{str(x).replace('.', '_')}s" for x in fv.SHORT_CLIP_SECONDS)
_SPREAD = f"""n, {dt.r4('lo')} AS min, {dt.r4('p05')} AS p05, {dt.r4('med')} AS median, {dt.r4('p95')} AS p95,
    {dt.r4('hi')} AS max"""

QUERIES = {
    "audit_counters": lambda s, d: audit.task_counters(_rows(s, d)),
    "audit_totals": audit_totals,
    "audit_document": audit_document,
    "audit_duplicates": audit_duplicates,
    "audit_histograms": audit_histograms,
    "audit_key_sets": lambda s, d: audit.anchor_key_sets(_rows(s, d), "task", "anchor"),
    "audit_labels": lambda s, d: audit.label_histograms(_rows(s, d), "task", "anchor"),
    "audit_templates": audit_templates,
    "audit_templates_text": audit_templates_text,
    "audit_lengths": lambda s, d: audit.instruction_lengths(_rows(s, d), "task", "instruction"),
    "audit_durations": lambda s, d: audit.duration_summary(_rows(s, d), "task", "duration"),
    "task_audit": lambda s, d: audit.task_audit(_rows_with_audio(s, d)),
    "nearest_rank": nearest_rank,
    "price_distribution": price_distribution,
    "declared_paths": declared_paths,
    "manifest_reconcile": manifest_reconcile,
    "declared_missing": declared_missing,
    "first_missing": first_missing,
    "asset_allow_list": asset_allow_list,
    "asset_sha": asset_sha,
    "task_languages": task_languages,
    "required_groups": required_groups,
    "task_readiness": task_readiness,
}

ORACLES = {
    "audit_counters": f"{_WITH} SELECT task, {_COUNTERS} FROM a GROUP BY 1",
    "audit_totals": f"""{_WITH}, f AS ({duck(LISTED)}),
    b AS (SELECT coalesce(task, '(none)') AS task, sample_id, instruction, duration, audio_path NOT IN (SELECT path FROM f) AS lost
        FROM a),
    d AS (SELECT task, count(*) AS n FROM b GROUP BY task, sample_id HAVING count(*) > 1),
    t AS (SELECT coalesce(task, '(all)') AS task, count(DISTINCT task) AS tasks, count(*) AS samples,
    count(*) FILTER (WHERE trim(coalesce(instruction, '')) = '') AS empty_instruction_count,
    count(*) FILTER (WHERE duration IS NULL) AS missing_duration_count,
    count(*) FILTER (WHERE lost) AS missing_audio_count FROM b GROUP BY ROLLUP (task))
    SELECT t.*, (SELECT count(*) FROM d WHERE d.task = t.task OR t.task = '(all)') AS duplicate_sample_id_count FROM t""",
    "audit_duplicates": f"{_WITH} {_DUPS}",
    "audit_histograms": f"""{_WITH} SELECT task, coalesce(language, 'None') AS value, count(*) AS count, 'language' AS field
    FROM a GROUP BY ALL UNION ALL
    SELECT task, source_dataset, count(*), 'source_dataset' FROM a GROUP BY ALL""",
    "audit_key_sets": f"""{_WITH} SELECT task, coalesce(array_to_string(list_sort(json_keys(anchor)), '|'), '') AS key_set,
    count(*) AS count FROM a GROUP BY ALL""",
    "audit_labels": f"""{_WITH}, c AS (SELECT task, k AS label_key, json_extract_string(anchor, '$.' || k) AS value,
        coalesce(list_contains(json_keys(anchor), k), FALSE) AS has
    FROM a CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in fv.AUDIT_LABEL_KEYS)}) AS v(k)),
    u AS (SELECT DISTINCT task, label_key FROM c WHERE has)
    SELECT c.task, c.label_key, coalesce(value, 'None') AS value, count(*) AS count
    FROM c JOIN u ON u.task IS NOT DISTINCT FROM c.task AND u.label_key = c.label_key GROUP BY ALL""",
    "audit_lengths": f"""{_WITH}, b AS (SELECT task, length(coalesce(instruction, ''))::DOUBLE AS len FROM a)
    SELECT task, min(len) AS min, median(len) AS median, max(len) AS max FROM b GROUP BY 1""",
    "audit_durations": f"""{_WITH}, {_rank_sql('a', 'task', 'duration')},
    s AS (SELECT task, {_SHORT} FROM a WHERE duration IS NOT NULL GROUP BY 1)
    SELECT task, {_SPREAD}, {_SHORT_NAMES} FROM rk JOIN s ON s.task IS NOT DISTINCT FROM rk.g""",
    "task_audit": f"""{_WITH}, {_rank_sql('a', 'task', 'duration')},
    s AS (SELECT task, {_SHORT} FROM a WHERE duration IS NOT NULL GROUP BY 1),
    t AS (SELECT task, {_SPREAD}, {_SHORT_NAMES} FROM rk JOIN s ON s.task IS NOT DISTINCT FROM rk.g),
    f AS ({duck(LISTED)}),
    c AS (SELECT task, {_COUNTERS}, count(*) FILTER (WHERE audio_path NOT IN (SELECT path FROM f)) AS missing_audio_count, min(length(coalesce(instruction, '')))::DOUBLE AS instruction_length_min,
        median(length(coalesce(instruction, '')))::DOUBLE AS instruction_length_median,
        max(length(coalesce(instruction, '')))::DOUBLE AS instruction_length_max FROM a GROUP BY 1),
    u AS ({_DUPS})
    SELECT c.*, u.* EXCLUDE (task), t.n AS durations, t.* EXCLUDE (task, n)
    FROM c JOIN u ON u.task IS NOT DISTINCT FROM c.task LEFT JOIN t ON t.task IS NOT DISTINCT FROM c.task""",
    "nearest_rank": f"""WITH {_rank_sql('lineitem', 'l_returnflag', 'l_extendedprice')}
    SELECT g AS l_returnflag, n, p05, p95, {dt.r4('med')} AS median FROM rk""",
    "price_distribution": f"""WITH {_rank_sql('orders', 'o_orderstatus', 'o_totalprice')},
    s AS (SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 1000) AS lt_1000_0s,
        count(*) FILTER (WHERE o_totalprice < 50000) AS lt_50000_0s FROM orders GROUP BY 1)
    SELECT o_orderstatus, {_SPREAD}, lt_1000_0s, lt_50000_0s FROM rk JOIN s ON s.o_orderstatus = rk.g""",
    "declared_paths": f"WITH {_DECLARED} SELECT * FROM declared",
    "manifest_reconcile": f"""WITH {_DECLARED}, m AS ({duck(MANIFEST)}), p AS ({duck(PRESENT)}), f AS ({duck(LOCAL)}),
    d AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE path IN (SELECT path FROM p)) AS here FROM declared GROUP BY 1),
    c AS (SELECT task_id, count(*) AS n FROM l GROUP BY 1)
    SELECT task_id, c.n AS samples, m.samples AS expected_samples, c.n = m.samples AS samples_ok,
        d.n AS declared_audio_files, d.here AS audio_files, m.audio_files AS expected_audio_files,
        d.n = m.audio_files AS audio_manifest_ok, d.n = m.audio_files AND d.n = d.here AS audio_complete,
        d.n - d.here AS missing_audio_count, greatest(0, f.n - d.here)::BIGINT AS extra_audio_files
    FROM m JOIN c USING (task_id) JOIN d USING (task_id) JOIN f USING (task_id)""",
    "declared_missing": f"""WITH {_DECLARED} SELECT path, task_id FROM declared
    WHERE path NOT IN (SELECT path FROM ({duck(PRESENT)}))""",
    "first_missing": f"""WITH {_DECLARED} SELECT * FROM (SELECT path, task_id,
        row_number() OVER (PARTITION BY task_id ORDER BY path)::INT AS position FROM declared
        WHERE path NOT IN (SELECT path FROM ({duck(PRESENT)}))) WHERE position <= 3""",
    "asset_allow_list": f"""WITH {_DECLARED} SELECT path AS pattern FROM declared
    UNION SELECT 'data/' || split_part(url, '/', 3) || '/samples.jsonl' FROM pages""",
    "asset_sha": f"""WITH f AS (SELECT 't' || doc_id::VARCHAR AS task_id, sha256(text) AS samples_sha256,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS samples FROM documents),
    x AS (SELECT regexp_extract(path, '/data/([^/]+)/audio/', 1) AS task_id, count(*) AS n, sum(length)::BIGINT AS b
        FROM ({duck(ASSET_FILES)}) WHERE path LIKE '%/audio/%.wav' GROUP BY 1)
    SELECT task_id, samples::BIGINT AS samples, samples_sha256, coalesce(n, 0) AS audio_files, coalesce(b, 0) AS audio_bytes
    FROM f LEFT JOIN x USING (task_id)""",
    "task_languages": f"""WITH {_REQUIRED} SELECT task, language, language NOT IN ('en', 'zh') AS unexpected
    FROM all_langs""",
    "required_groups": f"WITH {_REQUIRED} SELECT task, scorer_group FROM need",
    "task_readiness": f"""WITH {_REQUIRED}, v AS ({duck(AVAILABLE)}),
    j AS (SELECT n.task, n.scorer_group AS g, coalesce(v.ok OR v.auto_provision, FALSE) AS ok, v.scorer_group IS NULL AS lost
        FROM need n LEFT JOIN v ON v.scorer_group = n.scorer_group)
    SELECT task, bool_and(ok) AS ready, coalesce(string_agg(g, ',' ORDER BY g), '') AS required_groups,
        coalesce(string_agg(g, ',' ORDER BY g) FILTER (WHERE NOT ok), '') AS missing_groups,
        coalesce(string_agg(g, ',' ORDER BY g) FILTER (WHERE lost), '') AS unknown_groups FROM j GROUP BY 1""",
}

def _templates_sql(text: str) -> str:
    """Quoted spans and label words replaced. RE2's boundary is ASCII, so neighbours are spelled out; two passes handle
    labels that share a separator."""
    quoted = f"""regexp_replace({text}, '"[^"]+"', '{fv.TEMPLATE_QUOTE_MARK}', 'g')"""
    labels = fv.TEMPLATE_LABEL_WORDS.replace(r"\b", "")
    edge = "[^a-zA-Z0-9_À-ÖØ-öø-ÿœŒß一-鿿]"
    pattern = f"(?i)(^|{edge}){labels}($|{edge})"
    once = f"regexp_replace({quoted}, '{pattern}', '\\1{fv.TEMPLATE_LABEL_MARK}\\3', 'g')"
    return f"regexp_replace({once}, '{pattern}', '\\1{fv.TEMPLATE_LABEL_MARK}\\3', 'g')"


ORACLES["audit_templates"] = f"""WITH t AS (SELECT task, {_templates_sql('instruction')} AS template, count(*) AS count,
    min(event_id) AS f FROM ({duck(SHORT_TEMPLATE_ROWS)}) GROUP BY ALL)
SELECT task, rank, template, count FROM (SELECT *,
    row_number() OVER (PARTITION BY task ORDER BY count DESC, f)::INT AS rank FROM t) WHERE rank <= 8"""
ORACLES["audit_templates_text"] = f"""{_WITH} SELECT doc_id, md5({_templates_sql('instruction')}) AS template_md5 FROM a"""
ORACLES["audit_document"] = ORACLES["audit_totals"]
